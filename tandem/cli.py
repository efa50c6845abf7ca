"""Command line over a repository: query, explain, audit, diff, eval."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config, render
from .config import Options, UsageError, parse_excludes, seed_budget
from .operators import changedset, evaluate, explain, history, renames, scorers
from .sources import gitlog

VERSION = "0.1.0"
BROAD_HINT = "Many of the first results are lock files, manifests, workflows or release documents; a lower --max-files-per-commit or --exclude helps."
STILL_BROAD_HINT = "Many of the first results are still broad-change files; look at --evidence 3 or lower --max-files-per-commit further."


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(os.environ.get("SPARK_MASTER", "local[*]"))
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tandem")
    top.add_argument("--version", action="version", version=VERSION)
    kinds = top.add_subparsers(dest="command", required=True)

    def command(name: str, top_rows: int | None = None, modes: bool = False):
        p = kinds.add_parser(name)
        p.add_argument("--repo", default=".")
        p.add_argument("--format", choices=("text", "json"), default="text")
        p.add_argument("--evidence", type=int, default=8 if name == "explain" else 0)
        p.add_argument("--max-commits", type=int, default=config.MAX_BASKETS)
        p.add_argument("--since", help="epoch seconds, a date, or a time such as '2 weeks ago'")
        p.add_argument("--max-files-per-commit", type=int, default=config.MAX_ITEMS)
        p.add_argument("--half-life-days", type=float, default=config.HALF_LIFE_DAYS)
        if name != "eval":
            p.add_argument("--accuracy", help=", ".join(config.ACCURACY))
            p.add_argument("--history-backend", help=", ".join(config.BACKENDS))
            p.add_argument("--jobs", type=int, default=os.cpu_count() or 1)
            p.add_argument("--scan-commits", type=int, default=0)
        if top_rows:
            p.add_argument("--top", type=int, default=top_rows)
            p.add_argument("--exclude")
        if modes:
            p.add_argument("--mode", default="direct", choices=config.MODES)
        return p

    command("query", config.TOP, True).add_argument("path")
    both = command("explain")
    both.add_argument("a")
    both.add_argument("b")
    audit = command("audit", config.AUDIT_TOP)
    audit.add_argument("--mode", default="direct", choices=("direct", "pagerank"))
    audit.add_argument("--min-confidence", default="medium")
    audit.add_argument("--fail-on-confidence")
    which = audit.add_mutually_exclusive_group()
    which.add_argument("--staged", action="store_true")
    which.add_argument("--range")
    command("diff", config.TOP, True).add_argument("--staged", action="store_true")
    ev = command("eval", config.AUDIT_TOP)
    ev.add_argument("--task", choices=("audit", "query"), default="audit")
    ev.add_argument("--shape", choices=("on-demand", "global"), default="on-demand")
    ev.add_argument("--modes")
    ev.add_argument("--min-confidence", default="medium")
    ev.add_argument("--test-commits", type=int, default=config.TEST_BASKETS)
    ev.add_argument("--train-commits", type=int, default=config.TRAIN_BASKETS)
    return top


def options_of(a: argparse.Namespace, repo: str) -> tuple[Options, list[str]]:
    """The options, and hints about what the repository did not allow."""
    backend, hints = gitlog.runtime_backend(repo, config.backend_of(getattr(a, "accuracy", None), getattr(a, "history_backend", None)))
    return Options(
        max_items=a.max_files_per_commit, max_baskets=a.max_commits, half_life_days=a.half_life_days, evidence=a.evidence, since=gitlog.since_time(repo, a.since),
        top=getattr(a, "top", config.TOP), mode=getattr(a, "mode", "direct"), exclude=parse_excludes(getattr(a, "exclude", None)),
        min_confidence=getattr(a, "min_confidence", "medium"), fail_on_confidence=getattr(a, "fail_on_confidence", None),
        backend=backend, scan_commits=getattr(a, "scan_commits", 0), jobs=getattr(a, "jobs", 1),
    ), hints


def rankings(baskets: DataFrame, seeds: DataFrame, o: Options, top: int | None) -> DataFrame:
    made = evaluate.rankers(baskets, o, "on-demand")[o.mode](seeds, top)
    for column, value in (("weight", F.col("score") if o.mode == "hot" else F.lit(0.0)), ("last_seen", F.lit(""))):
        if column not in made.columns:
            made = made.withColumn(column, value)
    return made


def evidenced(results: DataFrame, baskets: DataFrame, seeds: DataFrame, o: Options, merged: bool) -> DataFrame:
    """Results with their evidence: of the one seed's pairs, or merged over all seeds."""
    if not o.evidence or o.mode in ("hot", "path"):
        return results.withColumn("evidence", F.array().cast("array<string>"))
    found = scorers.on_demand_evidence(baskets, seeds, o).join(results.select("path"), "path", "left_semi")
    return changedset.with_evidence(results, changedset.merged_evidence(found.drop("nth"), o.evidence) if merged else found, "path")


def rows_of(df: DataFrame, n: int) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.orderBy("rank").limit(n).collect()]


def run(argv: list[str], out=sys.stdout) -> int:
    a = parser().parse_args(argv)
    repo = gitlog.root(a.repo)
    o, notes = options_of(a, repo)
    spark = session()
    emit = lambda value, text: print(render.as_json(value) if a.format == "json" else text, file=out)
    if a.command == "query":
        path = gitlog.resolved(spark, repo, a.repo, a.path)
        seeds = spark.createDataFrame([(path,)], "seed string")
        baskets = gitlog.seed_histories(spark, repo, [path], o)
        found = rankings(baskets, seeds, o, o.query_top)
        found = scorers.ranked(found.drop("rank").where(~_excluded(o)), o.top, "seed")
        rows = rows_of(evidenced(found, baskets, seeds, o, False), o.top)
        hints = notes + _hints(rows, o)
        mode = f"{o.mode}:on-demand"
        emit({"schema_version": 1, "target": path, "mode": mode, "related": rows, "hints": hints}, render.query_text(path, mode, rows, hints))
    elif a.command == "explain":
        first, second = (gitlog.resolved(spark, repo, a.repo, x) for x in (a.a, a.b))
        baskets = gitlog.seed_histories(spark, repo, [first], o)
        row = explain.explain(baskets, first, second, o).first().asDict()
        found = explain.evidence(baskets, first, second, o).orderBy("nth").drop("nth").collect() if o.evidence else []
        row |= {"evidence": [r.asDict() for r in found], "hints": notes}
        emit({"schema_version": 1, **row}, render.explain_text(row))
    elif a.command == "diff":
        changed = gitlog.diff_names(spark, repo, a.staged)
        names = [r["path"] for r in changed.orderBy("path").collect()]
        if not names:
            raise UsageError("no changed files found")
        seeds = changed.select(F.col("history_path").alias("seed"))
        baskets = gitlog.seed_histories(spark, repo, names, o)
        found = evidenced(changedset.diff(rankings(baskets, seeds, o, o.query_top), changed, o), baskets, seeds, o, True)
        rows = [r.asDict(recursive=True) for r in found.orderBy(F.desc(F.round("score", scorers.DIGITS)), "path").collect()]
        hints = notes + _hints(rows, o)
        emit({"schema_version": 1, "target": ",".join(names), "mode": o.mode, "related": rows, "hints": hints}, render.query_text(",".join(names), o.mode, rows, hints))
    elif a.command == "audit":
        return _audit(a, o, notes, spark, repo, emit)
    else:
        _eval(a, o, spark, repo, emit)
    return config.EXIT_OK


def _excluded(o: Options):
    from .functions import paths

    return paths.excluded(F.col("path"), o.exclude)


def _hints(rows: list[dict], o: Options) -> list[str]:
    from .functions.paths import BROAD_FOLDER, BROAD_NAMES

    first = [r["path"] for r in rows[:8]]
    broad = sum(p.rsplit("/", 1)[-1] in BROAD_NAMES or p.startswith(BROAD_FOLDER) for p in first)
    return [STILL_BROAD_HINT if o.exclude else BROAD_HINT] if broad >= 4 and broad * 2 >= len(first) else []


def _audit(a, o: Options, notes: list[str], spark: SparkSession, repo: str, emit) -> int:
    changed = gitlog.changed_set(spark, repo, a.staged, a.range)
    pairs = [(r["path"], r["history_path"]) for r in changed.orderBy("path").collect()]
    if not pairs:
        raise UsageError("no changed files found")
    seeds = changed.select(F.col("history_path").alias("seed")).distinct()
    baskets = gitlog.seed_histories(spark, repo, sorted({h for _, h in pairs}), o)
    found = rankings(baskets, seeds, o, seed_budget(o.top))
    found = changedset.eligible(changedset.attributed(found, changed), gitlog.universe(spark, repo, a.range), changed, o)
    total = changedset.aggregate(found)
    shown = changedset.top_candidates(total, o).withColumnRenamed("strongest", "strongest_pair_cochanges")
    rows = rows_of(evidenced(shown, baskets, seeds, o, True), o.top)
    omitted = changedset.filtered_count(total, o).first()["filtered"]
    enforced = None
    if o.fail_on_confidence:
        n = sum(config.BANDS.index(r["confidence"]) >= config.BANDS.index(o.fail_on_confidence) for r in rows)
        enforced = {"threshold": o.fail_on_confidence, "finding_count": n, "triggered": n > 0, "exit_code": config.EXIT_FINDINGS if n else config.EXIT_OK}
    hints = notes + _hints(rows, o) + ([f"Omitted {omitted} candidates below {o.min_confidence} confidence."] if omitted else [])
    names = [p for p, _ in pairs]
    value = {
        "schema_version": 2, "scope": a.range or ("staged" if a.staged else "worktree"), "seeds": names, "mode": o.mode, "minimum_confidence": o.min_confidence,
        "thresholds": {"medium": config.MEDIUM_FROM, "high": config.HIGH_FROM}, "candidates": rows, "abstained": not rows, "enforcement": enforced,
        "history_coverage": {**history.coverage(o.backend, o.scan_commits > 0, any(p != h for p, h in pairs)), "max_target_commits": o.max_baskets, "scan_commits": o.scan_commits}, "hints": hints,
    }
    emit(value, render.audit_text(value))
    return config.EXIT_FINDINGS if enforced and enforced["triggered"] else config.EXIT_OK


def _eval(a, o: Options, spark: SparkSession, repo: str, emit) -> None:
    n = a.test_commits + a.train_commits
    baskets = gitlog.history(spark, repo, max_count=str(n), renames="true" if a.task == "audit" else "false")
    test, train = history.split(baskets, a.test_commits, a.train_commits)
    o = o.but(max_baskets=0, since=None)
    modes = tuple(dict.fromkeys((a.modes or ("direct,pagerank" if a.task == "audit" else ",".join(config.MODES))).split(",")))
    for mode in modes:
        o.but(mode=mode)
    if a.task == "query":
        counters = evaluate.query_counters(test, train, o).first().asDict()
        metrics = [r.asDict() for r in evaluate.query_metrics(test.drop("renames"), train.drop("renames"), o, modes, a.shape, o.top).orderBy("mode").collect()]
        emit({"schema_version": 1, **counters, "metrics": metrics}, render.table_text(metrics))
        return
    records = lambda df: df.select("ord", F.posexplode("renames").alias("pos", "r")).select("ord", "pos", "r.old_path", "r.new_path")
    ends = renames.closure(renames.alias_map(records(train)))
    train, test = renames.canonical(train.drop("renames"), ends), renames.canonical_tests(test.drop("renames"), records(test), ends)
    counters = evaluate.audit_counters(test, train, o).first().asDict()
    metrics, bands = [], []
    for mode in sorted(modes):
        tasks, shown = evaluate.audit_candidates(test, train, o, mode)
        metrics += [evaluate.audit_metrics(tasks, shown, o, mode).first().asDict()]
        bands += [r.asDict() for r in evaluate.band_metrics(tasks, shown, mode).collect()]
    bands.sort(key=lambda r: (r["mode"], config.BANDS.index(r["confidence"])))
    emit({"schema_version": 2, **counters, "metrics": metrics, "confidence_metrics": bands}, render.table_text(metrics) + "\n\n" + render.table_text(bands))


def main() -> None:
    try:
        sys.exit(run(sys.argv[1:]))
    except (UsageError, gitlog.LogError, ValueError) as error:
        print(f"error: {error}", file=sys.stderr)
        sys.exit(config.EXIT_ERROR)


if __name__ == "__main__":
    main()
