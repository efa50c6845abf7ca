"""The registered queries of the engine's own operators, over order histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Options, seed_budget
from ..functions import paths, scoring
from ..operators import changedset, evaluate, explain, graph, history, renames, scorers
from . import datasets
from .datasets import dense, sparse, table

DENSE = Options(max_items=6, evidence=3, top=5, max_baskets=0)
SINCE = 883612800  # 1998-01-01
EXCLUDE = ("*.lock", "economy/*", "red-*")
TEST, TRAIN = 200, 3000


def six(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def basket_size_filter(spark, d):
    return history.in_size(dense(spark, d), DENSE.max_items).select("ord", "hash", F.size("files").cast("long").alias("n_files"))


def item_stats(spark, d):
    return graph.item_stats(dense(spark, d), DENSE).select("path", "changes", *six("weighted_changes"), "last_seen")


def pair_stats(spark, d):
    return graph.pair_stats(dense(spark, d), DENSE).select("a", "b", "cochanges", *six("weight"), "last_seen")


def pair_stats_sparse(spark, d):
    return graph.pair_stats(sparse(spark, d), DENSE).select("a", "b", "cochanges", *six("weight"), "last_seen")


def pair_evidence_first3(spark, d):
    return graph.pair_evidence(dense(spark, d), DENSE).select("a", "b", F.col("nth").cast("long").alias("nth"), "hash", "date", "file_count", *six("weight"))


def direct_global_all(spark, d):
    b = dense(spark, d)
    return graph.scored_pairs(graph.pair_stats(b, DENSE), graph.item_stats(b, DENSE)).select("a", "b", "cochanges", *six("weight", "score"), "last_seen")


def _ranked(df: DataFrame, *more: str) -> DataFrame:
    return df.select("seed", "path", F.col("rank").cast("long").alias("rank"), *six("score"), *more)


def direct_global_topk(spark, d):
    return _ranked(scorers.direct_global(dense(spark, d), DENSE, 5), "cochanges", "last_seen")


def direct_on_demand_topk(spark, d):
    return _ranked(scorers.direct_on_demand(dense(spark, d), None, DENSE, 5), "cochanges", "last_seen")


def direct_on_demand_sparse(spark, d):
    return _ranked(scorers.direct_on_demand(sparse(spark, d), None, DENSE, 3), "cochanges")


def direct_on_demand_since(spark, d):
    return _ranked(scorers.direct_on_demand(dense(spark, d), None, DENSE.but(since=SINCE), 5), "cochanges")


def direct_max_commits(spark, d):
    return _ranked(scorers.direct_on_demand(dense(spark, d), None, DENSE.but(max_baskets=50), 5), "cochanges")


def on_demand_evidence(spark, d):
    return scorers.on_demand_evidence(dense(spark, d), None, DENSE.but(evidence=2)).select("seed", "path", F.col("nth").cast("long").alias("nth"), "hash", "file_count", *six("weight"))


def hot_topk(spark, d):
    return scorers.hot(graph.item_stats(dense(spark, d), DENSE), 20).select("path", *six("score"), "last_seen")


def hot_on_demand(spark, d):
    return _ranked(scorers.hot_on_demand(dense(spark, d), None, DENSE, 5), "last_seen")


def _part_paths(spark, d):
    return datasets.part_paths(spark, d).select("path")


def _some_parts(spark, d):
    """The parts of the newest basket that has any."""
    return _newest(sparse(spark, d))


def _newest(baskets: DataFrame) -> DataFrame:
    newest = baskets.where(F.size("files") >= 3).agg(F.min("ord").alias("ord"))
    return baskets.join(F.broadcast(newest), "ord", "left_semi").select(F.explode("files").alias("path"))


def path_similarity_topk(spark, d):
    return _ranked(scorers.path_similarity(_some_parts(spark, d), _part_paths(spark, d), 20))


def path_similarity_urls(spark, d):
    urls = table(spark, d, "pages").select(F.col("url").alias("path"))
    return _ranked(scorers.path_similarity(urls, urls, 3))


def weighted_degree(spark, d):
    return graph.degree(graph.adjacency(graph.pair_stats(dense(spark, d), DENSE))).select(F.col("u").alias("path"), *six("degree"))


def adjacency(spark, d):
    return graph.adjacency(graph.pair_stats(dense(spark, d), DENSE)).select("u", "v", *six("weight"))


def _seeds(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "seed string")


def pagerank_global(spark, d):
    adj = graph.adjacency(graph.pair_stats(dense(spark, d), DENSE))
    return scorers.pagerank(adj, _seeds(spark, "supp/1", "supp/7")).select("seed", "path", *six("score"))


def pagerank_on_demand(spark, d):
    return _ranked(scorers.pagerank_on_demand(dense(spark, d), _seeds(spark, "supp/1", "supp/7"), DENSE, 20), "cochanges", "reason")


def pagerank_with_direct_evidence(spark, d):
    b = sparse(spark, d)
    seeds = _newest(b).select(F.col("path").alias("seed"))
    return _ranked(scorers.pagerank_global(b, seeds, DENSE, 50), "cochanges", "reason")


def exclude_glob(spark, d):
    return _part_paths(spark, d).where(paths.excluded(F.col("path"), EXCLUDE))


def exclude_then_topk(spark, d):
    b = sparse(spark, d)
    rows = scorers.direct_on_demand(b, _newest(b).select(F.col("path").alias("seed")), DENSE).where(~paths.excluded(F.col("path"), EXCLUDE))
    return _ranked(scorers.ranked(rows.drop("rank"), 5, "seed"), "cochanges")


def broad_change_hint(spark, d):
    named = table(spark, d, "part").select(
        F.concat(F.lower("p_type"), F.lit("/"), F.when(F.col("p_partkey") % 3 == 0, "package.json").when(F.col("p_partkey") % 3 == 1, "Cargo.lock").otherwise(F.col("p_name"))).alias("path"),
        F.col("p_brand").alias("seed"), F.col("p_retailprice").alias("score"),
    ).groupBy("seed", "path").agg(F.sum("score").alias("score"))
    return changedset.broad_hint(scorers.ranked(named, 8, "seed"), "seed")


def explain_pair(spark, d):
    return explain.explain(dense(spark, d), "supp/7", "supp/1", DENSE).select("a", "b", "related", "cochanges", *six("weight"), "last_seen")


def explain_unrelated(spark, d):
    return explain.explain(dense(spark, d), "supp/7", "supp/none", DENSE).select("a", "b", "related", "cochanges", *six("weight"), "last_seen")


def resolve_path_suffix(spark, d):
    asked = table(spark, d, "part").select(F.regexp_replace(datasets.part_path(), "^[^/]*/", "").alias("asked"))
    return explain.resolve(_part_paths(spark, d), asked)


def resolve_path_ambiguous(spark, d):
    renamed = table(spark, d, "part").select(F.concat(F.lower("p_type"), F.lit("/"), F.lower("p_brand"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("path"))
    asked = table(spark, d, "part").select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("asked")).unionByName(spark.createDataFrame([("no-such-name",)], "asked string"))
    return explain.resolve(renamed, asked)


def _changed(baskets: DataFrame) -> DataFrame:
    return _newest(baskets).select("path", F.col("path").alias("history_path"))


def _universe(baskets: DataFrame) -> DataFrame:
    """Known names but those whose number is divisible by 17."""
    return explain.known_names(baskets).where(F.regexp_extract("path", r"([0-9]+)[^0-9]*$", 1).cast("long") % 17 != 0)


def _rankings(b: DataFrame, mode: str = "direct") -> DataFrame:
    seeds = _newest(b).select(F.col("path").alias("seed"))
    make = {"direct": scorers.direct_on_demand, "pagerank": scorers.pagerank_on_demand}[mode]
    return make(b, seeds, DENSE, seed_budget(DENSE.top))


def _candidates(b: DataFrame, mode: str = "direct") -> DataFrame:
    changed = _changed(b)
    return changedset.aggregate(changedset.eligible(_rankings(b, mode), _universe(b), changed, DENSE))


def _shown(df: DataFrame) -> DataFrame:
    return df.select(
        "path", "confidence", "support_count", F.array_join("supported_by", ",").alias("supported_by"), "cochanges", "strongest", *six("score", "weight"), "last_seen", "reason"
    )


def audit_candidates(spark, d):
    return _shown(_candidates(dense(spark, d)))


def audit_eligible(spark, d):
    b = dense(spark, d)
    return _ranked(changedset.eligible(_rankings(b), _universe(b), _changed(b), DENSE.but(exclude=("supp/1*",))), "cochanges")


def _audit(band: str, make=dense):
    def query(spark, d):
        top = changedset.top_candidates(_candidates(make(spark, d)), DENSE.but(min_confidence=band, top=20))
        return _shown(top.withColumn("path", F.concat(F.col("rank").cast("string"), F.lit(" "), F.col("path"))))

    return query


def audit_pagerank(spark, d):
    return _shown(changedset.top_candidates(_candidates(dense(spark, d), "pagerank"), DENSE.but(min_confidence="low", top=20)))


def audit_evidence(spark, d):
    b = dense(spark, d)
    seeds = _newest(b).select(F.col("path").alias("seed"))
    rows = scorers.on_demand_evidence(b, seeds, DENSE).drop("nth").join(_changed(b), "path", "left_anti")
    return changedset.merged_evidence(rows, 3).select("path", F.col("nth").cast("long").alias("nth"), "hash", "date", "file_count")


def audit_filtered_count(spark, d):
    return changedset.filtered_count(_candidates(sparse(spark, d)), DENSE)


def audit_enforcement(spark, d):
    shown = changedset.top_candidates(_candidates(dense(spark, d)), DENSE.but(top=50))
    return changedset.enforcement(shown, "high")


def diff_aggregate(spark, d):
    b = dense(spark, d)
    seeds = _newest(b).select(F.col("path").alias("seed"))
    return _shown(changedset.diff(scorers.direct_on_demand(b, seeds, DENSE, 20), _changed(b), DENSE.but(top=20))).drop("confidence", "supported_by")


def _evidence_text(df: DataFrame) -> DataFrame:
    shown = F.array_join(F.transform("evidence", lambda e: F.concat_ws(" ", e["hash"], e["date"], e["file_count"].cast("string"))), ",")
    return df.withColumn("evidence", shown)


def audit_candidates_with_evidence(spark, d):
    b = dense(spark, d)
    seeds = _newest(b).select(F.col("path").alias("seed"))
    top = changedset.top_candidates(_candidates(b), DENSE.but(top=20))
    found = scorers.on_demand_evidence(b, seeds, DENSE).drop("nth").join(top.select("path"), "path", "left_semi")
    rows = changedset.with_evidence(top, changedset.merged_evidence(found, 3), "path")
    return _evidence_text(rows).select("path", F.col("rank").cast("long").alias("rank"), "confidence", "evidence")


def diff_evidence(spark, d):
    b = dense(spark, d)
    seeds = _newest(b).select(F.col("path").alias("seed"))
    top = changedset.diff(scorers.direct_on_demand(b, seeds, DENSE, 20), _changed(b), DENSE.but(top=20))
    found = scorers.on_demand_evidence(b, seeds, DENSE).drop("nth").join(top.select("path"), "path", "left_semi")
    return _evidence_text(changedset.with_evidence(top, changedset.merged_evidence(found, 3), "path")).select("path", *six("score"), "evidence")


def explain_evidence(spark, d):
    return explain.evidence(dense(spark, d), "supp/7", "supp/1", DENSE).select(F.col("nth").cast("long").alias("nth"), "hash", "date", "subject", "file_count", *six("weight"))


def multi_seed_follow(spark, d):
    """Two seeds with former names of their own; where both were renamed in one basket each seed sees the other's old name."""
    b = history.in_size(dense(spark, d), DENSE.max_items)
    made = None
    for new, old in (("supp/1", "supp/2"), ("supp/7", "supp/8")):
        own = b.where(F.array_contains("files", new) | ((F.col("unix_time") < SINCE) & F.array_contains("files", old))).withColumn("seed", F.lit(new))
        made = own if made is None else made.unionByName(own)
    return _ranked(scorers.direct_on_demand(renames.follow(made, _aliases(made)), _seeds(spark, "supp/1", "supp/7"), DENSE), "cochanges")


def _change_sources(spark, d):
    part = table(spark, d, "part")
    name = lambda prefix: F.concat(F.lit(prefix), F.col("p_partkey"))
    staged = part.where("p_partkey % 3 = 0").select(name("s/").alias("path"), F.when(F.col("p_partkey") % 2 == 0, name("old/")).otherwise(name("s/")).alias("history_path"))
    unstaged = part.where("p_partkey % 3 = 0 and p_partkey % 4 < 2").select(F.when(F.col("p_partkey") % 4 == 0, name("u/")).otherwise(name("s/")).alias("path"), name("s/").alias("history_path"))
    untracked = part.where("p_partkey % 7 = 0").select(name("u/").alias("path"))
    return staged, unstaged, untracked


def worktree_changed_set(spark, d):
    return changedset.worktree(*_change_sources(spark, d))


def changed_name_set(spark, d):
    return changedset.changed_names(changedset.worktree(*_change_sources(spark, d)))


def _aliases(rows: DataFrame) -> DataFrame:
    """Older baskets know supp/1 as supp/2, and supp/7 as supp/8."""
    old = rows.where("unix_time < 883612800")
    return old.select("seed", "ord", F.when(F.col("seed") == "supp/1", "supp/2").otherwise("supp/8").alias("alias"))


def rename_follow_exact(spark, d):
    b = history.in_size(dense(spark, d), DENSE.max_items)
    either = [("supp/1", "supp/2"), ("supp/7", "supp/8")]
    made = None
    for new, old in either:
        own = b.where(F.array_contains("files", new) | ((F.col("unix_time") < SINCE) & F.array_contains("files", old))).withColumn("seed", F.lit(new))
        made = own if made is None else made.unionByName(own)
    followed = renames.follow(made, _aliases(made)).withColumn("path", F.explode("files")).where("path <> seed")
    return followed.groupBy("seed", "path").agg(F.count(F.lit(1)).alias("cochanges"))


def staged_rename_mapping(spark, d):
    b = dense(spark, d)
    changed = spark.createDataFrame([("supp/new", "supp/7"), ("supp/1", "supp/1")], "path string, history_path string")
    rows = scorers.direct_on_demand(b, changed.select(F.col("history_path").alias("seed")), DENSE, 10)
    named = changedset.attributed(rows, changed).join(changedset.changed_names(changed), "path", "left_anti")
    return _ranked(named, "cochanges")


def rename_exact_blob(spark, d):
    part = table(spark, d, "part")
    blob = F.concat(F.lit("b"), F.when(F.col("p_partkey") % 10 < 8, F.col("p_partkey")).otherwise(F.floor(F.col("p_partkey") / 10) * 10 + 8))
    before = part.select(F.lit(2).alias("ord"), F.lit(3).alias("parent_ord"), F.concat(F.lit("a/"), F.col("p_partkey")).alias("path"), F.lit(33188).alias("mode"), blob.alias("blob"))
    moved = F.when(F.col("p_partkey") % 5 == 3, F.concat(F.lit("b/"), F.col("p_partkey"))).otherwise(F.concat(F.lit("a/"), F.col("p_partkey")))
    after = part.where("p_partkey % 10 <> 9").select(F.lit(1).alias("ord"), F.lit(2).alias("parent_ord"), moved.alias("path"), F.lit(33188).alias("mode"), blob.alias("blob"))
    return renames.exact_content_renames(before.unionByName(after)).where("ord = 1").select("old_path", "new_path")


def _rename_records(spark, d):
    """Customers as rename records: chains of up to eight names, some repeated, and a few cycles."""
    c = table(spark, d, "customer")
    name = lambda e: F.concat(F.lit("n/"), e)
    k = F.col("c_custkey")
    new = F.when(k % 50 == 49, k - 3).otherwise(k + 1)
    chain = c.where("c_custkey % 8 <> 7 or c_custkey % 50 = 49").select((10 - k % 8).alias("ord"), F.lit(0).alias("pos"), name(k).alias("old_path"), name(new).alias("new_path"))
    again = c.where("c_custkey % 16 = 2").select((20 + k % 8).alias("ord"), F.lit(1).alias("pos"), name(k).alias("old_path"), name(k + 3).alias("new_path"))
    return chain.unionByName(again)


def rename_alias_closure(spark, d):
    return renames.closure(renames.alias_map(_rename_records(spark, d)))


def eval_known_items(spark, d):
    _, train = history.split(dense(spark, d), TEST, TRAIN)
    return evaluate.known_items(train, DENSE)


def eval_split(spark, d):
    test, train = history.split(dense(spark, d), TEST, TRAIN)
    return test.select("ord", "hash", F.lit("test").alias("part")).unionByName(train.select("ord", "hash", F.lit("train").alias("part")))


def _eval_query(shape: str, modes: tuple[str, ...], make=dense):
    def query(spark, d):
        test, train = history.split(make(spark, d), TEST, TRAIN)
        rows = evaluate.query_metrics(test, train, DENSE, modes, shape, 5)
        return rows.select("mode", "tasks", *six("hit_rate_at_k", "precision_at_k", "recall_at_k", "mrr", "avg_results"))

    return query


def eval_query_counters(spark, d):
    test, train = history.split(sparse(spark, d), TEST, TRAIN)
    return evaluate.query_counters(test, train, DENSE)


def eval_audit_counters(spark, d):
    test, train = history.split(sparse(spark, d), TEST, TRAIN)
    return evaluate.audit_counters(test, train, DENSE)


def _audit_eval(spark, d, mode="direct"):
    test, train = history.split(dense(spark, d), TEST, TRAIN)
    return evaluate.audit_candidates(test, train, DENSE, mode)


def _audit_metrics(mode: str):
    def query(spark, d):
        tasks, shown = _audit_eval(spark, d, mode)
        rows = evaluate.audit_metrics(tasks, shown, DENSE, mode)
        return rows.select("mode", "tasks", "hits_at_k", *six("hit_rate_at_k", "precision_at_k", "mrr", "avg_results", "avg_false_positives", "abstention_rate"))

    return query


def eval_audit_band_metrics(spark, d):
    tasks, shown = _audit_eval(spark, d)
    return evaluate.band_metrics(tasks, shown, "direct").select(
        "mode", "confidence", "candidates", "correct_candidates", *six("candidate_precision"), "tasks_with_candidates", "tasks_with_correct_candidate", *six("task_coverage", "conditional_hit_rate")
    )


def bounded_scan_cut(spark, d):
    return history.bounded_scan(dense(spark, d), "supp/7", cap=12000, least=100, hits=20, stall=400).select("ord", "hash")


def history_coverage(spark: SparkSession, d):
    rows = [history.coverage(b, limited, mapped) for b in ("git", "git-remove-empty", "pack-scan", "pack-fast", "gix") for limited in (False, True) for mapped in (False, True)]
    return spark.createDataFrame(sorted({tuple(r.values()) for r in rows}), "backend string, completeness string, approximate boolean, rename_tracking string")


def path_normalise(spark, d):
    messy = F.concat(F.lit("./"), F.replace("url", F.lit("://"), F.lit("//./")), F.lit("//x/."))
    return table(spark, d, "pages").select("page_id", paths.normalised(messy).alias("path"))


def path_parts(spark, d):
    p = F.col("path")
    return _part_paths(spark, d).select("path", paths.basename(p).alias("base"), paths.dirname(p).alias("dir"), paths.extension(p).alias("ext"))


def path_tokens(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.explode(paths.tokens(F.col("url"))).alias("t"))
    return rows.select("page_id", "t.token", "t.weight")


def time_decay(spark, d):
    b = dense(spark, d)
    newest = b.agg(F.max("unix_time").alias("latest"))
    return b.join(F.broadcast(newest)).select("hash", F.round(scoring.decay(F.col("latest"), F.col("unix_time"), 365.0), 9).alias("decay"))


def confidence_band(spark, d):
    return graph.pair_stats(sparse(spark, d), DENSE.but(max_items=80)).groupBy(scoring.confidence(F.col("cochanges")).alias("confidence")).agg(F.count(F.lit(1)).alias("pairs"))


QUERIES = {
    f.__name__: f
    for f in (
        basket_size_filter, item_stats, pair_stats, pair_stats_sparse, pair_evidence_first3, direct_global_all, direct_global_topk, direct_on_demand_topk,
        direct_on_demand_sparse, direct_on_demand_since, direct_max_commits, on_demand_evidence, hot_topk, hot_on_demand, path_similarity_topk,
        path_similarity_urls, weighted_degree, adjacency, pagerank_global, pagerank_on_demand, pagerank_with_direct_evidence, exclude_glob,
        exclude_then_topk, broad_change_hint, explain_pair, explain_unrelated, resolve_path_suffix, resolve_path_ambiguous, audit_candidates,
        audit_eligible, audit_pagerank, audit_evidence, audit_candidates_with_evidence, diff_evidence, explain_evidence, multi_seed_follow, audit_filtered_count, audit_enforcement, diff_aggregate, worktree_changed_set,
        changed_name_set, rename_follow_exact, staged_rename_mapping, rename_exact_blob, rename_alias_closure, eval_known_items, eval_split,
        eval_query_counters, eval_audit_counters, eval_audit_band_metrics, bounded_scan_cut, history_coverage, path_normalise,
        path_parts, path_tokens, time_decay, confidence_band,
    )
} | {
    "audit_low": _audit("low", sparse), "audit_medium": _audit("medium"), "audit_high": _audit("high"),
    "eval_query_on_demand": _eval_query("on-demand", ("direct", "hot", "path")), "eval_query_global": _eval_query("global", ("direct", "hot", "path")),
    "eval_query_pagerank": _eval_query("on-demand", ("pagerank",)), "eval_query_global_pagerank": _eval_query("global", ("pagerank",)),
    "eval_audit_metrics": _audit_metrics("direct"), "eval_audit_pagerank_metrics": _audit_metrics("pagerank"),
}
