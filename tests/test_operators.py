"""Engine operators on small literal histories with hand-computed results."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tandem.config import Options, UsageError
from tandem.functions import paths, scoring
from tandem.operators import changedset, evaluate, explain, graph, history, nearest, renames, scorers, walks
from tandem.schema import BASKETS

DAY = 86400
ALL = Options(max_items=80, max_baskets=0, evidence=3)


def baskets(spark, *rows):
    """rows: (hash, day, files[, renames]), newest first."""
    made = [(i, r[0], int(r[1] * DAY), f"d{int(r[1]):04d}", r[0], list(r[2]), list(r[3]) if len(r) > 3 else []) for i, r in enumerate(rows)]
    return spark.createDataFrame(made, BASKETS)


@pytest.fixture(scope="module")
def five(spark):
    return baskets(spark, ("hx", 400, ""), ("h3", 365, "abc"), ("h2", 200, "ab"), ("h1", 100, "bcde"), ("h0", 0, "ac")).cache()


def rounded(df, *columns):
    return {tuple(v for v in r if isinstance(v, str)): tuple(round(v, 6) for v in r if not isinstance(v, str)) for r in df.select(*columns).collect()}


def test_item_mass_counts_from_the_newest_basket_even_if_empty(five):
    assert rounded(graph.item_stats(five, ALL), "path", "weighted_changes") == {
        ("a",): (2.087535,), ("b",): (2.185378,), ("c",): (1.969231,), ("d",): (0.565689,), ("e",): (0.565689,)
    }


def test_global_direct(five):
    got = rounded(graph.scored_pairs(graph.pair_stats(five, ALL), graph.item_stats(five, ALL)), "a", "b", "cochanges", "weight", "score")
    assert got["a", "b"] == (2, 0.899399, 0.421087) and got["a", "c"] == (2, 0.763026, 0.376335) and got["d", "e"] == (1, 0.243629, 0.430677)
    assert len(got) == 8
    small = ALL.but(max_items=3)
    got = rounded(graph.scored_pairs(graph.pair_stats(five, small), graph.item_stats(five, small)), "a", "b", "cochanges", "weight", "score")
    assert got == {("a", "b"): (2, 0.899399, 0.489125), ("a", "c"): (2, 0.763026, 0.445769), ("b", "c"): (1, 0.467847, 0.310296)}


def test_on_demand_direct_and_bounds(five, spark):
    a = spark.createDataFrame([("a",)], "seed string")
    got = rounded(scorers.direct_on_demand(five, a, ALL.but(max_items=3)), "path", "cochanges", "weight", "score")
    assert got == {("b",): (2, 0.961210, 0.489125), ("c",): (2, 0.815465, 0.445769)}
    assert rounded(scorers.direct_on_demand(five, a, ALL.but(max_baskets=1)), "path", "cochanges") == {("b",): (1,), ("c",): (1,)}
    assert rounded(scorers.direct_on_demand(five, a, ALL.but(since=200 * DAY)), "path", "cochanges") == {("b",): (2,), ("c",): (1,)}


def test_first_evidence_is_the_newest(five):
    rows = graph.pair_evidence(five, ALL.but(evidence=1)).where("a = 'a'").select("b", "hash", "file_count").collect()
    assert {tuple(r) for r in rows} == {("b", "h3", 3), ("c", "h3", 3)}


def test_pagerank(five, spark):
    adj = graph.adjacency(graph.pair_stats(five, ALL))
    got = rounded(scorers.pagerank(adj, spark.createDataFrame([("a",)], "seed string")), "path", "score")
    assert got == {("b",): (0.271192,), ("c",): (0.249384,), ("d",): (0.074081,), ("e",): (0.074081,)}
    alone = scorers.pagerank(adj, spark.createDataFrame([("lonely",)], "seed string"))
    assert alone.count() == 0


def test_walks_over_baskets_are_those_over_pairs(spark):
    """The pair graph is not needed: mass goes through baskets, to the same scores and the same evidence."""
    r = random.Random(5)
    rows = baskets(spark, *[(f"h{i}", 200 - i, r.sample("abcdefghijklmnopqrst", r.randint(1, 5))) for i in range(60)], ("z", 1, "z"))
    seeds = spark.createDataFrame([("a",), ("b",), ("c",), ("z",), ("none",)], "seed string")
    some = ALL.but(max_items=4)
    scores = scorers.pagerank(graph.adjacency(graph.pair_stats(rows, some)), seeds)
    every = scorers.ranked(scorers.with_direct(scores, scorers.direct_global(rows, some).join(seeds, "seed", "left_semi")), 7, "seed")
    columns = ("seed", "path", "rank", "score", "cochanges", "weight", "last_seen", "reason")
    assert walks.best_of_all(rows, seeds, some, 7, few_items=10) is None
    assert rounded(scorers.pagerank_global(rows, seeds, some, 7), *columns) == rounded(every, *columns)


def test_chain_reaches_over_the_global_graph_only(spark):
    test = baskets(spark, ("t", 3, "ac"))
    train = baskets(spark, ("x", 2, "ab"), ("y", 1, "bc"))
    for shape, rate in (("global", 1.0), ("on-demand", 0.0)):
        row = evaluate.query_metrics(test, train, ALL, ("pagerank",), shape, 2).first()
        assert (row.tasks, row.hit_rate_at_k) == (2, rate)


def test_path_similarity(spark):
    one = spark.createDataFrame([("src/auth.ts",)], "path string")
    others = spark.createDataFrame([(p,) for p in ("src/session.ts", "tests/auth.test.ts", "README.md", "a", "SRC/auth.ts", "src/auth.ts")], "path string")
    got = rounded(scorers.path_similarity(one, others), "path", "score")
    assert got == {("src/session.ts",): (1.168367,), ("tests/auth.test.ts",): (0.176606,), ("SRC/auth.ts",): (1.0,)}
    readme = spark.createDataFrame([("README.md",)], "path string")
    assert rounded(scorers.path_similarity(readme, spark.createDataFrame([("LICENSE",)], "path string")), "path", "score") == {("LICENSE",): (0.25,)}


@pytest.mark.parametrize("rare,block", [(0, 3), (2, 7), (9, 2048), (64, 2048)])
def test_nearest_names_are_those_of_all_pairs(spark, rare, block):
    r = random.Random(rare)
    names = [f"{r.choice(['', 'src/', 'Src/', 'src/app/', 'lib/x/'])}{r.choice(['new', 'old'])}-{r.choice(['ab', 'cd', 'ef'])}{r.choice(['', '-' + str(r.randrange(30))])}{r.choice(['', '.ts', '.py'])}" for _ in range(220)]
    df = spark.createDataFrame([(n,) for n in [*names, "a", "", names[0]]], "path string")
    some = spark.createDataFrame([(n,) for n in [*names[:20], "src/none-ab.rs", "a"]], "path string")
    for targets, top in ((df, 3), (some, 20)):
        every = scorers.ranked(scorers.path_similarity(targets, df).drop("rank"), top, "seed")
        found = scorers.ranked(nearest.nearest(targets, df, top, rare, block), top, "seed")
        assert [tuple(x) for x in found.select("seed", "rank", "path", "score").orderBy("seed", "rank").collect()] == [
            tuple(x) for x in every.select("seed", "rank", "path", "score").orderBy("seed", "rank").collect()
        ]


def test_names_that_share_frequent_tokens_are_not_compared_in_pairs(spark):
    """16000 names with three tokens in common have 256 million pairs: rows of classes and small groups are a few a name."""
    df = spark.range(16000).select(F.format_string("src/main/folder%d/name-%d.ts", F.col("id") % 4000, "id").alias("path"))
    seen = {}
    original = nearest._best

    def best(rows, *more):
        seen[more[-1]] = rows.count()
        return original(rows, *more)

    nearest._best = best
    try:
        got = scorers.path_similarity(df, df, 3)
        assert got.groupBy("seed").count().where("count <> 3").isEmpty()
        assert got.where("rank = 1 and score < 0.9").isEmpty()
    finally:
        nearest._best = original
    assert 0 < seen["first"] < 16000 and 0 < seen["path"] < 16000


@pytest.mark.parametrize(
    "pattern,path,hit",
    [("Cargo.lock", "a/Cargo.lock", True), ("a/b", "x/a/b", True), ("b", "ab", False), ("*.lock", "a/b.lock", True), ("a/*", "a/b/c", True), ("a*c", "abd", False), ("x.y", "xzy", False), ("*", "", True)],
)
def test_exclude_patterns(spark, pattern, path, hit):
    assert spark.range(1).select(paths.excluded(F.lit(path), (pattern,))).first()[0] is hit


def test_bands_and_audit_aggregate(spark):
    rows = [("a", "b", 3), ("a", "test", 2), ("b", "test", 3), ("b", "weak", 1)]
    df = spark.createDataFrame([(s, p, 1.0, n, 0.5, f"d{n}", "direct_cochange") for s, p, n in rows], "seed string, path string, score double, cochanges long, weight double, last_seen string, reason string")
    changed = spark.createDataFrame([("a", "a"), ("b", "b")], "path string, history_path string")
    total = changedset.aggregate(changedset.eligible(df, df.select("path"), changed, ALL))
    top = changedset.top_candidates(total, ALL.but(min_confidence="medium")).collect()
    assert [(r.path, r.confidence, r.support_count, r.cochanges, r.strongest, r.supported_by) for r in top] == [("test", "medium", 2, 5, 3, ["a", "b"])]
    assert tuple(changedset.filtered_count(total, ALL).first()) == (2, 1)
    got = spark.createDataFrame([(n,) for n in (0, 1, 2, 24, 25)], "n int").select(scoring.confidence(F.col("n"))).collect()
    assert [r[0] for r in got] == ["low", "low", "medium", "medium", "high"]


def test_merged_evidence_and_diff_reason(spark):
    rows = [("s1", "p", "h1", "2024-02"), ("s2", "p", "h1", "2024-02"), ("s2", "p", "h0", "2024-03"), ("s1", "p", "h2", "2024-01")]
    ev = spark.createDataFrame(rows, "seed string, path string, hash string, date string")
    assert [(r.nth, r.hash) for r in changedset.merged_evidence(ev, 2).orderBy("nth").collect()] == [(1, "h0"), (2, "h1")]
    df = spark.createDataFrame([("x", "p", 1.25, 2, 0.5, "a", "r1"), ("y", "p", 2.75, 3, 1.5, "b", "r2")], "seed string, path string, score double, cochanges long, weight double, last_seen string, reason string")
    r = changedset.diff(df, spark.createDataFrame([("x", "x")], "path string, history_path string"), ALL).first()
    assert (r.score, r.cochanges, r.weight, r.last_seen, r.reason) == (4.0, 5, 2.0, "b", "diff_aggregate")


def test_worktree_chains_renames(spark):
    pair = "path string, history_path string"
    got = changedset.worktree(spark.createDataFrame([("mid", "old"), ("kept", "kept")], pair), spark.createDataFrame([("new", "mid")], pair), spark.createDataFrame([("fresh",)], "path string"))
    assert sorted(map(tuple, got.collect())) == [("fresh", "fresh"), ("kept", "kept"), ("new", "old")]


def test_rename_closure_cycles_and_oldest_record(spark):
    rows = [(1, 0, "a", "b"), (2, 0, "b", "c"), (3, 0, "a", "z"), (1, 1, "x", "y"), (1, 2, "y", "x"), (1, 3, "t", "x")]
    ends = renames.closure(renames.alias_map(spark.createDataFrame(rows, "ord long, pos int, old_path string, new_path string")))
    assert dict(map(tuple, ends.collect())) == {"a": "z", "b": "c", "x": "x", "y": "y", "t": "x"}


def test_rename_aware_tests_and_training(spark):
    test = baskets(spark, ("t1", 9, ["new", "companion"]), ("t2", 8, ["new", "companion"], [("old", "new")]))
    train = baskets(spark, ("r1", 2, ["old", "companion"]), ("r2", 1, ["old", "companion"])).withColumn("ord", F.col("ord") + 2)
    none = spark.createDataFrame([], "old_path string, canonical string")
    records = test.select("ord", F.posexplode("renames").alias("pos", "r")).select("ord", "pos", "r.*")
    named = {r.ord: r.files for r in renames.canonical_tests(test, records, none).collect()}
    assert named == {0: ["new", "companion"], 1: ["old", "companion"]}
    tests = renames.canonical_tests(test, records, none)
    tasks, shown = evaluate.audit_candidates(tests, train, ALL.but(top=5), "direct")
    row = evaluate.audit_metrics(tasks, shown, ALL.but(top=5), "direct").first()
    assert (row.tasks, row.hit_rate_at_k) == (2, 1.0)
    counters = evaluate.audit_counters(tests, train, ALL).first()
    assert (counters.candidate_tasks, counters.skipped_unknown_targets, counters.skipped_insufficient_known_files) == (4, 1, 1)


def test_exact_content_renames_abstain_when_ambiguous(spark):
    rows = [(2, 3, "old", 1, "x"), (2, 3, "p", 1, "y"), (2, 3, "q", 1, "y"), (1, 2, "new", 1, "x"), (1, 2, "r", 1, "y")]
    got = renames.exact_content_renames(spark.createDataFrame(rows, "ord long, parent_ord long, path string, mode int, blob string"))
    assert [tuple(r) for r in got.where("ord = 1").collect()] == [(1, "old", "new")]


def test_order_split_and_bounded_scan(spark):
    rows = spark.createDataFrame([(5, 10), (7, 10), (6, 99999), (1, 200000)], "key long, t long")
    assert [r.key for r in history.with_order(rows, "t", "key").orderBy("ord").collect()] == [1, 6, 7, 5]
    walk = baskets(spark, *[(f"h{i}", 100 - i, "ab" if i in (2, 3) else "b") for i in range(12)])
    assert history.bounded_scan(walk, "a", cap=10, least=4, hits=9, stall=3).count() == 7
    assert history.bounded_scan(walk, "a", cap=10, least=4, hits=2, stall=9).count() == 4
    assert history.bounded_scan(walk, "zz", cap=10).count() == 10
    with pytest.raises(ValueError):
        history.split(walk, 12, 5)


def test_resolve_and_explain(spark, five):
    known = spark.createDataFrame([("src/a.ts",), ("lib/a.ts",), ("lib/b.ts",), ("b.ts",)], "path string")
    asked = spark.createDataFrame([("a.ts",), ("b.ts",), ("lib/b.ts",), ("src/a.ts",), ("z",)], "asked string")
    got = {r.asked: (r.status, r.path) for r in explain.resolve(known, asked).collect()}
    assert got == {"a.ts": ("ambiguous", None), "b.ts": ("known", "b.ts"), "lib/b.ts": ("known", "lib/b.ts"), "src/a.ts": ("known", "src/a.ts"), "z": ("missing", None)}
    row = explain.explain(five, "a", "zz", ALL).first()
    assert (row.related, row.cochanges, row.weight) == (False, 0, 0.0)


def test_options_are_checked():
    for bad in ({"half_life_days": math.nan}, {"max_items": 0}, {"mode": "x"}, {"min_confidence": "x"}, {"min_confidence": "high", "fail_on_confidence": "low"}):
        with pytest.raises(UsageError):
            Options(**bad)


def test_walks_as_arrays_and_by_joins_agree(spark):
    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("c", "d", 0.5), ("a", "d", 3.0), ("x", "y", 1.0)]
    adj = spark.createDataFrame([e for u, v, w in edges for e in ((u, v, w), (v, u, w))], "u string, v string, weight double")
    seeds = spark.createDataFrame([("a",), ("x",), ("alone",)], "seed string")
    for by_seed in (False, True):
        graph_ = adj.crossJoin(seeds) if by_seed else adj
        found = [{(r.seed, r.path): round(r.score, 9) for r in scorers.pagerank(graph_, seeds, by_seed=by_seed, few=few).collect()} for few in (1000, 0)]
        assert found[0] == found[1] and {s for s, _ in found[0]} == {"a", "x"} and len(found[0]) == 4
