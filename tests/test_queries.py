"""Registered queries against plain Python over the test tables."""

import re
from collections import defaultdict

from tandem.operators import graph, nearest
from tandem.plans import datasets, queries

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_every_name_is_asked_by_its_suffix(spark):
    names = [r.path for r in datasets.part_paths(spark, SMALL).collect()]
    asked = {n.split("/", 1)[1] for n in names}
    got = {r.asked: r for r in queries.resolve_path_suffix(spark, SMALL).collect()}
    assert set(got) == asked and len(asked) > 100
    for a, r in got.items():
        fit = sorted({n for n in names if n == a or n.endswith("/" + a)})
        assert (r.status, r.path) == (("known", fit[0]) if len(fit) == 1 else ("ambiguous", None))


def test_changed_sets_take_all_parts(spark):
    keys = [r.p_partkey for r in datasets.table(spark, MORE, "part").select("p_partkey").collect()]
    assert max(keys) > 1000
    staged = {f"s/{k}": f"old/{k}" if k % 2 == 0 else f"s/{k}" for k in keys if k % 3 == 0}
    unstaged = [(f"u/{k}" if k % 4 == 0 else f"s/{k}", f"s/{k}") for k in keys if k % 3 == 0 and k % 4 < 2]
    want = {f"u/{k}": f"u/{k}" for k in keys if k % 7 == 0}
    touched = {old for _, old in unstaged}
    want |= {path: old for path, old in staged.items() if path not in touched}
    want |= {path: staged.get(old, old) for path, old in unstaged}
    assert {r.path: r.history_path for r in queries.worktree_changed_set(spark, MORE).collect()} == want
    assert {r.path for r in queries.changed_name_set(spark, MORE).collect()} == set(want) | set(want.values())


def test_pagerank_with_direct_evidence_walks_30_steps(spark):
    b = datasets.sparse(spark, SMALL)
    moves = defaultdict(dict)
    for r in graph.adjacency(graph.pair_stats(b, queries.DENSE)).collect():
        moves[r.u][r.v] = r.weight
    got = defaultdict(dict)
    for r in queries.pagerank_with_direct_evidence(spark, SMALL).collect():
        got[r.seed][r.path] = (r.rank, r.score)
    assert set(got) == {r.path for r in queries._newest(b).collect() if moves[r.path]}
    for seed, rows in got.items():
        mass = {seed: 1.0}
        for _ in range(30):
            after = defaultdict(float, {seed: 0.15})
            for u, m in mass.items():
                total = sum(moves[u].values())
                for v, w in moves[u].items() if total else [(seed, 1.0)]:
                    after[v] += 0.85 * m * w / (total or 1.0)
            mass = after
        best = sorted(((-round(m, 9), u) for u, m in mass.items() if u != seed))[:50]
        assert len(rows) == len(best)
        assert [s for _, s in sorted(rows.values())] == sorted((s for _, s in rows.values()), reverse=True)
        for (rank, score), (m, _) in zip(sorted(rows.values()), best):
            assert abs(score + m) < 2e-6
        assert all(abs(score - mass[u]) < 2e-6 for u, (_, score) in rows.items())


def test_path_similarity_gathers_neither_parts_nor_classes_on_the_driver(spark, monkeypatch):
    """Broadcasts pass the driver, and Spark's guess of their size is that of compressed files."""
    plans, write = [], datasets.written

    def written(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(datasets, "written", written)
    monkeypatch.setattr(nearest, "written", written)
    monkeypatch.setattr(datasets, "_WRITTEN", {})
    got = queries.path_similarity_topk(spark, SMALL)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    joined = {(how, key) for plan in plans for how, key in re.findall(r"(\w+Join) \[(\w+)#", plan)}
    assert {("SortMergeJoin", "p_partkey"), ("SortMergeJoin", "key")} <= joined
    assert not {("BroadcastHashJoin", "p_partkey"), ("BroadcastHashJoin", "key")} & joined
    assert not got.isEmpty()


def test_baskets_are_ordered_before_their_items_are_joined(spark, monkeypatch):
    """Else all items are dealt out once more, by day."""
    plans, write = [], datasets.written

    def written(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(datasets, "written", written)
    monkeypatch.setattr(datasets, "_WRITTEN", {})
    b = datasets.sparse(spark, SMALL)
    assert plans[0].index("Join LeftOuter") < plans[0].index("Window [row_number")
    rows = b.orderBy("ord").collect()
    assert [(r.unix_time, r.key) for r in rows] == sorted(((r.unix_time, r.key) for r in rows), reverse=True)
    assert [r.ord for r in rows] == list(range(datasets.table(spark, SMALL, "orders").count()))
