"""N-gram Jaccard join against all pairs."""

import glob
import os
import random
import re

import numpy as np

from tandem.llm import near_join, store

from .edge import ROWS, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k=5):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    n = len(rows)
    label, links = list(range(n)), [0] * n
    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if label[j] == label[i] and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids, default=None), label.count(label[i]), links[i]))
    return sorted(out, key=str)


def near_copies():
    r = random.Random(5)
    words = [f"v{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [r.choice(words) for _ in range(r.randint(30, 200))]
        for _ in range(r.randint(1, 14)):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(own) // 40))):
                own[r.randrange(len(own))] = r.choice(words)
            rows.append((len(rows) + 100, " ".join(own)))
    return rows


def test_classes_and_links_match_all_pairs(spark):
    rows = ROWS + near_copies()
    got = near_join.near_join(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_blocks_do_not_change_the_result(spark):
    rows = near_copies()
    got = near_join.near_join(frame(spark, rows), block_rows=3).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_dedup_keeps_one_of_each_group(spark):
    docs = frame(spark)
    kept = near_join.near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([-15, 1, 4, 5, 6, 7, 10, 12, 13, 14, None], key=str)
    assert near_join.near_join(docs.limit(0)).count() == 0


def test_prefixes_reach_the_recall_of_each_size():
    recall = lambda s, d: 1 - (1 - s**d) ** near_join.TREES
    own = near_join.visited(near_join.THRESHOLD, near_join.TREES, near_join.MAX_DEPTH, near_join.RECALL)
    at = lambda n: own[min(n, len(own) - 1)]
    assert own[:4] == [set()] * 4 and own[-1] == {6} and max(map(max, own[4:])) > 6
    for n in range(4, 120):
        for m in range(n, 150):
            similarity = [i / (n + m - i) for i in range(n + 1) if (i < n or m > n) and i / (n + m - i) >= 0.8 - 1e-9]
            if similarity:  # such sets can be partners: they meet at a depth of the target recall
                assert recall(min(similarity), max(at(n) & at(m))) >= near_join.RECALL
    assert near_join.prefix(0.8, 2, 8, 0.99) == 1


def test_rows_of_one_id_are_told_apart(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a unique text of seven words here"), (3, "p q r s t u"), (3, "p q r s t u"), (None, "p q r s t u"), (None, "two null ids"), (None, "two null ids"), (None, "other")]
    kept = near_join.near_dedup(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([rows[0], rows[2], rows[3], rows[6], rows[8]], key=str)


def test_a_growing_cluster_adds_few_rows(spark):
    r = random.Random(9)
    base = [f"v{i}" for i in range(150)]
    counted = []
    for n in (64, 128, 256):
        rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i in range(n) for k in [r.randrange(150)]]
        got = near_join.near_join(frame(spark, rows), block_rows=64).collect()
        assert {x.class_id for x in got} == {0} and {x.n_links for x in got} == {n - 1}
        pairs = max(glob.glob(f"{store.shared_root(spark).removeprefix('file://')}/tandem/pairs-*"), key=os.path.getmtime)
        counted.append(spark.read.parquet(pairs).count())
    assert counted == [1, 3, 10]  # one row each block and each two blocks, not each document


def test_components_match_union_find(spark):
    r = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (180, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    got = dict(map(tuple, store.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
