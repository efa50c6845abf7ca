"""Benchmark decontamination against a plain scan of windows."""

import hashlib

from tandem.llm import decontaminate

from .edge import BASE, ROWS, frame
from .test_near_join import LOW, WORD

ITEMS = [
    ("10", " ".join(BASE.split()[5:25]).upper()), ("9", "one two"), ("9", "one TWO"), ("a", " ".join(BASE.split()[40:52]) + " zzz"), (None, "negative"), ("e", ""), ("n", None), ("w", "!!"),
    ("long", "w1x1 w2x2 w3x3 w4x4 w5x5 w6x6 w7x7 w8x8 w9x9 w10x10 w11x11 w12x12"),
]


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(rows, items, window=10):
    wins = [((i or ""), tuple(w[k : k + window])) for i, t in items if (w := words(t)) for k in range(max(1, len(w) - window + 1))]
    for doc, text in rows:
        w = words(text)
        hit, found = set(), set()
        for name, win in wins:
            n = len(win)
            for p in range(len(w) - n + 1):
                if w[p] == win[0] and tuple(w[p : p + n]) == win:
                    hit.update(range(p, p + n))
                    found.add(name)
        yield doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def benchmark(spark, items=ITEMS):
    return spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, n_words int")


def test_hits_match_brute_force_in_one_and_many_blocks(spark):
    want = sorted(brute(ROWS, ITEMS), key=str)
    for size in (16 << 20, 60):
        got = decontaminate.flagged(frame(spark), benchmark(spark), block_bytes=size)
        assert sorted((tuple(r)[:6] for r in got.collect()), key=str) == want


def test_longest_match_and_its_place(spark):
    for size in (16 << 20, 60):
        got = {r.doc_id: r for r in decontaminate.contamination(frame(spark), benchmark(spark), block_bytes=size).collect() if r.doc_id in (1, 4, 10)}
        assert (got[1].longest, got[1].longest_start, got[1].longest_item) == (20, 5, "10") and got[1].spans == [5, 25, 40, 52]
        assert (got[4].longest, got[4].longest_item) == (0, None)
        assert (got[10].longest, got[10].longest_start) == (12, 1)


def test_removal_and_empty_tables(spark):
    docs = frame(spark)
    kept = decontaminate.decontaminate(docs, benchmark(spark))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([4, 5, 6, None, 12, 13, 14], key=str)
    assert decontaminate.decontaminate(docs, benchmark(spark).limit(0)).count() == len(ROWS)
    assert decontaminate.flagged(docs.limit(0), benchmark(spark)).count() == 0


def test_rows_are_judged_by_their_own_text(spark):
    rows = [(None, BASE), (None, "clean text"), (3, "fine"), (3, BASE)]
    for size in (16 << 20, 60):
        kept = decontaminate.decontaminate(frame(spark, rows), benchmark(spark), block_bytes=size).collect()
        assert sorted((r.text for r in kept)) == ["clean text", "fine"]


def test_removal_in_one_and_many_blocks_is_the_same(spark):
    docs = frame(spark).selectExpr("*", "text as spans", "doc_id as `n words.x`", "cast(null as array<struct<a: int>>) as c0", "timestamp_seconds(uid) as items")
    one, many = (decontaminate.decontaminate(docs, benchmark(spark), block_bytes=size) for size in (16 << 20, 60))
    assert one.schema.simpleString() == docs.schema.simpleString() and "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect())) and one.count() > 0
