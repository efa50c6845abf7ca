"""Exact dedup by chunk recipes against grouped normalised texts."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tandem.llm import exact_dedup

from .edge import LONG, ROWS, frame

MORE = [(20, LONG.replace(" ", "\n")), (21, LONG[:-1] + "!"), (22, "one   two"), (23, "one\xa0two"), (24, "é" * 9000), (25, "é" * 9000)]


def brute(rows):
    """Of each group one row is kept: that of the smallest id, then of the smallest digest of the text as it is."""
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for i, t in enumerate(norm):
        groups[t].append(i)
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0, hashlib.sha256((rows[i][1] or "").encode()).hexdigest(), i)
    for i, t in enumerate(norm):
        first = min(groups[t], key=order)
        yield rows[i][0], rows[first][0], len(groups[t]), i == first, hashlib.sha256(t.encode()).hexdigest()


REPEATED = [(2, "same text here"), (1, "same text here"), (2, "same  text here"), (2, "a unique text"), (5, "twice"), (5, "twice"), (None, "null"), (None, "null"), (None, "twice"), (6, "null id")]


def test_groups_match_brute_force(spark):
    rows = ROWS + MORE + REPEATED
    got = [tuple(r) for r in exact_dedup.exact_groups(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_chunks_join_to_the_text_and_follow_content(spark):
    r = random.Random(1)
    text = " ".join("".join(r.choice("aeionrst") for _ in range(r.randint(2, 8))) for _ in range(20_000))
    row = spark.createDataFrame([(text,), ("start " + text,), ("",)], "t string").select(exact_dedup.chunks(F.col("t")).alias("c")).collect()
    assert "".join(row[0].c) == text and row[2].c == [] and max(map(len, row[0].c)) <= exact_dedup.LONGEST
    assert len(set(row[0].c) & set(row[1].c)) >= len(set(row[0].c)) - 3


def test_removal_and_empty_table(spark):
    docs = frame(spark)
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, 4, 6, 7, None, 9, 10, 12, 13, 14, -15], key=str)
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_one_row_of_each_group_stays_though_ids_repeat(spark):
    kept = exact_dedup.exact_dedup(frame(spark, REPEATED)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(1, "same text here"), (2, "a unique text"), (5, "twice"), (None, "null"), (6, "null id")], key=str)


def test_identifiers_that_stand_for_two_contents_stop_the_job(spark):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(600)], "doc_id long, text string")
    assert exact_dedup.disputed(exact_dedup.recipes(docs)).count() == 0
    assert exact_dedup.disputed(exact_dedup.recipes(docs, bits=8)).count() > 0
    with pytest.raises(RuntimeError):
        exact_dedup.exact_groups(docs, bits=8)
