"""LM scoring against a plain PPM over dictionaries."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tandem.llm import lm_score

TEXTS = [
    (1, "the cat sat on the mat"), (2, "The dog\tsat on  the log."), (3, None), (4, ""), (5, "the cat sat on the mat"), (6, "über Straße straße"),
    (7, " \n "), (8, "cats and dogs and mats"), (9, "zzz q " * 40), (10, "the dot sat"), (11, "on the mat the cat"), (12, "new Words only here"), (12, "repeated id"),
]


def coded(text):
    return b" ".join((text or "").encode().lower().split()) + b"\n"


def brute_scores(train, texts, order):
    counts = defaultdict(Counter)
    for t in train:
        data = b"\n" * order + coded(t)
        for i in range(order, len(data)):
            for k in range(order + 1):
                counts[data[i - k : i]][data[i]] += 1

    def log_p(context, symbol):
        out, gone = 0.0, set()
        for k in range(len(context), -1, -1):
            seen = {s: n for s, n in counts.get(context[len(context) - k :], {}).items() if s not in gone}
            if not seen:
                continue
            mass = sum(seen.values()) + len(seen)
            if symbol in seen:
                return out + math.log10(seen[symbol] / mass)
            out += math.log10(len(seen) / mass)
            gone |= seen.keys()
        return out - math.log10(256 - len(gone))

    for t in texts:
        data = b"\n" * order + coded(t)
        yield sum(log_p(data[i - order : i], data[i]) for i in range(order, len(data)))


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


@pytest.mark.parametrize("common, few", [(1, 1 << 20), (1 << 20, 0)])
def test_scores_match_brute_force(spark, common, few):
    docs = spark.createDataFrame([(i, t, "x") for i, t in TEXTS], "doc_id long, text string, score string")
    got = lm_score.lm_scores(docs, lm_score.crc_fold("doc_id", 5, 1), common=common, few=few).collect()
    train = [t for i, t in TEXTS if not held(i)]
    assert 0 < len(train) < len(TEXTS)
    tokens = Counter(w for t in train for w in [*coded(t)[:-1].split(), b"\n"])
    n, v = sum(tokens.values()), len(tokens)
    want = []
    for (i, t), score in zip(TEXTS, brute_scores(train, [t for _, t in TEXTS], lm_score.ORDER)):
        own = [*coded(t)[:-1].split(), b"\n"]
        base = sum(math.log10((tokens[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        want.append((i, len(own), sum(tokens[w] > 0 for w in own), n, round(base, 6), round(score, 6)))
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == sorted(want)


def test_empty_table_and_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lm_score.lm_scores(docs.limit(0), F.lit(False)).count() == 0
    row = lm_score.lm_scores(docs, F.lit(True)).first()
    assert (row.train_tokens, row.n_known, row.n_tokens) == (0, 0, 3)
    assert row.score == pytest.approx(-4 * math.log10(256))
