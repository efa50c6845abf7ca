"""Sharding: the law, gapless slots, balance, and movement under growth and changed weights."""

import math
import zlib
from collections import Counter, defaultdict

import xxhash

from tandem.llm import sharding

from .edge import ROWS, frame


def test_contract_on_odd_documents(spark):
    rows = sharding.placed(frame(spark)).collect()
    assert len(rows) == len(ROWS)
    text = {i: (t or "").encode() for i, t in ROWS}
    slots, shard = defaultdict(list), {}
    for r in rows:
        assert (r.size, r.text_crc32, r.law) == (len(text[r.doc_id]) + 16, zlib.crc32(text[r.doc_id]), "key")
        assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
        assert shard.setdefault(r.doc_id, r.shard) == r.shard
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.placed(frame(spark).limit(0)).count() == 0


def many(spark, n=20000):
    return spark.range(n).selectExpr("id as doc_id", "'t' as text")


def test_balance_and_growth(spark):
    rows = sharding.placed(many(spark)).collect()
    counts = Counter(r.shard for r in rows)
    assert len(counts) == 40 and max(counts.values()) < 1.3 * min(counts.values())
    moved = [r for r in rows if r.grown_shard != r.shard]
    assert {r.grown_shard for r in moved} == {40} and 0.7 < len(moved) / (len(rows) / 41) < 1.3


def test_weights_shape_shares_and_confine_movement(spark):
    before = {r.doc_id: r.shard for r in sharding.placed(many(spark)).collect()}
    after = {r.doc_id: r.shard for r in sharding.placed(many(spark), weights={3: 3.0}).collect()}
    counts = Counter(after.values())
    assert 2.4 < counts[3] / (sum(counts[i] for i in range(8, 40)) / 32) < 3.6
    # shards 8 to 39 are in regions whose weights stay: rows leave them only for region 0, never for each other
    assert all(after[d] == s or after[d] < 8 for d, s in before.items() if s >= 8)


def plain_shard(key, shards, base=40):
    """A descent by plain draws: -ln(u) / weight with u from two chained 64-bit hashes."""

    def pick(children):
        def draw(child):
            name, weight = child[0], child[1]
            h = xxhash.xxh64(name.encode(), seed=xxhash.xxh64(key.encode(), seed=42).intdigest()).intdigest()
            return -math.log(((h >> 11) + 0.5) / 2**53) / weight

        return min(children, key=draw)

    racks = {r: [(f"shard {i}", 1.0, i) for i in range(r, min(r + 4, base))] for r in range(0, base, 4)}
    regions = [(f"region {g}", 8.0, [(f"rack {r}", 4.0, racks[r]) for r in (g, g + 4)]) for g in range(0, base, 8)]
    regions += [(f"region {i}", 1.0, [(f"rack {i}", 1.0, [(f"shard {i}", 1.0, i)])]) for i in range(base, shards)]
    return pick(pick(pick(regions)[2])[2])[2]


def test_shards_match_plain_draws(spark):
    rows = sharding.placed(frame(spark)).collect() + sharding.placed(many(spark, 3000)).collect()
    for r in rows:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert (r.shard, r.grown_shard) == (plain_shard(key, 40), plain_shard(key, 41))
