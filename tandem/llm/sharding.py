"""Sharding by a hierarchical weighted hash tree, in DataFrame functions alone.

A row descends from the root over regions and racks to a shard. At each level every child draws -ln(u) / weight with u
hashed from the row's key and the child's name, and the smallest draw wins, so a child receives its weight's share and
a change of weights moves rows only between the children whose weights changed. A shard added by growth opens a
region of its own, so all other weights stay and rows move only into it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import documents

SHARDS, RACK, REGION = 40, 4, 8
BUCKETS = 128


@dataclass(frozen=True)
class Node:
    """A region, rack or shard; leaf is the shard number, weight the sum of what is below."""

    name: str
    weight: float
    children: tuple[Node, ...] = ()
    leaf: int = -1


def group(name: str, children: list[Node]) -> Node:
    return Node(name, sum(c.weight for c in children), tuple(children))


def tree(shards: int, base: int | None = None, per_rack: int = RACK, per_region: int = REGION, weights: dict[int, float] | None = None) -> Node:
    """The tree of `shards` shards: `base` of them in full regions of racks, each later one in a region of its own."""
    base = shards if base is None else base
    leaf = [Node(f"shard {i}", (weights or {}).get(i, 1.0), (), i) for i in range(shards)]
    regions = []
    for at in range(0, base, per_region):
        own = leaf[at : min(at + per_region, base)]
        racks = [group(f"rack {at + k}", own[k : k + per_rack]) for k in range(0, len(own), per_rack)]
        regions.append(group(f"region {at}", racks))
    regions += [group(f"region {i}", [group(f"rack {i}", [leaf[i]])]) for i in range(base, shards)]
    return group("root", regions)


def _literal(nodes) -> str:
    """SQL array of children as structs of name, weight and leaf."""
    return "array(" + ", ".join(f"named_struct('name', '{n.name}', 'weight', double({n.weight!r}), 'leaf', {n.leaf})" for n in nodes) + ")"


def _pick(children: str, key: str) -> str:
    """SQL: position and leaf of the child with the least draw, exponential with the child's weight as its rate."""
    uniform = f"(shiftrightunsigned(xxhash64({key}, c.name), 11) + 0.5D) / {2**53}D"
    return f"array_min(transform({children}, (c, i) -> named_struct('draw', -ln({uniform}) / c.weight, 'at', i, 'leaf', c.leaf)))"


def descend(rows: DataFrame, node: Node, key: str, out: str) -> DataFrame:
    """Adds the int column `out`: the shard to which column `key` descends from the root over region and rack."""
    regions = node.children
    racks = "array(" + ", ".join(_literal(r.children) for r in regions) + ")"
    leaves = "array(" + ", ".join("array(" + ", ".join(_literal(k.children) for k in r.children) + ")" for r in regions) + ")"
    return (
        rows.withColumn("__region", F.expr(_pick(_literal(regions), key) + ".at"))
        .withColumn("__rack", F.expr(_pick(f"get({racks}, __region)", key) + ".at"))
        .withColumn(out, F.expr(_pick(f"get(get({leaves}, __region), __rack)", key) + ".leaf"))
        .drop("__region", "__rack")
    )


def placed(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", *, buckets: int = BUCKETS, weights: dict[int, float] | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 16; a null text has none of its own and the checksum of the empty text. law is
    "key": the id and the number of shards decide, a null id counting as the empty string. grown_shard is the shard
    under one more. slot numbers a shard's rows from 0 without gaps, by a hashed bucket and the id; rows of one id
    share a shard and take neighbouring slots. An empty table gives no rows. Other columns are ignored.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), key.alias("key"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32")
    )
    rows = descend(rows, tree(shards, weights=weights), "key", "shard")
    rows = descend(rows, tree(shards + 1, shards, weights=weights), "key", "grown_shard")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key", F.lit("slot")), F.lit(buckets)).cast("int"))
    cells = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = "coalesce(sum(n) over (partition by shard order by bucket rows between unbounded preceding and 1 preceding), 0)"
    offsets = cells.select("shard", "bucket", F.expr(before).alias("before"))  # at most shards x buckets rows
    numbered = rows.withColumn("within", F.expr("row_number() over (partition by shard, bucket order by key, text_crc32, size) - 1"))
    return numbered.join(F.broadcast(offsets), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("within")).cast("long").alias("slot"), "grown_shard"
    )


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    return placed(documents(spark, sf_dir))
