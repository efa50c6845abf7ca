"""Exact dedup by content-defined chunk recipes, in DataFrame functions alone.

A normalised text is cut where its own content says so: a chunk ends with a boundary pattern once it has the least
length, or at the greatest length (where the pattern does not occur, equal texts still have equal chunks). Every distinct chunk becomes
an identifier, which is verified: chunks that share one must agree in length and in an independent hash, of which only the least
and greatest values move. A document is then the ordered list of its identifiers. Only digests of these recipes are grouped
and joined; the texts never move, but for the rows that a removal returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import documents, text_key, without, written

SHORTEST, LONGEST = 512, 4096
#: Rare endings of words in Latin, Greek and Cyrillic letters, and sentence marks of scripts without blanks.
BOUNDARY = r"[aeiou][^aeiou\s][ ]|[αεηιου][^αεηιου\s][ ]|[аеиоуыя][^аеиоуыя\s][ ]|[。！？।؟]"
HEAVY = 4000
BLANKS = r"[\x20\x09-\x0D]+"


def chunks(text, shortest: int = SHORTEST, longest: int = LONGEST, boundary: str = BOUNDARY):
    """Column array<string>: the chunks of a text column, which joined give the text again."""
    pattern = rf"(?s).{{{shortest},{longest - 1}}}?(?:{boundary})|.{{1,{longest}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 256) -> DataFrame:
    """doc_id, text_key (digest of the text as it is), text_sha256 (of the normalised text) and marks of each row; null counts as empty.

    marks are the chunks in order as id (the first `bits` of SHA-256), size and check (an independent hash).
    """
    normal = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), BLANKS, " ")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), normal.alias("normal"))
    mark = lambda c: F.struct(F.substring(F.unhex(F.sha2(c, 256)), 1, bits // 8).alias("id"), F.length(c).alias("size"), F.xxhash64(c).alias("check"))
    return rows.select("doc_id", "text_key", F.sha2("normal", 256).alias("text_sha256"), F.transform(chunks(F.col("normal")), mark).alias("marks"))


def disputed(rows: DataFrame) -> DataFrame:
    """Chunk identifiers of recipes() that stand for more than one content."""
    parts = rows.select(F.explode("marks").alias("m")).select("m.*")
    seen = parts.groupBy("id").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("size", "check") for f in (F.min, F.max)])
    return seen.where("min_size <> max_size or min_check <> max_check").select("id")


def _grouped(docs: DataFrame, id_col: str, text_col: str, bits: int = 256) -> DataFrame:
    """doc_id, text_key, text_sha256, rows (equal in these), first (least of these of the group) and group_size.

    Groups of more than one row in HEAVY are fewer than HEAVY; they are joined by broadcast, so that none fills a task.
    """
    chunked = written(recipes(docs, id_col, text_col, bits), "recipes")
    if not disputed(chunked).isEmpty():
        raise RuntimeError("two chunks of different content share one identifier")
    recipe = F.sha2(F.array_join(F.transform("marks", lambda m: F.hex(m["id"])), ","), 256).alias("recipe")
    rows = written(chunked.select("doc_id", "text_key", "text_sha256", recipe).groupBy("recipe", "doc_id", "text_key", "text_sha256").agg(F.count(F.lit(1)).alias("rows")), "digests")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    groups = written(rows.groupBy("recipe").agg(F.min(first).alias("first"), F.sum("rows").alias("group_size"), F.count(F.lit(1)).alias("kinds")), "groups")
    most = (groups.agg(F.sum("kinds").alias("n")).first()["n"] or 0) // HEAVY + 1
    heavy = F.broadcast(groups.where(F.col("kinds") > most).select("recipe", "first", "group_size"))
    light = groups.where(F.col("kinds") <= most).select("recipe", "first", "group_size")
    marked = rows.join(heavy.select("recipe", F.lit(True).alias("is_heavy"), "first", "group_size"), "recipe", "left")
    out = ["doc_id", "text_key", "text_sha256", "rows", "first", "group_size"]
    return marked.where("is_heavy").select(*out).unionByName(marked.where("is_heavy is null").drop("first", "group_size").join(light, "recipe").select(*out))


def _stays():
    return F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bits: int = 256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after each run of blanks [space, tab to carriage return] is made one space. keep_id
    is the smallest id of the group that is not null (null if it has none), and exactly one row of a group is kept: of
    several with that id one whose text has the smallest digest. Repeated rows are all in the group's size. Null counts as empty; the
    empty text has the empty recipe. Very long texts are cut like others. An empty table gives no rows. Chunk identifiers are verified before
    the recipes are compared; if one stood for two contents, the job would stop with an error rather than merge different
    texts. Other columns are ignored.
    """
    nth = F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("nth")
    every = _grouped(docs, id_col, text_col, bits).select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", _stays().alias("stays"), "text_sha256", nth)
    return every.select("doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("nth") == 1)).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bits: int = 256) -> DataFrame:
    """The rows of docs that stay, columns unchanged: of each group of equal texts the one row that exact_groups keeps."""
    told = _grouped(docs, id_col, text_col, bits).select("doc_id", "text_key", (~_stays()).alias("gone"), "rows")
    return without(docs, id_col, text_col, told)


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST, sha256(raw)) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""
