"""Sums kept over micro-batches give the batch engine's pair scores."""

from tandem.config import Options
from tandem.operators import graph
from tandem.schema import BASKETS
from tandem.streaming import incremental

from .test_operators import DAY, baskets

ALL = Options(max_items=80, max_baskets=0)


def test_stream_equals_batch(spark, tmp_path):
    whole = baskets(spark, ("h3", 365, "abc"), ("h2", 200, "ab"), ("h1", 100, "bcde"), ("h0", 0, "ac"))
    for i in range(4):
        whole.where(f"ord = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(BASKETS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = incremental.maintain(stream, str(tmp_path / "out"), 100 * DAY, ALL, str(tmp_path / "cp"))
    assert query.awaitTermination(120)
    got = incremental.scored_pairs(spark, str(tmp_path / "out"), 100 * DAY, 365 * DAY, ALL)
    want = graph.scored_pairs(graph.pair_stats(whole, ALL), graph.item_stats(whole, ALL))
    rows = lambda df: {(r.a, r.b): (r.cochanges, round(r.weight, 9), round(r.score, 9), r.last_seen) for r in df.collect()}
    assert rows(got) == rows(want)
