"""Schemas of the engine's tables; no schema is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

EVIDENCE = T.StructType(
    [
        T.StructField("hash", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("file_count", T.LongType()),
        T.StructField("weight", T.DoubleType()),
    ]
)
RENAMES = T.ArrayType(T.StructType([T.StructField("old_path", T.StringType()), T.StructField("new_path", T.StringType())]))
BASKETS = T.StructType(
    [
        T.StructField("ord", T.LongType()),
        T.StructField("hash", T.StringType()),
        T.StructField("unix_time", T.LongType()),
        T.StructField("date", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("files", T.ArrayType(T.StringType())),
        T.StructField("renames", RENAMES),
    ]
)
CHANGED_SET = T.StructType([T.StructField("path", T.StringType()), T.StructField("history_path", T.StringType())])
