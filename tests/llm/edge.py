"""Documents that every operator must take: nulls, empty and wordless texts, ties, repeated rows, odd characters, clashing names."""

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
BASE = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, BASE), (2, BASE), (2, BASE), (3, BASE + " tail"), (4, None), (5, ""), (6, " \t\n "), (7, "one two"), (8, "one two"), (None, "null id text"),
    (9, "Ünï çödé 😀 " + BASE.upper()), (10, LONG), (11, LONG), (12, "a" * 5000), (13, "-- !! ??"), (14, "x\x00y \x01 z \x1c end"), (-15, "negative id"),
]
SCHEMA = "doc_id long, text string, score double, kept string, uid long, key long, lead long, label int, main string"


def frame(spark, rows=ROWS):
    """With further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 0.5, "k", 1, 2, 3, 4, "m") for r in rows], SCHEMA)
