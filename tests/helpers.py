from pyspark.sql import functions as F


def column_values(spark, values, fn, dtype="string"):
    """Evaluate ``fn(col)`` over one-column rows, keeping input order."""
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, x {dtype}")
    out = df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in out]
