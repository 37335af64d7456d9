"""Running sums and row numbers over groups of any size, without one task for a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.workspace import Workspace

#: Rows of a window partition, at most about; fewer where that gives every shuffle partition some.
BUCKET_ROWS = 16_384


def running(df: DataFrame, keys: list[str], order: Column, weight: Column, out: str, rows: int, ws: Workspace, name: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``out``: the sum of ``weight`` over earlier rows of the same keys; and the sums per key and bucket.

    ``order`` is a 64-bit hash of a unique row id: rows of a key are cut by it into buckets of about BUCKET_ROWS
    rows or less, whose sums are added up first. ``rows`` is the number of rows of df. The result does not depend on
    the number of buckets.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, -(-rows // BUCKET_ROWS), min(rows, 4 * parts))
    place = F.least(F.floor((order.cast("double") / F.lit(2.0**64) + 0.5) * buckets), F.lit(buckets - 1)).cast("int")
    cut = df.withColumn("_order", order).withColumn("_weight", weight).withColumn("_bucket", place)
    sums = ws.table(name, cut.groupBy(*keys, "_bucket").agg(F.sum("_weight").alias("_sum")))
    upto = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = sums.withColumn("_before", F.sum("_sum").over(upto) - F.col("_sum")).drop("_sum")
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cut.withColumn("_inside", F.sum("_weight").over(inside) - F.col("_weight")).join(offsets, [*keys, "_bucket"])
    return placed.withColumn(out, F.col("_before") + F.col("_inside")).select(*df.columns, out), sums
