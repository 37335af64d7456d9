"""DataFrames as names in SQL text, without string formatting (encoded phonemes hold braces)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def query(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """Run SQL in which ``@name@`` stands for a given DataFrame. Views live only while the query is analysed."""
    views = {name: f"v_{name}_{uuid.uuid4().hex[:10]}" for name in frames}
    try:
        for name, df in frames.items():
            df.createOrReplaceTempView(views[name])
            text = text.replace(f"@{name}@", views[name])
        return spark.sql(text)
    finally:
        for v in views.values():
            spark.catalog.dropTempView(v)
