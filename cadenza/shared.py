"""Tables written to the folder that all machines share, so that a plan uses a result twice without computing it twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on one machine."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    already = spark.sparkContext._jsc.sc().getCheckpointDir()
    if already.isDefined():
        return already.get().rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="cadenza-"))
    return _local[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: its lineage is cut, and lost executors cost nothing."""
    spark = df.sparkSession
    at = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)
