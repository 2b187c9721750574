"""Tables that are used several times, written once to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a list of ids that are sent to every task at most; beyond it, both sides of a join are shuffled.
SENT = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, in local mode alone, an own folder where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lectern-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and read again; a lost executor costs nothing that was finished."""
    path = f"{shared_dir(df.sparkSession)}/lectern-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent(ids: DataFrame) -> DataFrame:
    """ids, which is written or small, for a join with a large table: sent to every task, so that the table stays where it
    lies and is not written for a shuffle."""
    return F.broadcast(ids) if ids.count() <= SENT else ids
