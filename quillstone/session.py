"""The shared folder, and tables written to it to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where a session on one machine names none, a folder is made and set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quillstone-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Rows of a few values each up to which a table is joined by a broadcast.
BROADCAST_ROWS = 50_000


def looked_up(rows: DataFrame, few: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined to the staged ``few``: by a broadcast where it is that, else by a join whose hot keys Spark splits."""
    return rows.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, on, how)


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` in equal shares, a few for each core: for work that takes long for its few bytes, such as a file for each row."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def written(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/quillstone/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
