"""Shared folder of a session, and lineage cut there."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="skein-graph-")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset, a local one, and on a cluster an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir isn't set: a cluster needs a folder that all executors share")
    base = base or "file://" + _own_folder()
    return f"{base.rstrip('/')}/graph-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: loops keep a short lineage and survive lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
