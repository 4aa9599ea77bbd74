"""Cutting lineage in loops: reliable checkpoints in the folder that the cluster names."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame

_own: list[tempfile.TemporaryDirectory] = []


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` and written: what groups, joins or windows it by them, with another table dealt so, needs no further exchange."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartition(n, *keys))


def _folder(spark) -> str:
    """The context's checkpoint folder, set on first use."""
    if spark.sparkContext.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            master = spark.conf.get("spark.master", "")
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            _own.append(tempfile.TemporaryDirectory(prefix="ductwise-"))
            atexit.register(_own[-1].cleanup)
            path = f"file://{_own[-1].name}"
        spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back; in local mode without one, to a temporary folder."""
    _folder(df.sparkSession)
    return df.checkpoint()


def sized(df: DataFrame) -> DataFrame:
    """``df`` written there as a Parquet table: joins then know its true size and send a small one to all tasks instead of dealing what it meets by key."""
    path = f"{_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
