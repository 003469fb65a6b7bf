"""Session helpers shared by the bench, the checks and the tests."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the test data needs.

    On a cluster the session comes from the submit command; nothing in the
    library depends on these values.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tierlens")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as `spark.checkpoint.dir` names it.

    A local session that names none gets a temporary folder, set on the
    session; a cluster that names none is an error, because executors would
    write to their own disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder; what is written there is removed when the session's JVM ends."""
    path = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes an intermediate table once and reads it back.

    Cuts the lineage where several later steps read the same costly rows; a
    lost executor then re-reads files instead of recomputing.  Parquet keeps
    column pruning and filter pushdown for the readers.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equality join on columns of both sides in which null matches null; the keys come once, from the left."""
    renamed = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *[F.col(c) for c in right.columns if c not in keys])
    match = F.lit(True)
    for k in keys:
        match = match & left[k].eqNullSafe(renamed[f"_right_{k}"])
    return left.join(renamed, match, how).drop(*[f"_right_{k}" for k in keys])
