"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("holdfast")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # Small inputs: keep all local cores busy. A cluster keeps its own values.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
        .config("spark.sql.files.openCostInBytes", str(128 * 1024))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``. Only a local master may do without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):  # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, parted_by: Sequence[str] = ()) -> DataFrame:
    """Write a shared intermediate as a table in the shared folder and read it back.

    This cuts the lineage, survives lost executors, and gives the readers a
    columnar table with a known size to prune and to choose joins by. With
    ``parted_by`` there is a folder per value, which readers of one value read alone.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/holdfast-{uuid.uuid4().hex}"
    df.write.partitionBy(*parted_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
