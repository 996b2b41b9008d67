"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tallyaudit", cpus: str | int = "*", shuffle: int = 8) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def use_utc(spark: SparkSession) -> None:
    """Every clock rule is defined on UTC instants plus an explicit offset."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    A fresh local folder is used only by a single-machine session that names none; any other master must
    set ``spark.checkpoint.dir``, since its executors do not share local disks.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tallyaudit-ckpt-")
    sc.setCheckpointDir(path)
    return path


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for ``name`` under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    It is computed once, survives lost executors, and carries its real size, so the optimizer
    chooses between a broadcast and a shuffled join from a measured number.
    """
    spark = df.sparkSession
    path = shared_folder(spark, "tables")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
