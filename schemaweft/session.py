"""Session construction and the shared folder for files that outlive a stage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("schemaweft")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """A fresh path under the folder the session names in ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) is a local folder made
    and set, so that later calls and ``checkpoint()`` use the same one. On a cluster that
    would leave parts on executors' own disks, so it is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        base = tempfile.mkdtemp(prefix="schemaweft-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/schemaweft-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write an intermediate result that several branches read, and read it back.

    The table lies in the shared folder, so it survives the loss of executors, and what
    follows is planned over a scan instead of over copies of everything before it.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """Join this side by sorting and merging: it has rows for every column or pair of the catalog.

    Spark estimates it by the size of the files below it, which hold repeated names in few bytes
    and tell nothing of rows that an explode makes; a broadcast would put all of it into the driver.
    """
    return df.hint("merge")
