"""Session settings and the shared work folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "eventloom", **conf: str) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
        "spark.driver.bindAddress": "127.0.0.1",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``. Where it is unset, a session on one machine
    uses a folder below its warehouse folder; on a cluster that folder may be the driver's own, so
    the setting is asked for."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext.getCheckpointDir()
        if current is not None:
            return current
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/work"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, not yet existing sub-folder of the shared folder."""
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, dense: bool = False) -> DataFrame:
    """Write a frame to the shared folder and go on from the written table.

    The table survives lost executors, ends the lineage, and is read by column, so a frame used
    in several places is computed once. ``dense`` is for frames of many hashed ids, whose digits the
    usual compression leaves as they are.
    """
    path = fresh_dir(df.sparkSession, "step")
    (df.write.option("compression", "zstd") if dense else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
