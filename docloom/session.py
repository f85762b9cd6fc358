"""Session for local use and tests; on a cluster the caller's own session is used as it is."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, **settings: str) -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("DOCLOOM_DRIVER_MEMORY", "8g"),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | settings
    return SparkSession.builder.master(f"local[{cores}]").appName("docloom").config(map=conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names; a local session that names none gets one of its own, any other must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written as Parquet into the shared folder and read again: later plans begin at the files, whose sizes they know."""
    path = f"{shared_folder(df.sparkSession)}/docloom-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
