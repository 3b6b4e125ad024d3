"""Spark session helpers.

The library never creates its own cluster settings beyond what a job needs:
AQE on (coalescing + skew join), UTC session time zone, UI off for batch runs.
``checkpoint_dir`` reads ``spark.checkpoint.dir`` from the session and only
sets a local scratch folder when the cluster did not name one (tests).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "tabloom", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts: the cluster's ``spark.checkpoint.dir``.

    A local session (tests) that names none gets a scratch folder; on a cluster a
    machine-local folder would lose files, so there it is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not current:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="tabloom-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", current)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def _tables_dir(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/tables-{spark.sparkContext.applicationId}"


def materialize(df):
    """Cut lineage before a multi-pass fit: write the frame as a Parquet table
    in the shared checkpoint folder and read it back (survives executor loss,
    never localCheckpoint; later passes read only the columns they use).
    ``release`` deletes an application's tables."""
    path = f"{_tables_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)      # known: no job to infer it


def release(spark: SparkSession) -> None:
    """Delete all tables that ``materialize`` wrote in this application. Frames read
    from them can't be used afterwards: call it when their results are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
