"""The Spark session as this engine wants it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder of each session of one machine that names none.
_own_dirs: dict[str, str] = {}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """master: None leaves it to spark-submit, or takes all cores of this machine where nothing is set."""
    builder = SparkSession.builder.appName("notemill")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | ({"spark.sql.shuffle.partitions": str(os.cpu_count() or 4)} if master and master.startswith("local") else {})
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session of one machine has a
    temporary folder; on a cluster that can't work, and is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if context.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
    if context.applicationId not in _own_dirs:
        made = tempfile.mkdtemp(prefix="notemill-")
        atexit.register(shutil.rmtree, made, True)
        _own_dirs[context.applicationId] = "file://" + made
    return _own_dirs[context.applicationId]


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, so that its lineage ends there and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/notemill-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
