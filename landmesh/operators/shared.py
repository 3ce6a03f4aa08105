"""The folder that driver and executors share, in which lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def ensure_checkpoints(spark: SparkSession) -> str:
    """The session's checkpoint folder; a new one only in a local session that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="landmesh-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{ensure_checkpoints(spark)}/{name}-{uuid.uuid4().hex}"
