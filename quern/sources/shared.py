"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in spark.checkpoint.dir. Where that is unset, in a temporary folder if the master is local, else an error:
    a machine's own folder isn't seen by others."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("quern.shared.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("quern.shared.dir", folder)
    return f"{folder.rstrip('/')}/quern-{what}-{uuid.uuid4().hex}"
