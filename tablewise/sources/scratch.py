"""The shared folder for tables that a job writes and reads back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class NoSharedFolderError(RuntimeError):
    """The session names no folder that driver and executors share."""


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the session's ``spark.checkpoint.dir``.

    What is written there stays: a table that was read from it may still be in use.  Clear
    the ``tablewise`` folder between jobs.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        raise NoSharedFolderError(
            "set spark.checkpoint.dir to a folder that driver and executors share"
        )
    return f"{base.rstrip('/')}/tablewise/{uuid.uuid4().hex}/{name}"
