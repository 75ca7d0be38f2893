"""Where streams keep their progress: the shared folder the session names."""

from __future__ import annotations

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """``<spark.checkpoint.dir>/<name>``; ValueError when the session names no folder.

    Only a local session, whose one machine shares everything, falls back to a folder of its application below /tmp.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = f"/tmp/sparktide-{spark.sparkContext.applicationId}"
    return f"{base.rstrip('/')}/{name}"
