"""Shared folders for data that must outlive an executor."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir``, else the warehouse. A warehouse on a local disk counts
    only where the session runs in one process; on a cluster it raises.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    local_disk = warehouse.startswith(("file:", "/")) or ":" not in warehouse
    if local_disk and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir: the warehouse is on a local disk")
    return f"{warehouse.rstrip('/')}/_scratch"


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder under the shared root."""
    return f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
