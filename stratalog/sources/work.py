"""A place for logs that queries make: in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from ..errors import InvalidArgumentError


def work_path(spark: SparkSession, name: str) -> str:
    """A new place for a log; it is deleted when the application ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise InvalidArgumentError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/stratalog-logs/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(target)
    files.deleteOnExit(target)
    return path
