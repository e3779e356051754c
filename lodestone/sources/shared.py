"""The folder that driver and executors share, named by spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only local sessions may go without one and get a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/lodestone/{label}-{uuid.uuid4().hex}"


class Folder:
    """A folder on any file system that Spark reads, seen from the driver: names, existence, removal."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._make = spark._jvm.org.apache.hadoop.fs.Path
        self.path = path.rstrip("/")
        self._fs = self._make(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def has(self, name: str = "") -> bool:
        return self._fs.exists(self._make(f"{self.path}/{name}" if name else self.path))

    def names(self, name: str = "") -> list[str]:
        at = f"{self.path}/{name}" if name else self.path
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._make(at))) if self.has(name) else []

    def remove(self, name: str) -> None:
        self._fs.delete(self._make(f"{self.path}/{name}"), True)
