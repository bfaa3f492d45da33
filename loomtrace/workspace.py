"""Where intermediate tables live between the jobs of one multi-job operator.

Lineage is cut by writing a parquet table into the shared folder that the cluster
names in ``spark.checkpoint.dir`` and reading it back, so a lost executor costs at
most a re-read, and a later step reads only the columns it needs.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; on a local master only, a temporary one."""
    folder = spark.conf.get(_CHECKPOINT_DIR, None)
    if folder:
        return folder
    master = spark.conf.get("spark.master", "local")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set {_CHECKPOINT_DIR} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="loomtrace-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set(_CHECKPOINT_DIR, folder)
    return folder


class Workspace:
    """A private subfolder of the shared folder, deleted by ``close`` or when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/loomtrace-{uuid.uuid4().hex}"
        self._count = 0
        # What nobody closes goes when the driver's JVM ends.
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` out, counting its rows on the way, and return a scan of the table."""
        self._count += 1
        path = f"{self.root}/{self._count:04d}-{name}"
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved._loomtrace_path = path
        saved._loomtrace_rows = seen.get["rows"]
        return saved

    def drop(self, saved: DataFrame) -> None:
        """Delete a table that no live DataFrame reads any more."""
        self._delete(saved._loomtrace_path)

    def close(self) -> None:
        """Delete every table of this workspace."""
        self._delete(self.root)

    def _delete(self, folder: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def row_count(df: DataFrame) -> int:
    """The number of rows: known for a saved table, counted otherwise."""
    known = getattr(df, "_loomtrace_rows", None)
    return df.count() if known is None else known
