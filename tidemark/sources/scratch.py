"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where the shared folder is a file system of the kernel, files have no checksum files beside them: parquet has its own,
#: and each file more is a process that sets its permissions.
WRITING = {"compression": "zstd", "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
_OWN_DIR: list[str] = []
_BASES: dict[str, SparkSession] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a temporary one only where Spark runs in one process."""
    said = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if said:
        return said.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
    if not _OWN_DIR:
        own = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _OWN_DIR.append(f"file://{own}")
    return _OWN_DIR[0]


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def clean_up() -> None:
    """Deletes the tables of this process, which returned plans may have read until now."""
    while _BASES:
        base, spark = _BASES.popitem()
        with contextlib.suppress(Exception):  # the cluster may be gone
            _remove(spark, base)


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive the loss of executors.

    A table that the returned plan still reads must stay; ``drop`` removes those that are no longer read, and all go
    when the process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        _BASES[self.base] = spark

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.n}"
        self.n += 1
        df.write.options(**WRITING).parquet(path)
        out = df.sparkSession.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # keeps the frame and its path together
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            _remove(self.spark, path)
