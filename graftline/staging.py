"""Written intermediate tables, for results that are read more than once.

A staged table is Parquet in the folder that ``spark.checkpoint.dir`` names, which all executors
share.  It cuts the lineage, survives lost executors and is read back column by column.  ``release`` deletes a table that
is not needed any more; what is left goes when the driver's JVM ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own: dict[str, str] = {}


def staging_root(spark: SparkSession) -> str:
    """The shared folder; a local one of our own only where the setting is absent on a local master."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own[app] = tempfile.mkdtemp(prefix="graftline-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


#: With this, Spark removes a query's shuffle files when the query ends instead of when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _writers, _before = threading.Lock(), 0, "false"


class _CleanShuffles:
    """The setting holds while any thread writes, and is put back by the last."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        global _writers, _before
        with _lock:
            if _writers == 0:
                _before = self.spark.conf.get(_CLEANUP, "false")
                self.spark.conf.set(_CLEANUP, "true")
            _writers += 1

    def __exit__(self, *_):
        global _writers
        with _lock:
            _writers -= 1
            if _writers == 0:
                self.spark.conf.set(_CLEANUP, _before)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder's path below the staging folder; it goes when the driver's JVM ends."""
    path = f"{staging_root(spark)}/graftline-{name}-{uuid.uuid4().hex}"
    fs, at = _file_system(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def _write(df: DataFrame, path: str) -> None:
    with _CleanShuffles(df.sparkSession):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once and return the written table; the shuffle files of the write are not needed any more."""
    path = new_folder(df.sparkSession, name)
    _write(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete staged tables; nothing that reads them may run afterwards."""
    for df in tables:
        fs, at = _file_system(df.sparkSession, df._staged)
        fs.delete(at, True)


def _relaxed(t: T.DataType) -> T.DataType:
    """The type with nulls allowed everywhere."""
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_relaxed(t.elementType))
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _relaxed(f.dataType)) for f in t])
    return t


class Rounds:
    """A table that grows by rounds: each is written once, and the whole is read from one folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n, self.schema = spark, new_folder(spark, name), 0, None

    def add(self, df: DataFrame) -> DataFrame:
        """Write the next round and return it."""
        if self.schema is None:
            self.schema = _relaxed(df.schema)
        path = f"{self.path}/round={self.n}"
        _write(df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]), path)
        self.n += 1
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        """All rounds so far."""
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(self.path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
