"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate tables.

    It is read from ``spark.checkpoint.dir``.  Where that is unset a local master
    gets a temporary folder of this process; on a cluster, whose executors would each
    write to their own disk, it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="lithoframe-")
    return _own_dir[app]


def remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder that goes when the application ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(remove, spark, path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts lineage so that a lost executor costs only the tasks it ran, and
    gives later stages column pruning and exact sizes.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed_table(spark: SparkSession, path: str, columns: str, keys: list[str], buckets: int) -> str:
    """Name of a table stored under ``path`` in buckets of ``keys``; what is stored there already is part of it.

    A join on the keys reads such a table in place: only the other side is shuffled.
    """
    name = "stored_" + hashlib.md5(path.encode(), usedforsecurity=False).hexdigest()
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({', '.join(keys)}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return name


def append(df: DataFrame, name: str) -> None:
    """Add rows to a table of `bucketed_table`."""
    df.select(df.sparkSession.table(name).columns).write.insertInto(name)
