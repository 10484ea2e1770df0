"""Written intermediate tables in the folder that the whole cluster shares.

A lineage is cut by writing Parquet there and reading it back, so a lost executor costs only
the tasks it ran. The folder is `spark.checkpoint.dir`; only where that is unset and all tasks run in
one process (tests) one is made under the system's temporary folder, elsewhere it is an error.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="rulequarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_scopes: list[list[DataFrame]] = []


@contextmanager
def scratch(*keep: DataFrame):
    """Notes the tables that are made meanwhile; gives a list, and drops at the end all of them but those put into it."""
    made, kept = [], [*keep]
    _scopes.append(made)
    try:
        yield kept
    finally:
        _scopes.remove(made)
        stay = {x._scratch_path for x in kept}
        for table in made:
            if table._scratch_path not in stay:
                drop(table)


def _made(table: DataFrame) -> DataFrame:
    for scope in _scopes:
        scope.append(table)
    return table


def path_for(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished phases now, not at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder."""
    spark = df.sparkSession
    path = path_for(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return _made(back)


def drop(df: DataFrame) -> None:
    """Delete what written() or bucketed() made, once nothing reads it any more."""
    spark = df.sparkSession
    path = getattr(df, "_scratch_path", None)
    if table := getattr(df, "_scratch_table", None):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    if path:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def plain(df: DataFrame) -> DataFrame:
    """The rows of a bucketed table without its buckets, so that a join on a common key has an exchange to split."""
    return df.sparkSession.read.schema(df.schema).parquet(df._scratch_path)


@contextmanager
def sorted_buckets(spark: SparkSession):
    """What is planned meanwhile takes tables of bucketed(), which have one file a bucket, as sorted, and doesn't sort them again."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bucketed(df: DataFrame, key: str | list[str], name: str, buckets: int | None = None) -> DataFrame:
    """The same rows as a table hashed on `key` and sorted in each bucket: later joins on it need no exchange of this side."""
    spark = df.sparkSession
    key = [key] if isinstance(key, str) else key
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = path_for(spark, name)
    table = f"{name}_{uuid.uuid4().hex}"
    (
        df.repartition(n, *key)
        .write.bucketBy(n, *key)
        .sortBy(*key)
        .option("path", path)
        .option("compression", "zstd")
        .format("parquet")
        .saveAsTable(table)
    )
    release(spark)
    back = spark.table(table)
    back._scratch_path, back._scratch_table = path, table
    return _made(back)


def opened(spark: SparkSession, table: str, path: str, schema: str, key: list[str], buckets: int) -> DataFrame:
    """A table that bucketed() wrote, entered in this session's catalogue if it isn't there; schema: as simpleString() gives it."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromDDL(schema[len("struct<") : -1]))
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY ({', '.join(key)}) SORTED BY ({', '.join(key)}) INTO {buckets} BUCKETS LOCATION '{path}'")
    back = spark.table(table)
    back._scratch_path, back._scratch_table = path, table
    return back
