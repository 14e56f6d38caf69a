"""The shared scratch folder, and tables that are written there to cut lineage."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no checkpoint folder, as in local tests.
LOCAL_SCRATCH = "/tmp/checkpoints/linkloom"
#: Rows of a table of ids that is sent to every executor at most, some 32 MB.
BROADCAST_ROWS = 1 << 20
#: Spark's setting by which a finished query removes its shuffle files.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """Folder shared by the driver and all executors (``spark.checkpoint.dir``)."""
    conf = spark.sparkContext.getConf()
    root = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{LOCAL_SCRATCH}"


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of ``path``, and ``path`` for it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


#: The paths of each open ``scope``, innermost last.
_scopes: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed at the end of the ``scope`` or, at the latest, when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    system, at = file_system(spark, path)
    system.deleteOnExit(at)
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes what was written to the scratch folder inside it; results must have been written elsewhere by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            system, at = file_system(spark, path)
            system.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    system, at = file_system(spark, path)
    return system.exists(at)


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside it go as soon as it is written, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    It cuts the lineage: a lost executor costs a re-read and never a recomputation
    of what stands before.
    """
    path = scratch_path(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_partitions(df: DataFrame, column: str, n: int) -> DataFrame:
    """``df`` with a note that its rows are dealt out by ``column`` over ``n`` partitions; the note goes along when it is written."""
    return df.withMetadata(column, {"partitions": n})


def partitions_by(df: DataFrame, column: str) -> int:
    """Over how many partitions ``df`` is dealt out by ``column``: as ``in_partitions`` noted, else Spark's shuffle partitions."""
    return df.schema[column].metadata.get("partitions") or shuffle_partitions(df.sparkSession)


def dealt(df: DataFrame, name: str, column: str) -> DataFrame:
    """``materialise`` in one bucket per partition (see ``partitions_by``), so that joins by ``column`` read the rows as they lie.

    Buckets need a table's entry in the catalog; it goes at once, the files stay to the end.
    """
    spark = df.sparkSession
    path, table = scratch_path(spark, name), f"linkloom_{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.bucketBy(partitions_by(df, column), column).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table)
    written = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return written


def stored(df: DataFrame, path: str, compression: str = "zstd") -> DataFrame:
    """``df`` as Parquet at ``path``: written unless it is there whole, and read back.

    The commit protocol marks a whole folder by its ``_SUCCESS`` file.
    """
    spark = df.sparkSession
    if not exists(spark, f"{path}/_SUCCESS"):
        with tidy(spark):
            df.write.mode("overwrite").option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept_out(rows: DataFrame) -> DataFrame:
    """``rows`` marked so that a join sorts both sides and never sends them whole through the driver.

    For rows that are unfolded from lists or read from well compressed files: Spark takes them
    for as large as those files, and the table it would build in the driver's memory can be
    tens of times that.
    """
    return rows.hint("merge")


def bounded(ids: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``ids`` marked for broadcast if it has no more than ``rows`` rows, else as it is.

    ``ids`` should be a written table, whose rows are counted from its files' footers. A
    larger one is joined by whatever plan Spark picks.
    """
    return F.broadcast(ids) if ids.count() <= rows else ids
