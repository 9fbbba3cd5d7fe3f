"""Tables in the folder that driver and executors share: they cut a plan's lineage and outlive lost executors."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset a local master gets a temporary one, and a cluster an error."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = context.getCheckpointDir()
    return folder


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder. Its writing leaves no shuffle files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    with _shuffles_released(spark):
        df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark deletes an execution's shuffle files as soon as it ends, not when the driver happens to collect its garbage. A table's writing is planned anew each time, so nothing reads them later."""
    before = spark.conf.get(_RELEASE, "false")
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(_RELEASE, before)


def dropped(df: DataFrame) -> None:
    """Deletes the table that `written` or `kept` made of df; only tables that are written already may have been made from it."""
    context = df.sparkSession.sparkContext
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def kept(df: DataFrame, tag: str) -> DataFrame:
    """df written, for tables that grow with the input: joins exchange and sort both sides, so none is sent through the driver to every executor while its files happen to be small."""
    return written(df, tag).hint("merge")


#: What a table may hold that is sent to every executor.
MOST_SMALL = 500_000


def small(df: DataFrame, entries: Column | None = None) -> DataFrame:
    """df, to be sent to every executor if it is counted to hold at most MOST_SMALL rows (or entries, where a row holds many); beyond that joins exchange both sides."""
    n = df.agg(F.sum(F.lit(1) if entries is None else F.greatest(entries, F.lit(1)))).first()[0] or 0
    return F.broadcast(df) if n <= MOST_SMALL else df


#: Documents that a task cuts: the work on a text is large beside its bytes, so tasks by bytes would be few and long.
TASK_DOCS = 2000


def spread(df: DataFrame, key: str) -> DataFrame:
    """df by key in tasks of about TASK_DOCS rows, at least one for each core."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_DOCS)), key)


def once(build):
    """build(spark, ...) is run once for each application and its arguments; the tables that it writes are shared by all queries of a session."""
    built: dict[tuple, object] = {}

    @functools.wraps(build)
    def get(spark: SparkSession, *args, **kwargs):
        key = (spark.sparkContext.applicationId, id(spark), args, tuple(sorted(kwargs.items())))
        if key not in built:
            built[key] = build(spark, *args, **kwargs)
        return built[key]

    return get
