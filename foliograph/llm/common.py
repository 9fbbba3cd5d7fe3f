"""Helpers shared by the operators of this subpackage: shared-folder tables and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its measured row count is at most this.
BROADCAST_ROWS = 20_000
#: Copies of each small row when the rows of one join key may be a large part of all rows.
SALTS = 16
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset a local master gets a temporary one, and a cluster an error."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = context.getCheckpointDir()
    return folder


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives lost executors."""
    return _written(df, table_path(df.sparkSession, tag))


def table_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str) -> DataFrame:
    with _shuffles_released(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark deletes an execution's shuffle files as soon as it ends. A table's writing is planned anew each time, so nothing reads them later."""
    before = spark.conf.get(_RELEASE, "false")
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(_RELEASE, before)


class Scratch:
    """Tables that only an operator's own later tables are made from; `clear` deletes them once those are written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, tag: str) -> DataFrame:
        path = table_path(self.spark, tag)
        self.paths.append(path)
        return _written(df, path)

    def clear(self) -> None:
        context = self.spark.sparkContext
        for path in self.paths:
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
        self.paths = []


#: Bytes as words see them: a-z, 0-9 and all bytes beyond ASCII as they are, A-Z lower-cased, everything else a space.
_WORD_BYTES = bytes(b if chr(b).isalnum() else 32 for b in range(128)).lower() + bytes(range(128, 256))
_WORD_PART = 4_000_000


def ascii_words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, maximal runs of letters, digits and characters beyond ASCII with A-Z lower-cased, some million bytes at a time."""
    spaced, at = text.translate(_WORD_BYTES), 0
    while len(spaced) - at > _WORD_PART and (cut := spaced.find(b" ", at + _WORD_PART)) > 0:
        yield spaced[at:cut].split()
        at = cut
    yield (spaced[at:] if at else spaced).split()


def in_row(docs: DataFrame, *, without: tuple[str, ...] = (), **columns: Column) -> DataFrame:
    """docs as one struct `row` of all its columns, with named columns beside it: whatever docs' columns are called, they clash with none."""
    names = [c for c in docs.columns if c not in without]
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def out_of_row(df: DataFrame, names: list[str], **changed: Column) -> DataFrame:
    """The columns `names` of `row` again, some of them changed."""
    return df.select(*[(changed[c] if c in changed else F.col("row").getField(c)).alias(c) for c in names])


def one_of_each(rows: DataFrame, names: list[str]) -> DataFrame:
    """One row of those of `in_row` that repeat a doc_id and its text: that whose other columns come first as JSON."""
    rest = F.to_json(F.struct(F.lit(0).alias("none"), *[F.col("row").getField(c) for c in names if c not in ("doc_id", "text")]))
    text = F.sha2(F.coalesce(F.col("row.text").cast("string"), F.lit("")), 256)
    return rows.groupBy(F.col("row.doc_id"), text, F.col("row.text").isNull()).agg(F.min_by("row", rest).alias("row"))


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star steps.

    edges: (a long, b long); self-loops, repeats, either direction and nulls (dropped) are fine.
    Returns (node long, component long): a row for every node that has an edge, component being the smallest
    node reachable. The number of rounds grows with the logarithm of the longest chain. Each round's edges are
    written and the ones before deleted: a checkpointed table keeps the size that Spark estimated for its plan, and estimates of joins
    are products, so its digits went up fourfold with every round. Neighbours of a hub are dealt over SALTS tasks. Joins exchange both sides.
    """
    held = Scratch(edges.sparkSession)
    found = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = held.written(found.distinct(), "edges")
    seen = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _with_least(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, low).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        after = Scratch(edges.sparkSession)
        e = after.written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        held.clear()
        held = after
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).hint("merge")


def _with_least(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """pairs (u, v) with the m of u; the pairs of a hub u are dealt over SALTS tasks. Spark's estimate of the salted side has one copy of each row, so without the hint it sends SALTS times what the threshold allows through the driver."""
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    return pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(salted, ["u", "salt"])


def whole_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows sorted by their first `keys` columns (numbers) as tables that never cut a run of equal keys; holds one run besides a batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        if held and any(c[0] != held[-1].column(i)[-1].as_py() for i, c in enumerate(columns)):
            yield pa.Table.from_batches(held)
            held = []
        other = np.zeros(batch.num_rows, bool)
        for c in columns:
            other |= c != c[-1]
        last = int(np.nonzero(other)[0][-1]) + 1 if other.any() else 0
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def run_bounds(table: pa.Table, keys: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal keys."""
    change = np.zeros(max(0, table.num_rows - 1), bool)
    for i in range(keys):
        change |= np.diff(table.column(i).to_numpy()) != 0
    cut = np.nonzero(change)[0] + 1
    return np.r_[0, cut], np.r_[cut, table.num_rows]


def paired_chunks(rows: DataFrame, keys: list[str], by: str, chunk: int) -> DataFrame:
    """rows with (i, j, side): the members of a key's list are dealt by hash of `by` to chunks of about `chunk`, and a list of several chunks has
    a group for each pair i <= j, in which side 0 holds chunk i and side 1 chunk j. So all pairs of a list meet, and no group holds more than two chunks.

    The table of long lists has at most rows / chunk rows; it is broadcast when its measured count is at most BROADCAST_ROWS.
    """
    lists = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("_chunks"))
    lists = written(lists.filter("_chunks > 1"), "long_lists")
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    joined = rows.join(F.broadcast(lists) if lists.count() <= BROADCAST_ROWS else lists, same, "left")
    n = F.coalesce("_chunks", F.lit(1))
    joined = joined.withColumn("_own", F.pmod(F.xxhash64(by), n).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), n - 1)))
    return joined.select(*rows.columns, F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), F.when(F.col("_own") <= F.col("_other"), 0).otherwise(1).alias("side"))


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, those with the smallest hashed `key` (ties by the other columns).

    A counted share of the hash range is cut off first, so that all tasks together send little more than `most` rows.
    """
    n = rows.count()
    h = F.xxhash64(key)
    if n > most:
        rows = rows.filter(F.pmod(h, F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, 1.2 * most / n)) + 1))
    return rows.orderBy(F.pmod(h, F.lit(1_000_000)), h, *rows.columns).limit(most)
