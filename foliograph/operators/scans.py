"""Running aggregates over the rows of a document in two levels, so that no task needs the whole of a long one.

Rows carry `block`, the number of a stretch of BLOCK positions. Values run inside a block first; blocks' totals, one row each, run over the document then and are joined to the block's rows. Rows and totals share
the partitioning by (doc_id, block), so the rows are exchanged once, whatever number of scans follows. doc_id is not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024


def blocked(df: DataFrame, position: str) -> DataFrame:
    """df with block, by a position that counts a document's rows."""
    return df.withColumn("block", F.floor(F.col(position) / BLOCK))


def running(df: DataFrame, order: str, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, segment: str | None = None, before: bool = False) -> DataFrame:
    """df (doc_id, block, ...) with running sums and last values that aren't null, up to each row or (before) up to the one before it, of the document or of a `segment` of it.

    `order` is unique in a document and ascends with the blocks; a segment's rows lie together, so only a block's first segment has rows in an earlier block.
    """
    sums, lasts = sums or {}, lasts or {}
    part = [segment] if segment else []
    inside = Window.partitionBy("doc_id", "block", *part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    earlier = Window.partitionBy("doc_id", *part).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("doc_id", "block", *part).agg(*[F.sum(c).alias(n) for n, c in sums.items()], *[F.max_by(c, F.when(c.isNotNull(), F.col(order))).alias(n) for n, c in lasts.items()])
    totals = totals.select(
        F.col("doc_id").alias("_d"), F.col("block").alias("_b"), *[F.col(p).alias("_s") for p in part], F.count(F.lit(1)).over(earlier).alias("_n"),
        *[F.sum(n).over(earlier).alias(f"_{n}") for n in sums], *[F.last(n, True).over(earlier).alias(f"_{n}") for n in lasts],
    ).filter("_n > 0")
    own = df.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()} | {n: F.last(c, True).over(inside) for n, c in lasts.items()})
    both = own.join(totals, (F.col("doc_id") == F.col("_d")) & (F.col("block") == F.col("_b")), "left")
    mine = lambda c: F.when(F.col("_s") == F.col(segment), F.col(c)) if segment else F.col(c)
    zero = F.lit(0)
    out = {n: F.coalesce(F.col(n), zero) + F.coalesce(mine(f"_{n}"), zero) for n in sums} | {n: F.coalesce(F.col(n), mine(f"_{n}")) for n in lasts}
    return both.withColumns(out).select(*df.columns, *out)
