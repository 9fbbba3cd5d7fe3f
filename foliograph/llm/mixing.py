"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of all characters over its present share. Each document's
count comes from inverting the Poisson distribution of that rate at a uniform number hashed from (seed, doc_id); the row is exploded
by its count, and all copies are dealt to partitions and ordered inside them by a second hash: a global shuffle with one exchange.

Rules for odd rows: a null source is a source of its own; a null doc_id hashes like the text 'null'; null and
empty texts have no characters but are replicated at their source's rate; a source without any character keeps each row
once; rows with the same doc_id get the same count, each for itself; an empty table gives an empty one. Extra
columns pass through, whatever their names; columns named copy_no or shuffle_key are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import BROADCAST_ROWS, SALTS, in_row, written

SEED = "mix-1"
#: Target weights of the query; other sources weigh DEFAULT_WEIGHT. The mixture has as many characters as the input.
WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 0.5, "src3": 0.0}
DEFAULT_WEIGHT = 1.0
_BITS = 52


def _hashed(*parts: Column | str) -> Column:
    """A long of 52 bits from the MD5 of the parts joined by ':'."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, _BITS // 4), 16, 10).cast("long")


def rates(docs: DataFrame, weights: dict[str, float], default: float, budget: float = 1.0) -> DataFrame:
    """(mix_source, rate) per source: rate = budget * all characters * share of the source / its characters. Partial sums come before the shuffle."""
    chars = docs.groupBy(F.col("source").alias("mix_source")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("chars"))
    weight = F.lit(float(default))
    for name, value in weights.items():
        weight = F.when(F.col("mix_source") == name, float(value)).otherwise(weight)
    chars = written(chars.withColumn("w", weight), "sources")
    total = chars.agg(F.sum("chars").alias("all_chars"), F.sum("w").alias("all_w"))
    rate = F.when(F.col("chars") == 0, 1.0).otherwise(budget * F.col("all_chars") * (F.col("w") / F.col("all_w")) / F.col("chars"))
    return chars.crossJoin(F.broadcast(total)).select("mix_source", rate.alias("rate"))


def poisson_bounds(rate: Column) -> Column:
    """The distribution function at 0, 1, 2, ...: as far as any 52-bit uniform number reaches."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    zero = F.struct(F.lit(0.0).alias("log_fact"), F.lit(0.0).alias("c"), F.array().cast("array<double>").alias("cs"))

    def step(acc: Column, j: Column) -> Column:
        log_fact = acc["log_fact"] + F.when(j > 0, F.log(j.cast("double"))).otherwise(0.0)
        c = acc["c"] + F.exp(j * F.log(rate) - rate - log_fact)
        return F.struct(log_fact.alias("log_fact"), c.alias("c"), F.concat(acc["cs"], F.array(c)).alias("cs"))

    return F.when(rate <= 0, F.array(F.lit(2.0))).otherwise(F.aggregate(F.sequence(F.lit(0), last), zero, step, lambda a: a["cs"]))


def mix(docs: DataFrame, weights: dict[str, float] = WEIGHTS, default: float = DEFAULT_WEIGHT, budget: float = 1.0, seed: str = SEED) -> DataFrame:
    """docs replicated to the target weights, with copy_no (from 1) and shuffle_key, in globally shuffled order.

    The table of rates has a row per source. It is broadcast when its measured count is at most BROADCAST_ROWS; beyond that it
    is joined with each source's rows dealt over SALTS tasks.
    """
    per_source = written(rates(docs.select("source", "text"), weights, default, budget).select("mix_source", poisson_bounds(F.col("rate")).alias("mix_bounds")), "rates")
    names = [c for c in docs.columns if c not in ("copy_no", "shuffle_key")]
    rows = in_row(docs, without=("copy_no", "shuffle_key"), id=F.col("doc_id"), source=F.col("source"))
    same = F.col("source").eqNullSafe(F.col("mix_source"))
    if per_source.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(per_source), same)
    else:
        salted = per_source.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = rows.withColumn("salt_of", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, same & (F.col("salt_of") == F.col("salt")))
    u = (_hashed(seed, F.col("id")) + F.lit(0.5)) / F.lit(float(2**_BITS))
    counted = joined.withColumn("u", u).withColumn("n", F.size(F.filter("mix_bounds", lambda c: c <= F.col("u"))))
    copies = counted.filter("n > 0").select("row", "id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy_no"))
    copies = copies.withColumn("shuffle_key", _hashed(f"{seed}-order", F.col("id"), F.col("copy_no")))
    dealt = copies.repartition("shuffle_key").sortWithinPartitions("shuffle_key", "id", "copy_no")
    return dealt.select(*[F.col("row").getField(c).alias(c) for c in names], "copy_no", "shuffle_key")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", "copy_no", "shuffle_key", "text")


def sql() -> str:
    weights = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items())
    hashed = lambda text: f"CAST('0x' || substr(md5({text}), 1, {_BITS // 4}) AS BIGINT)"
    return f"""
WITH s AS (SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS chars,
                  CASE source {weights} ELSE {DEFAULT_WEIGHT} END AS w FROM documents GROUP BY source),
r AS (SELECT source, CASE WHEN chars = 0 THEN 1.0 ELSE (SELECT sum(chars) FROM s) * (CAST(w AS DOUBLE) / (SELECT sum(CAST(w AS DOUBLE)) FROM s)) / chars END AS rate FROM s),
p AS (SELECT source, j, exp(j * ln(rate) - rate - lgamma(j + 1)) AS p
      FROM r, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 20) AS BIGINT) + 1)) AS t(j) WHERE rate > 0),
b AS (SELECT source, list(c ORDER BY j) AS bounds FROM (SELECT source, j, sum(p) OVER (PARTITION BY source ORDER BY j) AS c FROM p) GROUP BY source),
n AS (SELECT d.doc_id, d.source, d.text,
             len(list_filter(b.bounds, lambda x: x <= ({hashed(f"'{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')")} + 0.5) / {float(2**_BITS)})) AS n
      FROM documents d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, CAST(i AS INT) AS copy_no, {hashed(f"'{SEED}-order:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(i AS VARCHAR)")} AS shuffle_key, text
FROM n, unnest(range(1, n + 1)) AS t(i)"""
