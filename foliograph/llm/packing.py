"""Packing token sequences as a cutting-stock problem solved by column generation.

Each document is its token ids and an end id. Full pieces of LENGTH ids are sequences of their own. The rest of each document (its tail) is an item of a length class, GRAIN ids
wide. The linear program runs on the histogram of classes (LENGTH / GRAIN numbers, whatever the corpus): its columns are patterns of classes that
fit a sequence, a knapsack dynamic program prices new ones by the dual values, and patterns used x times are rounded down; what is left over is
packed by decreasing length. Tails are ranked inside their class, and a rank decides pattern, sequence and place by arithmetic.

Rounding lengths up leaves a few unused ids in each sequence. A share of the documents, chosen by hashed key and only as large as those gaps, is
held back as filler: their tails form one stream, cut wherever a gap ends. All other tails stay whole.

Rules for odd rows: a null or empty text is the end id alone; rows that repeat a doc_id are packed each for itself; a null doc_id is packed
like any other; a document longer than a sequence is cut into full pieces and a tail; an empty table gives no pieces; extra columns are not carried.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from types import ModuleType
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.llm.common import BROADCAST_ROWS, written

LENGTH, GRAIN, END_ID = 4096, 16, 2
CAPACITY = LENGTH // GRAIN
#: Rows of a chunk that prefix sums and ranks are dealt over.
CHUNK_ROWS = 50_000
_SHARES = 1000
_KEPT = 600_000
_BUCKET = 1024
VOCABULARY = "word_bpe_49k.json"


class Encoder:
    """Token ids by the tokenizers library, as little-endian unsigned 32-bit bytes.

    White space never joins two tokens of this vocabulary, so ids are kept for each space-separated word, up to _KEPT words. A text with characters whose
    normal form, case or spaces this rule doesn't cover, or with a special token's beginning, goes to the tokenizer whole.
    """

    _plain = re.compile("[^\x00-\x1b\x20-įı-ɏ]|<\\|").search

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        if self._plain(text):
            return self._whole([text])[0]
        words = text.lower().split()
        found = list(map(self.kept.get, words))
        if None in found:
            new = self._new(dict.fromkeys(w for w, f in zip(words, found) if f is None))
            found = [new[w] if f is None else f for w, f in zip(words, found)]
        return b"".join(found)

    def _new(self, missing) -> dict[str, bytes]:
        """Ids of words not kept yet. Letters and the marks after them are tokens of their own, so a word's forms with marks need no further encoding."""
        parts = {w: (w[: len(stem)], w[len(stem) :]) for w in missing if (stem := w.rstrip(".,;:!?")) != w and stem.isalpha()}
        need = dict.fromkeys(x for w in missing for x in parts.get(w, (w,)) if x not in self.kept)
        found = dict(zip(need, self._whole(list(need)))) if need else {}
        held = lambda x: found[x] if x in found else self.kept[x]
        new = {w: b"".join(map(held, parts.get(w, (w,)))) for w in missing}
        if len(self.kept) < _KEPT:
            self.kept.update(found)
            self.kept.update(new)
        return new

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _encoder(path: str) -> Encoder:
    """One encoder for a worker process: Spark reuses workers, and a later task finds the words of the earlier ones. Functions shipped with a job have new globals in each task, so a module of its own holds it."""
    held = sys.modules.setdefault("foliograph_encoders", ModuleType("foliograph_encoders")).__dict__
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def _tokenized(path: str, tails: bool):
    """Rows (doc_id, text) to (doc_id, n, crcs of the full pieces and the tail), with the tail's ids if `tails`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(path), np.array([END_ID], "<u4").tobytes()
        for b in batches:
            n, crcs, rest = [], [], []
            for t in b.column(1):
                ids = encode(t.as_py() or "") + end
                n.append(len(ids) // 4)
                crcs.append([crc32(ids[at : at + 4 * LENGTH]) for at in range(0, len(ids), 4 * LENGTH)])
                rest.append(ids[len(ids) // (4 * LENGTH) * 4 * LENGTH :] if tails else None)
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rest, pa.binary())] if tails else columns, names=["doc_id", "n", "crcs", "tail"][: 4 if tails else 3])

    return run


def knapsack(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items in `capacity`, by dynamic programming over capacities; counts by item."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fit = np.nonzero(size <= c)[0]
        if not len(fit):
            continue
        got = best[c - size[fit]] + value[fit]
        i = int(np.argmax(got))
        best[c], last[c] = (got[i], fit[i]) if got[i] > best[c - 1] + 1e-12 else (best[c - 1], -1)
    counts, c = np.zeros(len(size), np.int64), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            counts[last[c]] += 1
            c -= int(size[last[c]])
    return float(best[capacity]), counts


def inverted(matrix: np.ndarray) -> np.ndarray:
    """The inverse by row elimination with the largest pivots. Plain array steps: threaded linear algebra may wait for ever in a driver that Spark's JVM shares the cores with."""
    n = len(matrix)
    both = np.concatenate([matrix.astype(float), np.eye(n)], axis=1)
    for i in range(n):
        pivot = i + int(np.argmax(np.abs(both[i:, i])))
        if pivot != i:
            both[[i, pivot]] = both[[pivot, i]]
        both[i] /= both[i, i]
        factors = both[:, i].copy()
        factors[i] = 0
        rows = np.nonzero(factors)[0]
        both[rows] -= factors[rows, None] * both[i]
    return both[:, n:]


def column_generation(size: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 4000, refresh: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often the linear program uses each. The start has one pattern per class; each round brings in the pattern of the best price.

    It stops when no pattern is worth more than a sequence, which is the optimum, or after `rounds` rounds; then the patterns hold every item too, in more sequences.
    """
    times = lambda v: (inverse * v).sum(axis=1)
    basis = np.diag(capacity // size).astype(float)
    inverse = np.diag(1.0 / np.diag(basis))
    x = times(demand)
    for round_ in range(rounds):
        worth, column = knapsack(inverse.sum(axis=0), size, capacity)
        if worth <= 1 + 1e-7:
            break
        u = times(column)
        ok = u > 1e-9
        ratio = np.where(ok, x / np.where(ok, u, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = column
        if round_ % refresh == refresh - 1:
            inverse = inverted(basis)
        else:
            row = inverse[out] / u[out]
            inverse -= u[:, None] * row
            inverse[out] = row
        x = np.maximum(times(demand), 0)
    return basis.astype(np.int64), x


def plan_patterns(size: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) that hold every item: rounded columns first, then the few items that rounding leaves, by decreasing length."""
    if not len(size):
        return []
    columns, x = column_generation(size, demand.astype(float), capacity)
    plan, left = [], demand.copy()
    for column, times in zip(columns.T, np.floor(x + 1e-6).astype(np.int64)):
        times = min(int(times), *(int(left[i] // column[i]) for i in np.nonzero(column)[0]))
        if times > 0:
            plan.append((column, times))
            left -= times * column
    while left.any():
        pattern, room = np.zeros_like(left), capacity
        for i in np.argsort(-size):
            pattern[i] = min(left[i], room // size[i])
            room -= int(pattern[i] * size[i])
        times = int(min(left[i] // pattern[i] for i in np.nonzero(pattern)[0]))
        plan.append((pattern, times))
        left -= times * pattern
    return plan


def _summed(df: DataFrame, group: list[str], key: Column, value: Column, out: str) -> tuple[DataFrame, DataFrame]:
    """df with `out`: the sum of `value` over the rows before it in its group, in the order of (chunk, hash); and the groups' totals.

    A group has a chunk for each CHUNK_ROWS of its counted rows. Sums run inside chunks and, over the chunks' totals, before them: no task holds a whole group.
    There are at most CAPACITY groups, so their counts are broadcast; the totals are only when their measured number is at most BROADCAST_ROWS.
    """
    sizes = df.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).alias("_chunks"))
    df = df.join(F.broadcast(sizes), group).withColumn("_h", key).withColumn("_chunk", F.pmod("_h", F.col("_chunks"))).withColumn("_v", value).drop("_chunks")
    totals = written(df.groupBy(*group, "_chunk").agg(F.sum("_v").alias("_sum")), "chunks")
    earlier = Window.partitionBy(*group, F.lit(0)).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*group, "_chunk").orderBy("_h").rowsBetween(Window.unboundedPreceding, 0)
    few = totals.count() <= BROADCAST_ROWS
    df = df.withColumn("_in", F.sum("_v").over(inside) - F.col("_v")).join(F.broadcast(before) if few else before, [*group, "_chunk"])
    return df.withColumn(out, F.col("_in") + F.col("_before")).drop("_h", "_chunk", "_v", "_in", "_before"), totals


def pack(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of docs (doc_id, text). vocabulary: the tokenizer's file."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tokenized = docs.mapInArrow(_tokenized(vocabulary, False), "doc_id long, n long, crcs array<long>")
    # Rows that repeat a document are counted, then numbered.
    tokenized = tokenized.groupBy("doc_id", "n", "crcs").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    items = tokenized.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
    items = items.withColumn("key", F.xxhash64("doc_id", "n", "crcs", "copy")).withColumn("r", F.col("n") % LENGTH)
    items = items.withColumn("share", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(_SHARES)).cast("int"))
    items = written(items.withColumn("class", F.ceil(F.col("r") / GRAIN).cast("int")), "items")
    tails = items.filter("r > 0").withColumn("crc", F.element_at("crcs", -1))

    # The smallest share of filler that covers what rounding leaves open. Driver: _SHARES rows, then CAPACITY rows.
    share = np.zeros((_SHARES, 2), np.int64)
    for s, r, gap in tails.groupBy("share").agg(F.sum("r"), F.sum(F.col("class") * GRAIN - F.col("r"))).collect():
        share[s] = r, gap
    filler, gaps = np.cumsum(share[:, 0]), share[:, 1].sum() - np.cumsum(share[:, 1])
    cut = int(np.argmax(filler >= 1.05 * gaps + min(2 * LENGTH, 0.02 * filler[-1])))
    whole = tails.filter(F.col("share") > cut)
    counts = {c: n for c, n in whole.groupBy("class").count().collect()}
    size = np.array(sorted(counts), np.int64)
    plan = plan_patterns(size, np.array([counts[c] for c in size], np.int64), CAPACITY)

    places, at, sequences = [], np.zeros(len(size), np.int64), 0
    for pattern, times in plan:
        for i in np.nonzero(pattern)[0]:
            each = int(pattern[i])
            places.append((int(size[i]), int(at[i]), int(at[i] + each * times), each, sequences))
            at[i] += each * times
        sequences += times
    table = items.sparkSession.createDataFrame(places, "p_class int, low long, high long, each long, first long")
    ranked, _ = _summed(whole, ["class"], F.col("key"), F.lit(1).cast("long"), "rank")
    placed = ranked.join(F.broadcast(table), (F.col("class") == F.col("p_class")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    placed = placed.withColumn("sequence_id", F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each")).cast("long"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank").rowsBetween(Window.unboundedPreceding, 0)
    placed = written(placed.withColumn("offset", F.sum("r").over(inside) - F.col("r")).select("doc_id", "n", "r", "crc", "sequence_id", "offset"), "placed")
    out = placed.select("doc_id", (F.col("n") - F.col("r")).alias("start"), F.col("r").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", "offset")

    # Gaps and filler as two streams on one line, joined where they overlap.
    used = placed.groupBy("sequence_id").agg(F.sum("r").alias("used"))
    open_ = used.filter(F.col("used") < LENGTH).withColumn("one", F.lit(0))
    open_, gap_totals = _summed(open_, ["one"], F.xxhash64("sequence_id"), F.lit(LENGTH) - F.col("used"), "s0")
    held, held_totals = _summed(tails.filter(F.col("share") <= cut).withColumn("one", F.lit(0)), ["one"], F.col("key"), F.col("r"), "f0")
    held = written(held.select("doc_id", "n", "r", "crc", "copy", "f0"), "filler")
    total_gap = gap_totals.agg(F.sum("_sum")).first()[0] or 0
    buckets = lambda a, b: F.explode(F.sequence(F.floor(a / _BUCKET), F.floor((b - 1) / _BUCKET)))
    f = held.withColumn("f1", F.col("f0") + F.col("r"))
    s = open_.withColumn("s1", F.col("s0") + LENGTH - F.col("used")).drop("one")
    low, high = F.greatest("f0", "s0"), F.least("f1", "s1")
    left = f.filter(F.col("f0") < total_gap).withColumn("bucket", buckets(F.col("f0"), F.col("f1")))
    right = s.withColumn("s_bucket", buckets(F.col("s0"), F.col("s1")))
    cuts = left.join(right, (F.col("bucket") == F.col("s_bucket")) & (low < high) & (F.floor(low / _BUCKET) == F.col("bucket")))
    cuts = cuts.select("doc_id", "n", "crc", "copy", F.struct((low - F.col("f0")).alias("at"), (high - low).alias("length"), "sequence_id", (F.col("used") + low - F.col("s0")).alias("offset")).alias("cut"))
    # What is left of the filler fills sequences of its own.
    f0, f1 = F.greatest(F.col("f0"), F.lit(total_gap)) - F.lit(total_gap), F.col("f1") - F.lit(total_gap)
    rest = f.filter(F.col("f1") > total_gap).withColumns({"g0": f0, "g1": f1})
    rest = rest.withColumn("q", F.explode(F.sequence(F.floor(F.col("g0") / LENGTH), F.floor((F.col("g1") - 1) / LENGTH))))
    low, high = F.greatest(F.col("g0"), F.col("q") * LENGTH), F.least(F.col("g1"), (F.col("q") + 1) * LENGTH)
    rest = rest.select("doc_id", "n", "crc", "copy", F.struct((F.col("r") - (F.col("g1") - low)).alias("at"), (high - low).alias("length"), (F.col("q") + sequences).alias("sequence_id"), (low % LENGTH).alias("offset")).alias("cut"))
    total_rest = max(0, (held_totals.agg(F.sum("_sum")).first()[0] or 0) - total_gap)
    cuts = cuts.unionByName(rest).groupBy("doc_id", "n", "crc", "copy").agg(F.collect_list("cut").alias("cuts"))  # at most LENGTH cuts a tail
    again = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(_SHARES)) <= cut).mapInArrow(_tokenized(vocabulary, True), "doc_id long, n long, crcs array<long>, tail binary")
    again = again.select(F.col("doc_id").alias("t_doc"), F.col("n").alias("t_n"), F.element_at("crcs", -1).alias("t_crc"), "tail").dropDuplicates(["t_doc", "t_n", "t_crc"])
    both = cuts.join(again, F.col("doc_id").eqNullSafe(F.col("t_doc")) & (F.col("n") == F.col("t_n")) & (F.col("crc") == F.col("t_crc")))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    out = out.unionByName(both.select("doc_id", "n", "tail", "cuts").mapInArrow(_cut, schema))

    # Full pieces: a sequence each.
    full, _ = _summed(items.filter(F.col("n") >= LENGTH).withColumn("one", F.lit(0)), ["one"], F.col("key"), F.floor(F.col("n") / LENGTH).cast("long"), "first")
    full = full.select("doc_id", "n", "first", F.posexplode(F.slice("crcs", F.lit(1), F.floor(F.col("n") / LENGTH).cast("int"))).alias("i", "crc"))
    base = sequences + -(-total_rest // LENGTH)
    return out.unionByName(
        full.select(
            "doc_id", (F.col("i") * F.lit(LENGTH).cast("long")).alias("start"), F.lit(LENGTH).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), (F.lit(base) + F.col("first") + F.col("i")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
        )
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, n, tail ids, cuts) to pieces."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for b in batches:
        rows = []
        for doc, n, tail, cuts in zip(*(b.column(i).to_pylist() for i in range(4))):
            before = n - len(tail) // 4
            for c in cuts:
                rows.append((doc, before + c["at"], c["length"], crc32(tail[4 * c["at"] : 4 * (c["at"] + c["length"])]), n, c["sequence_id"], c["offset"]))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 7)], names=names)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
