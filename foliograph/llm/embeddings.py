"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its K nearest pivots in order. Inverted lists hold, by label and pivot subset, the vectors that have the subset among
their K; pairs of a list with SHARED or more pivots in common are verified by cosine in double precision. A list's key is one pivot, or a
subset of two or three when the table is so large that lists for smaller subsets would be long: a pair with SHARED pivots in common has
every such subset of them in common, so the subset's size changes the speed and not the result. A pair that meets in several lists
counts in the list of its smallest common pivots only.

Pivots are at most MOST_PIVOTS vectors, taken from the CANDIDATES times as many with the smallest hashed vec_id (the only sample; the number of pivots grows with the square root of the
row count up to that bound). They are thinned so that no two are near each other: in a large group of near copies a plain sample would have hundreds of pivots, among which
the members' nearest are a matter of chance, and links would be lost. Vectors that don't give enough pivots that way are one list. All rows are indexed. Equal vectors enter once, with their number. Lists above CHUNK members are cut into chunks and each pair
of chunks is a task's work, so no task holds more than two chunks; counts are added up per task, so pairs are never emitted.

Rules for odd rows: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label, link with nothing and are their own
component; vectors of different lengths never link; a null vec_id has no links, a null component and isn't kept; rows that repeat a vec_id are links of each other only
as one vector; an empty table gives an empty one; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import BROADCAST_ROWS, bounded_sample, connected_components, run_bounds, whole_runs, written

COSINE = 0.98
K, SHARED, MOST_PIVOTS, CHUNK = 8, 2, 1024, 1024
CANDIDATES = 4
#: Cosines that two pivots may not reach; the lowest that leaves enough pivots is used.
APART = (0.5, 0.6, 0.7, 0.8, 0.9)


def _pivot_count(rows: int) -> int:
    return max(16, min(MOST_PIVOTS, int(rows**0.5)))


def _thinned(candidates: np.ndarray, most: int) -> np.ndarray:
    """At most `most` of the candidates (unit vectors, the first ones first), no two of them near each other. Half of `most` are enough; fewer are taken only where APART leaves no more."""
    kept = []
    for apart in APART:
        free, own = np.ones(len(candidates), bool), []
        while len(own) < most and free.any():
            own.append(int(np.argmax(free)))
            free &= candidates @ candidates[own[-1]] < apart
            free[own[-1]] = False
        if 2 * len(own) >= most:
            return candidates[own]
        kept.append(own)
    enough = most / 4
    while enough > 2 * K and not any(len(own) >= enough for own in kept):
        enough /= 2
    return candidates[next((own for own in kept if len(own) >= max(enough, 2 * K)), kept[-1])]


def _arity(rows_of_label: int, pivots: int) -> int:
    """The least size of the subsets that keeps the expected list within half a chunk; at most SHARED."""
    return next((r for r in range(1, SHARED) if rows_of_label * comb(K, r) / comb(pivots, r) <= CHUNK / 2), SHARED)


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.reshape(-1, dim).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _describe(pivots: dict[int, np.ndarray], arity: int):
    """Rows (rep, label, n, vec) to postings; pivots by the vectors' length."""

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column(3)
            lengths = np.diff(vectors.offsets.to_numpy())
            keys, rows, prefixes = [], [], []
            for dim in np.unique(lengths):
                at = np.nonzero(lengths == dim)[0]
                x = _unit(vectors.take(pa.array(at)).flatten().to_numpy(), int(dim))
                p = pivots.get(int(dim))
                k = min(K, len(p)) if p is not None else 0
                if k < K:  # a length with too few pivots: one list
                    order = np.full((len(at), K), -1, np.int16)
                    key = np.full((len(at), 1), int(dim) << 40)
                else:
                    order = np.argsort(-(x @ p.T), axis=1, kind="stable")[:, :K].astype(np.int16)
                    near = np.sort(order, axis=1).astype(np.int64)
                    key = np.stack([sum((near[:, c] + 1) << (12 * i) for i, c in enumerate(cs)) for cs in combinations(range(K), arity)], axis=1) | (int(dim) << 40)
                keys.append(key.ravel())
                rows.append(np.repeat(at, key.shape[1]))
                prefixes.append(np.repeat(order, key.shape[1], axis=0))
            if not keys:
                continue
            take = pa.array(np.concatenate(rows))
            prefix = np.concatenate(prefixes)
            yield pa.RecordBatch.from_arrays(
                [b.column(1).take(take), pa.array(np.concatenate(keys)), b.column(0).take(take), b.column(2).take(take), pa.array(list(prefix.reshape(-1, K)), pa.list_(pa.int16())), vectors.take(take)],
                names=["label", "key", "rep", "n", "prefix", "vec"],
            )

    return postings


def _pairs(prefix_a, prefix_b, key: int, unit_a, unit_b) -> np.ndarray:
    """Which pairs link here: tallied by shared pivots, at home in this list, verified by cosine."""
    if prefix_a[0, 0] < 0:
        return unit_a @ unit_b.T >= COSINE
    top = 0
    while (key >> (12 * top)) & 0xFFF and top < 3:
        top += 1
    own = [((key >> (12 * i)) & 0xFFF) - 1 for i in range(top)]
    size = int(max(prefix_a.max(), prefix_b.max())) + 1
    a, b = np.zeros((len(prefix_a), size), np.float32), np.zeros((len(prefix_b), size), np.float32)
    np.put_along_axis(a, prefix_a.astype(np.int64), 1, axis=1)
    np.put_along_axis(b, prefix_b.astype(np.int64), 1, axis=1)
    upto = max(own) + 1
    linked = (a @ b.T >= SHARED) & (a[:, :upto] @ b[:, :upto].T == len(own))
    linked &= unit_a @ unit_b.T >= COSINE
    return linked


def _count_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, key, i, j, side, rep, n, prefix, vec) of chunk pairs to (rep, n_links, root): root is the smallest rep of the connected part."""
    for table in whole_runs(batches, 4):
        table = table.combine_chunks()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        starts, ends = run_bounds(table, 4)
        key, i, j = (table.column(c).to_numpy() for c in (1, 2, 3))
        side, rep, n = (table.column(c).to_numpy() for c in (4, 5, 6))
        prefix = table.column(7).combine_chunks().flatten().to_numpy().reshape(-1, K) if table.num_rows else None
        vectors = table.column(8).combine_chunks()
        offsets = vectors.offsets.to_numpy()
        flat = vectors.values.to_numpy()
        for s, e in zip(starts, ends):
            if e - s < 2:
                continue
            unit = _unit(flat[offsets[s] : offsets[e]], int(key[s] >> 40))
            a = np.arange(e - s) if i[s] == j[s] else np.nonzero(side[s:e] == 0)[0]
            b = a if i[s] == j[s] else np.nonzero(side[s:e] == 1)[0]
            if not len(a) or not len(b):
                continue
            linked = _pairs(prefix[s:e][a], prefix[s:e][b], int(key[s]) & ((1 << 40) - 1), unit[a], unit[b])
            r, w = rep[s:e], n[s:e]
            if a is b:
                np.fill_diagonal(linked, False)
            if not linked.any():
                continue
            count = np.zeros(e - s, np.int64)
            count[a] += linked @ w[b]
            if a is not b:
                count[b] += w[a] @ linked
            root = np.arange(e - s)
            todo = np.nonzero(count)[0]
            todo = todo[np.argsort(r[todo])]
            open_ = np.zeros(e - s, bool)
            open_[todo] = True
            for first in todo:
                if not open_[first]:
                    continue
                open_[first] = False
                frontier = np.array([first])
                while len(frontier):
                    near = np.zeros(e - s, bool)
                    in_a, in_b = np.isin(a, frontier), np.isin(b, frontier)
                    near[b] |= linked[in_a].any(axis=0)
                    near[a] |= linked[:, in_b].any(axis=1)
                    near &= open_
                    frontier = np.nonzero(near)[0]
                    open_[frontier] = False
                    root[frontier] = first
            keep = np.nonzero(count)[0]
            out.append((r[keep], count[keep], r[root[keep]]))
        if out:
            a, b, c = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], names=["rep", "n_links", "root"])


def near_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of vectors (vec_id, embedding array<float>, label)."""
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("vec"), F.col("label").cast("long").alias("label"))
    plain = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    usable = given.filter("vec_id is not null and label is not null and vec is not null").filter(plain)
    classes = written(usable.groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("n")), "vectors")
    sizes = classes.groupBy("label").agg(F.count(F.lit(1)).alias("c")).agg(F.sum("c"), F.max("c")).first()
    rows, of_label = sizes[0] or 0, sizes[1] or 0
    candidates: dict[int, list] = {}
    most = _pivot_count(rows)
    for r in bounded_sample(classes.select("rep", "vec"), "rep", CANDIDATES * most).collect():
        candidates.setdefault(len(r["vec"]), []).append(np.array(r["vec"], np.float32))
    sampled = sum(map(len, candidates.values()))
    fixed = {dim: _thinned(_unit(np.concatenate(c), dim), max(2 * K, most * len(c) // sampled)) for dim, c in candidates.items()}
    fixed = {dim: p for dim, p in fixed.items() if len(p) >= 2 * K}
    arity = _arity(of_label, max([1, *map(len, fixed.values())]))
    postings = classes.select("rep", "label", "n", "vec").mapInArrow(_describe(fixed, arity), "label long, key long, rep long, n long, prefix array<short>, vec array<float>")
    postings = written(postings, "postings")
    lists = postings.groupBy(F.col("label").alias("l"), F.col("key").alias("k")).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    long_lists = written(lists.filter("chunks > 1"), "long_lists")
    small = F.broadcast(long_lists) if long_lists.count() <= BROADCAST_ROWS else long_lists
    p = postings.join(small, (postings["label"] == small["l"]) & (postings["key"] == small["k"]), "left")
    chunks = F.coalesce("chunks", F.lit(1))
    p = p.withColumn("chunk", F.pmod(F.xxhash64("rep"), chunks).cast("int"))
    p = p.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    blocks = p.select(
        "label", "key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), F.when(F.col("chunk") <= F.col("other"), 0).otherwise(1).alias("side"), "rep", "n", "prefix", "vec"
    )
    blocks = blocks.repartition("label", "key", "i", "j").sortWithinPartitions("label", "key", "i", "j")
    found = written(blocks.mapInArrow(_count_links, "rep long, n_links long, root long"), "found")
    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("n_links").alias("outside"))
    reps = classes.join(counts, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
    reps = reps.select(F.col("label").alias("r_label"), F.col("vec").alias("r_vec"), (F.coalesce("outside", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    reps = written(reps, "vector_classes")
    out = given.join(reps, (given["label"] == reps["r_label"]) & (given["vec"] == reps["r_vec"]) & given["vec_id"].isNotNull(), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
