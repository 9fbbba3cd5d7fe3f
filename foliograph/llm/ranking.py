"""Ranked lexical search on a K2-treap over the grid of terms and documents.

A posting is a cell: its row is the term's number, its column the document's, its value the impact of the term there. The grid is halved both ways again and again; a cell of a level that holds
postings is a node with a mask of its four quarters and the largest impact in it. Nodes of a level lie in Morton order, so a quarter's node is found by counting mask bits, and maxima are
kept as differences from the node above. For an item, the paths of its terms' rows go down the levels together over ranges of documents: a range's bound is the sum of its terms' weights times the maxima
of their nodes, ranges with the greatest bounds are halved first (BATCH of a level at once), and the search ends when no bound reaches the TOP-th best score. A range of one document has its exact score.

On Spark: a task cuts its documents into grids of at most COLUMNS documents with postings, and keeps postings only; corpus statistics are sums over grids; then each grid becomes one row of the index table, and tasks search
their grids one after the other, the TOP-th score of an item carried from grid to grid. Only TOP rows for each item and task are shuffled. Items are searched in blocks of at most BLOCK_WORDS words and one item: a block's
terms, weights and items are what is broadcast.

Rules for odd rows: a null text has no terms, and a document without terms counts nowhere; rows that repeat a doc_id are documents of their own; a document with a null doc_id counts in all statistics and is never
returned; items with the same item_id are one item with the terms of all; an item with a null item_id is left out; items without terms have no rows; empty tables give an empty one; extra columns are not carried.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from foliograph.llm.common import SALTS, ascii_words, written
from foliograph.llm.substrings import text_slices

TOP, COLUMNS, POSTINGS, BATCH, BLOCK_WORDS = 20, 8192, 4_000_000, 256, 100_000
_POP = np.array([bin(i).count("1") for i in range(16)], np.int64)
#: Place of a quarter's node among its node's: how many lower bits of the mask are set.
_PLACE = np.array([[bin(m & ((1 << q) - 1)).count("1") if m >> q & 1 else -1 for q in range(4)] for m in range(16)], np.int64)
_POSTINGS = "n_docs long, n_terms long, docs binary, lengths binary, cells binary, counts binary, terms array<int>, dfs array<int>"
_INDEX = "docs binary, levels int, masks binary, maxima binary"


def impact(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """The weight-free part of a posting's score."""
    m = 100 - 25 + (25 * n * documents) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Treap:
    """Cells in levels: masks of quarters (2 for the lower rows, 1 for the right columns), first quarters' places, maxima."""

    def __init__(self, levels: int, masks: list[np.ndarray], maxima: list[np.ndarray]):
        self.levels, self.masks, self.maxima = levels, masks, maxima
        self.first = [np.cumsum(_POP[m]) - _POP[m] for m in masks]

    @classmethod
    def of(cls, rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> Treap:
        levels = max(1, int(max(rows.max(), columns.max())).bit_length())
        code = np.zeros(len(rows), np.int64)
        for bit in range(levels):
            code |= ((rows >> bit & 1) << 1 | columns >> bit & 1) << (2 * bit)
        order = np.argsort(code)
        code, top = code[order], values[order]
        masks, maxima = [], [top]
        for _ in range(levels):
            up = code >> 2
            begin = np.nonzero(np.r_[True, up[1:] != up[:-1]])[0]
            masks.append(np.bitwise_or.reduceat(1 << (code & 3), begin).astype(np.uint8))
            top = np.maximum.reduceat(top, begin)
            maxima.append(top)
            code = up[begin]
        return cls(levels, masks[::-1], maxima[::-1])

    def packed(self) -> tuple[int, bytes, bytes]:
        import zstandard

        below = [np.repeat(up, _POP[m]) - low for up, m, low in zip(self.maxima, self.masks, self.maxima[1:])]
        press = zstandard.ZstdCompressor(level=3)
        return self.levels, press.compress(np.concatenate(self.masks).tobytes()), press.compress(np.concatenate([self.maxima[0], *below]).astype(np.uint32).tobytes())

    @classmethod
    def unpacked(cls, levels: int, masks: bytes, maxima: bytes) -> Treap:
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        all_masks = np.frombuffer(unpress.decompress(masks), np.uint8)
        less = np.frombuffer(unpress.decompress(maxima), np.uint32).astype(np.int64)
        out_masks, out, at, size = [], [less[:1]], 0, 1
        for _ in range(levels):
            mask = all_masks[at : at + size]
            each = _POP[mask]
            at, size = at + size, int(each.sum())
            out_masks.append(mask)
            # Differences of a level begin where those of the levels above end, after the root's maximum.
            out.append(np.repeat(out[-1], each) - less[at : at + size])
        return cls(levels, out_masks, out)

    def best(self, rows: np.ndarray, weights: np.ndarray, docs: np.ndarray, held: tuple[np.ndarray, np.ndarray], top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
        """The `top` best (scores, doc_ids), those of `held` included; equal scores by doc_id."""
        scores, ids = held
        least = int(scores[-1]) if len(scores) == top else 1
        fit = rows < 1 << self.levels
        rows, weights = rows[fit], weights[fit]
        # Open ranges of each level: bounds, range numbers, and a node (or -1) for each term.
        open_: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(self.levels)]
        greatest = np.full(self.levels, -1, np.int64)
        bound = int(weights.sum() * self.maxima[0][0])
        if bound >= least:
            open_[0].append((np.array([bound]), np.zeros(1, np.int64), np.zeros((1, len(rows)), np.int64)))
            greatest[0] = bound
        while True:
            level = self.levels - 1 - int(np.argmax(greatest[::-1]))
            if greatest[level] < least:
                return scores, ids
            bounds, columns, nodes = (np.concatenate(x) for x in zip(*open_[level])) if len(open_[level]) > 1 else open_[level][0]
            live = bounds >= least
            if not live.all():
                bounds, columns, nodes = bounds[live], columns[live], nodes[live]
            if len(bounds) > BATCH:
                order = np.argpartition(-bounds, BATCH)
                now, later = order[:BATCH], order[BATCH:]
                open_[level] = [(bounds[later], columns[later], nodes[later])]
                greatest[level] = bounds[later].max()
                columns, nodes = columns[now], nodes[now]
            else:
                open_[level], greatest[level] = [], -1
            masks = np.where(nodes >= 0, self.masks[level][nodes], 0)
            firsts = self.first[level][nodes]
            half = 2 * (rows >> (self.levels - 1 - level) & 1)
            below = self.maxima[level + 1]
            for side in (0, 1):
                place = _PLACE[masks, half + side]
                node = np.where(place >= 0, firsts + place, -1)
                bound = np.where(place >= 0, below[node], 0) @ weights
                ok = bound >= least
                if not ok.any():
                    continue
                bound, column = bound[ok], 2 * columns[ok] + side
                if level + 1 < self.levels:
                    open_[level + 1].append((bound, column, node[ok]))
                    greatest[level + 1] = max(greatest[level + 1], int(bound.max()))
                    continue
                scores, ids = np.r_[scores, bound], np.r_[ids, docs[column]]
                order = np.lexsort((ids, -scores))[:top]
                scores, ids = scores[order], ids[order]
                least = int(scores[-1]) if len(scores) == top else 1


def _query_blocks(item_type: pa.DataType):
    """Rows (item_id, text) to blocks (number, vocabulary, items, sizes, terms, repeats): each item's terms as numbers of the block's vocabulary."""

    def row(number: int, vocabulary: dict[bytes, int], items: list, counts: list[Counter]) -> pa.RecordBatch:
        flat = lambda x: pa.array([np.fromiter(chain.from_iterable(x), np.int64).tobytes()], pa.binary())
        columns = [pa.array([number], pa.int64()), pa.array([b" ".join(vocabulary)], pa.binary()), pa.array([items], pa.list_(item_type)), pa.array([np.array([len(c) for c in counts], np.int64).tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays([*columns, flat(counts), flat(c.values() for c in counts)], names=["number", "vocabulary", "items", "sizes", "terms", "repeats"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, vocabulary, items, counts = TaskContext.get().partitionId() << 32, 0, {}, [], []
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                found = Counter(vocabulary.setdefault(w, len(vocabulary)) for w in chain.from_iterable(ascii_words(text or b"")))
                if not found:
                    continue
                items.append(item)
                counts.append(found)
                size += found.total()
                if size >= BLOCK_WORDS:
                    yield row(number, vocabulary, items, counts)
                    number, size, vocabulary, items, counts = number + 1, 0, {}, [], []
        if items:
            yield row(number, vocabulary, items, counts)

    return run


def _postings(sent):
    """Rows (doc_id, text) to grids of postings of the terms in `sent`, with counts of documents and terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(sent.value.split(b" "))}
        held: list[tuple[np.ndarray, ...]] = []
        docs = terms = columns = postings = 0

        def grid() -> pa.RecordBatch:
            ids, named, lengths, column, term, tf = (np.concatenate(x) for x in zip(*held))
            found, df = np.unique(term, return_counts=True)
            # Columns without a doc_id are counted in df and go here.
            ok = named[column]
            column, term, tf = (np.cumsum(named) - 1)[column[ok]], term[ok], tf[ok]
            cells = np.stack([term, column]).astype(np.int32)
            arrays = [pa.array([x.tobytes()], pa.binary()) for x in (ids[named], lengths[named], cells, tf.astype(np.int32))]
            return pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([terms], pa.int64()), *arrays, pa.array([found], pa.list_(pa.int32())), pa.array([df], pa.list_(pa.int32()))], names=[c.split()[0] for c in _POSTINGS.split(", ")])

        for b, texts in text_slices(batches, 1):
            ids, counts = [], []
            for t in texts:
                parts = [np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words)) for words in ascii_words(t)]
                ids.extend(parts)
                counts.append(sum(map(len, parts)))
            term, n = np.concatenate(ids), np.array(counts, np.int64)
            doc = np.repeat(np.arange(len(texts)), n)
            docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
            cell, tf = np.unique((doc * len(number) + term)[term >= 0], return_counts=True)
            doc, term = cell // len(number), cell % len(number)
            hit, column = np.unique(doc, return_inverse=True)
            own = b.column(0).take(pa.array(hit))
            held.append((own.fill_null(0).to_numpy(), np.asarray(own.is_valid()), n[hit], column + columns, term, tf))
            columns, postings = columns + len(hit), postings + len(cell)
            if columns >= COLUMNS or postings >= POSTINGS:
                yield grid()
                held, docs, terms, columns, postings = [], 0, 0, 0, 0
        if docs:
            yield grid()

    return run


def _treaps(documents: int, terms: int):
    """Grids of postings to rows of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for docs, lengths, cells, counts in zip(*(b.column(i).to_pylist() for i in range(4))):
                row, column = np.frombuffer(cells, np.int32).astype(np.int64).reshape(2, -1)
                if not len(row):
                    continue
                values = impact(np.frombuffer(counts, np.int32).astype(np.int64), np.frombuffer(lengths, np.int64)[column], documents, terms)
                levels, masks, maxima = Treap.of(row, column, values).packed()
                yield pa.RecordBatch.from_arrays([pa.array([docs], pa.binary()), pa.array([levels], pa.int32()), pa.array([masks], pa.binary()), pa.array([maxima], pa.binary())], names=[c.split()[0] for c in _INDEX.split(", ")])

    return run


def _searched(sent, item_type: pa.DataType):
    """Rows of the index to the best (item_id, doc_id, score, part) of a task. sent: items, and their terms' numbers and weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, queries = sent.value
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        held = [none] * len(items)
        for b in batches:
            for docs, levels, masks, maxima in zip(*(b.column(i).to_pylist() for i in range(4))):
                treap, ids = Treap.unpacked(levels, masks, maxima), np.frombuffer(docs, np.int64)
                held = [treap.best(rows, weights, ids, h) for (rows, weights), h in zip(queries, held)]
        n = [len(scores) for scores, _ in held]
        columns = [pa.array([i for i, k in zip(items, n) for _ in range(k)], item_type), *[pa.array(np.concatenate([none[0], *x]), pa.int64()) for x in ([h[1] for h in held], [h[0] for h in held])]]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(sum(n), TaskContext.get().partitionId() % SALTS), pa.int32())], names=["item_id", "doc_id", "score", "part"])

    return run


def rank(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score): the TOP best docs (doc_id, text) of each of the items (item_id, text)."""
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType
    item_type, item_sql = to_arrow_type(kind), kind.simpleString()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.filter("item_id is not null").groupBy("item_id").agg(F.array_join(F.collect_list(F.col("text").cast("string")), " ").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    schema = f"number long, vocabulary binary, items array<{item_sql}>, sizes binary, terms binary, repeats binary"
    blocks = written(items.repartition(1 + size // (8 * BLOCK_WORDS)).mapInArrow(_query_blocks(item_type), schema), "query_blocks")
    found = None
    for number in sorted(r[0] for r in blocks.select("number").collect()):
        best = _rank_block(docs, blocks.filter(F.col("number") == number).first(), item_type, item_sql)
        found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], f"item_id {item_sql}, rank int, doc_id long, score long")
    # A task's best first, then those of the tasks that share a number: no task ranks what all tasks send for an item.
    order = [F.desc("score"), F.asc("doc_id")]
    for group in (["item_id", "part"], ["item_id"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= TOP)
    return found.select("item_id", "rank", "doc_id", "score")


def _rank_block(docs: DataFrame, block, item_type: pa.DataType, item_sql: str) -> DataFrame:
    context = docs.sparkSession.sparkContext
    postings = written(docs.mapInArrow(_postings(context.broadcast(bytes(block["vocabulary"]))), _POSTINGS), "postings")
    documents, terms = (x or 0 for x in postings.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    entries = postings.select(F.explode(F.arrays_zip("terms", "dfs")).alias("e"))
    weights = np.zeros(len(block["vocabulary"].split(b" ")), np.int64)
    for term, df in entries.groupBy("e.terms").agg(F.sum("e.dfs")).collect():  # at most the block's vocabulary
        weights[term] = weight(documents, df)
    index = written(postings.select("docs", "lengths", "cells", "counts").mapInArrow(_treaps(documents, terms), _INDEX), "index")
    read = lambda name: np.frombuffer(block[name], np.int64)
    at = np.cumsum(read("sizes"))[:-1]
    queries = []
    for rows, repeats in zip(np.split(read("terms"), at), np.split(read("repeats"), at)):
        worth = weights[rows] * repeats
        order = np.argsort(rows[worth > 0])
        queries.append((rows[worth > 0][order], worth[worth > 0][order]))
    return index.mapInArrow(_searched(context.broadcast((block["items"], queries)), item_type), f"item_id {item_sql}, doc_id long, score long, part int")


def query(spark, sf_dir: str) -> DataFrame:
    return rank(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sql() -> str:
    terms = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
    WITH q AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest({terms}) AS term FROM benchmark WHERE item_id IS NOT NULL) GROUP BY item_id, term),
    d AS (SELECT row_number() OVER () AS id, doc_id, {terms} AS t FROM documents),
    docs AS (SELECT id, doc_id, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
    total AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs),
    p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY id, term),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, total GROUP BY term),
    s AS (
      SELECT item_id, p.id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM p JOIN q ON p.term = q.term JOIN w ON p.term = w.term JOIN docs ON p.id = docs.id, total GROUP BY item_id, p.id
    ),
    r AS (
      SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
      FROM s JOIN docs ON s.id = docs.id WHERE score > 0 AND doc_id IS NOT NULL
    )
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {TOP}
    """
