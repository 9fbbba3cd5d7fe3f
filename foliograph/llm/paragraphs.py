"""Repeated passages across documents by MinHash banding.

A unit is a run of words that is compared as a whole. Units are the lines of MIN_WORDS words or more, and windows of MIN_WORDS words that begin at content-defined anchors and may
lie inside a line or cross line breaks: an anchor is the least hashed SHINGLE-word shingle of some REACH shingles in a row, the leftmost of equals. Two documents that share a run of at
least MIN_WORDS + REACH - 1 words share REACH shingles in a row that begin a whole window, so they share an anchor and its window, wherever the run lies in either text.

Each line's MinHash signature of SHINGLE-word shingles is cut into bands of ROWS values; the number of bands is the least that finds a pair at the threshold with probability RECALL.
Lines that collide in a band are joined and verified by exact Jaccard similarity of their shingle sets; verified links make components, and a component's
units go from every document but its first (the smallest doc_id). Windows are linked when they are equal: of a window's 16 shingles one changed word takes up to five, so those at
the threshold differ at their ends only, and an edited passage has other windows.

Equal units enter once. A list of colliding units is searched breadth first and yields a link per member, not its pairs; a list above
CHUNK members is cut into chunks and each pair of chunks is a task's work. Joins exchange both sides: no table that grows with the corpus goes through the driver.

Rules for odd rows: null and empty texts have no units; a run of fewer than MIN_WORDS words is never compared; a passage repeated inside one document
only is left alone; a null doc_id neither loses words nor counts as a first one; rows with the same doc_id are the same document, each with its own text; an empty table gives an empty one; extra columns
are not carried by `repeated_passages` and pass through `remove_passages`, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import Scratch, connected_components, in_row, one_of_each, out_of_row, paired_chunks, run_bounds, whole_runs, written
from foliograph.llm.substrings import text_slices

SHINGLE, SIMILARITY, ROWS, RECALL, CHUNK = 5, 0.8, 3, 0.998, 2048
MIN_WORDS, REACH = 20, 30
_MIX = 0x9E3779B97F4A7C15
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes of words that are hashed together.
PART = 4_000_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_ROWS_SCHEMA = "doc_id long, text_crc long, start int, size int, k1 long, k2 long, bands binary"


def band_count(similarity: float = SIMILARITY, rows: int = ROWS, recall: float = RECALL) -> int:
    """The least number of bands of `rows` values that finds a pair of this similarity with probability `recall`."""
    bands = 1
    while 1 - (1 - similarity**rows) ** bands < recall:
        bands += 1
    return bands


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_OF_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MIX))


@dataclass
class Units:
    """Units of several texts: whose they are, first word and number of words in that text, number of bands (0: only equal ones are linked), and the place of their shingles in `shingles`."""

    shingles: np.ndarray
    owner: np.ndarray
    start: np.ndarray
    size: np.ndarray
    bands: np.ndarray
    at: np.ndarray

    def gathered(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shingles of some units one after the other, where each unit's begin, and each shingle's number in its unit."""
        count = self.size[some] - SHINGLE + 1
        begin = np.cumsum(count) - count
        inside = np.arange(count.sum()) - np.repeat(begin, count)
        return self.shingles[np.repeat(self.at[some], count) + inside], begin, inside

    def identities(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of hash of each unit's words in order."""
        if not len(self.at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        s, begin, inside = self.gathered(np.arange(len(self.at)))
        with np.errstate(over="ignore"):
            step = inside.astype(np.uint64) * np.uint64(_MIX)
            k1, k2 = (_mixed(np.add.reduceat(_mixed(s + step + np.uint64(seed)), begin) + np.uint64(seed)).view(np.int64) for seed in (1, 2))
        return k1, k2


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and line number (counted through all texts) of each word; only A-Z is lower-cased, words are separated by ASCII white space."""
    data = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)
    inside = ~_SPACE[data]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    size = ends - starts
    powers = np.ones(int(size.max(initial=1)), np.uint64)
    with np.errstate(over="ignore"):
        np.cumprod(np.full(len(powers) - 1, _MIX, np.uint64), out=powers[1:])
    h = np.zeros(len(starts), np.uint64)
    part = np.cumsum(size) // PART
    for low, high in zip(*_runs(part)):
        n = size[low:high]
        begin = np.cumsum(n) - n
        place = np.arange(n.sum()) - np.repeat(begin, n)
        with np.errstate(over="ignore"):
            h[low:high] = _mixed(np.add.reduceat(_OF_BYTE[data[np.repeat(starts[low:high], n) + place]] * powers[place], begin))
    line = np.searchsorted(np.nonzero(data == 10)[0], starts)
    first = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return h, np.searchsorted(first, starts, side="right") - 1, line


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.nonzero(np.diff(x))[0] + 1
    return (np.r_[0, cut], np.r_[cut, len(x)]) if len(x) else (cut, cut)


def _shingles(h: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the SHINGLE words from each word on, SHINGLE empty words after each text; number of words and place of the first word of each text."""
    n = np.bincount(owner, minlength=texts)
    base = np.cumsum(n) - n + SHINGLE * np.arange(texts)
    padded = np.zeros(len(h) + SHINGLE * (texts + 1), np.uint64)
    padded[np.arange(len(h)) + SHINGLE * owner] = h
    s = np.zeros(len(padded) - SHINGLE + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(SHINGLE):
            s = s * np.uint64(_MIX) + padded[j : j + len(s)]
    return _mixed(s), n, base


def anchors(s: np.ndarray, n: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in s of the first words of all windows, and their texts."""
    if len(s) < REACH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(n)), n + SHINGLE)
    left = n[owner] - (np.arange(len(owner)) - base[owner])  # words from here to the text's end
    # Hash and place share a number; a place has 32 bits.
    low = (s & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(s), dtype=np.uint64)
    width = 1
    while width < REACH:
        step = min(width, REACH - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    low = low[: len(left)][left[: len(low)] >= REACH + SHINGLE - 1]
    at = np.unique((low & np.uint64(0xFFFFFFFF)).astype(np.int64))
    at = at[left[at] >= MIN_WORDS]
    return at, owner[at]


def _line_units(h: np.ndarray, of_word: np.ndarray, line: np.ndarray, s: np.ndarray, base: np.ndarray) -> Units:
    low, high = _runs(line)
    long = high - low >= MIN_WORDS
    low, high = low[long], high[long]
    owner = of_word[low]
    at = low + SHINGLE * owner
    return Units(s, owner, at - base[owner], high - low, np.full(len(low), band_count()), at)


def line_units(texts: list[bytes]) -> Units:
    """Lines of MIN_WORDS words or more."""
    h, of_word, line = word_hashes(texts)
    s, _, base = _shingles(h, of_word, len(texts))
    return _line_units(h, of_word, line, s, base)


def passage_units(texts: list[bytes]) -> Units:
    """Lines of MIN_WORDS words or more, and windows of MIN_WORDS words, which have no bands."""
    h, of_word, line = word_hashes(texts)
    s, n, base = _shingles(h, of_word, len(texts))
    u = _line_units(h, of_word, line, s, base)
    at, owner = anchors(s, n, base)
    return Units(s, np.r_[u.owner, owner], np.r_[u.start, at - base[owner]], np.r_[u.size, np.full(len(at), MIN_WORDS)], np.r_[u.bands, np.zeros(len(at), np.int64)], np.r_[u.at, at])


def document_units(texts: list[bytes]) -> Units:
    """Each whole text as a unit; a text of fewer than SHINGLE words has one shingle."""
    h, of_word, _ = word_hashes(texts)
    s, n, base = _shingles(h, of_word, len(texts))
    return Units(s, np.arange(len(texts)), np.zeros_like(base), np.maximum(n, SHINGLE), np.full(len(texts), band_count()), base)


Cut = Callable[[list[bytes]], Units]


def _signatures(cut: Cut):
    """Rows (doc_id, text) to a row per unit; one that its slice of texts repeats has its bands in its first row only, and units without bands have none."""
    bands = band_count()
    seeds = _mixed(np.arange(1, bands * ROWS + 1, dtype=np.uint64) * np.uint64(_MIX))

    def bands_of(units: Units, some: np.ndarray) -> np.ndarray:
        s, begin, _ = units.gathered(some)
        keys = np.zeros((len(some), bands), np.uint64)
        with np.errstate(over="ignore"):
            for band in range(bands):
                for r in range(ROWS):
                    keys[:, band] = keys[:, band] * np.uint64(_MIX) + np.minimum.reduceat(_mixed(s ^ seeds[band * ROWS + r]), begin)
                keys[:, band] = _mixed(keys[:, band] + np.uint64(band))
        return keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in text_slices(batches, 1):
            units = cut(texts)
            if not len(units.at):
                continue
            k1, k2 = units.identities()
            packed: list[bytes | None] = [None] * len(k1)
            first = np.unique(k1, return_index=True)[1]
            first = first[units.bands[first] > 0]
            if len(first):
                for i, keys in zip(first.tolist(), bands_of(units, first)):
                    packed[i] = keys.tobytes()
            crc = np.array([zlib.crc32(t) for t in texts], np.int64)[units.owner]
            columns = [b.column(0).take(pa.array(units.owner)), pa.array(crc), pa.array(units.start, pa.int32()), pa.array(units.size, pa.int32()), pa.array(k1), pa.array(k2), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_crc", "start", "size", "k1", "k2", "bands"])

    return run


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        packed = b.column(1).to_pylist()
        each = np.array([len(p) // 8 for p in packed], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(packed), np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), each))], names=["key", "k1"])


def _colliding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, k1) sorted by both: the different k1 of the keys that have several."""
    for table in whole_runs(batches, 1):
        key, k1 = (table.column(i).to_numpy() for i in range(2))
        new = np.r_[True, (np.diff(key) != 0) | (np.diff(k1) != 0)]
        key, k1 = key[new], k1[new]
        edges = np.r_[0, np.nonzero(np.diff(key))[0] + 1, len(key)]
        several = np.repeat(np.diff(edges) > 1, np.diff(edges))
        yield pa.RecordBatch.from_arrays([pa.array(key[several]), pa.array(k1[several])], names=["key", "k1"])


def _shingle_sets(cut: Cut):
    """Rows (wanted array<k1>, text) to (k1, sorted distinct shingle hashes) of the texts' wanted units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in text_slices(batches, 1):
            units = cut(texts)
            k1, _ = units.identities()
            _, first = np.unique(k1, return_index=True)
            some = first[np.isin(k1[first], b.column(0).flatten().to_numpy())]
            if not len(some):
                continue
            s, begin, _ = units.gathered(some)
            yield pa.RecordBatch.from_arrays([pa.array(k1[some]), pa.array([np.unique(x).tobytes() for x in np.split(s, begin[1:])], pa.binary())], names=["k1", "shingles"])

    return run


def _similar(one: np.ndarray, flat: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of several shingle sets have exact Jaccard similarity SIMILARITY or more with one."""
    shared = np.bincount(owner[np.isin(flat, one)], minlength=len(sizes))
    return shared >= SIMILARITY * (len(one) + sizes - shared)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, side, k1, shingles) of chunk pairs to links (a, b): one for each member of a connected part, to its smallest k1."""
    for table in whole_runs(batches, 3):
        a_side, b_side = [], []
        starts, ends = run_bounds(table, 3)
        i, j, side, k1 = (table.column(c).to_numpy() for c in (1, 2, 3, 4))
        sets = table.column(5).to_pylist()
        for s, e in zip(starts, ends):
            if e - s < 2:
                continue
            each = [np.frombuffer(x, np.uint64) for x in sets[s:e]]
            sizes, sides = np.array([len(x) for x in each]), side[s:e]
            rest, within = np.arange(e - s), i[s] == j[s]
            while len(rest) > 1:
                part, frontier, rest = [rest[:1]], list(rest[:1]), rest[1:]
                while frontier and len(rest):
                    x = frontier.pop()
                    able = rest if within else rest[sides[rest] != sides[x]]
                    able = able[(sizes[able] >= SIMILARITY * sizes[x]) & (sizes[x] >= SIMILARITY * sizes[able])]
                    if not len(able):
                        continue
                    flat = np.concatenate([each[r] for r in able])
                    hit = able[_similar(each[x], flat, np.repeat(np.arange(len(able)), sizes[able]), sizes[able])]
                    if len(hit):
                        rest = rest[~np.isin(rest, hit)]
                        frontier.extend(hit)
                        part.append(hit)
                k = k1[s:e][np.concatenate(part)]
                a_side.append(k[k != k.min()])
                b_side.append(np.full(len(a_side[-1]), k.min()))
        if a_side:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (a_side, b_side)], names=["a", "b"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, text_crc, start, size, first_doc_id, component_id) of docs (doc_id, text): the units that go, as first word and number of words of
    the text with this CRC-32, and the document that keeps them. Units of a passage may overlap.

    component_id is the component's smallest unit hash. Units are told apart by 128 bits of hash.
    """
    return _repeated(docs, passage_units, line_units)


def _repeated(docs: DataFrame, cut: Cut, banded: Cut) -> DataFrame:
    """banded: cuts the units of `cut` that have bands."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    rows = written(docs.mapInArrow(_signatures(cut), _ROWS_SCHEMA), "units")
    bands = rows.filter("bands is not null").select("k1", "bands").mapInArrow(_band_rows, "key long, k1 long").repartition("key").sortWithinPartitions("key", "k1")
    met = scratch.written(bands.mapInArrow(_colliding, "key long, k1 long"), "colliding")
    classes = rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc"), F.max("doc_id").alias("last_doc"), F.bool_or(F.col("bands").isNotNull()).alias("banded"))
    classes = scratch.written(classes.filter("banded or doc < last_doc"), "unit_classes")
    classes = classes.join(met.select(F.col("k1").alias("m1")).distinct().hint("merge"), F.col("k1") == F.col("m1"), "left").filter("m1 is not null or doc < last_doc")
    classes = scratch.written(classes, "met_classes")
    wanted = classes.filter("m1 is not null").groupBy(F.col("doc").alias("w_doc")).agg(F.collect_list("k1").alias("wanted"))
    sets = docs.join(wanted.hint("merge"), F.col("doc_id") == F.col("w_doc")).select("wanted", "text").mapInArrow(_shingle_sets(banded), "k1 long, shingles binary")
    sets = scratch.written(sets.groupBy("k1").agg(F.any_value("shingles").alias("shingles")), "shingle_sets")
    pairs = paired_chunks(met, ["key"], "k1", CHUNK).join(sets.hint("merge"), "k1")
    pairs = pairs.select("key", "i", "j", "side", "k1", "shingles").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    parts = connected_components(pairs.mapInArrow(_verified, "a long, b long"))
    joined = classes.select("k1", "k2", "doc", "last_doc").join(parts, F.col("k1") == F.col("node"), "left")
    joined = scratch.written(joined.filter("component is not null or doc < last_doc").withColumn("component_id", F.coalesce("component", "k1")).select("k1", "k2", "doc", "component_id"), "repeats")
    firsts = scratch.written(joined.groupBy(F.col("component_id").alias("c")).agg(F.min("doc").alias("first_doc_id")), "firsts")
    placed = written(joined.join(firsts.hint("merge"), F.col("component_id") == F.col("c")).select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), "component_id", "first_doc_id"), "placed")
    scratch.clear()
    out = rows.select("doc_id", "text_crc", "start", "size", "k1", "k2").join(placed.hint("merge"), (F.col("k1") == F.col("p1")) & (F.col("k2") == F.col("p2")))
    return out.filter("doc_id > first_doc_id").select("doc_id", "text_crc", "start", "size", "first_doc_id", "component_id")


def _text_crc(text: str):
    return F.crc32(F.coalesce(F.col(text).cast("string"), F.lit("")))


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """docs without those whose whole text is near an earlier document's: links are pairs of texts with exact Jaccard similarity SIMILARITY or more of their
    SHINGLE-word shingles, and a component keeps the smallest doc_id. Of rows that repeat a doc_id and its text one stays, that whose other columns
    come first as JSON; texts without words are copies of each other; rows without doc_id stay.
    """
    gone = _repeated(docs, document_units, document_units).select("doc_id", "text_crc").distinct()
    row = in_row(docs, id=F.col("doc_id").cast("long"), crc=_text_crc("text")).filter("id is not null")
    kept = row.join(gone.hint("merge"), (F.col("id") == gone["doc_id"]) & (F.col("crc") == gone["text_crc"]), "left_anti")
    return out_of_row(one_of_each(kept, docs.columns), docs.columns).unionByName(docs.filter("doc_id is null"))


def _without(text: pd.Series, ranges: pd.Series) -> pd.Series:
    def one(t: str | None, gone) -> str | None:
        if t is None or gone is None or not len(gone):
            return t
        data = t.encode()
        spans, out, at = [m.span() for m in _WORD.finditer(data)], [], 0
        for r in sorted(gone, key=lambda r: r["start"]):
            low, high = spans[r["start"]][0], spans[r["start"] + r["size"] - 1][1]
            out.append(data[at : max(at, low)])
            at = max(at, high)
        return b"".join([*out, data[at:]]).decode()

    return pd.Series([one(*x) for x in zip(text, ranges)], dtype=object)


def remove_passages(docs: DataFrame) -> DataFrame:
    """docs without the passages that an earlier document has; all columns stay. White space around a passage stays."""
    gone = repeated_passages(docs).groupBy("doc_id", "text_crc").agg(F.collect_set(F.struct("start", "size")).alias("ranges"))
    row = in_row(docs, id=F.col("doc_id").cast("long"), crc=_text_crc("text"))
    joined = row.join(gone.hint("merge"), (F.col("id") == gone["doc_id"]) & (F.col("crc") == gone["text_crc"]), "left")
    return out_of_row(joined, docs.columns, text=F.pandas_udf(_without, "string")(F.col("row.text").cast("string"), F.col("ranges")))


def query(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
