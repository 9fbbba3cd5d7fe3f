"""Exact substring removal by blockwise suffix sorting with a difference cover.

A byte goes if a string of MATCH bytes covering it also starts in a document with a smaller doc_id. Suffixes are sorted in buckets, one
bucket at a time, so memory is bounded by a bucket: a suffix belongs to the bucket of its anchor, the position of the least hashed GRAM-byte string in its first MATCH bytes.
Equal strings of MATCH bytes have the same anchor, so equal suffixes always meet, and only suffixes whose anchor string
occurs in two different texts are sorted at all. Inside a bucket, suffixes are ordered by their first 16 bytes; longer ties are resolved by precomputed ranks of
cover samples: the positions whose distance from the anchor lies in a difference cover (COVER modulo PERIOD) are ranked by the 32 bytes after them,
and every suffix has such a sample 10 to 16 bytes on, so how far on it is, its rank and the last 8 bytes settle all MATCH bytes. Suffixes are compared as bytes; hashes only choose candidates.

Equal texts enter once, as the one with the smallest doc_id; the others lose everything if they have MATCH bytes. A string that several documents of one task
share goes to its bucket once, so a passage of a large part of all documents isn't one task's work.

Rules for odd rows: a null text counts as empty; texts below MATCH bytes keep all; rows with the same doc_id are the same document: no source of
each other, and each keeps what its own text has left; a null doc_id is neither a source nor changed; an empty table gives an empty one; extra columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import written

MATCH, GRAM = 50, 20
_WINDOWS = MATCH - GRAM + 1
PART = 8_000_000
# The perfect difference set modulo 13. Its gaps are at most 6.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Bytes of text that a task works on together, and of fragments that a bucket has on average.
SLICE, BUCKET_BYTES = 2_000_000, 16_000_000
#: Tasks that work on buckets, at most; beyond that a task takes several buckets, one after the other.
MOST_TASKS = 50_000
#: Texts of a slice: their numbers have 16 bits.
SLICE_TEXTS = 60_000
#: Suffixes sorted together; a bucket's anchors are taken in runs of about this many.
SORTED = 400_000
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM bytes from each position, by doubling."""
    with np.errstate(over="ignore"):
        h1 = data.astype(np.uint64) + np.uint64(1)
        h2 = h1[:-1] * _power(1) + h1[1:]
        h4 = h2[:-2] * _power(2) + h2[2:]
        h8 = h4[:-4] * _power(4) + h4[4:]
        h16 = h8[:-8] * _power(8) + h8[8:]
        h = h16[:-4] * _power(4) + h4[16:]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
    return h


def _anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of suffixes of the joined texts with one anchor: (hash, anchor, first suffix, number of suffixes, text number)."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    length = np.array([len(t) for t in texts])
    ends = np.cumsum(length)
    none = np.zeros(0, np.int64)
    if len(data) < MATCH:
        return none.astype(np.uint64), none, none, none, none
    h = _gram_hashes(data)
    # The least hash of each window's grams, the leftmost of equals: place and hash share a number, so long texts go in parts.
    windows, parts = len(h) - _WINDOWS + 1, []
    for start in range(0, windows, PART):
        own = h[start : start + PART + _WINDOWS - 1]
        low = (own & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(own), dtype=np.uint64)
        for step in (1, 2, 4, 8):
            low = np.minimum(low[:-step], low[step:])
        low = np.minimum(low[: len(low) - (_WINDOWS - 16)], low[_WINDOWS - 16 :])
        parts.append((low & np.uint64(0xFFFFFF)).astype(np.int64) + start)
    anchor = np.concatenate(parts)
    valid = np.ones(len(anchor), bool)
    for e in ends[:-1]:
        valid[max(0, e - MATCH + 1) : e] = False
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])]
    first = np.nonzero(new)[0]
    count = np.diff(np.r_[first, len(anchor)])
    keep = valid[first]
    first, count = first[keep], count[keep]
    at = anchor[first]
    return h[at], at, first, count, np.searchsorted(ends, first, side="right")


def _digest(text: bytes) -> tuple[int, int, str]:
    d = hashlib.sha256(text)
    raw = d.digest()
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:16], "big", signed=True), d.hexdigest()


def text_slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows and their texts, about SLICE bytes at a time (one text at least)."""
    for b in batches:
        texts = b.column(text).cast(pa.binary())
        start, size = 0, 0
        for i in range(b.num_rows):
            n = len(texts[i].as_buffer() or b"") if texts[i].is_valid else 0
            if i > start and (size + n > SLICE or i - start >= SLICE_TEXTS):
                yield b.slice(start, i - start), [t or b"" for t in texts.slice(start, i - start).to_pylist()]
                start, size = i, 0
            size += n
        if start < b.num_rows:
            yield b.slice(start), [t or b"" for t in texts.slice(start).to_pylist()]


def _light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(*_digest(t.as_py() or b""), len(t.as_py() or b"")) for t in b.column(1).cast(pa.binary())]
        d1, d2, sha, n = zip(*rows) if rows else ([],) * 4
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sha, pa.string()), pa.array(n, pa.int64())], names=["doc_id", "d1", "d2", "sha", "n_bytes"])


def _first_seen(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Different texts of a slice and their digests as two longs."""
    different = [t for t in dict.fromkeys(texts) if len(t) >= MATCH]
    return different, np.array([_digest(t)[:2] for t in different], np.int64).reshape(-1, 2)


def _anchor_rows(buckets: int):
    """Rows (doc_id, text) to anchors by bucket. A hash that two texts of a slice have is known to be shared: its texts are told at once, and only two entries go to the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_slices(batches, 1):
            texts, digests = _first_seen(texts)
            if not texts:
                continue
            h, _, _, _, owner = _anchors(texts)
            order = np.lexsort((owner, h))
            h, owner = h.view(np.int64)[order], owner[order]
            new = np.r_[True, (np.diff(h) != 0) | (np.diff(owner) != 0)][: len(h)]
            h, owner = h[new], owner[new]
            cut = np.r_[0, np.nonzero(np.diff(h))[0] + 1, len(h)]
            size = np.diff(cut)
            place = np.arange(len(h)) - np.repeat(cut[:-1], size)
            told = np.repeat(size, size) > 1
            sent = place < 2
            bucket = (h[sent].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, hs, os = bucket[order], h[sent][order], owner[sent][order]
            edges = np.r_[0, np.nonzero(np.diff(bucket))[0] + 1, len(bucket)] if len(bucket) else np.zeros(1, int)
            out = []
            for s, e in zip(edges[:-1], edges[1:]):
                local, number = np.unique(os[s:e], return_inverse=True)
                out.append((int(bucket[s]), hs[s:e].tobytes(), number.astype(np.uint16).tobytes(), digests[local].tobytes()))
            if told.any():
                out.append((-1 - int(h[0] % buckets), h[told].tobytes(), owner[told].astype(np.uint16).tobytes(), digests.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "h", "number", "owners"])

    return run


def _unpack(h: bytes, number: bytes, owners: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(h, np.int64), np.frombuffer(owners, np.int64).reshape(-1, 2)[np.frombuffer(number, np.uint16)]


def _buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(bucket, its rows without the bucket) of rows sorted by their first column, one bucket at a time."""
    bucket, rows = None, []
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
            if rows and row[0] != bucket:
                yield bucket, rows
                rows = []
            bucket = row[0]
            rows.append(row[1:])
    if rows:
        yield bucket, rows


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of anchors to (d1, d2, h) where h occurs in two different texts. Buckets below 0 hold entries already known to be shared."""
    for bucket, rows in _buckets_of(batches):
        if bucket < 0:
            for row in rows:
                h, owner = _unpack(*row)
                yield pa.RecordBatch.from_arrays([pa.array(owner[:, 0]), pa.array(owner[:, 1]), pa.array(h)], names=["d1", "d2", "h"])
            continue
        parts = [_unpack(*r) for r in rows]
        h, owner = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(h, kind="stable")
        h, owner = h[order], owner[order]
        cut = np.r_[0, np.nonzero(np.diff(h))[0] + 1]
        size = np.diff(np.r_[cut, len(h)])
        other = (owner != np.repeat(owner[cut], size, axis=0)).any(axis=1)
        ok = np.repeat(np.logical_or.reduceat(other, cut), size)
        yield pa.RecordBatch.from_arrays([pa.array(owner[ok, 0]), pa.array(owner[ok, 1]), pa.array(h[ok])], names=["d1", "d2", "h"])


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) to (d1, d2, doc_id, compressed text); a text that a slice repeats is sent with its smallest doc_id."""
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    for b, texts in text_slices(batches, 1):
        least: dict[bytes, int] = {}
        for doc, t in zip(b.column(0).to_pylist(), texts):
            if len(t) >= MATCH and doc < least.get(t, doc + 1):
                least[t] = doc
        rows = [(*_digest(t)[:2], doc, press.compress(t)) for t, doc in least.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["d1", "d2", "doc_id", "packed"])


#: A text is told by its doc_id and the first long of its digest.
_CUT_SCHEMA = "kind int, bucket long, doc_id long, d1 long, packed binary, ints binary, low long, high long"
_CUT_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
_CUT_NAMES = ["kind", "bucket", "doc_id", "d1", "packed", "ints", "low", "high"]


def _fragments(buckets: int):
    """Rows (doc_id, d1, packed, hashes) to three kinds of rows.

    0: a bucket's fragments (compressed bytes; per fragment the hash, doc_id, digest, place in the text, number of suffixes, place of the anchor); 1: the text of a document that has
    any; 2: a range that goes because the same fragment belongs to a smaller doc_id of this slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press, unpress = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()

        def flush(docs: list[int], digests: list[int], packed: list[bytes], texts: list[bytes], hashes: list[np.ndarray]) -> pa.RecordBatch:
            h, at, first, count, owner = _anchors(texts)
            wanted = np.zeros(len(h), bool)
            edges = np.searchsorted(owner, np.arange(len(texts) + 1))
            for i, want in enumerate(hashes):
                wanted[edges[i] : edges[i + 1]] = np.isin(h[edges[i] : edges[i + 1]].view(np.int64), want)
            h, at, first, count, owner = (x[wanted] for x in (h, at, first, count, owner))
            starts = np.cumsum([0, *[len(t) for t in texts]])[:-1]
            doc, text = np.array(docs, np.int64), np.array(digests, np.int64)
            rows: list[tuple] = [(1, None, docs[i], digests[i], packed[i], None, None, None) for i in np.unique(owner)]
            joined = b"".join(texts)
            lowest: dict[bytes, int] = {}
            kept: list[int] = []
            strings = [joined[f : f + c + MATCH - 1] for f, c in zip(first.tolist(), count.tolist())]
            for j in np.argsort(doc[owner], kind="stable").tolist():
                if doc[owner[j]] == lowest.setdefault(strings[j], doc[owner[j]]):
                    kept.append(j)
                else:
                    low = int(first[j] - starts[owner[j]])
                    rows.append((2, None, int(doc[owner[j]]), int(text[owner[j]]), None, None, low, low + len(strings[j])))
            keep = np.array(sorted(kept), np.int64)
            bucket = (h[keep] % np.uint64(buckets)).astype(np.int64)
            keep = keep[np.argsort(bucket, kind="stable")]
            bucket = np.sort(bucket)
            cuts = np.r_[0, np.nonzero(np.diff(bucket))[0] + 1, len(bucket)] if len(bucket) else np.zeros(1, int)
            for s, e in zip(cuts[:-1], cuts[1:]):
                k = keep[s:e]
                ints = np.stack([h[k].view(np.int64), doc[owner[k]], text[owner[k]], first[k] - starts[owner[k]], count[k], at[k] - first[k]]).astype(np.int64)
                rows.append((0, int(bucket[s]), None, None, press.compress(b"".join([strings[j] for j in k.tolist()])), press.compress(ints.tobytes()), None, None))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, _CUT_TYPES)], names=_CUT_NAMES)

        for b in batches:
            held, size = ([], [], [], [], []), 0
            for doc, d1, packed, hashes in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
                text = unpress.decompress(packed)
                if size and size + len(text) > SLICE:
                    yield flush(*held)
                    held, size = ([], [], [], [], []), 0
                for x, y in zip(held, (doc, d1, packed, text, hashes.values.to_numpy())):
                    x.append(y)
                size += len(text)
            if held[0]:
                yield flush(*held)

    return run


def _words(data: np.ndarray, count: int) -> np.ndarray:
    """The 8 bytes from each of the first `count` positions as a number that sorts like them."""
    out = np.zeros(count, np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | data[i : i + count]
    return out


def _repeated(data: np.ndarray, starts: np.ndarray, doc: np.ndarray, count: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the suffixes of fragments and tells which start a string that a smaller doc_id also has: (suffix flags, fragment of each suffix).

    data: the fragments' bytes, one after the other; starts, count, anchor: each fragment's place, number of suffixes, and place of its anchor from its start.
    """
    padded = np.concatenate([data, np.zeros(64, np.uint8)])
    word = _words(padded, len(data) + 48)
    fragment = np.repeat(np.arange(len(count)), count)
    inside = np.arange(len(fragment)) - np.repeat(np.cumsum(count) - count, count)
    at = starts[fragment] + inside
    # Cover samples: ranks of the 32 bytes from each position whose distance from its anchor is in the cover.
    gap = np.zeros(PERIOD, np.int64)
    for r in range(PERIOD):
        gap[r] = next(g for g in range(PERIOD) if (r + g) % PERIOD in COVER)
    residue = (inside + 10 - anchor[fragment]) % PERIOD
    sample = at + 10 + gap[residue]
    places = np.unique(sample)
    order = np.lexsort((word[places + 24], word[places + 16], word[places + 8], word[places]))
    ordered = places[order]
    rank = np.zeros(len(places), np.int64)
    differs = np.zeros(max(0, len(places) - 1), bool)
    for k in (0, 8, 16, 24):
        differs |= word[ordered[1:] + k] != word[ordered[:-1] + k]
    rank[order] = np.r_[0, np.cumsum(differs)] if len(places) else rank
    of_suffix = rank[np.searchsorted(places, sample)]
    # Ranks tell only samples at the same distance apart; equal strings have equal distances.
    keys = (doc[fragment], word[at + MATCH - 8], of_suffix, gap[residue], word[at + 8], word[at])
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys[1:]:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    group = np.nonzero(new)[0]
    least = np.repeat(doc[fragment][order[group]], np.diff(np.r_[group, len(order)]))
    flags = np.zeros(len(order), bool)
    flags[order] = doc[fragment][order] > least
    return flags, fragment


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of fragments to ranges (doc_id, d1, low, high) of bytes that go."""
    import zstandard

    unpress = zstandard.ZstdDecompressor()
    for _, rows in _buckets_of(batches):
        ints = [np.frombuffer(unpress.decompress(i), np.int64).reshape(6, -1) for _, i in rows]
        data = np.frombuffer(b"".join(unpress.decompress(p) for p, _ in rows), np.uint8)
        h, doc, text, place, count, anchor = np.concatenate(ints, axis=1) if ints else np.zeros((6, 0), np.int64)
        starts = np.cumsum(count + MATCH - 1) - (count + MATCH - 1)
        order = np.argsort(h, kind="stable")
        edges = np.r_[0, np.nonzero(np.diff(h[order]))[0] + 1]
        total = np.add.reduceat(count[order], edges) if len(order) else np.zeros(0, np.int64)
        # Anchors with one fragment have nothing to meet. The others are taken together until SORTED suffixes are reached.
        alone = np.diff(np.r_[edges, len(order)]) == 1
        edges_end = np.r_[edges[1:], len(order)]
        edges, edges_end, total = edges[~alone], edges_end[~alone], total[~alone]
        run = np.cumsum(total) // SORTED
        for r in np.unique(run):
            pick = np.concatenate([order[s:e] for s, e in zip(edges[run == r], edges_end[run == r])])
            size = count[pick] + MATCH - 1
            index = np.repeat(starts[pick] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            flags, fragment = _repeated(data[index], np.cumsum(size) - size, doc[pick], count[pick], anchor[pick])
            edge = np.diff(np.r_[False, flags, False].astype(np.int8))
            # Runs of flags, also cut where a fragment ends.
            begin = np.r_[True, fragment[1:] != fragment[:-1]] if len(fragment) else np.zeros(0, bool)
            first = np.nonzero(flags & ((edge[:-1] == 1) | begin))[0]
            last = np.nonzero(flags & ((edge[1:] == -1) | np.r_[begin[1:], True]))[0]
            base = np.cumsum(count[pick]) - count[pick]
            f = fragment[first]
            low = place[pick][f] + first - base[f]
            high = place[pick][f] + last - base[f] + MATCH
            yield pa.RecordBatch.from_arrays([pa.array(doc[pick][f]), pa.array(text[pick][f]), pa.array(low), pa.array(high)], names=["doc_id", "d1", "low", "high"])


def cut_ranges(text: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The text without the union of the ranges, the bytes that went, and the maximal runs that went."""
    kept, at, gone, runs, end = [], 0, 0, 0, -1
    for low, high in sorted(ranges):
        if low > end:
            kept.append(text[at:low])
            runs += 1
            gone += high - low
            at = end = high
        elif high > end:
            gone += high - end
            at = end = high
    kept.append(text[at:])
    return b"".join(kept), gone, runs


def _kept_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpress = zstandard.ZstdDecompressor()
    for b in batches:
        rows = []
        for doc, d1, packed, ranges in zip(*(b.column(i).to_pylist() for i in range(4))):
            kept, gone, runs = cut_ranges(unpress.decompress(packed), [(r["low"], r["high"]) for r in ranges])
            rows.append((doc, d1, kept, gone, runs))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()))], names=["doc_id", "d1", "kept", "n_removed", "n_spans"])


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """rows by bucket, sorted; a hash of the bucket would put several into one task and none into others. Buckets below 0 go with those that they were named after."""
    number = F.when(F.col("bucket") < 0, -1 - F.col("bucket")).otherwise(F.col("bucket"))
    tasks = min(buckets, MOST_TASKS)
    return rows.repartitionById(tasks, (number % tasks).cast("int")).sortWithinPartitions("bucket")


def _wanted(docs: DataFrame, buckets: int) -> DataFrame:
    """(d1, d2, hashes): the anchors of each text that another text has too; a text has fewer anchors than bytes."""
    rows = docs.mapInArrow(_anchor_rows(buckets), "bucket long, h binary, number binary, owners binary")
    met = _dealt(rows, buckets).mapInArrow(_shared, "d1 long, d2 long, h long")
    return written(met.groupBy("d1", "d2").agg(F.collect_set("h").alias("hashes")), "wanted")


def _pieces(docs: DataFrame, wanted: DataFrame, buckets: int) -> DataFrame:
    texts = docs.mapInArrow(_packed_texts, "d1 long, d2 long, doc_id long, packed binary")
    texts = texts.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.any_value("packed").alias("packed"))
    return written(texts.join(wanted, ["d1", "d2"]).select("doc_id", "d1", "packed", "hashes").mapInArrow(_fragments(buckets), _CUT_SCHEMA), "fragments")


def _all_ranges(pieces: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, d1, ranges); a document has fewer ranges than bytes."""
    found = _dealt(pieces.filter("kind = 0").select("bucket", "packed", "ints"), buckets)
    ranges = found.mapInArrow(_ranges, "doc_id long, d1 long, low long, high long").union(pieces.filter("kind = 2").select("doc_id", "d1", "low", "high"))
    return written(ranges.groupBy("doc_id", "d1").agg(F.collect_list(F.struct("low", "high")).alias("ranges")), "ranges")


def shared_texts(docs: DataFrame, light: DataFrame) -> DataFrame:
    """(doc_id, d1, kept binary, n_removed, n_spans) of the documents, one per different text, that lose bytes. light: see `remove_repeats`."""
    total = light.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    docs = docs.filter("doc_id is not null")
    wanted = _wanted(docs, buckets)
    pieces = _pieces(docs, wanted, buckets)
    ranges = _all_ranges(pieces, buckets)
    return pieces.filter("kind = 1").select("doc_id", "d1", "packed").join(ranges, ["doc_id", "d1"]).mapInArrow(_kept_texts, "doc_id long, d1 long, kept binary, n_removed long, n_spans long")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    light = written(docs.mapInArrow(_light, "doc_id long, d1 long, d2 long, sha string, n_bytes long"), "light")
    first = written(light.groupBy(F.col("d1").alias("f1"), F.col("d2").alias("f2")).agg(F.min("doc_id").alias("first_id")), "firsts")
    # Both sides are tables, so adaptive execution can split the partition of a text with very many copies.
    both = written(light.join(first, (F.col("d1") == F.col("f1")) & (F.col("d2") == F.col("f2"))).drop("d2", "f1", "f2"), "copies")
    copy = F.coalesce((F.col("doc_id") > F.col("first_id")) & (F.col("n_bytes") >= MATCH), F.lit(False))
    cut = shared_texts(docs, light).select(F.col("doc_id").alias("cut_id"), F.col("d1").alias("cut_text"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha"))
    lead = both.filter(~copy & F.col("doc_id").isNotNull()).join(cut, (F.col("doc_id") == F.col("cut_id")) & (F.col("d1") == F.col("cut_text")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    lead = lead.select("doc_id", "n_bytes", zero(F.col("n_removed")).alias("n_removed"), zero(F.col("n_spans")).alias("n_spans"), F.coalesce("kept_sha", "sha").alias("kept_sha256"))
    gone = both.filter(copy).select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256().hexdigest()).alias("kept_sha256"))
    none = both.filter("doc_id is null").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"))
    return lead.union(gone).union(none)


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
