"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Fingerprints of 64 bits that differ in at most 3 bits differ in at most 3 of their 8 bytes, so a linked pair has at least
MATCHES = 5 equal positional bytes: the guaranteed minimum. A list for one positional byte would hold 1/256 of the corpus, so the
postings join four positions: the 14 blocks of the Steiner system S(3, 4, 8). Any 5 positions contain a whole block (5
positions hold 10 triples, each in exactly one block), so no pair is lost. Pairs of a list are tallied by equal positional bytes, those
with MATCHES or more stay, and the bits decide.

Only distinct fingerprints enter the index, so copies cost nothing more. A list is searched breadth first
and yields one link per member instead of all its pairs, so a large group of near copies costs about its size. A list above LIST members
is first divided by a fifth equal byte.

Rules for odd rows: null and empty texts have fingerprint zero and are linked like any other; a null doc_id gets a fingerprint and a null component; repeated rows
share a component; an empty table gives an empty one; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import connected_components, in_row, one_of_each, out_of_row, written

BITS, MATCHES, WORDS, LIST = 3, 5, 3, 20_000


def blocks() -> list[tuple[int, ...]]:
    """The 14 blocks of S(3, 4, 8): the words of weight 4 of the extended Hamming code, as position sets whose 3-bit numbers have XOR zero."""
    from itertools import combinations

    return [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]


def _mask(positions: tuple[int, ...]) -> int:
    unsigned = sum(255 << (8 * p) for p in positions)
    return unsigned - (1 << 64) if unsigned >> 63 else unsigned


def fingerprint(text: bytes | None) -> int:
    """The fingerprint as a signed long. Words are separated by ASCII white space; only A-Z is lower-cased."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < WORDS:
        hashes = [digest(b" ".join(words), 42)]
    else:
        hashes = [digest(b"%b %b %b" % three, 42) for three in zip(words, words[1:], words[2:])]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], dtype=">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).cast(pa.binary())
        prints = [fingerprint(t.as_py()) for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of docs (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tally the equal positional bytes of each pair, keep pairs with the guaranteed minimum, verify by bits."""
    x = np.ascontiguousarray(a ^ b)
    shared = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=-1)
    return (shared >= MATCHES) & (np.bitwise_count(x) <= BITS)


def _groups(fp: np.ndarray, positions: tuple[int, ...]) -> Iterator[np.ndarray]:
    """Index sets of a list's linked members, each a connected part; the same member may come in several."""
    if len(fp) > LIST and len(positions) == 4:
        for p in set(range(8)) - set(positions):
            byte = (fp >> np.uint64(8 * p)) & np.uint64(255)
            order = np.argsort(byte, kind="stable")
            for part in np.split(order, np.nonzero(np.diff(byte[order]))[0] + 1):
                if len(part) > 1:
                    yield from (part[g] for g in _groups(fp[part], (*positions, p)))
        return
    rest = np.arange(len(fp))
    while len(rest) > 1:
        found, frontier, rest = [rest[:1]], rest[:1], rest[1:]
        while len(frontier) and len(rest):
            hit = np.zeros(len(rest), bool)
            step = max(1, 500_000 // max(1, len(rest)))
            for at in range(0, len(frontier), step):
                free = np.nonzero(~hit)[0]
                if not len(free):
                    break
                hit[free] = _near(fp[frontier[at : at + step], None], fp[rest[free]][None, :]).any(axis=0)
            frontier, rest = rest[hit], rest[~hit]
            found.append(frontier)
        members = np.concatenate(found)
        if len(members) > 1:
            yield members


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, m, fp, rep) sorted by (k, m): a link from each member of a connected part to its smallest rep."""
    held: list[tuple[np.ndarray, ...]] = []
    all_blocks = blocks()

    def lists(k: np.ndarray, m: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        cut = np.nonzero((np.diff(k) != 0) | (np.diff(m) != 0))[0] + 1
        starts, ends = np.r_[0, cut], np.r_[cut, len(k)]
        a_side, b_side = [], []
        two = starts[ends - starts == 2]
        if len(two):
            ok = two[_near(fp[two], fp[two + 1])]
            a_side.append(rep[ok])
            b_side.append(rep[ok + 1])
        for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
            for g in _groups(fp[s:e], all_blocks[int(k[s])]):
                r = rep[s:e][g]
                low = r.min()
                a_side.append(r[r != low])
                b_side.append(np.full(len(a_side[-1]), low))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a_side, b_side))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        k, m, fp, rep = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        if not len(k):
            continue
        fp = fp.view(np.uint64)
        if held and (k[0] != held[-1][0][-1] or m[0] != held[-1][1][-1]):
            yield lists(*(np.concatenate(x) for x in zip(*held)))
            held = []
        cut = np.nonzero((k != k[-1]) | (m != m[-1]))[0]
        last = int(cut[-1]) + 1 if len(cut) else 0
        if last:
            held.append((k[:last], m[:last], fp[:last], rep[:last]))
            yield lists(*(np.concatenate(x) for x in zip(*held)))
            held = []
        held.append((k[last:], m[last:], fp[last:], rep[last:]))
    if held:
        yield lists(*(np.concatenate(x) for x in zip(*held)))


def links(classes: DataFrame) -> DataFrame:
    """Links (a, b) between representatives of fingerprint classes (fp, rep), enough to connect all fingerprints within BITS bits."""
    postings = F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(_mask(b))).alias("m")) for i, b in enumerate(blocks())])
    rows = classes.filter("rep is not null").select(F.explode(postings).alias("p"), "fp", "rep").select("p.k", "p.m", "fp", "rep")
    rows = rows.repartition("k", "m").sortWithinPartitions("k", "m")
    return rows.mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of docs (doc_id, text); component_id is the smallest doc_id reachable."""
    prints = written(fingerprints(docs), "prints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    parts = connected_components(links(classes))
    labelled = classes.join(parts, classes["rep"] == parts["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    # Both sides are tables here, so that adaptive execution can split the partition of a very common fingerprint.
    out = prints.join(written(labelled, "labelled"), "fp")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without those that are near an earlier one: a group keeps the document with the smallest doc_id. Rows without doc_id stay.

    Of rows that repeat a doc_id and its text one stays, that whose other columns come first as JSON; different texts of one doc_id are one document and stay or go together.
    """
    kept = near_duplicates(docs).filter("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    found = in_row(docs, id=F.col("doc_id").cast("long")).join(kept, F.col("id") == F.col("kept_id"), "left_semi")
    return out_of_row(one_of_each(found, docs.columns), docs.columns).unionByName(docs.filter("doc_id is null"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
