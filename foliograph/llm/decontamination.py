"""Benchmark decontamination by a generalised suffix automaton of the test items.

Words are maximal runs of a-z, 0-9 and characters beyond ASCII; A-Z is lower-cased. A window is WINDOW consecutive words of an item; an item of fewer words is one window.
The automaton of the items' word sequences reads each document word by word and tracks the longest ending that some item has. Where it is WINDOW words or more,
the last WINDOW words are a window; a shorter item's window is a state whose longest string is the whole item, met on the chain of suffix links. A word or a pair of
neighbours that no item has leaves a length of one at most, so the automaton only reads the runs between such places that are as long as the shortest window.

Automata hold at most AUTOMATON_WORDS words and one piece more: items are dealt over tasks, a task starts a new automaton when one is full, and an item longer than PIECE words enters in pieces that
overlap by WINDOW - 1 words, so no window is lost. A pass over the documents takes PASS automata, sent to the tasks as one broadcast of bounded size; a larger benchmark takes more passes.

Rules for odd rows: null and empty texts have no words; rows that repeat a doc_id are documents of their own, each with its result; a null doc_id is scanned like any other; items with the
same item_id are one item; a null item_id counts as the empty string; items without words have no windows; without items nothing is hit; an empty table of documents gives an empty one; extra columns are not
carried by `scan` and pass through `decontaminate`, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import ascii_words, in_row, out_of_row, written
from foliograph.llm.substrings import text_slices

WINDOW, SPAN, COVERAGE = 10, 10, 0.5
AUTOMATON_WORDS, PIECE, PASS = 200_000, 50_000, 8
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_BLOB = "number long, vocabulary binary, steps binary, targets binary, link binary, length binary, window binary, short binary, owner_states binary, owner_items binary, items array<string>"
_SCHEMA = "doc_id long, sha string, n_words long, ranges array<struct<start:int,end:int>>, items array<string>"


class Builder:
    """The automaton while items enter. A state is a set of strings that end at the same places; `length` is its longest, `link` the state of the longest ending outside it."""

    def __init__(self):
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.pieces: list[tuple[str, list[int]]] = []
        self.words = 0

    def add(self, item: str, words: list[bytes]) -> None:
        ids = [self.ids.setdefault(w, len(self.ids)) for w in words]
        self.pieces.append((item, ids))
        self.words += len(ids)
        at = 0
        for w in ids:
            at = self._after(at, w)

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The strings of q that are w after a string of p, as a state of their own between q and its link."""
        part = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = part
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = part
            p = self.link[p]
        return part

    def _after(self, last: int, w: int) -> int:
        """The state of the whole string read so far, with w after what `last` stands for."""
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def columns(self, number: int) -> tuple:
        """The finished automaton as a row of arrays: steps sorted by state and word, the windows and short items on each state's chain, and which items have which window states."""
        n = len(self.ids)
        steps = np.array([s * n + w for s, out in enumerate(self.next) for w in out], np.int64)
        targets = np.array([t for out in self.next for t in out.values()], np.int32)
        order = np.argsort(steps)
        names = sorted({item for item, _ in self.pieces})
        at = {item: i for i, item in enumerate(names)}
        window = window_states(np.array(self.link), np.array(self.length))
        short, owners = set(), set()
        for item, ids in self.pieces:
            state = 0
            for i, w in enumerate(ids):
                state = self.next[state][w]
                if i >= WINDOW - 1:
                    owners.add((int(window[state]), at[item]))
            if len(ids) < WINDOW:
                short.add(state)
                owners.add((state, at[item]))
        # The nearest state on each chain, itself included, that is a whole short item.
        nearest = np.full(len(self.link), -1)
        nearest[sorted(short)] = sorted(short)
        for v in np.argsort(self.length, kind="stable").tolist():
            if nearest[v] < 0 and v:
                nearest[v] = nearest[self.link[v]]
        owned = np.array(sorted(owners), np.int32).reshape(-1, 2)
        arrays = (steps[order], targets[order], *[np.array(a, np.int32) for a in (self.link, self.length, window, nearest)], owned[:, 0], owned[:, 1])
        return (number, b" ".join(self.ids), *[a.tobytes() for a in arrays], names)


def window_states(link: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each state the one on its chain of links that holds its ending of WINDOW words; -1 for shorter states."""
    out = np.full(len(link), -1)
    for v in np.argsort(length, kind="stable").tolist():
        if length[v] >= WINDOW:
            out[v] = v if length[link[v]] < WINDOW else out[link[v]]
    return out


def _automata(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item_id, text) to automata."""

    def row(builder: Builder, number: int) -> pa.RecordBatch:
        types = [pa.int64(), *[pa.binary()] * 9, pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(builder.columns(number), types)], names=[c.split()[0] for c in _BLOB.split(", ")])

    number, builder = TaskContext.get().partitionId() << 32, Builder()
    for b in batches:
        for item, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
            words = list(chain.from_iterable(ascii_words(text or b"")))
            for low in range(0, max(1, len(words) - WINDOW + 1), PIECE):
                builder.add(item or "", words[low : low + PIECE + WINDOW - 1])
                if builder.words >= AUTOMATON_WORDS:
                    yield row(builder, number)
                    number, builder = number + 1, Builder()
    if builder.words:
        yield row(builder, number)


class Automaton:
    """A finished automaton. `known` translates the numbers of a pass's vocabulary to its own."""

    def __init__(self, blob: dict, vocabulary: dict[bytes, int]):
        own = blob["vocabulary"].split(b" ")
        self.n = len(own)
        self.known = np.full(len(vocabulary) + 1, -1)
        self.known[[vocabulary[w] for w in own]] = np.arange(self.n)
        read = lambda name, kind: np.frombuffer(blob[name], kind)
        self.steps, self.targets = read("steps", np.int64), read("targets", np.int32)
        self.link, self.length = read("link", np.int32), read("length", np.int32)
        self.window, self.short = read("window", np.int32), read("short", np.int32)
        self.owner_states, self.owner_items, self.items = read("owner_states", np.int32), read("owner_items", np.int32), blob["items"]
        self.shortest = int(self.length[self.short[self.short >= 0]].min(initial=WINDOW))
        # Pairs of neighbours that some item has: what follows the states of single words.
        first = self.targets[: np.searchsorted(self.steps, self.n)]
        self.word_state = np.zeros(self.n, np.int64)
        self.word_state[self.steps[: len(first)]] = first

    def _step(self, state: int, word: int) -> int:
        key = state * self.n + word
        i = int(np.searchsorted(self.steps, key))
        return int(self.targets[i]) if i < len(self.steps) and self.steps[i] == key else -1

    def runs(self, ids: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first position, words) of the runs of known neighbours that are as long as the shortest window."""
        inside = ids >= 0
        joined = inside[:-1] & inside[1:] & (doc[:-1] == doc[1:])
        if self.shortest > 1:
            at = np.nonzero(joined)[0]
            pair = self.word_state[ids[at]] * self.n + ids[at + 1]
            place = np.minimum(np.searchsorted(self.steps, pair), len(self.steps) - 1)
            joined[at] = self.steps[place] == pair
        begin = np.nonzero(inside & ~np.r_[False, joined])[0]
        end = np.nonzero(inside & ~np.r_[joined, False])[0] + 1
        for b, e in zip(begin.tolist(), end.tolist()):
            if e - b >= self.shortest:
                yield b, ids[b:e]

    def walk(self, words: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Ranges of the words inside windows, and the windows' states."""
        found, met, state, size = [], set(), 0, 0
        for i, w in enumerate(words.tolist()):
            while (to := self._step(state, w)) < 0 and state:
                state = int(self.link[state])
                size = int(self.length[state])
            state, size = (to, size + 1) if to >= 0 else (0, 0)
            if size >= WINDOW:
                found.append((i - WINDOW + 1, i + 1))
                met.add(int(self.window[state]))
            v = state if size == self.length[state] else int(self.link[state])
            while v > 0 and (v := int(self.short[v])) > 0:
                found.append((i + 1 - int(self.length[v]), i + 1))
                met.add(v)
                v = int(self.link[v])
        return found, met

    def items_of(self, states: set[int]) -> set[str]:
        out = set()
        for s in states:
            low, high = np.searchsorted(self.owner_states, [s, s + 1])
            out.update(self.items[i] for i in self.owner_items[low:high].tolist())
        return out


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _scanned(sent):
    """Rows (doc_id, sha, text) to _SCHEMA. sent: a broadcast list of automata as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: dict[bytes, int] = {}
        for blob in sent.value:
            for w in blob["vocabulary"].split(b" "):
                vocabulary.setdefault(w, len(vocabulary))
        automata = [Automaton(blob, vocabulary) for blob in sent.value]
        for b, texts in text_slices(batches, 2):
            ids, counts = [], []
            for t in texts:
                parts = [np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int64, len(words)) for words in ascii_words(t)]
                ids.extend(parts)
                counts.append(sum(map(len, parts)))
            word, doc = np.concatenate(ids), np.repeat(np.arange(len(texts)), counts)
            first = np.cumsum(counts) - counts
            ranges: list[list[tuple[int, int]]] = [[] for _ in texts]
            items: list[set[str]] = [set() for _ in texts]
            for a in automata:
                for at, words in a.runs(a.known[word], doc):
                    found, met = a.walk(words)
                    if found:
                        d = int(doc[at])
                        shift = at - int(first[d])
                        ranges[d].extend((low + shift, high + shift) for low, high in found)
                        items[d] |= a.items_of(met)
            spans = pa.array([[{"start": low, "end": high} for low, high in merged(r)] for r in ranges], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            columns = [b.column(0), b.column(1), pa.array(counts, pa.int64()), spans, pa.array([sorted(i) for i in items], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "sha", "n_words", "ranges", "items"])

    return run


def _sha(text: str):
    return F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)


def _scan(docs: DataFrame, items: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _sha("text").alias("sha"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    automata = written(items.repartition(1 + size // (4 * AUTOMATON_WORDS)).mapInArrow(_automata, _BLOB), "automata")
    numbers = sorted(r[0] for r in automata.select("number").collect())
    passes = []
    for low in range(0, max(1, len(numbers)), PASS):
        some = automata.filter(F.col("number").isin(numbers[low : low + PASS])).collect() if numbers else []
        sent = spark.sparkContext.broadcast([r.asDict() for r in some])
        found = docs.mapInArrow(_scanned(sent), _SCHEMA)
        passes.append(found if len(numbers) <= PASS else written(found, "scanned"))
        if len(numbers) > PASS:
            sent.unpersist()
    return passes[0] if len(passes) == 1 else _together(passes)


def _together(passes: list[DataFrame]) -> DataFrame:
    """The passes' rows put together. Equal rows have equal results, so each pass counts them first."""
    key = ["doc_id", "sha", "n_words"]
    each = [p.groupBy(*key).agg(F.count(F.lit(1)).cast("int").alias("copies"), F.any_value("ranges").alias("r"), F.any_value("items").alias("i")) for p in passes]
    every = each[0]
    for e in each[1:]:
        every = every.unionByName(e)
    every = every.groupBy(*key).agg(F.max("copies").alias("copies"), F.array_sort(F.flatten(F.collect_list("r"))).alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("i")))).alias("items"))

    def step(acc, x):
        last = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (x["start"] <= F.get(acc, F.size(acc) - 1)["end"]), longer).otherwise(F.concat(acc, F.array(x)))

    whole = F.aggregate("r", F.array().cast("array<struct<start:int,end:int>>"), step)
    return every.withColumn("_", F.explode(F.sequence(F.lit(1), "copies"))).select(*key, whole.alias("ranges"), "items")


def scan(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, ranges, items) of docs (doc_id, text) against items (item_id, text): maximal ranges of words inside windows, and the items whose windows occur."""
    return _scan(docs, items).drop("sha")


def _without(text: pd.Series, ranges: pd.Series) -> pd.Series:
    def one(t: str | None, gone) -> str | None:
        if t is None or gone is None or not len(gone):
            return t
        data, out, at = t.encode(), [], 0
        spans = [m.span() for m in _WORD.finditer(data)]
        for r in gone:
            out.append(data[at : spans[r["start"]][0]])
            at = spans[r["end"] - 1][1]
        return b"".join([*out, data[at:]]).decode()

    return pd.Series([one(*x) for x in zip(text, ranges)], dtype=object)


def decontaminate(docs: DataFrame, items: DataFrame, span: int = SPAN, coverage: float = COVERAGE) -> DataFrame:
    """docs without the maximal ranges of `span` or more words inside windows; documents with more than `coverage` of their words inside windows are gone. All columns stay."""
    hit = F.aggregate("ranges", F.lit(0), lambda n, r: n + r["end"] - r["start"])
    found = _scan(docs, items).filter(F.size("ranges") > 0).select("doc_id", "sha", (hit > coverage * F.col("n_words")).alias("gone"), F.filter("ranges", lambda r: r["end"] - r["start"] >= span).alias("ranges")).dropDuplicates(["doc_id", "sha"])
    row = in_row(docs, id=F.col("doc_id").cast("long"), of=_sha("text"))
    joined = row.join(found, row["id"].eqNullSafe(found["doc_id"]) & (row["of"] == found["sha"]), "left").filter("gone is null or not gone")
    return out_of_row(joined, docs.columns, text=F.pandas_udf(_without, "string")(F.col("row.text").cast("string"), F.col("ranges")))


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def sql() -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
    WITH i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {words} AS w FROM benchmark),
    windows AS (
      SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS size, array_to_string(w[p:p + {WINDOW - 1}], ' ') AS gram
      FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 2))) AS p FROM i WHERE len(w) > 0)
    ),
    d AS (SELECT doc_id, row_number() OVER () AS id, {words} AS w FROM documents),
    grams AS (
      SELECT id, p, size, array_to_string(w[p:p + size - 1], ' ') AS gram
      FROM (SELECT id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)
    ),
    found AS (SELECT id, p, g.size, item_id FROM grams g JOIN windows v ON g.size = v.size AND g.gram = v.gram),
    hits AS (SELECT id, count(*) AS n FROM (SELECT DISTINCT id, unnest(range(p, p + size)) AS at FROM found) GROUP BY id),
    items AS (SELECT id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT id, item_id FROM found) GROUP BY id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
      sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN hits h ON d.id = h.id LEFT JOIN items t ON d.id = t.id
    """
