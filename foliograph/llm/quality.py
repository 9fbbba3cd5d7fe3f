"""Quality rules as a learned decision list.

Sequential covering over labelled statistics grows conjunctions of threshold tests and prunes them on held-back rows; the rules become ordered
conditional expressions, evaluated on all documents' statistics inside Spark.

Statistics are counted over whole texts in Arrow batches, a row at a time in memory. The list is learned on at most TRAIN_ROWS labelled rows
(those with the smallest hashed doc_id); that bound is the only sample, and statistics and verdicts cover every row.

Rules for odd rows: a null text has no words and fails the base rule; empty texts likewise; a null doc_id is never a
training row; labels that are null or repeated count once each where present; without labels of both kinds the list is empty and
the base rule alone decides; repeated rows are judged each for itself; extra columns are not carried.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import bounded_sample, written

TRAIN_ROWS = 20_000
#: A rule needs this precision on the rows it was pruned on and this many rows; a conjunction has at most MOST_TESTS tests.
PRECISION, LEAST_ROWS, MOST_TESTS, MOST_RULES = 0.9, 5, 3, 12
_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_digits", "n_marks", "n_same_next", "n_lines", "n_distinct")

#: Statistics that tests use: shares, so that a rule means the same for short and long texts.
FEATURES = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(n_letters, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "same_next_share": "n_same_next / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "mean_line": "n_words / greatest(n_lines, 1)",
}


def count_statistics(text: bytes | None) -> tuple[int, ...]:
    """The counts of one text, in the order of _COUNTS. Words are separated by ASCII white space."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return (0, 0, len(text) - len(text.translate(None, _SYMBOLS)), *[0] * 9)
    packed = text.translate(None, _SPACE)
    decoded = packed.decode("utf-8", "replace")
    repeat = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:]))
        seen = Counter(windows)
        if len(seen) < len(windows):
            upto = 0
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeat += i + 3 - max(upto, i)
                    upto = i + 3
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    upper = sum(map(len, filter(bytes.isupper, words)))
    return (
        n,
        len(decoded),
        len(packed) - len(packed.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat,
        upper,
        len(packed.translate(None, b"0123456789.,;:!?\"'()-" + _SYMBOLS)),
        len(packed) - len(packed.translate(None, b"0123456789")),
        packed.count(b"!") + packed.count(b"?"),
        sum(map(bytes.__eq__, words, words[1:])),
        len(lines),
        len(set(words)),
    )


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [count_statistics(t.as_py()) for t in b.column(1).cast(pa.binary())]
        columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(_COUNTS)
        yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", *_COUNTS])


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, the counts) of docs (doc_id, text)."""
    schema = ", ".join(["doc_id long", *[f"{c} long" for c in _COUNTS]])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_statistics, schema)


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    bound: float

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.bound if self.above else x[self.feature] <= self.bound

    def sql(self) -> str:
        return f"({FEATURES[self.feature]} {'>=' if self.above else '<='} {self.bound!r}D)"


def _covered(rule: list[Test], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for t in rule:
        out &= t.mask(x)
    return out


def _grow(x: dict[str, np.ndarray], y: np.ndarray) -> list[Test]:
    """Adds the test of the largest information gain until no negative row is covered or no test helps."""
    rule: list[Test] = []
    live = np.ones(len(y), bool)
    while len(rule) < MOST_TESTS and (live & ~y).any():
        p0, n0 = (live & y).sum(), (live & ~y).sum()
        best: tuple[float, Test | None] = (1e-9, None)
        for name, values in x.items():
            v, yes = values[live], y[live]
            order = np.argsort(v, kind="stable")
            v, yes = v[order], yes[order]
            edge = np.nonzero(np.diff(v) > 0)[0]
            if not len(edge):
                continue
            up_to = np.cumsum(yes)[edge].astype(float)
            rows = (edge + 1).astype(float)
            for above in (True, False):
                p = p0 - up_to if above else up_to
                size = len(v) - rows if above else rows
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / size) - np.log2(p0 / (p0 + n0))), 0)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (float(gain[i]), Test(name, above, float((v[edge[i]] + v[edge[i] + 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        live &= best[1].mask(x)
    return rule


def _prune(rule: list[Test], x: dict[str, np.ndarray], y: np.ndarray) -> list[Test]:
    """Drops last tests as long as (p - n) / (p + n) on the held-back rows doesn't fall."""

    def worth(r: list[Test]) -> float:
        c = _covered(r, x, len(y))
        p, n = (c & y).sum(), (c & ~y).sum()
        return (p - n) / max(1, p + n)

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(x: dict[str, np.ndarray], low: np.ndarray, order: np.ndarray) -> list[list[Test]]:
    """Ordered rules for low quality. `order` decides which third of the rows is held back for pruning."""
    rules: list[list[Test]] = []
    back = order % 3 == 0
    left = np.ones(len(low), bool)
    while len(rules) < MOST_RULES and (left & low).sum() >= LEAST_ROWS:
        grown_on, held = left & ~back, left & back
        rule = _grow({k: v[grown_on] for k, v in x.items()}, low[grown_on])
        if not rule:
            break
        rule = _prune(rule, {k: v[held] for k, v in x.items()}, low[held])
        c = _covered(rule, x, len(low)) & left
        p, n = (c & low).sum(), (c & ~low).sum()
        if p < LEAST_ROWS or p < PRECISION * (p + n):
            break
        rules.append(rule)
        left &= ~c
    return rules


def rules_column(rules: list[list[Test]]) -> Column:
    """The list as one ordered conditional: false at the first rule that holds, else true."""
    out = None
    for rule in rules:
        holds = F.expr(" AND ".join(t.sql() for t in rule))
        out = F.when(holds, False) if out is None else out.when(holds, False)
    return F.lit(True) if out is None else out.otherwise(True)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit(stats: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> list[list[Test]]:
    """Rules learned on at most `rows` labelled rows that pass the base rule. labels: (doc_id, quality)."""
    given = labels.filter("doc_id is not null and quality is not null").select(F.col("doc_id").alias("label_id"), "quality")
    train = stats.join(given, stats["doc_id"] == given["label_id"]).filter(~base_failed())
    train = train.select(F.col("doc_id").alias("h"), (F.col("quality") == 0).alias("low"), *[F.expr(e).alias(k) for k, e in FEATURES.items()])
    got = bounded_sample(train, "h", rows).toPandas()
    if not len(got) or got["low"].nunique() < 2:
        return []
    return learn({k: got[k].to_numpy(float) for k in FEATURES}, got["low"].to_numpy(bool), np.arange(len(got)))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, the counts, base_failed, kept) of docs (doc_id, text)."""
    stats = written(statistics(docs), "statistics")
    verdict = rules_column(fit(stats, labels))
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(verdict))


def query(spark, sf_dir: str) -> DataFrame:
    judged = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
