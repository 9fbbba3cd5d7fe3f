"""Toxicity by a weighted finite-state pattern grammar.

Five small transducers read the classes of a text's tokens: insult, threat, target, negation and reported speech. Their composition (the
product of their states) is one table, built once; reading a clause through it gives the clause's weight, so an insult aimed at somebody weighs more
than the bare word, and a negated or reported one less. A document's clause weights become a probability by a logistic regression.

The insult transducer's lexicon holds the fixed words below and stems learned from labels: words and word beginnings that are significantly more frequent in
toxic training documents. Lexicon and regression are fitted on at most TRAIN_ROWS labelled rows (those with the smallest hashed doc_id among the training rows); the bound is the
only sample, and every document is scored over its whole text. Labels, lang, source and doc_id are no inputs of a score.

Rules for odd rows: null and empty texts match no clause and get the score of such texts; a null doc_id is not held out and never trained on; labels that are null are ignored and repeated labels
of a document count by their maximum; without labels of both kinds a fixed regression is used; repeated rows are scored each for itself; an empty table gives an
empty one; extra columns are not carried by `score` and pass through `drop_toxic`.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import bounded_sample, written

TRAIN_ROWS, MOST_STEMS, THRESHOLD = 20_000, 4_000, 0.7
#: What a stem needs: training documents with it, log-likelihood ratio, and share of toxic ones among them.
LEAST_DOCS, LEAST_LLR, LEAST_SHARE = 5, 25.0, 0.75
_STEM_LENGTHS = (4, 5, 6)
_WORDS_KEPT = 400_000

# The words of each transducer.
INSULTS = """idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown imbecile dumbass bastard vermin filth
dumm dummkopf idiotin trottel abschaum arschloch wertlos idiote imbécile connard connasse minable ordure stupide estúpido estúpida imbécil escoria basura inútil asqueroso""".split()
THREATS = """kill hurt destroy smash stab shoot burn beat murder crush töten umbringen schlagen vernichten tuer frapper détruire brûler matar golpear destruir quemar""".split()
INTENTS = "will gonna going shall must should wish hope werde wirst sollst vais vas dois voy vas debes".split()
TARGETS = "you your yours you're youre u they them him her he she people du dich dir dein ihr euch tu toi te vous ton usted tú ustedes ellos".split()
NEGATIONS = "not no never isn't aren't wasn't don't without nicht kein keine nie pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says say called calls calling wrote writes quoted quote reported claims claimed according word sagte nannte schrieb dit appelle écrit dijo llamó escribió".split()

OTHER, INSULT, STRONG, THREAT, INTENT, TARGET, NEGATION, REPORT = range(8)
_END = 8  # added to a token's class when a clause ends after it
_EDGE = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum() and chr(c) != "'") + "«»„“”‚‘’…¡¿—–"


# The transducers: state x class -> state. A clause starts in state 0, but for reported speech, which lasts to the end of the sentence.
def _insult(s: int, c: int) -> int:
    return min(3, s + {INSULT: 1, STRONG: 2}.get(c, 0))


def _threat(s: int, c: int) -> int:
    """0 nothing, 1 an intention, 2 a threat without one, 3 a threat with one."""
    if c == INTENT:
        return max(s, 1)
    return {0: 2, 1: 3}.get(s, s) if c == THREAT else s


def _target(s: int, c: int) -> int:
    return 1 if c == TARGET else s


def _negation(s: int, c: int) -> int:
    """4 a negation reached an insult or threat; 3, 2, 1 tokens that an open negation still reaches."""
    if s == 4:
        return 4
    if c == NEGATION:
        return 3
    return 4 if s and c in (INSULT, STRONG, THREAT) else max(0, s - 1)


def _report(s: int, c: int) -> int:
    return 1 if c == REPORT else s


_PARTS = ((_insult, 4), (_threat, 4), (_target, 2), (_negation, 5), (_report, 2))


def compose() -> tuple[list[list[int]], list[tuple[float, float, int, int]]]:
    """The composed transducer: next state by state and class, and each state's output at a clause's end (insult weight, threat weight, aimed, softened)."""
    states = list(product(*[range(n) for _, n in _PARTS]))
    number = {s: i for i, s in enumerate(states)}
    table = [[number[tuple(f(x, c) for (f, _), x in zip(_PARTS, s))] for c in range(8)] for s in states]
    outputs = []
    for insult, threat, target, negation, report in states:
        factor = (0.4 if negation == 4 else 1.0) * (0.5 if report else 1.0)
        aimed = target and (insult or threat)
        a = (0.0, 0.6, 1.0, 1.4)[insult] * (1.5 if aimed else 1.0) * factor
        b = {2: 0.3, 3: 1.0}.get(threat, 0.0) * (1.5 if target else 0.2) * factor
        outputs.append((a, b, int(bool(aimed)), int((insult > 0 or threat > 1) and factor < 1)))
    return table, outputs


class _Classes(dict):
    """Class of a raw token, plus _END if a clause ends after it; found once for each token and kept, up to _WORDS_KEPT tokens."""

    def __init__(self, stems: dict[str, int]):
        self.words = {w: STRONG for w in INSULTS}
        for c, words in ((THREAT, THREATS), (INTENT, INTENTS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            self.words.update(dict.fromkeys(words, c))
        self.stems = stems

    def __missing__(self, token: str) -> int:
        word = token.strip(_EDGE)
        found = self.words.get(word, OTHER)
        if not found and word:
            found = next((self.stems[p] for p in (word, *(word[:n] for n in _STEM_LENGTHS)) if p in self.stems), OTHER)
        if token[-1] in ".!?;:,":
            found += _END * (2 if token[-1] in ".!?" else 1)
        if len(self) < _WORDS_KEPT:
            self[token] = found
        return found


#: Features of a document: weights of its heaviest clause and of all clauses (log), clauses aimed, threats, softened, share of the words.
N_FEATURES = 6
_HITS = frozenset(c + e for c in (INSULT, STRONG, THREAT) for e in (0, _END, 2 * _END))
_NO_HIT = bytes(c for c in range(256) if c not in _HITS)


def _features(text: str | None, classes: _Classes, table, outputs) -> tuple[float, ...]:
    tokens = (text or "").lower().split()
    codes = bytes(map(classes.__getitem__, tokens))
    if not codes.translate(None, _NO_HIT):
        return (0.0,) * N_FEATURES
    top = total = threats = 0.0
    aimed = softened = state = 0
    for code in codes + bytes([2 * _END]):
        state = table[state][code & 7]
        if code >= _END:
            a, b, hit, soft = outputs[state]
            if a or b:
                top = max(top, a + b)
                total += a + b
                threats += b
                aimed += hit
                softened += soft
            state = 0 if code >= 2 * _END else state & 1  # the last digit is reported speech
    return (top, math.log1p(total), math.log1p(aimed), math.log1p(threats), math.log1p(softened), min(1.0, 20 * total / len(tokens)))


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stem, toxic, all): documents of this task that have a stem."""
    toxic, every = Counter(), Counter()
    for b in batches:
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            stems = set()
            for token in set((text or "").lower().split()):
                word = token.strip(_EDGE)
                if word.isalpha() and len(word) > 3:
                    stems.update((word, *(word[:n] for n in _STEM_LENGTHS if len(word) > n)))
            every.update(stems)
            if y:
                toxic.update(stems)
    keys = list(toxic)
    yield pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([every[k] - toxic[k] for k in keys], pa.int64()), pa.array([False] * len(keys))], names=["stem", "toxic", "clean", "rest"]
    )
    keys = [k for k in every if k not in toxic]
    zeros = pa.array(np.zeros(len(keys), np.int64))
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), zeros, pa.array([every[k] for k in keys], pa.int64()), pa.array([True] * len(keys))], names=["stem", "toxic", "clean", "rest"])


def learn_stems(train: DataFrame, toxic: int, clean: int) -> dict[str, int]:
    """Stems (to INSULT or STRONG) from train (text, toxic): at most MOST_STEMS, the most significant ones."""
    if not toxic or not clean:
        return {}
    counts = train.select("text", "toxic").mapInArrow(_stem_counts, "stem string, toxic long, clean long, rest boolean")
    counts = counts.groupBy("stem").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).filter(F.col("t") >= LEAST_DOCS)
    share, rate = F.col("t") / (F.col("t") + F.col("c")), toxic / (toxic + clean)
    part = lambda n, p, q: F.when(n > 0, n * F.log(p / q)).otherwise(0.0)
    llr = 2 * (part(F.col("t"), share, F.lit(rate)) + part(F.col("c"), 1 - share, F.lit(1 - rate)))
    found = counts.withColumns({"share": share, "llr": llr}).filter((F.col("share") >= LEAST_SHARE) & (F.col("llr") >= LEAST_LLR))
    return {r["stem"]: STRONG if r["share"] >= 0.9 else INSULT for r in found.orderBy(F.desc("llr"), "stem").limit(MOST_STEMS).collect()}


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge; the last coefficient is the constant."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    ridge = np.r_[np.full(x.shape[1], 0.5), 1e-3]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(h, a.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


_FIXED = np.array([3.0, 1.0, 0.5, 0.5, -1.0, 0.5, -3.0])


def _scorer(stems: dict[str, int], weights: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, (table, outputs) = _Classes(stems), compose()
        for b in batches:
            x = np.array([_features(t.as_py(), classes, table, outputs) for t in b.column(1)], float).reshape(-1, N_FEATURES)
            if weights is None:
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in x.T]], names=["id", *[f"f{i}" for i in range(N_FEATURES)]])
            else:
                score = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], names=["id", "score"])

    return run


def held_out(column: str = "doc_id"):
    """True for rows that are never trained on: crc32 of the doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[dict[str, int], np.ndarray]:
    """Stems and regression weights from at most `rows` labelled rows that are not held out. labels: (doc_id, toxic)."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out())
    known = known.groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").cast("long").alias("toxic"))
    known = written(bounded_sample(known, "label_id", rows), "labels")
    # At most `rows` rows, so broadcasting has a fixed bound.
    train = written(docs.join(F.broadcast(known), docs["doc_id"] == known["label_id"]).select("text", "toxic"), "train")
    n = {r[0]: r[1] for r in train.groupBy(F.col("toxic") > 0).count().collect()}
    if len(n) < 2:
        return {}, _FIXED
    stems = learn_stems(train, n[True], n[False])
    schema = ", ".join(["id long", *[f"f{i} double" for i in range(N_FEATURES)]])
    got = train.select("toxic", "text").mapInArrow(_scorer(stems, None), schema).toPandas().to_numpy(float)
    return stems, _fit(got[:, 1:], (got[:, 0] > 0).astype(float))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stems, weights = fit(docs, labels)
    out = docs.mapInArrow(_scorer(stems, weights), "id long, score double").withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows predicted toxic; all columns stay, whatever their names."""
    stems, weights = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    run = _scorer(stems, weights)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pair = pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), b.column(b.schema.get_field_index("text"))], names=["id", "text"])
            for s in run(iter([pair])):
                yield b.filter(pa.array(s.column(1).to_numpy() < THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
