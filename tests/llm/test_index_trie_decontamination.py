"""op11, op12 and op13 against brute-force versions, on odd rows and with small bounds, so that every way through them is taken."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from foliograph.llm import decontamination, ranking, registry, trie
from foliograph.llm.common import ascii_words

from .conftest import prose


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_words_of_long_texts(monkeypatch):
    from foliograph.llm import common

    monkeypatch.setattr(common, "_WORD_PART", 7)
    for text in ["", "a", "Ab c\x00d-é_Z9 x" * 9, " " * 50, "x" * 40, "\x85 a\xa0b\n"]:
        assert [w.decode() for part in ascii_words(text.encode()) for w in part] == words_of(text)


def test_queries_equal_their_sql(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name in ("op11_ranked_search", "op12_conversation_trie", "op13_decontamination"):
        df = registry.queries()[name](spark, sf)
        r = con.execute(registry.oracle_sql()[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == sorted(df.columns)
        got = sorted(repr([row[c] for c in sorted(names)]) for row in df.collect())
        assert got and got == sorted(repr([x for _, x in sorted(zip(names, row))]) for row in r.fetchall())


# ---- 11 ranked search


def plain_rank(docs, items):
    terms = [(d, words_of(t)) for d, t in docs]
    terms = [(d, w) for d, w in terms if w]
    total, length = len(terms), sum(len(w) for _, w in terms)
    df = Counter(x for _, w in terms for x in set(w))
    asked = defaultdict(Counter)
    for item, text in items:
        if item is not None:
            asked[item].update(words_of(text))
    out = []
    for item, repeats in asked.items():
        found = []
        for d, w in terms:
            tf, m = Counter(w), 100 - 25 + 25 * len(w) * total // length
            score = sum(n * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m)) for t, n in repeats.items() if tf[t])
            if score > 0 and d is not None:
                found.append((-score, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(found)[:20], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def searched(spark, odd_docs):
    r = random.Random(3)
    docs = [(x["doc_id"], x["text"]) for x in odd_docs.collect()] + [(100 + i, prose(i, r.choice([3, 40, 90]))) for i in range(150)] + [(300 + i, prose(77, 30)) for i in range(40)] + [(-5, prose(77, 30))]
    items = [(1, prose(77, 25)), (2, prose(3, 12)), (2, "River42 river42 RIVER1"), (3, None), (4, "zzz unheard"), (None, prose(5, 9)), (5, "the0 of1"), (6, "of1 of1 the0"), (7, "")]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_ranked_search(spark, searched, monkeypatch, small):
    docs, items = searched
    if small:  # many grids, several blocks of items, ranges opened one by one
        for name, value in {"COLUMNS": 5, "BATCH": 1, "BLOCK_WORDS": 10}.items():
            monkeypatch.setattr(ranking, name, value)
        monkeypatch.setattr("foliograph.llm.substrings.SLICE", 600)
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS score", "'x' AS item_id").repartition(3)
    got = ranking.rank(d, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "2 AS rank"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain_rank(docs, items)


def test_ranked_search_of_nothing(spark, searched, no_docs):
    items = spark.createDataFrame(searched[1], "item_id long, text string")
    assert ranking.rank(no_docs, items).count() == 0
    assert ranking.rank(spark.createDataFrame(searched[0], "doc_id long, text string"), items.limit(0)).count() == 0
    assert ranking.rank(spark.createDataFrame([(None, "the0"), (1, "other")], "doc_id long, text string"), items).count() == 0


def test_treap_maxima_and_packing():
    r = np.random.default_rng(1)
    rows, columns, values = r.integers(0, 50, 300), r.integers(0, 700, 300), r.integers(1, 1000, 300)
    _, one = np.unique(rows * 1000 + columns, return_index=True)
    rows, columns, values = rows[one], columns[one], values[one]
    t = ranking.Treap.of(rows, columns, values)
    again = ranking.Treap.unpacked(*t.packed())
    assert t.levels == again.levels == 10 and again.maxima[0].tolist() == [values.max()]
    for a, b in zip(t.maxima, again.maxima):
        assert a.tolist() == b.tolist()
    for level in range(11):
        cells = {}
        for x, y, v in zip(rows >> (10 - level), columns >> (10 - level), values):
            cells[x, y] = max(v, cells.get((x, y), 0))
        assert sorted(cells.values()) == sorted(again.maxima[level].tolist())


# ---- 12 prefix trie


def plain_trie(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [x[2:] for x in sorted(t)] for c, t in convs.items()}
    new = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        new[c] = tuple(said.get(base, [])[:h] + said[c][h:])
    members = defaultdict(list)
    for c, t in new.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        own = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += own
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(new[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def talks():
    r = random.Random(5)
    rows = []
    for c in [*range(0, 130), -3, -41, 2**40]:
        same = r.random() < 0.6
        for t in range(r.choice([1, 2, 3, 5, 9])):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} same words" if same and r.random() < 0.9 else f"turn {t} of {c % 7} \t\n x"))
    rows += [(200, i, "user", f"word {i % 3}") for i in range(60)] + [(201, i, "user", f"word {i % 3}") for i in range(45)]
    rows += [(202, None, None, None), (202, 3, "user", ""), (202, None, "user", "null first"), (202, 3, "user", "tie"), (202, 3, "user", "tie"), (None, 0, "user", "nobody")]
    return rows


def trie_of(spark, rows, **how):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS depth", "2 AS pos", "3 AS k1").repartition(3)
    return sorted((tuple(x) for x in trie.conversation_trie(df, **how).collect()), key=repr)


@pytest.mark.parametrize("local", [200_000, 8])
def test_trie(spark, talks, monkeypatch, local):
    if local == 8:  # components are split by joins, conversations have several blocks
        monkeypatch.setattr(trie, "BLOCK", 4)
    assert trie_of(spark, talks, local=local) == plain_trie(talks)


def test_trie_of_few_and_none(spark):
    assert trie_of(spark, []) == []
    assert trie_of(spark, [(None, 1, "user", "x")]) == []
    one = [(1, 1, "user", "x")]  # h of 1 is 3: the conversation has no turns
    assert trie_of(spark, one) == plain_trie(one) == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]


def test_centroid_sums():
    r = random.Random(2)
    for shape in ("path", "star", "random", "forest"):
        n = 60
        parent = [-1] + [{"path": i - 1, "star": 0, "random": r.randrange(i), "forest": r.randrange(-1, i)}[shape] for i in range(1, n)]
        component, weight = [0] * n, [r.randrange(1, 9) for _ in range(n)]
        for i in range(n):
            component[i] = i if parent[i] < 0 else component[parent[i]]
        values = np.array([[r.randrange(5) for _ in range(n)], [1] * n])
        total, expected = weight[:], values.copy()
        for i in range(n - 1, 0, -1):
            if parent[i] >= 0:
                total[parent[i]] += total[i]
                expected[:, parent[i]] += expected[:, i]
        got = trie.centroid_sums(np.array(component), np.array(parent), np.array(total), values)
        assert got.tolist() == expected.tolist()


# ---- 13 decontamination


def plain_scan(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        if w:
            size = min(10, len(w))
            for i in range(len(w) - size + 1):
                windows[tuple(w[i : i + size])].add(item or "")
    out = []
    for d, text in docs:
        w, hit, met = words_of(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if found := windows.get(tuple(w[i : i + size])):
                    hit.update(range(i, i + size))
                    met |= found
        out.append((d, len(w), tuple(sorted(hit)), tuple(sorted(met))))
    return sorted(out, key=repr)


def scanned(df):
    return sorted(((r["doc_id"], r["n_words"], tuple(i for x in r["ranges"] for i in range(x["start"], x["end"])), tuple(r["items"])) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def tests_and_docs(odd_docs):
    r = random.Random(9)
    ab = lambda n: " ".join(r.choice("ab") for _ in range(n))
    items = [("q1", prose(1, 30)), ("q2", prose(2, 30) + " " + prose(1, 12)), ("q2", "Short ITEM here"), ("q3", "one"), ("q4", ab(300)), ("q5", ab(4)), (None, "no id given"), ("q6", None), ("q7", " ,;- "), ("q8", "ITEM here")]
    docs = [(x["doc_id"], x["text"]) for x in odd_docs.collect()]
    docs += [(20, "so. " + prose(1, 30).upper() + "! tail"), (21, prose(1, 9)), (22, "a short-item HERE; and one"), (23, ab(500)), (24, prose(1, 15) + " " + prose(2, 20)), (25, prose(2, 30)[9:] + " no id given"), (26, "b a"), (20, "one"), (20, "one")]
    return items, docs


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("without", [(), ("q3", "q5", "q8")])
def test_scan(spark, tests_and_docs, monkeypatch, small, without):
    items, docs = tests_and_docs
    items = [i for i in items if i[0] not in without]
    if small:  # several automata and passes, long items in pieces
        for name, value in {"AUTOMATON_WORDS": 20, "PIECE": 15, "PASS": 2}.items():
            monkeypatch.setattr(decontamination, name, value)
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS ranges", "'y' AS sha").repartition(3)
    i = spark.createDataFrame(items, "item_id string, text string").repartition(2)
    assert scanned(decontamination.scan(d, i)) == plain_scan(docs, items)


def test_scan_of_nothing(spark, tests_and_docs, no_docs):
    items, docs = tests_and_docs
    i, d = spark.createDataFrame(items, "item_id string, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    assert decontamination.scan(no_docs, i).count() == 0
    assert scanned(decontamination.scan(d, i.limit(0))) == plain_scan(docs, [])


def test_decontaminate(spark):
    leak, clean = prose(1, 20), prose(2, 40)
    docs = spark.createDataFrame([(1, f"{clean}; {leak}! end", 7), (2, leak, 8), (3, clean, 9), (None, None, 1), (1, clean, 3)], "doc_id long, text string, gone int")
    out = decontamination.decontaminate(docs, spark.createDataFrame([("q", leak)], "item_id string, text string"))
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, f"{clean}; ! end", 7), (3, clean, 9), (None, None, 1), (1, clean, 3)], key=repr)
