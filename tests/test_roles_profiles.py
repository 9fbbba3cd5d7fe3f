"""Keyword rules, similarity and layered profiles against plain loops."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from foliograph.operators import profiles, roles
from foliograph.plans import fixtures as X


def test_keyword_hits_like_a_search(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abß é") for _ in range(n))
    terms = [(p, i, f"r{i}", word(rng.randint(1, 7))) for p in ("one", "two") for i in range(25) for _ in range(2)] + [("two", 30, "all", ""), ("one", 3, "none", None)]
    titles = [(p, t) for p in ("one", "two", "three") for t in {word(rng.randint(0, 14)) for _ in range(150)}] + [("one", None), ("two", None), ("two", "")]
    got = roles.keyword_hits(spark.createDataFrame(titles, "profile_id string, title string"), spark.createDataFrame(terms, "profile_id string, rule_idx int, role string, term string"))
    want = {}
    for p, t in titles:
        found = [(i, r) for q, i, r, x in terms if p == q and x is not None and t is not None and x.upper() in t.upper()]
        if found:
            want[p, t] = min(found)
    assert {(r["profile_id"], r["title"]): (r["rule_idx"], r["role"]) for r in got.collect()} == want and len(want) > 200


def test_one_title_holds_most_rows(spark):
    resolved, _ = profiles.resolve_profiles(X.profiles(spark))
    nodes = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("n").alias("node_id"), F.lit("paper").alias("profile_id"), F.when(F.col("id") % 3 > 0, "Our Method").otherwise(F.concat(F.lit("zq"), "id")).alias("title"))
    counts = {r["semantic_role"]: r["count"] for r in roles.keyword_classify(nodes, resolved).groupBy("semantic_role").count().collect()}
    assert counts == {"methodology": 13333, "generic": 6667}


def _grams(text):
    words = f"{text}".lower().split()
    return Counter(w[i : i + n] for w in (f" {x} " for x in words) for n in (3, 4, 5) for i in range(len(w) - n + 1))


def test_similarity_like_a_loop(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 6)))
    said = {f"r{i}": " ".join(word() for _ in range(6)) for i in range(7)} | {"same": "xyz xyz", "twin": "xyz xyz"}
    base = X.profiles(spark).filter("id = 'base'")
    vocabulary = ["generic", *said]
    p = base.withColumn("role_vocabulary", F.array(*[F.lit(r) for r in vocabulary])).withColumn("role_descriptions", F.create_map(*[F.lit(x) for kv in said.items() for x in kv]))
    queries = ["", "qqqq", "xyz", *{" ".join(word() for _ in range(rng.randint(1, 8))) for _ in range(60)}]
    docs = {r: _grams(f"{r} {d}") for r, d in said.items()}
    idf = {g: math.log((len(docs) + 1) / (sum(g in d for d in docs.values()) + 1)) + 1 for g in {g for d in docs.values() for g in d}}
    want = {}
    for q in queries:
        c = _grams(q)
        norm = math.sqrt(sum((n * idf.get(g, 1.0)) ** 2 for g, n in c.items()))
        for r, d in docs.items():
            if set(c) & set(d):
                want[q, r] = sum(c[g] * d[g] * idf[g] ** 2 for g in c if g in d) / norm / math.sqrt(sum((n * idf[g]) ** 2 for g, n in d.items()))
    texts = spark.createDataFrame([("base", q) for q in queries] + [("base", None)], "profile_id string, query string")
    got = {(r["query"], r["role"]): r["similarity"] for r in roles.role_cosine(texts, p).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    best = {r["query"]: r for r in roles.best_role(texts, p).collect()}
    assert len(best) == len(set(queries)) + 1
    for q in queries:
        top = max([want[q, r] for r in said if (q, r) in want], default=0.0)
        assert abs(best[q]["similarity"] - top) < 1e-9 and (best[q]["role"] == "generic") == (top == 0)
    assert best["xyz"]["role"] == "same" and best[None]["role"] == "generic"  # of equals the earlier


def test_extension_paths(spark):
    chain = {f"c{i}": f"c{i + 1}" for i in range(100)} | {"c100": None}
    ring = {f"k{i}": f"k{(i + 1) % 5}" for i in range(5)} | {f"t{i}": f"t{i + 1}" for i in range(9)} | {"t9": "k3", "self": "self", "to_self": "self"}
    lost = {"l1": "l2", "l2": "l3", "l3": "nobody"}
    extends = chain | ring | lost
    want = {}
    for p in extends:
        path, at = [p], extends[p]
        while at is not None and at in extends and at not in path:
            path.append(at)
            at = extends[at]
        want[p] = (path, at, "whole" if at is None else "cycle" if at in path else "missing")
    rows = spark.createDataFrame(list(extends.items()), "id string, extends string")
    assert {r["id"]: (r["path"], r["next"], r["state"]) for r in profiles.extension_paths(rows).collect()} == want


def test_long_chain_of_layers(spark):
    one = X.profiles(spark).filter("id = 'base'")
    none = one.schema
    rows = [{**{f.name: None for f in none}, "id": f"p{i}", "extends": f"p{i + 1}" if i < 49 else "base", "role_vocabulary": [f"r{i}"]} for i in range(50)]
    p = one.union(spark.createDataFrame([tuple(r[f.name] for f in none) for r in rows], none))
    resolved, errors = profiles.resolve_profiles(p)
    got = {r["id"]: r for r in resolved.collect()}
    assert errors.count() == 0 and len(got) == 51
    assert got["p0"]["role_vocabulary"] == got["base"]["role_vocabulary"] + [f"r{i}" for i in range(49, -1, -1)] and got["p0"]["default_role"] == "generic"


def test_no_profiles_no_titles(spark):
    none = X.profiles(spark).limit(0)
    resolved, errors = profiles.resolve_profiles(none)
    assert resolved.count() == errors.count() == 0
    nodes = spark.createDataFrame([], "doc_id long, node_id string, profile_id string, title string, first_paragraph string")
    assert roles.router_classify(nodes, resolved, lazy=True).count() == 0


def test_grams_that_no_role_has_stay_in_their_row(spark):
    """They count in a text's norm, but give no row: a text of only such grams has no score, and the default role."""
    resolved, _ = profiles.resolve_profiles(X.profiles(spark))
    base = resolved.filter("id = 'base'")
    texts = roles._keyed(spark.createDataFrame([("base", "qqxq wwzw"), ("base", "method qqxq qqxq"), ("base", "")], "profile_id string, query string"))
    weights = roles.role_weights(base)
    scores = roles._scores(texts, weights).collect()
    assert len(scores) == 1
    idf = {r["gram"]: r["idf"] for r in weights.collect()}
    grams = Counter(f" {w} "[i : i + n] for w in ("method", "qqxq", "qqxq") for n in (3, 4, 5) for i in range(len(w) + 3 - n))
    assert math.isclose(scores[0]["qn"], math.sqrt(sum((n * idf.get(g, 1.0)) ** 2 for g, n in grams.items())), rel_tol=1e-12)
    best = {r["query"]: (r["role"], r["similarity"]) for r in roles.best_role(texts.select("profile_id", "query"), base).collect()}
    assert best["qqxq wwzw"] == best[""] == ("generic", 0.0) and best["method qqxq qqxq"][0] == "methodology"
