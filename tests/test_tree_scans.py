"""Tags and trees of documents with many sections, against a plain loop."""

import random

from pyspark.sql import functions as F

from foliograph.operators import content


def walk(levels, words):
    """(tag, parent, depth, subtree_end, child words) of each section, by a stack."""
    n1 = n2 = n3 = 0
    out, open_ = [], []
    for i, level in enumerate(levels):
        if level == 1:
            n1, n2, n3 = n1 + 1, 0, 0
        elif level == 2:
            n2, n3 = n2 + 1, 0
        else:
            n3 += 1
        top = n1 or -1
        tag = [f"h1_{top}", f"h2_{top}_{n2}", f"h3_{top}_{n2}_{n3}"][level - 1]
        while open_ and levels[open_[-1]] >= level:
            out[open_.pop()][3] = i + 1
        out.append([tag, out[open_[-1]][0] if open_ else None, len(open_), None, 0])
        for j in open_:
            out[j][4] += words[i]
        open_.append(i)
    return [tuple(x) for x in out]


def test_tree_like_a_stack(spark):
    rng = random.Random(3)
    docs = {d: [(rng.choice((1, 2, 3, 3, 3)), rng.randint(0, 9)) for _ in range(rng.randint(1, 60))] for d in range(12)}
    docs |= {100: [(3, 1)] * 20, 101: [(2, 2), (3, 1), (1, 4), (3, 5)], 102: [(1, 1)] + [(3, 2)] * 40 + [(2, 1)]}
    rows = [(d, i + 1, level, n) for d, x in docs.items() for i, (level, n) in enumerate(x)]
    heads = spark.createDataFrame(rows, "doc_id long, sec_no long, level int, word_count long")
    t = content.document_tree(content.section_tags(heads)).orderBy("doc_id", "sec_no").collect()
    got = [(r["doc_id"], r["tag"], r["parent_id"], r["depth"], r["subtree_end"], r["child_word_count"]) for r in t]
    assert got == [(d, *x) for d in sorted(docs) for x in walk(*zip(*docs[d]))] and t[0]["node_id"] == t[0]["tag"]


def test_one_document_of_many_sections(spark):
    """A third of all sections are one document's: its totals are right."""
    n = 200_000
    heads = spark.range(1, n + 1).select(F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.col("id") / 3).otherwise(1).cast("long").alias("sec_no"), F.lit(1).cast("long").alias("word_count"))
    heads = heads.filter("doc_id <> 1 or sec_no > 1").union(spark.createDataFrame([(1, 1, 1)], heads.schema)).distinct()
    heads = heads.withColumn("level", F.when(F.col("sec_no") == 1, 1).when(F.col("sec_no") % 1000 == 2, 2).otherwise(3))
    t = content.document_tree(content.section_tags(heads)).filter("doc_id = 1")
    root, last = t.filter("sec_no = 1").first(), t.orderBy(F.desc("sec_no")).first()
    assert root["child_word_count"] == n // 3 - 1 and root["subtree_end"] is None
    assert last["tag"] == f"h3_1_{(n // 3 - 2) // 1000 + 1}_{(n // 3 - 2) % 1000}" and last["depth"] == 2
    assert t.agg(F.sum("child_word_count")).first()[0] == (n // 3 - 1) + t.filter("level = 3").count()


def test_no_sections(spark):
    none = spark.createDataFrame([], "doc_id long, sec_no long, level int, word_count long")
    assert content.document_tree(content.section_tags(none)).count() == 0
