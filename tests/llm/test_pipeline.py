from pyspark.sql import functions as F

import corpus_pipeline
from foliograph.llm import secrets, toxicity
from foliograph.llm.common import written


def test_stages_on_small_and_odd_tables(spark, sf, odd_docs):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd_docs, odd_docs.limit(0)):
        columns, n = docs.columns, docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, sf), name)
            assert docs.columns == columns
            if name == "near_copies":
                ids = [r[0] for r in docs.select("doc_id").collect() if r[0] is not None]
                assert len(ids) == len(set(ids)) and (n == 0 or 0 < len(ids) <= n)
            if name == "secrets":
                assert secrets.scan_secrets(docs).filter("size(secret_spans_base) > 0").count() == 0
        out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
        assert (out.count() == 0) == (n == 0)


def test_clean_documents_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r[0] for r in corpus_pipeline.drop_toxic(spark, docs, sf).select("doc_id").collect()}
    scores = toxicity.score(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert kept == {r["doc_id"] for r in scores if not r["predicted"]}


def test_edited_copies_go(spark, sf):
    words = [f"w{i * 7919 % 1000}" for i in range(200)]
    edited = [f"new{i}" if i % 70 == 9 else w for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(words[::-1]))], "doc_id long, text string")
    assert sorted(r[0] for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect()) == [1, 3]


#: Names that operators use for columns of their own, and those of the tables that they join.
CLASHES = (
    "toxic quality id row crc kept_id ranges doc text_crc start size gone given spans fold masked secret_spans secret_spans_base mix_source mix_bounds rate u n salt salt_of "
    "first_doc_id component_id component node fp rep fingerprint held_out score predicted k1 k2 bands _row _text _base _kept _gone _spans _fold mix_n mix_u copies class share key r crcs"
).split()


def test_extra_columns_with_any_name_come_through(spark, sf):
    docs = spark.createDataFrame([(i, f"{i % 3} some words of a text {i % 3} that go on for a while, secret=abcdef{i % 3}", "a") for i in range(6)], "doc_id long, text string, source string")
    wide = docs.select("*", *[F.concat(F.lit(f"{c}-"), "doc_id").alias(c) for c in CLASHES])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, sf).collect()
        assert out and all(r[c] == f"{c}-{r['doc_id']}" for r in out for c in CLASHES), name
    from foliograph.llm import mixing, paragraphs, simhash

    for f in (simhash.keep_first, paragraphs.keep_first_copies, paragraphs.remove_passages, mixing.mix, secrets.redact_secrets):
        out = f(wide).collect()
        assert out and all(r[c] == f"{c}-{r['doc_id']}" for r in out for c in CLASHES), f
    assert corpus_pipeline.STAGES[-1][1](spark, wide, sf).count() > 0


def test_different_texts_of_one_doc_id_stay(spark):
    from foliograph.llm import paragraphs, simhash

    docs = spark.createDataFrame([(1, "one two three four five six", "b"), (1, "one two three four five six", "a"), (1, "other words that are not those at all", "c"), (2, "one two three four five six", "d")], "doc_id long, text string, tag string")
    for f in (simhash.keep_first, paragraphs.keep_first_copies):
        assert sorted((r["doc_id"], r["tag"]) for r in f(docs).collect()) == [(1, "a"), (1, "c")]
