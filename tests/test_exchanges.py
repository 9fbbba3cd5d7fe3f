"""What is left on disk and what is exchanged: tables that are written leave no shuffle files, and texts aren't exchanged where only a part of them is needed."""

import os
import random
import time

from pyspark.sql import functions as F

from foliograph.functions import text as T
from foliograph.operators import checks, readback
from foliograph.plans import queries as Q
from foliograph.sources.scratch import shared_dir, written

from .test_chain import _shuffled


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_written_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    assert written(spark.range(1000).repartition(3, "id"), "some").count() == 1000
    late = time.time() + 20
    while (left := {f for f in _shuffle_files(spark) - before if f.endswith(".data")}) and time.time() < late:
        time.sleep(0.2)
    assert len(left) <= 4, left  # those of the count


def test_chain_deletes_the_corpus_that_nothing_reads_again(spark, sf):
    assert Q.chain(spark, sf).docs.count() > 0
    folder = shared_dir(spark).removeprefix("file:")
    assert not [x for x in os.listdir(folder) if x.startswith("md-")] and [x for x in os.listdir(folder) if x.startswith("blocks-")]


def _long(n: int, seed: int) -> str:
    r = random.Random(seed)
    return "".join(chr(r.randrange(97, 123)) for _ in range(n))


def _merged(spark, f):
    """f() and the bytes that it exchanges when no side is broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    before = _shuffled(spark)
    try:
        return f(), _shuffled(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_checks_exchange_the_beginnings_of_texts(spark):
    docs = spark.createDataFrame([(1, 1)], "doc_id long, template_id long")
    texts = [_long(20_000, i) for i in range(40)]
    e = spark.createDataFrame([(1, i, "para", f"p{i}", "Normal", t, "exact") for i, t in enumerate([*texts, "  "])], "doc_id long, seq int, kind string, para_id string, style string, text string, line_rule string")
    styles = spark.createDataFrame([(1, "Normal")], "template_id long, body_style string")
    formats = spark.createDataFrame([(1, {"lineSpacing": "1.5", "lineRule": "auto"})], "template_id long, body_format map<string,string>")
    s6, moved = _merged(spark, lambda: checks.line_spacing(docs, e, formats, styles).first())
    assert not s6["passed"] and s6["details"][0] == f"{texts[0][:30]}: exact line height, the template has auto" and moved < 100_000
    s5, moved = _merged(spark, lambda: checks.trailing_empties(docs, e.withColumn("style", F.lit("Other")), styles).first())
    assert s5["message"] == "1 empty paragraphs near the end" and moved < 100_000


def test_front_matter_exchanges_no_texts(spark):
    e = [(1, i, "para", "Heading1" if i == 30 else "Normal", "" if i == 3 else _long(20_000, i)) for i in range(40)] + [(2, 1, "para", "Normal", "no heading"), (3, 1, "para", "Heading2", "x")]
    got, moved = _merged(spark, lambda: {(r["doc_id"], r["n"]) for r in readback.front_matter_count(spark.createDataFrame(e, "doc_id long, seq int, kind string, style string, text string")).collect()})
    assert got == {(1, 29), (3, 0)} and moved < 100_000


def test_text_functions_agree_with_plain_patterns(spark):
    """Quick ways for texts without marks, beyond-ASCII letters or odd white space give what the whole patterns give."""
    r = random.Random(4)
    odd = [*map(chr, [*range(0x3100), 0xFEFF, 0x1F600])]
    odd = [c for c in odd if not 0xD800 <= ord(c) < 0xE000 and c != "\0"]
    mixed = ["".join(r.choice([*"ab *_$[]()<>\n\t", "\x85", " ", "é", "K", "İ", "é"]) for _ in range(r.randrange(9))) for _ in range(400)]
    df = spark.createDataFrame([(x,) for c in odd for x in (c, f" {c}a{c} b")] + [(x,) for x in [*mixed, "", "  ", None]], "t string")
    t = F.col("t")
    from foliograph.functions.text import _FROM, _TO

    pairs = {
        "strip": (T.strip(t), F.regexp_replace(t, r"(?U)^\s+|\s+$", "")),
        "spaces": (T.single_spaces(t), F.regexp_replace(t, r"(?U)\s+", " ")),
        "fold": (T.fold_text(t), F.regexp_replace(F.translate(F.lower(t), _FROM, _TO), r"\p{Mn}", "")),
        "plain": (F.when(~t.rlike(r"[\[$*_<]"), T.runs_text(T.tokenize_runs(t))), F.when(~t.rlike(r"[\[$*_<]"), F.regexp_replace(t, "[\u0001-\u0003]", ""))),
    }
    for name, (one, two) in pairs.items():
        assert not df.filter(~one.eqNullSafe(two)).limit(3).collect(), name
