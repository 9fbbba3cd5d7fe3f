"""Templates, slots, roles, profiles, plans, checks and readback."""

import random

import pytest
from pyspark.sql import functions as F

from foliograph.operators import checks, placement, plan, profiles, readback, registry, roles, slots, template
from foliograph.plans import fixtures as X
from foliograph.plans import queries as Q
from foliograph.sources import tables

RAW = template.RAW_SCHEMA


def raw(spark, *paras):
    """Paragraphs as (style, text) or (style, text, extra format)."""
    rows = [(1, i, p[1], p[3] if len(p) > 3 else f"/body/p[{i}]", {"paraId": f"P{i}", **({"style": p[0]} if p[0] else {}), **(p[2] if len(p) > 2 else {})}) for i, p in enumerate(paras, 1)]
    return spark.createDataFrame(rows, RAW)


def test_body_style_and_format(spark):
    p = template.load_template_paras(raw(spark, (None, "cover"), ("heading 1", "A"), (None, "x", {"markRPr.size": "13pt", "font.hAnsi": "Arial", "align": "both"}), ("caption", "y"), ("caption", "z", {"effective.size": "9pt"}), (None, "w", {"size": "13pt", "font.ascii": "Arial"}), (None, "cell", {"size": "1pt"}, "/body/tbl[1]/tr[1]/tc[1]/p[1]")))
    assert template.body_style(p).first()["body_style"] == "Normal"  # a tie: the first seen
    assert template.body_format(p).first()["body_format"] == {"size": "13pt", "font.ascii": "Arial", "font.hAnsi": "Arial", "align": "both"}
    assert template.body_format(p.filter("eff_size is null")).count() == 0
    assert [r["seq"] for r in template.content_region(p).orderBy("seq").collect()] == [2, 3, 4, 5, 6, 7]
    assert [r["pos"] for r in slots.body_children(p).filter("kind = 'tbl'").collect()] == [6]


def test_heading_props(spark):
    r = raw(spark, ("heading 1", "1. Introduction to things", {"align": "left"}), ("heading 1", "LIST OF FIGURES AND TABLES", {"align": "center"}), ("heading 1", "2. Method", {"align": "left", "markRPr.size": "14pt"}), ("heading 2", "a", {"font.ascii": "Arial"}))
    p = template.load_template_paras(r)
    protos = template.section_context(template.load_prototypes(r, template.body_style(p)), p)
    titles = spark.createDataFrame([(1, "a", 1, "Heading1", "List of figures"), (1, "b", 1, "Heading1", "Other"), (1, "c", 1, "Heading3", "x"), (1, "d", 1, "Heading1", "2. METHOD"), (1, "e", 1, "Quote", "x")], "doc_id long, node_id string, template_id long, style_name string, title string")
    got = {r["node_id"]: r["props"] for r in template.heading_props(titles, protos).collect()}
    assert got["a"]["align"] == "center" and got["b"] == {"style": "Heading1", "size": "14pt", "align": "left"} and got["d"]["size"] == "14pt"
    assert got["c"] == {"style": "Heading3", "font.ascii": "Arial", "font.hAnsi": "Arial"} and got["e"] == {"style": "Quote"}
    o = template.outline_para_ids(spark.createDataFrame([(1, 1, "2. Method", "Heading1"), (1, 2, "LIST OF FIG", "Heading1"), (1, 3, "zzz", "Heading1")], "template_id long, index int, text string, style string"), protos)
    assert {r["index"]: r["para_id"] for r in o.collect()} == {1: "P3", 2: "P2", 3: None}


def test_slots_of_a_template_without_headings(spark):
    p = template.load_template_paras(raw(spark, (None, "Ministry of things"), (None, "Purpose of the visit"), (None, "text"), (None, "……"), (None, "Signature")))
    docs = spark.createDataFrame([(1, 1, "preserve"), (2, 1, "preserve"), (3, 1, "replace")], "doc_id long, template_id long, front_matter_strategy string")
    sections = spark.createDataFrame([(1, "h1_1", "Purpose of the visit to Rome"), (2, "h1_1", "Purpose"), (3, "h1_1", "x")], "doc_id long, tag string, title string")
    c = slots.classify_elements(slots.body_children(p), docs, slots.content_titles(sections))
    got = {(r["doc_id"], r["pos"]): (r["role"], r["trailing"]) for r in c.collect()}
    assert [got[1, i][0] for i in range(5)] == ["furniture", "slot", "slot", "slot", "furniture"] and got[1, 4][1] and not got[1, 0][1]
    assert [got[2, i][0] for i in range(5)] == ["furniture"] * 3 + ["slot", "furniture"]
    assert all(got[3, i][0] == "slot" for i in range(5))
    assert slots.furniture_ids(c).filter("doc_id = 1").count() == 2 and slots.trailing_order(c).filter("doc_id = 1").count() == 1


def test_profiles(spark):
    resolved, errors = profiles.resolve_profiles(X.profiles(spark))
    p = {r["id"]: r for r in resolved.collect()}
    assert set(p) == {"base", "paper", "report"} and {r["id"] for r in errors.collect()} == {"a", "b", "orphan"}
    assert p["report"]["keyword_rules"][0]["role"] == "discussion" and len(p["report"]["keyword_rules"]) == 13 and p["report"]["front_matter_strategy"] == "replace"
    assert p["report"]["role_to_logical"]["abstract"]["intent"] == "preserve" and p["paper"]["role_to_logical"]["abstract"]["intent"] == "replace"
    assert p["report"]["role_vocabulary"] == p["paper"]["role_vocabulary"] and p["paper"]["role_vocabulary"][:9] == p["base"]["role_vocabulary"]
    texts = spark.createDataFrame([(1, '{"id": "x", "strategy": "clone"}'), (2, '{"strategy": "dance"}'), (3, "{oops")], "n long, json string")
    v = {(r["n"], r["path"]) for r in profiles.contract_violations(texts, "id string, strategy string", "n", "json", ["id"], {"strategy": ["clone", "merge"]}).collect()}
    assert v == {(2, "$.id"), (2, "$.strategy"), (3, "$")}
    raw_map = F.create_map(F.lit("//note"), F.lit("x"), F.lit("id"), F.lit("y"))
    assert spark.range(1).select(profiles.strip_comment_keys(raw_map).alias("m")).first()["m"] == {"id": "y"}


def test_roles(spark):
    resolved, _ = profiles.resolve_profiles(X.profiles(spark))
    rows = [(1, "a", "report", 1, "Overview of Methods", ""), (1, "b", "paper", 1, "Tong quan nghien cuu", ""), (1, "c", "paper", 1, "zzz", "future work and conclusions"), (1, "d", "paper", 1, "qqqq", "")]
    nodes = spark.createDataFrame(rows, "doc_id long, node_id string, profile_id string, level int, title string, first_paragraph string")
    got = {r["node_id"]: (r["semantic_role"], r["evidence"]) for r in roles.router_classify(nodes, resolved, lazy=True).collect()}
    assert got["a"] == ("discussion", "heading") and got["b"] == ("literature_review", "ngram") and got["c"][1] == "ngram+summary" and got["d"] == ("generic", "fallback")
    strange = spark.createDataFrame([(1, "a", "paper", "pirate", 0.99, "x"), (1, "b", "paper", "generic", 0.2, "x")], "doc_id long, node_id string, profile_id string, semantic_role string, confidence double, evidence string")
    clean, warnings = roles.check_nodes(strange, resolved)
    assert {r["semantic_role"] for r in clean.collect()} == {"generic"} and warnings.count() == 3
    answers = spark.createDataFrame([(1, "b", "results", None, None)], "doc_id long, node_id string, semantic_role string, confidence double, evidence string")
    merged = {r["node_id"]: r for r in roles.merge_answers(strange, answers, resolved)[0].collect()}
    assert (merged["b"]["semantic_role"], merged["b"]["confidence"], merged["b"]["evidence"]) == ("results", 0.9, "llm-stage2") and merged["a"]["evidence"] == "clamped"


def test_placement(spark):
    resolved, _ = profiles.resolve_profiles(X.profiles(spark))
    rows = [(1, 1, "a", "report", 1, "abstract", 0.9), (1, 2, "b", "report", 2, "results", 0.9), (1, 3, "c", "report", 3, "nobody", 0.3), (2, 1, "a", "report", 1, "abstract", 0.5)]
    nodes = spark.createDataFrame(rows, "doc_id long, sec_no long, node_id string, profile_id string, level int, semantic_role string, confidence double")
    got = {(r["doc_id"], r["node_id"]): r for r in placement.logical_nodes(nodes, resolved).collect()}
    assert got[1, "a"]["intent"] == "preserve" and got[2, "a"]["intent"] == "replace" and got[2, "a"]["resolved_by"] == "role:generic"
    assert [got[1, n]["presentation"] for n in "bc"] == ["major_section", "minor_section"] and got[1, "b"]["outline_shift"] == 1 and not got[1, "b"]["toc"]
    assert placement.intent_defaults(nodes.select("doc_id")).first()["intent"] == "insert"


@pytest.fixture(scope="module")
def built(spark, sf):
    return Q._built(spark, sf)


def test_plan_and_checks(spark, built):
    c, logical, ops, children, elements = built
    classified = slots.classify_elements(slots.body_children(c.paras), c.docs, slots.content_titles(c.sections, slots.emitted_nodes(logical)))
    assert classified.count() == children.count()
    ck = checks.run_checks(c.docs, ops, elements, c.paras, c.sections, logical, template.best_prototype(c.prototypes), template.body_format(c.paras), template.body_style(c.paras), classified)
    rows = ck.collect()
    assert len(rows) == 13 * c.docs.count()
    failed = {r["name"] for r in rows if not r["passed"] and r["severity"] == "error"}
    # Degraded display equations add paragraphs, styled like the heading when they come first; a document may end up empty.
    assert failed <= {"para_count", "S5", "S8"}
    clean = plan.plan(c.docs, logical, c.sections, c.blocks, c.paras, c.prototypes)
    assert checks.para_count(c.docs, clean, c.sections, logical).filter("not passed").count() == 0
    assert plan.unknown_nodes(logical, c.sections).count() == 0
    seqs = ops.groupBy("doc_id").agg(F.max("op_seq").alias("m"), F.count(F.lit(1)).alias("n")).filter("m <> n")
    assert seqs.count() == 0
    kept = elements.filter("para_id is not null").select("doc_id", "para_id")
    assert slots.furniture_ids(classified).select("doc_id", "para_id").exceptAll(kept).count() == 0


def test_checks_that_fail(spark):
    docs = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, template_id long")
    op = "doc_id long, op_seq int, command string, type string, parent string, path string, before string, props map<string,string>"
    ops = spark.createDataFrame([(1, 1, "remove", None, None, "/body/p[@paraId=NO]", None, {}), (1, 2, "add", "p", "/body", None, None, {}), (1, 3, "add", "r", "x", None, None, {"text": ""}), (1, 4, "add", "r", "x", None, None, {"text": " "})], op)
    paras = template.load_template_paras(raw(spark, ("heading 1", "A")))
    got = {(r["doc_id"], r["name"]): r for r in checks.run_checks(docs, ops, paras=paras).collect()}
    assert not got[2, "nonempty"]["passed"] and got[1, "remove_targets"]["details"] == ["NO"] and got[1, "add_p_style"]["details"] == ["1"] and got[1, "runs_nonempty"]["details"] == ["2"]
    assert got[1, "S7"]["passed"] and got[1, "S7"]["severity"] == "info"
    heads = spark.createDataFrame([(1, 1, 1), (1, 2, 3), (2, 1, 2)], "doc_id long, seq int, level int")
    assert {r["doc_id"]: r["passed"] for r in checks.heading_order(docs, heads).collect()} == {1: False, 2: True}
    verdict = {r["doc_id"]: r["passed"] for r in checks.check_verdict(checks.run_checks(docs, ops, paras=paras)).collect()}
    assert verdict == {1: False, 2: False}


def test_exact_line_height_and_lost_furniture(spark):
    docs = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, template_id long")
    elements = spark.createDataFrame(
        [(1, 1, "para", "P1", "Normal", "cover", None), (1, 2, "para", None, "Normal", "abc", "exact"), (1, 3, "para", None, "Normal", "def", "auto"), (2, 1, "para", "P1", "Normal", "cover", "exact"), (2, 2, "para", "P2", "Normal", "end", None), (2, 3, "para", None, "Normal", "ghi", None), (2, 4, "table", None, None, None, None)],
        "doc_id long, seq int, kind string, para_id string, style string, text string, line_rule string",
    )
    classified = spark.createDataFrame([(d, 1, *x) for d in (1, 2) for x in ((0, "p", "P1", "furniture"), (1, "p", "P2", "furniture"), (2, "tbl", None, "furniture_table"))], "doc_id long, template_id long, pos int, kind string, para_id string, role string")
    formats = spark.createDataFrame([(1, {"lineSpacing": "1.5", "lineRule": "auto"})], "template_id long, body_format map<string,string>")
    styles = spark.createDataFrame([(1, "Normal")], "template_id long, body_style string")
    got = {r["doc_id"]: r for r in checks.line_spacing(docs, elements, formats, styles, slots.furniture_ids(classified)).collect()}
    assert not got[1]["passed"] and got[1]["details"] == ["abc: exact line height, the template has auto"] and got[1]["severity"] == "error"
    assert got[2]["passed"] and got[2]["message"] == "1 body paragraphs have free line height"
    kept = {r["doc_id"]: r for r in checks.furniture_survived(docs, elements, classified).collect()}
    assert kept[1]["details"] == ["1 fixed paragraphs are gone: P2", "0 of 1 fixed tables are left, 1 are gone"] and not kept[1]["passed"]
    assert kept[2]["passed"] and kept[2]["message"] == "all 2 fixed paragraphs and 1 fixed tables are there"


def test_missing_content(spark):
    """S7 fails below 85 % of the expected body paragraphs, and only there."""
    docs = spark.createDataFrame([(d, 1) for d in (1, 2, 3)], "doc_id long, template_id long")
    elements = spark.createDataFrame([(d, i, "para", "Normal", "x") for d, n in ((1, 16), (2, 17)) for i in range(n)], "doc_id long, seq int, kind string, style string, text string")
    sections = spark.createDataFrame([(1, "h1_1", 20), (2, "h1_1", 20)], "doc_id long, tag string, paragraph_count int")
    styles = spark.createDataFrame([(1, "Normal")], "template_id long, body_style string")
    got = {r["doc_id"]: (r["passed"], r["message"]) for r in checks.completeness(docs, elements, sections, styles).collect()}
    assert got == {1: (False, "content is missing: 16 body paragraphs of 20"), 2: (True, "enough content: 17 body paragraphs of 20"), 3: (True, "enough content: 0 body paragraphs of 0")}


def test_registered_check(spark):
    docs = spark.createDataFrame([(1, 1)], "doc_id long, template_id long")
    registry.register_check("mine", lambda docs, **_: checks.skipped(docs, "mine"))
    try:
        assert "mine" in {r["name"] for r in checks.run_checks(docs).collect()}
    finally:
        registry.unregister_check("mine")


def test_registered_feature(spark):
    """A registered kind of block is a feature; a profile that denies its capability degrades it with the registered note, or with one made from its name."""
    sections = spark.createDataFrame([(1, False, False), (2, True, False)], "doc_id long, has_math boolean, has_image boolean")
    blocks = spark.createDataFrame([(1, "figure"), (1, "figure"), (1, "paragraph"), (2, "figure")], "doc_id long, kind string")
    docs = spark.createDataFrame([(1, "no"), (2, "yes")], "doc_id long, profile_id string")
    allowed = spark.createDataFrame([("no", {"drawing": False}), ("yes", {"drawing": True, "equation": False})], "id string, capabilities map<string,boolean>")
    assert profiles.detect_features(sections, blocks).filter("feature = 'figure'").count() == 0
    registry.register_feature("figure", "drawing", "figures are left out")
    try:
        found = profiles.detect_features(sections, blocks)
        assert {tuple(r) for r in found.collect()} == {(1, "figure"), (2, "figure"), (2, "math")}
        got = {(r["doc_id"], r["feature"]): (r["capability"], r["status"], r["note"]) for r in profiles.negotiate_capabilities(found, docs, allowed).collect()}
        assert set(got) == {(1, "figure"), (2, "math")} and got[1, "figure"] == ("drawing", "degraded", "figures are left out")
    finally:
        registry.unregister_feature("figure")
    assert "figure" not in registry.features()


def test_documents_with_another_strategy(spark, built):
    """Documents that can't be planned get no operations, the others exactly theirs; no strategy means clone."""
    c, logical, *_ = built
    strategy = F.when(F.col("doc_id") % 5 == 1, "merge").when(F.col("doc_id") % 5 == 2, F.lit(None)).otherwise("clone")
    docs = c.docs.withColumn("strategy", strategy)
    ok, rest = plan.strategy_filter(docs)
    assert ok.count() + rest.count() == c.docs.count() and {r["strategy"] for r in rest.collect()} == {"merge"}
    columns = ["doc_id", "op_seq", "command", "type", "parent", "path", "before", F.to_json(F.array_sort(F.map_entries("props"))).alias("props")]
    some = plan.plan(docs, logical, c.sections, c.blocks, c.paras, c.prototypes).select(*columns)
    all_ = plan.plan(c.docs, logical, c.sections, c.blocks, c.paras, c.prototypes).select(*columns).filter("doc_id % 5 <> 1")
    assert some.count() > 0 and some.exceptAll(all_).count() == 0 and all_.exceptAll(some).count() == 0


def test_unknown_nodes(spark):
    logical = spark.createDataFrame([(1, "h1_1"), (1, "h1_9"), (2, "h1_1")], "doc_id long, node_id string")
    sections = spark.createDataFrame([(1, "h1_1"), (2, "h2_1_1")], "doc_id long, tag string")
    assert {tuple(r) for r in plan.unknown_nodes(logical, sections).collect()} == {(1, "h1_9"), (2, "h1_1")}


def test_mean_confidence_of_exactly_one_half(spark):
    """The order of a document's nodes doesn't decide: 0.3 four times and 0.9 twice are one half, whatever the order of summation."""
    allowed = spark.createDataFrame([("p", "generic")], "id string, default_role string")
    orders = [[0.3, 0.3, 0.3, 0.3, 0.9, 0.9], [0.9, 0.3, 0.3, 0.9, 0.3, 0.3], [0.9, 0.9, 0.3, 0.3, 0.3, 0.3], [0.3, 0.9, 0.3, 0.3, 0.9, 0.3]]
    rows = [(d, "p", "results", c) for d, cs in enumerate(orders) for c in cs] + [(9, "p", "results", 0.3), (9, "p", "results", 0.69)]
    nodes = spark.createDataFrame(rows, "doc_id long, profile_id string, semantic_role string, confidence double").coalesce(1)
    assert [r["doc_id"] for r in roles.quality_gate(nodes, allowed).collect()] == [9]


def test_degraded_equations(spark):
    op = "doc_id long, op_seq int, command string, type string, parent string, path string, before string, props map<string,string>"
    ops = spark.createDataFrame([(1, 1, "add", "p", "/body", None, None, {"style": "Q"}), (1, 2, "add", "equation", "/body/p[last()]", None, None, {"formula": "a", "mode": "inline"}), (1, 3, "add", "equation", "/body", None, None, {"formula": "b", "mode": "display"}), (1, 4, "add", "r", "/body/p[last()]", None, None, {"text": "t"})], op)
    out, n = plan.degrade_equations(ops, spark.createDataFrame([(1, 2), (1, 3)], "doc_id long, op_seq int"))
    assert [(r["type"], r["props"].get("text") or r["props"].get("style")) for r in out.orderBy("op_seq").collect()] == [("p", "Q"), ("r", "$a$"), ("p", "Q"), ("r", "$b$"), ("r", "t")]
    assert n.first()["degraded"] == 2


def test_readback(spark):
    e = spark.createDataFrame(
        [(1, 1, "para", "Normal", None, "cover page", None, None), (1, 2, "para", "Heading1", "center", "Méthod", None, None), (1, 3, "para", "Normal", None, "• the quick brown fox jumps", None, None), (1, 4, "para", "Normal", None, "entirely other words stand here", None, None), (1, 5, "table", None, None, "", 2, 3), (1, 6, "para", "Heading2", None, "Alien", None, None), (1, 7, "para", "Toc1", None, "x" * 80, None, None), (1, 8, "para", "Normal", None, "", None, None)],
        "doc_id long, seq int, kind string, style string, align string, text string, rows int, cols int",
    )
    blobs = spark.createDataFrame([(1, "method || see the quick brown foxes run", ["method"], 0)], "doc_id long, blob string, headings array<string>, tables long")
    assert {r["seq"] for r in readback.foreign_paragraphs(e, blobs).collect()} == {4, 7}
    o = {r["signal"]: r for r in readback.observations(e, blobs).collect()}
    assert o["front_matter_paragraphs"]["value"] == 1 and o["tables_in_output"]["note"] == "1 tables of 2×3" and o["table_count_mismatch"]["value"] == 1 and o["headings_not_in_source"]["value"] == 1
    view = [r["line"] for r in readback.render_view(e).orderBy("n").collect()]
    assert view[1] == "  2  [#1 Heading1·center] Méthod" and view[4] == "  5  [TABLE 2×3]" and view[6].endswith("…") and "TOC·Toc1" in view[6] and view[7] == "  8  [Normal·empty]"
    lines = spark.createDataFrame([(1, 1, "[/body/p[@paraId=A1]] Hello"), (1, 2, "[/body/tbl[1]] (2 rows, 3 cols)"), (1, 3, "[/body/p[@paraId=B2]] x")], "doc_id long, seq int, line string")
    styles = spark.createDataFrame([(1, "A1", "heading 2", "both")], "doc_id long, para_id string, style string, align string")
    got = readback.load_output_blocks(lines, styles).orderBy("seq").collect()
    assert [(r["kind"], r["style"], r["text"], r["rows"], r["cols"]) for r in got] == [("para", "Heading2", "Hello", None, None), ("table", None, "", 2, 3), ("para", "Normal", "x", None, None)]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"id": "a", "n": 1}\n{"id": "b", "n": "no"}\n')
    good, bad = tables.read_ir(spark, str(tmp_path / "in.json"), "id string, n int", strict=False)
    assert [r["id"] for r in good.collect()] == ["a"] and bad.count() == 1
    with pytest.raises(Exception):
        tables.read_ir(spark, str(tmp_path / "in.json"), "id string, n int")[0].collect()
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "x.md").write_text("# A\ntext\n")
    docs = tables.read_markdown(spark, str(tmp_path / "md"))
    assert docs.first()["source_file"] == "x.md"
    from foliograph.operators import content

    numbered = content.section_lines(content.corpus_lines(docs))
    tables.write_content_ir(docs, content.sections(docs), content.blocks(numbered), str(tmp_path / "ir"))
    assert spark.read.json(str(tmp_path / "ir")).first()["section_count"] == 1
    tables.write_tables({"docs": docs}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "docs")).count() == 1


def test_stream(spark, tmp_path):
    from foliograph.streaming.arrivals import latest_sections, upsert_sections

    for n, text in enumerate(("# A\nx", "# B\n## C")):
        spark.createDataFrame([(1, text), (10 + n, "# D")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
        upsert_sections(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    latest = latest_sections(spark.read.parquet(str(tmp_path / "out")))
    assert sorted((r["doc_id"], r["tag"]) for r in latest.collect()) == [(1, "h1_1"), (1, "h2_1_1"), (10, "h1_1"), (11, "h1_1")]


def test_foreign_paragraphs_like_a_search(spark):
    """A paragraph is the source's own if its text, or any four words in a row, occur in the source at any character."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("ab") for _ in range(r.randrange(1, 9)))
    blobs, elements = [], []
    for doc in range(12):
        source = [" ".join(word() for _ in range(r.randrange(1, 30))) for _ in range(6)]
        blobs.append((doc, " || ".join(source)))
        for seq in range(40):
            t = r.choice(source)
            at = r.randrange(len(t))
            cut = t[at : at + r.randrange(8, 40)] if r.random() < 0.6 else " ".join(word() for _ in range(r.randrange(1, 6)))
            elements.append((doc, seq, "para", r.choice(["", "• ", "- "]) + cut + " " * 12))
    elements += [(0, 100, "para", "[skipped text of a mark"), (0, 101, "table", "a table of no text here"), (0, 102, "para", "short"), (0, 103, "para", "•  •  ·  ·  •  • "), (99, 1, "para", "a document without a source")]
    said = spark.createDataFrame(elements, "doc_id long, seq int, kind string, text string")
    got = {(x["doc_id"], x["seq"]) for x in readback.foreign_paragraphs(said, spark.createDataFrame(blobs, "doc_id long, blob string")).collect()}
    blob, want = dict(blobs), set()
    for doc, seq, kind, text in elements:
        if kind == "para" and len(text) >= 12 and not text.startswith("[") and doc in blob:
            w = text.strip().lstrip("•·- ").split()
            pieces = [" ".join(w)] if len(w) < 4 else [" ".join(w[i : i + 4]) for i in range(len(w) - 3)]
            if w and not any(x in blob[doc] for x in pieces):
                want.add((doc, seq))
    assert got == want and len(want) > 20


def _shuffled(spark):
    """Bytes that all stages so far wrote for exchanges."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none, q = spark.sparkContext._jvm.java.util.ArrayList(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, q, none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_foreign_paragraphs_exchange_texts_once(spark, monkeypatch):
    """Long words aren't exchanged once for each of their characters, and no phrase is lost where a long source text is cut."""
    r = random.Random(9)
    words = ["".join(chr(r.randrange(97, 123)) for _ in range(1500)) for _ in range(12)]
    blobs = spark.createDataFrame([(1, " ".join(words)), (2, "")], "doc_id long, blob string")
    e = spark.createDataFrame([(1, i, "para", w[700:740]) for i, w in enumerate(words)] + [(1, 50, "para", "z" * 40), (2, 1, "para", words[0])], "doc_id long, seq int, kind string, text string")
    monkeypatch.setattr(readback, "PIECE", 30, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    before = _shuffled(spark)
    try:
        got = {(x["doc_id"], x["seq"]) for x in readback.foreign_paragraphs(e, blobs).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {(1, 50), (2, 1)}
    assert _shuffled(spark) - before < 10 * sum(map(len, words))


def test_growing_tables_are_not_broadcast(built, spark, sf):
    """No join of the plan, of its application or of the checks sends a table that grows with the input to every executor, however small its files are."""
    c, logical, ops, children, elements = built
    classified = Q._classified(spark, sf)[3]
    planned = plan.plan(c.docs, logical, c.sections, c.blocks, c.paras, c.prototypes)
    checked = checks.run_checks(c.docs, ops, elements, c.paras, c.sections, logical, template.best_prototype(c.prototypes), template.body_format(c.paras), template.body_style(c.paras), classified)
    for name, df in {"plan": planned, "degrade": plan.degrade_equations(ops, Q._failed(ops))[0], "apply": plan.apply_plan(children, ops), "checks": checked}.items():
        assert len(df.collect()) > 0, name  # the plan is final then
        assert name and "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
