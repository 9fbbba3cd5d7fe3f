"""Content operators on hand-written documents, and blocks against a plain fold over random lines."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from foliograph.functions import text as T
from foliograph.operators import content, registry
from foliograph.sources import scratch

QUIRKS = """lost before the first heading
## orphan
text **b** _it_ combined_loss $x_1$ [a](u) [](v)
### deep orphan
# One
#### like *this*

***1.1 Title***

**Note** hello
- a
2) b
```py
# Head in fence

```
### three
$$ a
b $$
$$$$
|---|---|
after
> quoted
| a | b |
|--|--|
| 1 |
---
end
~~~
unclosed
"""


def table(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_lines(spark):
    rows = content.corpus_lines(table(spark, "a\r\nb\n\n", "", None, "x")).orderBy("doc_id", "line_no").collect()
    assert [(r["doc_id"], r["line_no"], r["line"]) for r in rows] == [(0, 1, "a"), (0, 2, "b"), (0, 3, ""), (3, 1, "x")]


def test_tags_parents_and_intervals(spark):
    t = content.document_tree(content.sections(table(spark, QUIRKS))).orderBy("sec_no").collect()
    assert [(r["tag"], r["parent_id"]) for r in t] == [("h2_-1_1", None), ("h3_-1_1_1", "h2_-1_1"), ("h1_1", None), ("h1_2", None), ("h3_2_0_1", "h1_2")]
    assert [r["depth"] for r in t] == [0, 1, 0, 0, 1]
    for r in t:
        inside = [x for x in t if r["sec_no"] < x["sec_no"] < (r["subtree_end"] or 99)]
        assert r["child_word_count"] == sum(x["word_count"] for x in inside)
    assert t[3]["title"] == "Head in fence" and t[1]["has_bold"] is None and t[1]["paragraph_count"] == 0


def test_blocks(spark):
    b = content.blocks(content.section_lines(content.corpus_lines(table(spark, QUIRKS)))).orderBy("sec_no", "block_no", "part_no").collect()
    got = [(r["sec_no"], r["kind"], r["text"] or r["formula"] or r["lines"]) for r in b]
    assert got == [
        (1, "paragraph", "text b it combined_loss x_1 a v"), (3, "paragraph", "like this"), (3, "paragraph", "1.1 Title"), (3, "callout", "Note hello"), (3, "list", None), (3, "code", []),
        (4, "code", []), (5, "equation", "a\nb"), (5, "paragraph", "after quoted"), (5, "table", None), (5, "paragraph", "end"), (5, "code", ["unclosed"]),
    ]
    one = {(r["sec_no"], r["kind"]): r for r in b}
    assert one[3, "list"]["ordered"] is False and one[3, "code"]["lang"] == "py" and one[5, "table"]["ncols"] == 2 and one[5, "table"]["header"]
    assert [[[x["text"] for x in c] for c in row] for row in one[5, "table"]["rows"]] == [[["a"], ["b"]], [["1"], [""]]]


def fold(lines):
    """Kinds and payloads of the blocks of body lines, read one line at a time."""
    fence, open_math = re.compile(r"^\s*(```|~~~)\s*([A-Za-z0-9_+-]*)\s*$"), re.compile(r"^\s*\$\$")
    item = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+(.*)$")
    row, sep = re.compile(r"^\s*\|.*\|\s*$"), re.compile(r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?\s*$")
    out, held, i = [], [], 0

    def flush():
        for p in re.split(r"\n\s*\n", "\n".join(held).strip("\n")):
            if p.strip():
                out.append(("text", " ".join(p.strip().split("\n"))))
        held.clear()

    while i < len(lines):
        x = lines[i]
        if fence.match(x):
            j = next((k for k in range(i + 1, len(lines)) if fence.match(lines[k])), len(lines))
            flush()
            out.append(("code", tuple(lines[i + 1 : j])))
            i = j + 1
        elif open_math.match(x):
            j = i if x.count("$$") > 1 else next((k for k in range(i + 1, len(lines)) if "$$" in lines[k]), len(lines) - 1)
            flush()
            formula = "\n".join(lines[i : j + 1]).replace("$$", " ").strip()
            if formula:
                out.append(("equation", formula))
            i = j + 1
        elif re.match(r"^\s*(-{3,}|\*{3,}|_{3,})\s*$", x):
            flush()
            i += 1
        elif item.match(x):
            j = next((k for k in range(i, len(lines)) if not item.match(lines[k])), len(lines))
            flush()
            out.append(("list", tuple(item.match(y)[1].strip() for y in lines[i:j])))
            i = j
        elif row.match(x):
            j = next((k for k in range(i, len(lines)) if not row.match(lines[k])), len(lines))
            n = sum(not sep.match(y) for y in lines[i:j])
            if n:
                flush()
                out.append(("table", n))
            i = j
        else:
            q = re.match(r"^\s*>\s?(.*)$", x)
            held.append(q[1] if q else x)
            i += 1
    flush()
    return out


def flat_blocks(b):
    """Kinds and payloads of the blocks of each document."""
    got = {}
    for x in b.orderBy("sec_no", "block_no", "part_no").collect():
        kind = "text" if x["kind"] in ("paragraph", "callout") else x["kind"]
        flat = {"text": (x["raw"] or "").replace("\n", " "), "code": tuple(x["lines"] or ()), "equation": x["formula"], "list": tuple("".join(c["text"] for c in i) for i in x["items"] or ()), "table": len(x["rows"] or ())}
        got.setdefault(x["doc_id"], []).append((kind, flat[kind]))
    return got


@pytest.mark.parametrize("small", [False, True])
def test_blocks_like_the_fold(spark, monkeypatch, small):
    """Both ways, by lines and inside the document's row; small: blocks of lines of 8 and groups of 2."""
    if small:
        monkeypatch.setattr(content, "BLOCK", 8)
        monkeypatch.setattr(content, "FAN", 2)
        monkeypatch.setattr("foliograph.operators.scans.BLOCK", 8)
    r = random.Random(4)
    pool = ["", " ", "word", "more words", "> quote", "- item", "3. item", "| a |", "|---|", "```", "~~~ sql", "$$", "$$ x $$", "y $$", "---", "| b | c |", "a | b", "```x y"]
    docs = [[r.choice(pool) for _ in range(r.randrange(1, 60 if n % 5 == 0 else 14))] for n in range(150)]
    t = table(spark, *["# T\n" + "\n".join(d) + "\nlast" for d in docs])
    by_lines, by_rows = flat_blocks(content.blocks(content.section_lines(content.corpus_lines(t)))), flat_blocks(content.document_blocks(t))
    for n, d in enumerate(docs):
        assert by_lines.get(n, []) == fold(d + ["last"]) == by_rows.get(n, []), d


def test_the_two_ways_agree(spark):
    """All columns of the blocks, and the numbered lines, of documents with several sections."""
    docs = table(spark, QUIRKS, "", None, "no heading", QUIRKS + QUIRKS, "# only", "\r\n# a\r\rb\r\n")
    lines = content.section_lines(content.corpus_lines(docs))
    rows = lambda df, cols: sorted(map(repr, df.select(*cols).collect()))
    assert rows(lines, lines.columns) == rows(content.document_lines(docs), lines.columns)
    assert rows(lines.filter("is_heading"), lines.columns) == rows(content.document_headings(docs), lines.columns)
    b = content.blocks(lines)
    assert rows(b, b.columns) == rows(content.document_blocks(docs), b.columns)


def test_one_long_section(spark):
    """A section of 200,000 lines, by lines and inside its row: as many blocks as there must be, in seconds; half of it is one fence that opens in one block of lines and ends in another."""
    part = ["text", "", "- a", "- b", "---", "| a |", "|---|", "$$ x", "y $$", "> q"]
    lines = part * 10_000 + ["```"] + ["x = 1"] * 99_998 + ["```"]
    docs = table(spark, "# T\n" + "\n".join(lines))
    began = time.time()
    for b in (content.document_blocks(docs), content.blocks(content.section_lines(content.corpus_lines(docs)))):
        n = {r["kind"]: (r["n"], r["lines"]) for r in b.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("lines")).alias("lines")).collect()}
        assert {k: v[0] for k, v in n.items()} == {"paragraph": 10_001, "list": 10_000, "table": 10_000, "equation": 10_000, "code": 1} and n["code"][1] == 99_998
    assert time.time() - began < 120


def test_registered_block(spark):
    registry.register_block("figure", lambda line: line.startswith("!!"), count=2)
    try:
        docs = table(spark, "# A\n!! one\n!! two $$\nb\n$$\n!! three\n!! $$")
        for b in (content.blocks(content.section_lines(content.corpus_lines(docs))), content.document_blocks(docs)):
            rows = b.orderBy("block_no").collect()
            assert [(r["kind"], r["text"] or r["formula"]) for r in rows] == [("figure", "!! one\n!! two $$"), ("paragraph", "b"), ("equation", "!! three\n!!")]
        assert content.section_stats(content.blocks(content.section_lines(content.corpus_lines(table(spark, "# A\n!! one"))))).first()["paragraph_count"] == 2
    finally:
        registry.unregister_block("figure")


def test_runs_and_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first()["c"]
    runs = lambda t, **k: [(r["text"], r["bold"], r["italic"], r["sup"], r["math"]) for r in one(T.tokenize_runs(F.lit(t), **k))]
    assert runs("a ***b*** __c__<sup>2</sup> $d_k$ combined_loss") == [("a ", False, False, False, False), ("b", True, True, False, False), (" ", False, False, False, False), ("c", True, False, False, False), ("2", False, False, True, False), (" ", False, False, False, False), ("d_k", False, False, False, True), (" combined_loss", False, False, False, False)]
    assert runs("") == [("", False, False, False, False)] and runs("**a****b**") == [("ab", True, False, False, False)]
    assert one(T.slugify(F.lit(" Đề Mục: Ảnh & số "))) == "de-muc-anh-so"
    assert one(T.norm_style(F.lit("heading 1"))) == "Heading1" and one(T.norm_style(F.lit("no-spacing x"))) == "No-SpacingX"
    assert one(T.fold_text(F.lit("Phương Pháp đßø"))) == "phuong phap đßø"
    assert [one(T.is_placeholder(F.lit(x))) for x in ("", "...", "a [b]", "[b]", "{{x}}", "axxx", "a xxx", "Về việc …")] == [False, True, False, True, True, False, True, True]
    assert one(T.norm_title(F.lit(" - Chapter .... 1 :"))) == "chapter 1" and one(T.table_cells(F.lit(" | a | b || "))) == ["a", "b", ""]
    assert one(T.normalize_formula(F.lit(r"\left[ x \right]"))) == "[ x ]"
    assert sorted(one(T.char_ngrams(F.lit("Ab")))) == sorted([" ab", "ab ", " ab "])
    assert [one(T.lcp_length(F.lit(a), F.lit(b))) for a, b in (("", "a"), ("ab", "ab"), ("abc", "abd"))] == [0, 2, 2]


def test_flags_raw_and_stripped(spark):
    b = content.blocks(content.section_lines(content.corpus_lines(table(spark, "# A\n**b** *i* $m$ ![x](y)"))))
    raw, stripped = content.paragraphs(b).first(), content.paragraphs(b, "stripped").first()
    assert all(raw[n] for n in content.FLAGS) and [tuple(i) for i in raw["images"]] == [("x", "y")]
    assert not any(stripped[n] for n in content.FLAGS)


def test_empty_tables(spark):
    none = table(spark, "x").limit(0)
    assert content.document_tree(content.sections(none)).count() == 0 and content.blocks(content.section_lines(content.corpus_lines(none))).count() == 0


def test_runs_are_made_once(spark):
    """Nothing that comes of runs is in a filter, where they would be made again, and documents are spread over tasks by their number."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "'# a\n\ntext **b**\n\n$$ $$\n\n$$x$$' AS text")
    blocks = content.document_blocks(scratch.spread(docs, "doc_id"))
    plan = blocks._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Filter" in x and "<sup>" in x]
    assert dict(blocks.groupBy("kind").count().collect()) == {"paragraph": 3000, "equation": 3000}
