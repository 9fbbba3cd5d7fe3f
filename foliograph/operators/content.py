"""Markdown corpora to sections, blocks, runs and the section tree.

Tables are keyed by doc_id. A document is one row when it is read, so its sections, lines and blocks are cut inside that row, in time linear in its lines and without an exchange. Tables that come as lines go through
an exchange by (doc_id, block of lines): section numbers run in two levels (`scans`), and what fences make of lines is composed of the blocks' steps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions import text as T
from foliograph.operators import registry
from foliograph.operators.scans import BLOCK, blocked, running

# Line patterns, callout labels and section types.
HEADING = r"(?s)^(#{1,3})(?U:\s+)(.+)$"
FENCE = r"^(?U:\s*)(```|~~~)(?U:\s*)([A-Za-z0-9_+-]*)(?U:\s*)$"
MATH_FENCE = r"^(?U:\s*)\$\$"
THEMATIC = r"^(?U:\s*)(-{3,}|\*{3,}|_{3,})(?U:\s*)$"
BULLET = r"(?s)^(?U:\s*)[-*+](?U:\s+)(.*)$"
ORDERED = r"(?s)^(?U:\s*)(?U:\d+)[.)](?U:\s+)(.*)$"
TABLE_ROW = r"(?s)^(?U:\s*)\|.*\|(?U:\s*)$"
TABLE_SEPARATOR = r"^(?U:\s*)\|?(?U:\s*):?-{2,}:?(?U:\s*)(\|(?U:\s*):?-{2,}:?(?U:\s*))*\|?(?U:\s*)$"
QUOTE = r"(?s)^(?U:\s*)>(?U:\s?)(.*)$"
HEADING_LIKE = r"(?d)^#{4,6}(?U:\s+)(.+)$"
NUMBERED = r"^(?U:\d+)(\.(?U:\d+))*\.?(?U:\s)"
CALLOUTS = ["important", "definition", "warning", "example", "note", "tip", "caution", "remark", "theorem", "lemma"]
IMAGE = r"!\[([^\]]*)\]\(([^)]+)\)"
FLAGS = {
    "has_image": [IMAGE],
    "has_math": [r"(?s)\$\$(.+?)\$\$", r"(?d)(?<!\$)\$(?!\$)(.+?)(?<!\$)\$(?!\$)"],
    "has_bold": [r"(?d)\*\*(.+?)\*\*"],
    "has_italic": [r"(?d)(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)"],
}

#: What a class of line makes of the states t (text), c (code) and m (math), in that order; other classes leave them. A heading starts anew.
TRANSITIONS = {"H": "ttt", "F": "ctm", "M": "mct", "S": "tct", "D": "tct"}
#: Steps of blocks that are composed together, and blocks of a section that are placed together.
FAN = 256


def _rows(low: int, high: int):
    """Sections of a document in order, from `low` to `high` rows off."""
    return Window.partitionBy("doc_id").orderBy("sec_no").rowsBetween(low, high)


def _so_far():
    return _rows(Window.unboundedPreceding, 0)


def _before():
    return _rows(Window.unboundedPreceding, -1)


def _after():
    """Sections after each, nearest last: a frame that ends at the last row would be read again for every row."""
    return Window.partitionBy("doc_id").orderBy(F.col("sec_no").desc()).rowsBetween(Window.unboundedPreceding, -1)


def _unified() -> Column:
    return F.regexp_replace("text", "\r\n?", "\n")


def _lines_of(text: Column) -> Column:
    """A text's lines: a final line break opens none."""
    return F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1)


def corpus_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): lines from 1; a final line break opens no line, null and empty texts have none."""
    found = docs.filter("text is not null and text <> ''").select("doc_id", F.posexplode(_lines_of(_unified())).alias("pos", "line"))
    return found.select("doc_id", (F.col("pos") + 1).alias("line_no"), "line")


def _fans(values: Column) -> Column:
    """An array in pieces of FAN: work that copies an array for each element is done in pieces, so that it grows with the array and not with its square."""
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / FAN).cast("int")), lambda i: F.slice(values, i * FAN + 1, F.lit(FAN)))
    return F.when(F.size(values) > 0, pieces).otherwise(F.slice(F.array(values), F.lit(1), F.lit(0)))


def _starts(sizes: Column) -> Column:
    """The sum of the sizes before each."""

    def before(values: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def whole(fans: Column) -> Column:
        totals = F.transform(fans, lambda f: F.aggregate(f, F.lit(0), lambda n, x: n + x))
        return F.flatten(F.transform(F.arrays_zip(fans.alias("f"), before(totals, F.lit(0)).alias("at")), lambda x: before(x["f"], x["at"])))

    # A lambda's argument is computed once; an expression in a lambda would be for each element.
    return F.transform(F.transform(F.array(sizes), _fans), whole)[0]


def _section_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, parts array<struct<at,text>>): the text cut before each heading line, with the number of the line that a part begins with; only parts that begin with a heading."""
    cut = F.split(_unified(), r"(?<=\n)(?=#{1,3}(?U:[^\S\n])[^\n])", -1)
    d = docs.filter("text <> ''").select("doc_id", cut.alias("texts"))
    parts = F.arrays_zip(_starts(F.transform("texts", lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))))).alias("at"), F.col("texts").alias("text"))
    return d.select("doc_id", F.filter(F.transform(parts, lambda p: F.struct((p["at"] + 1).alias("at"), p["text"].alias("text"))), lambda p: F.regexp_extract(p["text"], r"\A[^\n]*", 0).rlike(HEADING)).alias("parts"))


def document_sections(docs: DataFrame) -> DataFrame:
    """(doc_id, sec_no, at, lines): each section's lines, the heading first, and its number; cut inside each document's row."""
    s = _section_texts(docs).select("doc_id", F.posexplode("parts").alias("i", "p"))
    return s.select("doc_id", (F.col("i") + 1).cast("long").alias("sec_no"), F.col("p.at").alias("at"), _lines_of(F.col("p.text")).alias("lines"))


def document_lines(docs: DataFrame) -> DataFrame:
    """What section_lines makes of corpus_lines, without an exchange."""
    s = document_sections(docs).select("doc_id", "sec_no", "at", F.posexplode("lines").alias("j", "line"))
    return s.select("doc_id", (F.col("at") + F.col("j")).alias("line_no"), "line", (F.col("j") == 0).alias("is_heading"), "sec_no")


def document_headings(docs: DataFrame) -> DataFrame:
    """The heading lines of document_lines, without the others."""
    heads = F.transform("parts", lambda p: F.struct(p["at"].alias("line_no"), F.regexp_extract(p["text"], r"\A[^\n]*", 0).alias("line")))
    h = _section_texts(docs).select("doc_id", F.posexplode(heads).alias("i", "h"))
    return h.select("doc_id", "h.line_no", "h.line", F.lit(True).alias("is_heading"), (F.col("i") + 1).cast("long").alias("sec_no"))


def section_lines(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, line_no, line) with sec_no (from 1) and is_heading; lines before the first heading are gone."""
    marked = blocked(lines.withColumn("is_heading", F.col("line").rlike(HEADING)), "line_no")
    return running(marked, "line_no", {"sec_no": F.col("is_heading").cast("int")}).filter("sec_no > 0").drop("block")


def section_heads(numbered: DataFrame) -> DataFrame:
    """(doc_id, sec_no, line_no, level, title, type, verbatim, source_anchor) of the heading lines."""
    h = numbered.filter("is_heading").withColumn("level", F.length(F.regexp_extract("line", HEADING, 1)))
    h = h.withColumn("title", T.strip_inline(T.strip(F.regexp_extract("line", HEADING, 2))))
    return h.select("doc_id", "sec_no", "line_no", "level", "title", section_type(F.col("level")).alias("type"), F.lit(True).alias("verbatim"), T.slugify(F.col("title")).alias("source_anchor"))


def section_type(level: Column) -> Column:
    return F.when(level.between(1, 3), F.concat(F.lit("heading"), level.cast("string"))).otherwise("body_text")


def section_tags(heads: DataFrame) -> DataFrame:
    """heads with tag: h1_i, h2_i_j, h3_i_j_k by running counts; -1 before any level 1, 0 without a level 2."""
    n = lambda level, w: F.sum((F.col("level") == level).cast("int")).over(w)
    h = heads.withColumn("_h1", n(1, _so_far()))
    h = h.withColumn("_h2", n(2, Window.partitionBy("doc_id", "_h1").orderBy("sec_no").rowsBetween(Window.unboundedPreceding, 0)))
    h = h.withColumn("_h3", n(3, Window.partitionBy("doc_id", "_h1", "_h2").orderBy("sec_no").rowsBetween(Window.unboundedPreceding, 0)))
    one = F.when(F.col("_h1") == 0, -1).otherwise(F.col("_h1"))
    tag = F.when(F.col("level") == 1, F.concat_ws("_", F.lit("h1"), one)).when(F.col("level") == 2, F.concat_ws("_", F.lit("h2"), one, "_h2"))
    return h.withColumn("tag", tag.otherwise(F.concat_ws("_", F.lit("h3"), one, "_h2", "_h3"))).drop("_h1", "_h2", "_h3")


def _line_class(line: Column) -> Column:
    """F a fence, M math from here, S math on one line, D another line with $$, x any other."""
    dollars = F.when(F.size(F.split(line, r"\$\$", -1)) > 2, "S").otherwise("M")
    return F.when(line.rlike(FENCE), "F").when(line.rlike(MATH_FENCE), dollars).when(line.contains("$$"), "D").otherwise("x")


def _then(states: Column, step: Column) -> Column:
    """States after a step: three letters that say what becomes of t, c and m. Two steps in a row are one step, so steps may be put together in any grouping."""
    return F.call_function("translate", states, F.lit("tcm"), step)


def _step(cls: Column) -> Column:
    out = F.lit("tcm")
    for c, step in TRANSITIONS.items():
        out = F.when(cls == c, step).otherwise(out)
    return out


def _mode(state: Column, cls: Column) -> Column:
    opened = F.when(cls == "F", "o").when(cls == "M", "m").when(cls == "S", "s").otherwise("t")
    return F.when(state == "c", F.when(cls == "F", "c").otherwise("b")).when(state == "m", F.when(cls.isin("M", "S", "D"), "e").otherwise("n")).otherwise(opened)


def line_modes(numbered: DataFrame) -> DataFrame:
    """Body lines with mode: what the code and math fences make of each.

    Modes: t text, o and c a code block's fences, b its body, s math on one line, m math from here, n inside math, e its end. The lines of a section in a block of BLOCK lines are one row; it is a step
    from the state before to the state after, composed of its lines' steps, and the states that a long section's rows begin with are composed of those steps.
    """
    body = blocked(numbered.filter("not is_heading"), "line_no").withColumn("cls", _line_class(F.col("line")))
    rows = body.groupBy("doc_id", "block", "sec_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "line", "cls"))).alias("lines"))
    # A section that goes on in another block reaches the end of this one.
    edge = (F.get("lines", F.lit(0))["line_no"] % BLOCK == 0) | (F.element_at("lines", -1)["line_no"] % BLOCK == BLOCK - 1)
    whole = F.aggregate("lines", F.lit("tcm"), lambda a, x: _then(a, _step(x["cls"])))
    begins = _entries(rows.filter(edge).select("doc_id", "sec_no", "block", whole.alias("step")))
    rows = rows.join(begins, (F.col("doc_id") == F.col("_d")) & (F.col("block") == F.col("_b")), "left")
    state = F.when(F.col("_s") == F.col("sec_no"), F.col("entry")).otherwise("t")
    folded = F.aggregate("lines", F.struct(state.alias("state"), F.lit("").alias("modes")), lambda a, x: F.struct(_then(a["state"], _step(x["cls"])).alias("state"), F.concat(a["modes"], _mode(a["state"], x["cls"])).alias("modes")), lambda a: a["modes"])
    rows = rows.withColumn("modes", folded).select("doc_id", "block", "sec_no", "modes", F.posexplode("lines").alias("i", "l"))
    return rows.select("doc_id", "block", "sec_no", F.col("l.line_no").alias("line_no"), F.col("l.line").alias("line"), F.substr("modes", F.col("i") + 1, F.lit(1)).alias("mode"))


def _entries(steps: DataFrame) -> DataFrame:
    """(_d, _b, _s, entry): the state that a section's row in a block begins with, for steps (doc_id, sec_no, block, step); FAN steps are put together first, so no row holds more than a FAN-th of a section's."""
    sorted_ = lambda c: F.array_sort(F.collect_list(F.struct(F.col(c).alias("at"), "step")))

    def before(steps: Column, state: Column) -> Column:
        """Each step's place and the state before it."""
        start = F.struct(state.alias("state"), F.array().cast("array<struct<at:bigint,entry:string>>").alias("out"))
        return F.aggregate(steps, start, lambda a, x: F.struct(_then(a["state"], x["step"]).alias("state"), F.concat(a["out"], F.array(F.struct(x["at"].alias("at"), a["state"].alias("entry")))).alias("out")), lambda a: a["out"])

    low = steps.groupBy("doc_id", "sec_no", F.floor(F.col("block") / FAN).alias("wide")).agg(sorted_("block").alias("steps"))
    low = low.withColumn("step", F.aggregate("steps", F.lit("tcm"), lambda a, x: _then(a, x["step"])))
    high = low.groupBy(F.col("doc_id").alias("_d"), F.col("sec_no").alias("_s")).agg(sorted_("wide").alias("wides")).select("_d", "_s", F.explode(before(F.col("wides"), F.lit("t"))).alias("w"))
    low = low.join(high, (F.col("doc_id") == F.col("_d")) & (F.col("sec_no") == F.col("_s")) & (F.col("wide") == F.col("w.at")))
    each = low.select("_d", "_s", F.explode(before(F.col("steps"), F.col("w.entry"))).alias("e"))
    return each.select("_d", F.col("e.at").alias("_b"), "_s", F.col("e.entry").alias("entry")).filter("entry <> 't'")


def block_lines(modes: DataFrame) -> DataFrame:
    """Lines of line_modes with kind (code, equation, break, list, table, text or a registered kind) and block_no; lines that belong to no block are gone."""
    text = F.col("mode") == "t"
    kind = F.when(F.col("mode").isin("o", "b", "c"), "code").when(~text, "equation")
    for name, match in _tests():
        kind = kind.when(match(F.col("line")), name)
    rows = modes.withColumn("kind", kind.otherwise("text"))

    w = Window.partitionBy("doc_id", "sec_no").orderBy("line_no")

    def islands(df: DataFrame, out: str) -> DataFrame:
        before = F.lag("kind").over(w)
        new = before.isNull() | (before != F.col("kind")) | F.col("mode").isin("o", "m", "s")
        if "_island" in df.columns:  # only text joins up again
            new = new | ((F.col("kind") != "text") & (F.lag("_island").over(w) != F.col("_island")))
        return df.withColumn("_new", new.cast("int")).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")

    rows = islands(rows, "_island")
    # A table without a row that isn't a separator is no block, and the text around it joins up.
    rows = rows.withColumn("_separator", (F.col("kind") == "table") & F.col("line").rlike(TABLE_SEPARATOR))
    whole = F.min((F.col("kind") == "table") & F.col("_separator")).over(Window.partitionBy("doc_id", "sec_no", "_island"))
    rows = rows.withColumn("_void", whole).filter("not _void")
    return islands(rows, "block_no").filter("kind <> 'break' and not _separator").drop("_island", "_void", "_separator")


def _tests() -> list[tuple[str, Callable[[Column], Column]]]:
    """Kinds of text lines and their tests, in order."""
    own = registry.block_kinds()
    built_in = [("break", lambda x: x.rlike(THEMATIC)), ("list", lambda x: x.rlike(BULLET) | x.rlike(ORDERED)), ("table", lambda x: x.rlike(TABLE_ROW))]
    return [(k.kind, k.match) for k in own if k.priority < 0] + built_in + [(k.kind, k.match) for k in own if k.priority >= 0]


def _grouped(lines: DataFrame) -> DataFrame:
    """(doc_id, sec_no, block_no, kind, ls): the lines of each block of block_lines."""
    return lines.groupBy("doc_id", "sec_no", "block_no", "kind").agg(F.array_sort(F.collect_list(F.struct("line_no", "line", "mode"))).alias("ls"))


def _row_blocks(sections: DataFrame) -> DataFrame:
    """What _grouped makes of the lines of document_sections, cut inside each section's row.

    A line is one letter: F, M and S as line classes, k a break, l a list, r a table's row, p its separator, t text, u and on registered kinds; lines with $$ that may end math are capitals. Runs of letters are blocks: code and
    math run to the line that ends them. Separators without a row beside them are no table: they become v, and text goes on across them. Every step is linear in the lines: blocks get their places FAN at a time.
    """
    letters = {"break": ("k", "k"), "list": ("l", "L"), "table": ("r", "R")}
    # Registered kinds have two letters each, beyond those of any built-in class.
    letters |= {name: (chr(0x100 + 2 * i), chr(0x101 + 2 * i)) for i, name in enumerate(k.kind for k in registry.block_kinds())}

    def letter(line: Column) -> Column:
        cls, dollars = _line_class(line), line.contains("$$")
        out = F.when(cls.isin("F", "M", "S"), cls)
        for name, match in _tests():
            one = F.when(dollars, letters[name][1]).otherwise(letters[name][0])
            out = out.when(match(line), F.when(line.rlike(TABLE_SEPARATOR), "p").otherwise(one) if name == "table" else one)
        return out.otherwise(F.when(dollars, "T").otherwise("t"))

    ends = "MST" + "".join(high for _, high in letters.values() if high != "k")
    own = "".join(f"[{low}{high}]++|" for name, (low, high) in letters.items() if name != "table")
    runs = lambda text: F.lit(f"F[^F]*+F?|M[^{ends}]*+[{ends}]?|S|{own}[{text}]++|[rRp]++")
    first = F.regexp_extract_all(F.array_join(F.transform(F.slice("lines", F.lit(2), F.size("lines")), letter), ""), runs("tT"), F.lit(0))
    marked = F.array_join(F.transform(first, lambda r: F.when(r.rlike("^p+$"), F.replace(r, F.lit("p"), F.lit("v"))).otherwise(r)), "")
    s = sections.withColumn("found", F.regexp_extract_all(marked, runs("tTv"), F.lit(0)))

    def kind_of(c: Column) -> Column:
        out = F.when(c == "F", "code").when(c.isin("M", "S"), "equation").when(c == "p", "table")
        for name, pair in letters.items():
            out = out.when(c.isin(*pair), name)
        return out.otherwise("text")

    length = _starts(F.transform("found", F.length))
    number = _starts(F.transform("found", lambda r: (~r.rlike("^v+$")).cast("int")))
    s = s.withColumn("runs", F.arrays_zip(F.col("found").alias("run"), F.transform("found", lambda r: kind_of(F.substr(r, F.lit(1), F.lit(1)))).alias("kind"), length.alias("at"), number.alias("no")))
    # Each piece of runs gets its own lines first.
    last = lambda f: F.element_at(f, -1)
    fan = lambda f: F.struct(f.alias("runs"), F.slice(F.col("lines"), f[0]["at"] + 2, last(f)["at"] + F.length(last(f)["run"]) - f[0]["at"]).alias("lines"))
    s = s.select("doc_id", "sec_no", "at", F.explode(F.transform(_fans(F.col("runs")), fan)).alias("f")).select("doc_id", "sec_no", "at", "f.*")

    def cut(b: Column) -> Column:
        n, kind = F.length(b["run"]), b["kind"]
        zipped = F.arrays_zip(F.slice(F.col("lines"), b["at"] - F.col("runs")[0]["at"] + 1, n).alias("line"), F.slice(F.split(b["run"], ""), F.lit(1), n).alias("c"))
        rows = F.transform(zipped, lambda x, i: F.struct((F.col("at") + 1 + b["at"] + i).alias("line_no"), x["line"].alias("line"), F.when((kind == "code") & (x["c"] != "F"), "b").otherwise("t").alias("mode"), x["c"].alias("c")))
        kept = F.filter(rows, lambda r: ~r["c"].isin("p", "v") | kind.isin("code", "equation"))
        ls = F.transform(kept, lambda r: F.struct(r["line_no"].alias("line_no"), r["line"].alias("line"), r["mode"].alias("mode")))
        return F.struct((b["no"] + 1).cast("long").alias("block_no"), kind.alias("kind"), ls.alias("ls"))

    real = F.filter("runs", lambda b: ~b["run"].rlike("^(v+|k+)$"))
    return s.select("doc_id", "sec_no", F.explode(F.transform(real, cut)).alias("b")).select("doc_id", "sec_no", "b.*")


def _runs_of(c: Column) -> Column:
    return F.transform(c, lambda x: T.tokenize_runs(x))


def blocks(numbered: DataFrame) -> DataFrame:
    """(doc_id, sec_no, block_no, part_no, kind, ...): ordered blocks of numbered lines, one sparse row each."""
    return _finished(_grouped(block_lines(line_modes(numbered))))


def document_blocks(docs: DataFrame) -> DataFrame:
    """What blocks makes of the lines of docs (doc_id, text), without an exchange."""
    return _finished(_row_blocks(document_sections(docs)))


def _finished(g: DataFrame) -> DataFrame:
    """Blocks with what their kind has; a text block becomes its paragraphs."""
    all_lines = F.transform("ls", lambda x: x["line"])
    extra = {spec.kind: spec for spec in registry.block_kinds()}
    is_ = lambda k: F.col("kind") == k
    quoted = F.transform("ls", lambda x: F.when(x["line"].rlike(QUOTE), F.regexp_extract(x["line"], QUOTE, 1)).otherwise(x["line"]))
    parts = F.when(is_("text"), _paragraphs(quoted)).otherwise(F.array(F.lit(None).cast("string")))
    formula = T.strip(F.regexp_replace(F.replace(F.array_join(all_lines, "\n"), F.lit("$$"), F.lit(" ")), r"\\tag\{[^}]*\}", ""))
    # Equations are judged before runs are made, as a filter on what comes of runs would make them again; so would the filter that explode adds for its array.
    g = g.filter(~is_("equation") | (formula != ""))
    g = g.select("doc_id", "sec_no", "block_no", F.col("kind").alias("_kind"), F.when(~is_("text"), F.col("ls")).alias("ls"), F.posexplode_outer(parts).alias("part_no", "para")).filter("part_no is not null")
    g = paragraph_kind(g, "para").withColumn("kind", F.when(F.col("_kind") == "text", F.col("kind")).otherwise(F.col("_kind"))).drop("_kind")
    code_body = F.transform(F.filter("ls", lambda x: x["mode"] == "b"), lambda x: x["line"])
    item = lambda x: T.strip(F.when(x.rlike(ORDERED), F.regexp_extract(x, ORDERED, 1)).otherwise(F.regexp_extract(x, BULLET, 1)))
    g = g.withColumn("cells", F.when(is_("table"), F.transform(all_lines, T.table_cells)))
    g = g.withColumn("_width", F.array_max(F.transform("cells", F.size)))
    padded = F.transform("cells", lambda r: F.concat(r, F.array_repeat(F.lit(""), F.col("_width") - F.size(r))))
    first = F.get(all_lines, F.lit(0))
    return g.select(
        "doc_id", "sec_no", "block_no", "part_no", "raw", "runs", "heading_like", "kind", "label", F.when(F.col("kind").isin(*extra), F.array_join(all_lines, "\n")).otherwise(F.col("text")).alias("text") if extra else "text",
        F.when(is_("code"), F.regexp_extract(first, FENCE, 2)).alias("lang"),
        F.when(is_("code"), code_body).alias("lines"),
        F.when(is_("equation"), formula).alias("formula"),
        F.when(is_("equation"), F.lit("display")).alias("mode"),
        F.when(is_("list"), first.rlike(ORDERED)).alias("ordered"),
        F.when(is_("list"), _runs_of(F.transform(all_lines, item))).alias("items"),
        F.when(is_("table"), F.col("_width")).alias("ncols"),
        F.when(is_("table"), F.size("cells") > 1).alias("header"),
        F.when(is_("table"), F.transform(padded, _runs_of)).alias("rows"),
    )


def _paragraphs(lines: Column) -> Column:
    """Trimmed paragraphs of text lines, split at blank lines."""
    chunk = F.regexp_replace(F.array_join(lines, "\n"), r"^\n+|\n+\z", "")
    return F.filter(F.transform(F.split(chunk, r"(?U)\n\s*\n", -1), T.strip), lambda p: p != "")


def paragraph_kind(df: DataFrame, para: str) -> DataFrame:
    """Paragraph rows with kind (paragraph or callout), runs, text, label, heading_like and raw, the Markdown itself."""
    raw = F.col(para)
    single = T.strip(F.replace(raw, F.lit("\n"), F.lit(" ")))
    like = raw.rlike(HEADING_LIKE)
    inner = T.strip(F.regexp_extract(raw, HEADING_LIKE, 1))
    both = r"(?d)^(?:\*\*\*(.+?)\*\*\*|___(.+?)___)\z"
    starred = T.strip(F.concat(F.regexp_extract(raw, both, 1), F.regexp_extract(raw, both, 2)))
    numbered = ~like & raw.rlike(both) & starred.rlike(NUMBERED)
    one = F.array(F.struct(starred.alias("text"), F.lit(True).alias("bold"), F.lit(True).alias("italic"), F.lit(False).alias("sup"), F.lit(False).alias("sub"), F.lit(False).alias("math")))
    runs = F.when(like, T.tokenize_runs(inner, bold=True)).when(numbered, one.cast(f"array<{T.RUN}>")).otherwise(T.tokenize_runs(single))
    df = df.withColumn("runs", runs).withColumn("heading_like", like | numbered)
    first = F.get("runs", F.lit(0))
    label = T.strip(first["text"])
    callout = ~F.col("heading_like") & first["bold"] & F.lower(label).isin(CALLOUTS)
    df = df.withColumn("kind", F.when(callout, "callout").otherwise("paragraph")).withColumn("label", F.when(callout, label))
    return df.withColumn("text", T.runs_text(F.col("runs"))).withColumnRenamed(para, "raw")


def block_para_count(kind: Column, items: Column, lines: Column) -> Column:
    """Paragraphs that a block becomes; an unknown kind counts as one paragraph."""
    out = F.when(kind == "list", F.size(items)).when(kind == "code", F.size(lines)).when(kind.isin("table", "equation"), 0)
    for spec in registry.block_kinds():
        out = out.when(kind == spec.kind, spec.count)
    return out.otherwise(1)


def paragraph_flags(texts: Column) -> dict[str, Column]:
    """has_image, has_math, has_bold, has_italic and images of a text."""
    out = {name: F.exists(F.array(*[texts.rlike(p) for p in patterns]), lambda x: x) for name, patterns in FLAGS.items()}
    alt, url = (F.regexp_extract_all(texts, F.lit(IMAGE), F.lit(n)) for n in (1, 2))
    return out | {"images": F.arrays_zip(alt.alias("alt"), url.alias("url"))}


def paragraphs(block_rows: DataFrame, on: str = "raw") -> DataFrame:
    """Prose and callout blocks with their flags; on='raw' looks at the Markdown, on='stripped' at the visible text."""
    p = block_rows.filter(F.col("kind").isin("paragraph", "callout"))
    return p.select("doc_id", "sec_no", "block_no", "part_no", "kind", "text", *[c.alias(n) for n, c in paragraph_flags(F.col("raw" if on == "raw" else "text")).items()])


def section_stats(block_rows: DataFrame, on: str = "raw") -> DataFrame:
    """(doc_id, sec_no, paragraph_count, word_count, first_paragraph, body_paragraphs, flags); flags are null without paragraphs."""
    prose = F.col("kind").isin("paragraph", "callout")
    flags = paragraph_flags(F.col("raw" if on == "raw" else "text"))
    b = block_rows.withColumns({n: F.when(prose, flags[n]) for n in FLAGS})
    texts = F.array_sort(F.collect_list(F.when(prose, F.struct("block_no", "part_no", "text"))))
    g = b.groupBy("doc_id", "sec_no").agg(
        F.sum(block_para_count(F.col("kind"), F.col("items"), F.col("lines"))).alias("paragraph_count"),
        F.sum(F.when(prose, T.word_count(F.col("text"))).otherwise(0)).alias("word_count"),
        F.transform(texts, lambda x: x["text"]).alias("body_paragraphs"),
        *[F.bool_or(n).alias(n) for n in FLAGS],
    )
    return g.withColumn("first_paragraph", F.coalesce(F.substring(F.get("body_paragraphs", F.lit(0)), 1, 200), F.lit("")))


def sections(docs: DataFrame, on: str = "raw", block_rows: DataFrame | None = None) -> DataFrame:
    """Sections of docs (doc_id, text) with tags, counts and flags; sections without body have zero counts. block_rows: the documents' blocks, if they are there already."""
    stats = section_stats(document_blocks(docs) if block_rows is None else block_rows, on)
    s = section_tags(section_heads(document_headings(docs))).join(stats, ["doc_id", "sec_no"], "left")
    return s.fillna(0, ["paragraph_count", "word_count"]).fillna("", ["first_paragraph"]).withColumn("body_paragraphs", F.coalesce("body_paragraphs", F.array().cast("array<string>")))


def document_tree(section_rows: DataFrame) -> DataFrame:
    """sections with node_id, parent_id, depth, subtree_end (the next section outside, or null) and child_word_count.

    The parent is the nearest section before with a lower level. A subtree is an interval of sec_no, so its words are a difference of running sums.
    """
    level = F.col("level")
    by_level = lambda f: F.when(level == 1, f(1)).when(level == 2, f(2)).otherwise(f(3))
    s = section_rows.withColumn("_sum", F.sum("word_count").over(_so_far()))
    total = F.sum("word_count").over(Window.partitionBy("doc_id"))
    s = s.withColumns(
        {
            "parent_id": by_level(lambda n: F.last(F.when(level < n, F.col("tag")), True).over(_before())),
            "_two": F.last(F.when(level < 3, level), True).over(_before()),
            "subtree_end": by_level(lambda n: F.last(F.when(level <= n, F.col("sec_no")), True).over(_after())),
            "_upto": F.coalesce(by_level(lambda n: F.last(F.when(level <= n, F.col("_sum") - F.col("word_count")), True).over(_after())), total),
        }
    )
    one = F.max((level == 1).cast("int")).over(_before())
    depth = F.when(F.col("parent_id").isNull(), 0).when((level == 3) & (F.col("_two") == 2) & (one == 1), 2).otherwise(1)
    s = s.withColumn("depth", depth).withColumn("child_word_count", F.col("_upto") - F.col("_sum"))
    return s.withColumn("node_id", F.col("tag")).drop("_sum", "_two", "_upto")


def tree_nodes(tree: DataFrame) -> DataFrame:
    """Nodes depth first: document order is pre-order."""
    return tree.select("doc_id", "sec_no", "node_id", "parent_id", "title", "level", "word_count", "child_word_count", "first_paragraph")


def doc_summary(docs: DataFrame, section_rows: DataFrame) -> DataFrame:
    """(doc_id, section_count) of every document."""
    n = section_rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("section_count"))
    return docs.select("doc_id").distinct().join(n, "doc_id", "left").fillna(0, ["section_count"])
