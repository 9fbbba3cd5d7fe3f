"""Rule checks: each is a table (doc_id, name, passed, severity, message, details), one row per document, over a spine of all documents.

Joins exchange both sides, as every table here grows with the documents or the templates (see scratch.kept).

docs is the spine: (doc_id, template_id). elements are a document's output elements (operator apply_plan), plan_ops its operations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions import text as T
from foliograph.operators import registry, slots

# Share of paragraphs that must be there, paragraphs looked at from the end, characters of a text in a message, styles that may be empty there.
COMPLETE, LAST, SHOWN, KEEP = 0.85, 6, 30, ["Normal", "TOC", "No Spacing", "Header", "Footer"]
_STYLE_OF = {"major_section": "Heading1", "minor_section": "Heading2", "sub_section": "Heading3"}


def _rows(df: DataFrame, name: str, passed: Column, severity: str, message: Column, details: Column | None = None) -> DataFrame:
    none = F.array().cast("array<string>")
    details = none if details is None else F.when(passed, none).otherwise(F.coalesce(details, none))
    return df.select("doc_id", F.lit(name).alias("name"), passed.alias("passed"), F.when(passed, "info").otherwise(severity).alias("severity"), message.alias("message"), details.alias("details"))


def _first(value: Column, order: str, n: int) -> Column:
    """The first n distinct values of a group by order."""
    listed = F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(order).alias("o"), value.cast("string").alias("v"))))), lambda x: x["v"])
    return F.slice(F.array_distinct(listed), 1, n)


def _spread(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    return docs.select("doc_id").distinct().join(grouped.hint("merge"), "doc_id", "left")


def nonempty(docs: DataFrame, plan_ops: DataFrame) -> DataFrame:
    d = _spread(docs, plan_ops.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")))
    n = F.coalesce("n", F.lit(0))
    return _rows(d, "nonempty", n > 0, "error", F.when(n > 0, F.format_string("the plan has %d operations", n)).otherwise("the plan has no operation"))


def remove_targets(docs: DataFrame, plan_ops: DataFrame, paras: DataFrame) -> DataFrame:
    """Every removed paragraph exists in the template."""
    r = plan_ops.filter("command = 'remove'").withColumn("para_id", F.regexp_extract("path", r"@paraId=([^\]]+)\]", 1)).filter("para_id <> ''")
    r = r.join(docs.select("doc_id", "template_id"), "doc_id").join(paras.select("template_id", "para_id").distinct(), ["template_id", "para_id"], "left_anti")
    d = _spread(docs, r.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), _first(F.col("para_id"), "op_seq", 8).alias("d")))
    n = F.coalesce("n", F.lit(0))
    return _rows(d, "remove_targets", n == 0, "error", F.when(n == 0, "everything removed is in the template").otherwise(F.format_string("%d removed paragraphs are unknown to the template", n)), F.col("d"))


def add_p_style(docs: DataFrame, plan_ops: DataFrame) -> DataFrame:
    bad = (F.col("command") == "add") & (F.col("type") == "p") & (F.coalesce(F.try_element_at("props", F.lit("style")), F.lit("")) == "")
    return _counted(docs, plan_ops.filter(bad), "add_p_style", "each added paragraph has a style", "%d added paragraphs have no style", 8)


def runs_nonempty(docs: DataFrame, plan_ops: DataFrame) -> DataFrame:
    """No run is empty; a single space is a text."""
    bad = (F.col("command") == "add") & (F.col("type") == "r") & (F.coalesce(F.try_element_at("props", F.lit("text")), F.lit("")) == "")
    return _counted(docs, plan_ops.filter(bad), "runs_nonempty", "each added run has a text", "%d added runs have an empty text", 8)


def _counted(docs: DataFrame, bad: DataFrame, name: str, good: str, said: str, most: int) -> DataFrame:
    d = _spread(docs, bad.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), _first(F.col("op_seq") - 1, "op_seq", most).alias("d")))
    n = F.coalesce("n", F.lit(0))
    return _rows(d, name, n == 0, "error", F.when(n == 0, good).otherwise(F.format_string(said, n)), F.col("d"))


def _emitted_sections(sections: DataFrame, logical: DataFrame | None) -> DataFrame:
    if logical is None:
        return sections
    e = slots.emitted_nodes(logical).select("doc_id", F.col("node_id").alias("tag"))
    return sections.join(e.hint("merge"), ["doc_id", "tag"], "left_semi")


def para_count(docs: DataFrame, plan_ops: DataFrame, sections: DataFrame, logical: DataFrame | None = None) -> DataFrame:
    """Added paragraphs = headings + paragraphs of the emitted sections."""
    added = plan_ops.groupBy("doc_id").agg(F.count_if((F.col("command") == "add") & (F.col("type") == "p")).alias("a"))
    s = _emitted_sections(sections, logical)
    want = s.groupBy("doc_id").agg(F.count_if(F.col("type").startswith("heading")).alias("h"), F.sum("paragraph_count").alias("b"))
    d = _spread(docs, added).join(want.hint("merge"), "doc_id", "left").fillna(0, ["a", "h", "b"])
    ok = F.col("a") == F.col("h") + F.col("b")
    said = F.format_string("%d paragraphs are added, the content has %d: %d headings and %d in bodies", "a", F.col("h") + F.col("b"), "h", "b")
    return _rows(d, "para_count", ok, "error", F.when(ok, F.format_string("%d paragraphs are added, as many as the content has", "a")).otherwise(said))


def heading_order(docs: DataFrame, headings: DataFrame) -> DataFrame:
    """S1: no heading (doc_id, seq, level) is more than one level below the one before."""
    h = headings.withColumn("prev", F.lag("level").over(Window.partitionBy("doc_id").orderBy("seq")))
    jump = F.when(F.col("level") > F.col("prev") + 1, F.format_string("element %d goes from level %d to %d", "seq", "prev", "level"))
    d = _spread(docs, h.groupBy("doc_id").agg(F.count(jump).alias("n"), _first(jump, "seq", 1_000_000).alias("d")))
    n = F.coalesce("n", F.lit(0))
    return _rows(d, "S1", n == 0, "warning", F.when(n == 0, "no heading skips a level").otherwise(F.format_string("%d headings skip a level", n)), F.col("d"))


def _judged(docs: DataFrame, elements: DataFrame, furniture: DataFrame | None) -> DataFrame:
    """Text paragraphs that aren't the template's own, with template_id; of their texts, the first SHOWN characters."""
    p = elements.filter("kind = 'para'").filter(T.strip(F.coalesce("text", F.lit(""))) != "").withColumn("text", F.substring("text", 1, SHOWN)).join(docs.select("doc_id", "template_id").distinct(), "doc_id")
    return p if furniture is None else p.join(furniture.select("doc_id", "para_id").distinct().hint("merge"), ["doc_id", "para_id"], "left_anti")


def font_size(docs: DataFrame, elements: DataFrame, best: DataFrame, styles: DataFrame, furniture: DataFrame | None = None) -> DataFrame:
    """S3: fonts and sizes of headings and body as in the template's best prototypes; an unknown value on either side passes."""
    want = best.join(styles.hint("merge"), "template_id", "left").filter(F.col("style_name").isin("Heading1", "Heading2", "Heading3") | F.coalesce(F.col("style_name") == F.col("body_style"), F.lit(False)))
    want = want.select("template_id", F.col("style_name").alias("style"), F.nullif("effective_font", F.lit("")).alias("ef"), F.coalesce(F.nullif("explicit_size", F.lit("")), F.nullif("effective_size", F.lit(""))).alias("es"))
    p = _judged(docs, elements, furniture).join(want.hint("merge"), ["template_id", "style"])
    wrong = lambda got, exp, what: F.when(F.nullif(got, F.lit("")) != exp, F.format_string(f"style %s has {what} %s instead of %s", F.col("style"), got, exp))
    found = F.array_compact(F.array(wrong(F.col("font"), F.col("ef"), "font"), wrong(F.col("size"), F.col("es"), "size")))
    g = p.withColumn("w", found).groupBy("doc_id").agg(F.count(F.lit(1)).alias("checked"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("style", "seq", "w"))), lambda x: x["w"]))).alias("d"))
    d = _spread(docs, g)
    n = F.size(F.coalesce("d", F.array().cast("array<string>")))
    return _rows(d, "S3", n == 0, "warning", F.when(n == 0, F.format_string("fonts and sizes agree in %d paragraphs", F.coalesce("checked", F.lit(0)))).otherwise(F.format_string("%d kinds of font or size differ from the template", n)), F.slice("d", 1, 6))


def _body(docs: DataFrame, elements: DataFrame, styles: DataFrame, furniture: DataFrame | None, default: bool) -> DataFrame:
    name = F.coalesce("body_style", F.lit("Normal")) if default else F.col("body_style")
    return _judged(docs, elements, furniture).join(styles.hint("merge"), "template_id", "left").filter(F.col("style") == name)


def first_line_indent(docs: DataFrame, elements: DataFrame, best: DataFrame, styles: DataFrame, furniture: DataFrame | None = None) -> DataFrame:
    """S4: body paragraphs have the body prototype's first-line indent, if it has one."""
    want = best.join(styles.hint("merge"), "template_id").filter("style_name = body_style").select("template_id", F.col("ind_first_line").alias("exp"))
    want = want.filter(~F.coalesce("exp", F.lit("")).isin("", "0", "0pt", "0cm"))
    b = _body(docs, elements, styles, furniture, False).join(want.hint("merge"), "template_id")
    bad = F.when(~F.col("ind_first_line").eqNullSafe(F.col("exp")), F.format_string("%s: first line at %s instead of %s", "text", F.coalesce("ind_first_line", F.lit("None")), "exp"))
    d = _spread(docs, b.groupBy("doc_id").agg(F.count(bad).alias("n"), _first(bad, "seq", 5).alias("d"), F.max("exp").alias("exp")))
    n = F.coalesce("n", F.lit(0))
    good = F.coalesce(F.concat(F.lit("bodies begin their first line at "), "exp"), F.lit("the template has no first-line indent"))
    return _rows(d, "S4", n == 0, "warning", F.when(n == 0, good).otherwise(F.format_string("%d body paragraphs have another first-line indent", n)), F.col("d"))


def trailing_empties(docs: DataFrame, elements: DataFrame, styles: DataFrame) -> DataFrame:
    """S5: empty paragraphs of other styles among the last ones; always passes unless there is no paragraph."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("seq"))
    p = elements.filter("kind = 'para'").select("doc_id", "seq", "style", (T.strip(F.coalesce("text", F.lit(""))) == "").alias("blank"))
    p = p.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= LAST)
    p = p.join(docs.select("doc_id", "template_id").distinct(), "doc_id").join(styles.hint("merge"), "template_id", "left")
    kept = F.coalesce(F.col("style").isin(KEEP) | (F.col("style") == F.col("body_style")), F.col("style").isNull() & F.col("body_style").isNull(), F.lit(False))
    empty = F.col("blank") & ~kept
    d = _spread(docs, p.groupBy("doc_id").agg(F.count_if(empty).alias("n")))
    said = F.when(F.col("n").isNull(), "no paragraph at all").when(F.col("n") > 0, F.format_string("%d empty paragraphs near the end", "n")).otherwise("no empty paragraph near the end")
    return _rows(d, "S5", F.col("n").isNotNull(), "error", said)


def line_spacing(docs: DataFrame, elements: DataFrame, formats: DataFrame, styles: DataFrame, furniture: DataFrame | None = None) -> DataFrame:
    """S6: no body paragraph has an exact line height unless the template's body has; only if the body has a spacing."""
    value = lambda k: F.try_element_at("body_format", F.lit(k))
    want = formats.select("template_id", value("lineSpacing").alias("spacing"), value("lineRule").alias("rule")).filter("spacing is not null")
    b = _body(docs, elements, styles, furniture, True).join(want.hint("merge"), "template_id")
    bad = F.when((F.col("line_rule") == "exact") & ~F.coalesce(F.col("rule") == "exact", F.lit(False)), F.format_string("%s: exact line height, the template has %s", "text", F.coalesce("rule", F.lit("None"))))
    d = _spread(docs, b.groupBy("doc_id").agg(F.count(F.lit(1)).alias("checked"), F.count(bad).alias("n"), _first(bad, "seq", 5).alias("d")))
    n = F.coalesce("n", F.lit(0))
    good = F.when(F.col("checked").isNull(), "the template has no line spacing").otherwise(F.format_string("%d body paragraphs have free line height", "checked"))
    return _rows(d, "S6", n == 0, "error", F.when(n == 0, good).otherwise(F.format_string("%d body paragraphs have an exact line height", n)), F.col("d"))


def completeness(docs: DataFrame, elements: DataFrame, sections: DataFrame, styles: DataFrame, logical: DataFrame | None = None) -> DataFrame:
    """S7: at least COMPLETE of the expected body paragraphs; more are fine."""
    got = _body(docs, elements, styles, None, True).groupBy("doc_id").agg(F.count(F.lit(1)).alias("a"))
    want = _emitted_sections(sections, logical).groupBy("doc_id").agg(F.sum("paragraph_count").alias("e"))
    d = _spread(docs, got).join(want.hint("merge"), "doc_id", "left").fillna(0, ["a", "e"])
    ok = (F.col("e") == 0) | (F.col("a") >= COMPLETE * F.col("e"))
    return _rows(d, "S7", ok, "error", F.format_string("%s: %d body paragraphs of %d", F.when(ok, "enough content").otherwise("content is missing"), "a", "e"))


def heading_counts(docs: DataFrame, elements: DataFrame, sections: DataFrame, logical: DataFrame | None = None) -> DataFrame:
    """S8: as many headings of each style as the emitted nodes' presentations (without logical nodes: the section types) say."""
    if logical is None:
        want = sections.select("doc_id", F.initcap(F.regexp_replace("type", "^heading", "Heading")).alias("style")).filter("style like 'Heading%'")
    else:
        m = F.create_map(*[F.lit(x) for kv in _STYLE_OF.items() for x in kv])
        want = slots.emitted_nodes(logical).select("doc_id", F.try_element_at(m, F.col("presentation")).alias("style")).filter("style is not null")
    got = elements.filter("kind = 'para' and style in ('Heading1', 'Heading2', 'Heading3')").filter(T.strip(F.coalesce("text", F.lit(""))) != "")
    count = lambda df, n: df.groupBy("doc_id", "style").agg(F.count(F.lit(1)).alias(n))
    both = count(got, "g").join(count(want, "e"), ["doc_id", "style"], "full").fillna(0, ["g", "e"])
    bad = F.when(F.col("g") != F.col("e"), F.format_string("%s: %d headings instead of %d", "style", "g", "e"))
    d = _spread(docs, both.groupBy("doc_id").agg(F.count(bad).alias("n"), _first(bad, "style", 3).alias("d")))
    n = F.coalesce("n", F.lit(0))
    return _rows(d, "S8", n == 0, "error", F.when(n == 0, "as many headings as planned").otherwise("more or fewer headings than planned"), F.col("d"))


def furniture_survived(docs: DataFrame, elements: DataFrame, classified: DataFrame) -> DataFrame:
    """S9: all furniture paragraphs are in the output, and at least as many tables as furniture tables."""
    ids = slots.furniture_ids(classified).select("doc_id", "para_id")
    lost = ids.join(elements.select("doc_id", "para_id").distinct(), ["doc_id", "para_id"], "left_anti")
    lost = lost.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lost"), F.array_sort(F.collect_list("para_id")).alias("ids"))
    want = classified.groupBy("doc_id").agg(F.count_if(F.col("role") == "furniture_table").alias("et"), F.count_if((F.col("role") == "furniture") & (F.coalesce("para_id", F.lit("")) != "")).alias("ep"))
    got = elements.groupBy("doc_id").agg(F.count_if(F.col("kind") == "table").alias("gt"))
    d = _spread(docs, want).join(lost.hint("merge"), "doc_id", "left").join(got.hint("merge"), "doc_id", "left").fillna(0, ["et", "ep", "lost", "gt"])
    a = F.when(F.col("lost") > 0, F.format_string("%d fixed paragraphs are gone: %s", "lost", F.array_join(F.slice("ids", 1, 5), ", ")))
    b = F.when(F.col("gt") < F.col("et"), F.format_string("%d of %d fixed tables are left, %d are gone", "gt", "et", F.col("et") - F.col("gt")))
    ok = (F.col("lost") == 0) & (F.col("gt") >= F.col("et"))
    return _rows(d, "S9", ok, "error", F.when(ok, F.format_string("all %d fixed paragraphs and %d fixed tables are there", "ep", "et")).otherwise("fixed parts of the template are gone"), F.array_compact(F.array(a, b)))


def skipped(docs: DataFrame, name: str) -> DataFrame:
    """A check whose inputs are missing: passes with a note."""
    return _rows(docs.select("doc_id").distinct(), name, F.lit(True), "info", F.lit("not checked, as its inputs are missing"))


def run_checks(docs: DataFrame, plan_ops=None, elements=None, paras=None, sections=None, logical=None, best=None, formats=None, styles=None, classified=None) -> DataFrame:
    """All checks, then the registered ones, as one table; a check without its inputs is skipped."""
    furniture = slots.furniture_ids(classified) if classified is not None else None
    heads = None if elements is None else elements.filter("kind = 'para' and style rlike '^Heading[1-6]$'").select("doc_id", "seq", F.substring("style", 8, 1).cast("int").alias("level"))
    todo = [
        ("nonempty", [plan_ops], lambda: nonempty(docs, plan_ops)),
        ("remove_targets", [plan_ops, paras], lambda: remove_targets(docs, plan_ops, paras)),
        ("add_p_style", [plan_ops], lambda: add_p_style(docs, plan_ops)),
        ("runs_nonempty", [plan_ops], lambda: runs_nonempty(docs, plan_ops)),
        ("para_count", [plan_ops, sections], lambda: para_count(docs, plan_ops, sections, logical)),
        ("S1", [heads], lambda: heading_order(docs, heads)),
        ("S3", [elements, best, styles], lambda: font_size(docs, elements, best, styles, furniture)),
        ("S4", [elements, best, styles], lambda: first_line_indent(docs, elements, best, styles, furniture)),
        ("S5", [elements, styles], lambda: trailing_empties(docs, elements, styles)),
        ("S6", [elements, formats, styles], lambda: line_spacing(docs, elements, formats, styles, furniture)),
        ("S7", [elements, sections, styles], lambda: completeness(docs, elements, sections, styles, logical)),
        ("S8", [elements, sections], lambda: heading_counts(docs, elements, sections, logical)),
        ("S9", [elements, classified], lambda: furniture_survived(docs, elements, classified)),
    ]
    parts = [check() if all(i is not None for i in inputs) else skipped(docs, name) for name, inputs, check in todo]
    parts += [check(docs=docs, plan_ops=plan_ops, elements=elements, sections=sections, logical=logical) for check in registry.checks().values()]
    return reduce(DataFrame.unionByName, parts)


def check_verdict(checks: DataFrame) -> DataFrame:
    """(doc_id, errors, warnings, passed): a document fails by any error."""
    bad = lambda s: F.count_if(~F.col("passed") & (F.col("severity") == s))
    return checks.groupBy("doc_id").agg(bad("error").alias("errors"), bad("warning").alias("warnings")).withColumn("passed", F.col("errors") == 0)
