"""Rebuild plans as ordered operation rows, and their relational application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions import text as T
from foliograph.operators import registry, slots, template
from foliograph.sources.scratch import kept

# Heading styles by presentation, code font, callout indent.
STYLES = {"major_section": "Heading1", "minor_section": "Heading2", "sub_section": "Heading3", "appendix": "Heading1"}
MONO, INDENT = "Courier New", "360"
STRATEGIES = ["clone"]
_LAST = "/body/p[last()]"


def _none() -> Column:
    return F.create_map().cast("map<string,string>")


def _upto():
    return Window.partitionBy("doc_id").orderBy("op_seq").rowsBetween(Window.unboundedPreceding, 0)


def _key(phase: int, *parts: Column | int) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(p) for p in (phase, *parts)]
    cols += [F.lit(0)] * (6 - len(cols))
    return F.struct(*[c.cast("long").alias(n) for c, n in zip(cols, "pabcde")])


def _op(key: Column, command: str, type_: str | None = None, parent: Column | str | None = None, path: Column | None = None, before: str | None = None, props: Column | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(key.alias("key"), F.lit(command).alias("command"), lit(type_).alias("type"), lit(parent).alias("parent"), lit(path).alias("path"), lit(before).alias("before"), (_none() if props is None else props).cast("map<string,string>").alias("props"))


def _one(*pairs: str | Column) -> Column:
    return F.create_map(*[p if isinstance(p, Column) else F.lit(p) for p in pairs])


def _put(props: Column, more: Column) -> Column:
    """props with more on top."""
    return F.map_concat(F.map_filter(props, lambda k, _: ~F.map_contains_key(more, k)), more)


def remove_ops(classified: DataFrame) -> DataFrame:
    """One operation for each slot paragraph, in order, then for each slot table, highest index first."""
    p = classified.filter("role = 'slot' and coalesce(para_id, '') <> ''")
    p = p.select("doc_id", _op(_key(0, F.col("pos")), "remove", path=F.concat(F.lit("/body/p[@paraId="), "para_id", F.lit("]"))).alias("op"))
    t = classified.filter("role = 'slot_table'")
    return p.union(t.select("doc_id", _op(_key(1, -F.col("tbl_index")), "remove", path=F.concat(F.lit("/body/tbl["), F.col("tbl_index").cast("string"), F.lit("]"))).alias("op")))


def body_props(docs: DataFrame, formats: DataFrame, styles: DataFrame, best: DataFrame, justify: bool = False) -> DataFrame:
    """docs (doc_id, template_id) with body_props and run_props: the discovered format with a style, else the style's; run properties only from the format."""
    d = docs.join(formats.hint("merge"), "template_id", "left").join(styles.hint("merge"), "template_id", "left").withColumn("style_name", F.coalesce("body_style", F.lit("Normal")))
    d = template.props_for_style(best, d)
    found = F.size(F.coalesce("body_format", _none())) > 0
    body = F.when(found, template.with_style(F.col("body_format"), F.col("style_name"))).otherwise(F.col("props"))
    body = _put(body, _one("align", "both")) if justify else body
    value = lambda k: F.try_element_at("body_format", F.lit(k))
    run = F.map_filter(_one("size", value("size"), "font.latin", value("font.ascii")), lambda _, v: F.coalesce(v, F.lit("")) != "")
    return d.withColumn("body_props", body).withColumn("run_props", F.when(found, run).otherwise(_none())).drop("style_name", "props", "body_format", "body_style")


def run_ops(runs: Column, key, parent: Column | str, base: Column, mono: bool = False) -> Column:
    """Operations of non-empty runs; key(i) orders them. Math becomes an inline equation."""

    def one(r: Column, i: Column) -> Column:
        math = _op(key(i), "add", "equation", parent, props=_one("formula", T.normalize_formula(r["text"]), "mode", "inline"))
        style = {"bold": F.when(r["bold"], "true"), "italic": F.when(r["italic"], "true"), "vertAlign": F.when(r["sup"], "superscript").when(r["sub"], "subscript")}
        if mono:
            style = {"font.latin": F.lit(MONO)}
        more = F.map_filter(_one("text", r["text"], *[x for k, v in style.items() for x in (k, v)]), lambda _, v: v.isNotNull())
        plain = _op(key(i), "add", "r", parent, props=_put(base, more))
        return F.when(r["text"] == "", F.lit(None)).when(r["math"], math).otherwise(plain)

    return F.filter(F.transform(runs, one), lambda x: x.isNotNull())


def plain_run(text: Column) -> Column:
    no = F.lit(False)
    return F.array(F.struct(text.alias("text"), no.alias("bold"), no.alias("italic"), no.alias("sup"), no.alias("sub"), no.alias("math"))).cast(f"array<{T.RUN}>")


def heading_ops(nodes: DataFrame, prototypes: DataFrame) -> DataFrame:
    """A paragraph and its run for each emitted node (doc_id, sec_no, node_id, template_id, presentation, title) that isn't body text."""
    style = F.lit("Heading1")
    for k, v in STYLES.items():
        style = F.when(F.col("presentation") == k, v).otherwise(style)
    n = nodes.filter("presentation <> 'body_text'").withColumn("style_name", style)
    n = template.heading_props(n, prototypes)
    p = F.array(_op(_key(2, F.col("sec_no"), -1, 0, 0, -1), "add", "p", "/body", props=F.col("props")))
    runs = run_ops(plain_run(F.col("title")), lambda i: _key(2, F.col("sec_no"), -1, 0, 0, i), _LAST, _none())
    return n.select("doc_id", F.explode(F.concat(p, runs)).alias("op"))


def unknown_nodes(logical: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, node_id) of logical nodes that the content doesn't have."""
    s = sections.select("doc_id", F.col("tag").alias("node_id"))
    return logical.select("doc_id", "node_id").join(s, ["doc_id", "node_id"], "left_anti")


def block_ops(block_rows: DataFrame) -> DataFrame:
    """Operations of blocks (with body_props and run_props) by kind; unknown kinds are paragraphs."""
    at = lambda d, e: _key(2, F.col("sec_no"), F.col("block_no"), F.col("part_no"), d, e)
    body, base = F.col("body_props"), F.col("run_props")

    def para(props: Column, runs: Column, d: Column | int = 0, mono: bool = False) -> Column:
        d = d if isinstance(d, Column) else F.lit(d)
        return F.concat(F.array(_op(at(d, F.lit(-1)), "add", "p", "/body", props=props)), run_ops(runs, lambda i: at(d, i), _LAST, base, mono))

    text_runs = F.coalesce("runs", F.when(F.coalesce("text", F.lit("")) != "", plain_run(F.col("text"))), F.array().cast(f"array<{T.RUN}>"))
    listed = _put(body, _one("listStyle", F.when(F.col("ordered"), "ordered").otherwise("bullet")))
    items = F.flatten(F.transform("items", lambda runs, i: para(listed, runs, i)))
    code = F.flatten(F.transform("lines", lambda line, i: para(body, plain_run(F.when(line == "", " ").otherwise(line)), i, mono=True)))
    width = F.greatest(F.lit(1200), F.floor(F.lit(9000) / F.greatest(F.lit(1), F.col("ncols")))).cast("int").cast("string")
    table = F.array(_op(at(-1, 0), "add", "table", "/body", props=_one("colWidths", F.array_join(F.array_repeat(width, F.greatest(F.lit(1), F.col("ncols"))), ","))))

    def row(cells: Column, i: Column) -> Column:
        head = F.when(i > 0, F.array(_op(at(i, F.lit(-1)), "add", "row", "/body/tbl[last()]"))).otherwise(F.array(_op(at(i, F.lit(-1)), "skip")))
        cell = lambda runs, c: run_ops(runs, lambda k: at(i, c * 1_000_000 + k), F.concat(F.lit("/body/tbl[last()]/tr[last()]/tc["), (c + 1).cast("string"), F.lit("]/p[last()]")), base)
        return F.concat(F.filter(head, lambda o: o["command"] != "skip"), F.flatten(F.transform(cells, cell)))

    rows = F.flatten(F.transform("rows", row))
    equation = F.array(_op(at(0, 0), "add", "equation", "/body", props=_one("formula", T.normalize_formula(F.coalesce("formula", F.lit(""))), "mode", F.coalesce("mode", F.lit("display")))))
    special = {spec.kind: spec for spec in registry.block_kinds() if spec.ops}
    own = block_rows.filter(~F.col("kind").isin(*special)) if special else block_rows
    ops = F.when(F.col("kind") == "list", items).when(F.col("kind") == "code", code).when(F.col("kind") == "table", F.concat(table, rows)).when(F.col("kind") == "equation", equation)
    ops = ops.when(F.col("kind") == "callout", para(_put(body, _one("leftIndent", INDENT)), text_runs)).otherwise(para(body, text_runs))
    out = own.select("doc_id", F.explode(ops).alias("op"))
    for kind, spec in special.items():
        out = out.union(spec.ops(block_rows.filter(F.col("kind") == kind)))
    return out


def move_ops(trailing: DataFrame) -> DataFrame:
    """Trailing elements go before the last section mark; a table's index is the number of tables that stay, plus one."""
    path = F.when(F.col("kind") == "p", F.concat(F.lit("/body/p[@paraId="), "para_id", F.lit("]"))).otherwise(F.concat(F.lit("/body/tbl["), (F.col("kept_tables_before_trailing") + 1).cast("string"), F.lit("]")))
    return trailing.select("doc_id", _op(_key(3, F.col("order")), "move", path=path, before="/body/sectPr").alias("op"))


def strategy_filter(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that can be planned, and the others (doc_id, strategy)."""
    ok = F.coalesce("strategy", F.lit("clone")).isin(STRATEGIES)
    return docs.filter(ok), docs.filter(~ok).select("doc_id", "strategy")


def plan(docs: DataFrame, logical: DataFrame, sections: DataFrame, block_rows: DataFrame, paras: DataFrame, prototypes: DataFrame, justify: bool = False, classified: DataFrame | None = None) -> DataFrame:
    """(doc_id, op_seq, command, type, parent, path, before, props): removes, adds in content order, moves.

    docs: (doc_id, template_id, front_matter_strategy), and strategy if some documents may not be plannable: those get no operations; prototypes with section_context. classified: the docs' classified elements, if they are there already.
    """
    emitted = slots.emitted_nodes(logical)
    docs = strategy_filter(docs)[0] if "strategy" in docs.columns else docs
    if classified is None:
        classified = slots.classify_elements(slots.body_children(paras), docs, slots.content_titles(sections, emitted))
    templates = docs.select("doc_id", "template_id")
    nodes = emitted.select("doc_id", "node_id", "presentation").join(sections.select("doc_id", "sec_no", F.col("tag").alias("node_id"), "title"), ["doc_id", "node_id"]).join(templates, "doc_id")
    nodes = kept(nodes, "nodes")  # matching of headings and blocks reads them five times
    props = body_props(templates, template.body_format(paras), template.body_style(paras), template.best_prototype(prototypes), justify)
    b = block_rows.join(nodes.select("doc_id", "sec_no"), ["doc_id", "sec_no"]).join(props.select("doc_id", "body_props", "run_props").hint("merge"), "doc_id")
    ops = remove_ops(classified).union(heading_ops(nodes, prototypes)).union(block_ops(b)).union(move_ops(slots.trailing_order(classified)))
    return _numbered(ops)


def _numbered(ops: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("op.key")
    return ops.select("doc_id", F.row_number().over(w).alias("op_seq"), "op.command", "op.type", "op.parent", "op.path", "op.before", "op.props")


def plan_summary(plan_ops: DataFrame) -> DataFrame:
    """(doc_id, ops, removes, adds, moves, paragraphs, runs, tables, equations)."""
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    return plan_ops.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("ops"), is_("command", "remove").alias("removes"), is_("command", "add").alias("adds"), is_("command", "move").alias("moves"),
        is_("type", "p").alias("paragraphs"), is_("type", "r").alias("runs"), is_("type", "table").alias("tables"), is_("type", "equation").alias("equations"),
    )


def degrade_equations(plan_ops: DataFrame, failed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The plan with failed equations (doc_id, op_seq) as text, and (doc_id, degraded). A display equation becomes a paragraph like the last one before it."""
    f = failed.select(F.col("doc_id").alias("_d"), F.col("op_seq").alias("_s")).distinct()
    equation = F.coalesce(F.col("type") == "equation", F.lit(False))
    # Only equations are joined; the others go straight to the window's exchange by document.
    tried = plan_ops.filter(equation).join(f, (F.col("doc_id") == F.col("_d")) & (F.col("op_seq") == F.col("_s")), "left").withColumn("_bad", F.col("_d").isNotNull()).drop("_d", "_s")
    count = tried.filter("_bad").groupBy("doc_id").agg(F.count(F.lit(1)).alias("degraded"))
    p = tried.unionByName(plan_ops.filter(~equation).withColumn("_bad", F.lit(False)))
    is_p = (F.col("command") == "add") & (F.col("type") == "p")
    text = _one("text", F.concat(F.lit("$"), F.coalesce(F.try_element_at("props", F.lit("formula")), F.lit("")), F.lit("$")), "italic", "true")
    inline = (F.try_element_at("props", F.lit("mode")) == "inline") | (F.coalesce("parent", F.lit("/body")) != "/body")
    two = F.col("_bad") & ~inline
    more = F.coalesce(F.sum(two.cast("int")).over(Window.partitionBy("doc_id").orderBy("op_seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("op_seq")) + more
    p = p.withColumns({"_last": F.coalesce(F.last(F.when(is_p, F.col("props")), True).over(_upto()), _one("style", "Normal")), "_at": at.cast("int")})
    key = _key(0)
    same = F.struct(key.alias("key"), *["command", "type", "parent", "path", "before", "props"])
    as_run = lambda parent: _op(key, "add", "r", parent, props=text)
    ops = F.when(~F.col("_bad"), F.array(same)).when(inline, F.array(as_run(F.coalesce("parent", F.lit("/body"))))).otherwise(F.array(_op(key, "add", "p", "/body", props=F.col("_last")), as_run(F.lit(_LAST))))
    out = p.select("doc_id", "_at", F.posexplode(ops).alias("_i", "op"))
    return out.select("doc_id", (F.col("_at") + F.col("_i")).alias("op_seq"), "op.command", "op.type", "op.parent", "op.path", "op.before", "op.props"), count


def apply_plan(children: DataFrame, plan_ops: DataFrame) -> DataFrame:
    """Output elements (doc_id, seq, kind, para_id, style, align, text, size, font, ind_first_line, line_rule, tbl_index, rows, cols).

    children: the template's direct children for each document. Removes come first, then adds at the end, then moves.
    """
    para = F.regexp_extract("path", r"@paraId=([^\]]+)\]", 1)
    table = F.regexp_extract("path", r"^/body/tbl\[(\d+)\]", 1)
    named = plan_ops.filter(F.col("command").isin("remove", "move")).select(F.col("doc_id").alias("_d"), "op_seq", (F.col("command") == "remove").alias("_gone"), F.nullif(para, F.lit("")).alias("_p"), F.nullif(table, F.lit("")).cast("int").alias("_t"))
    # Paragraphs meet their removes and moves in one join; tables, which are few, go their own way.
    by_para = named.filter("_p is not null").groupBy("_d", "_p").agg(F.bool_or("_gone").alias("_gone"), F.max(F.when(~F.col("_gone"), F.col("op_seq"))).alias("_m"))
    texts = children.filter("kind <> 'tbl'").join(by_para.hint("merge"), (F.col("doc_id") == F.col("_d")) & (F.col("para_id") == F.col("_p")), "left").filter("not coalesce(_gone, false)").drop("_d", "_p", "_gone")
    by_table = named.filter("_t is not null")
    tables = children.filter("kind = 'tbl'").join(by_table.filter("_gone").select("_d", "_t"), (F.col("doc_id") == F.col("_d")) & (F.col("tbl_index") == F.col("_t")), "left_anti")
    # The n-th table move takes the n-th of the tables that the moves leave for the end.
    tables = tables.withColumn("_rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")))
    moves = by_table.filter("not _gone").select("_d", F.col("op_seq").alias("_m"), (F.col("_t") - 1 + F.row_number().over(Window.partitionBy("_d").orderBy("op_seq"))).alias("_r"))
    tables = tables.join(moves.hint("merge"), (F.col("doc_id") == F.col("_d")) & (F.col("_rank") == F.col("_r")), "left").drop("_d", "_rank", "_r")
    both = texts.unionByName(tables)
    moved = F.col("_m")
    null = lambda t: F.lit(None).cast(t)
    col = lambda n, t="string": F.col(n).cast(t) if n in both.columns else null(t)
    old = both.select("doc_id", _key(0, F.when(moved.isNull(), 0).otherwise(2), F.coalesce(moved, F.col("pos"))).alias("key"), F.when(F.col("kind") == "tbl", "table").otherwise("para").alias("kind"), "para_id", col("style").alias("style"), col("align").alias("align"), "text", col("eff_size").alias("size"), col("eff_font").alias("font"), null("string").alias("ind_first_line"), col("line_rule").alias("line_rule"), col("tbl_index", "int").alias("tbl_index"), col("rows", "int").alias("rows"), null("int").alias("cols"))
    a = plan_ops.filter("command = 'add'")
    starts = F.col("type").isin("p", "table") | ((F.col("type") == "equation") & (F.col("parent") == "/body"))
    a = a.withColumn("_e", F.sum(starts.cast("int")).over(_upto()))
    first = lambda v: F.max(F.when(starts, v))
    prop = lambda k: F.try_element_at("props", F.lit(k))
    own_run = (F.col("type") == "r") & (F.col("parent") == _LAST)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(own_run, F.struct("op_seq", prop("text").alias("t"))))), lambda x: x["t"]), "")
    new = a.groupBy("doc_id", "_e").agg(
        F.min("op_seq").alias("at"), first(F.when(F.col("type") == "p", "para").otherwise(F.col("type"))).alias("kind"), first(prop("style")).alias("style"), first(prop("align")).alias("align"), text.alias("text"),
        F.coalesce(first(prop("size")), F.max(F.when(own_run, prop("size")))).alias("size"), F.coalesce(first(prop("font.ascii")), F.max(F.when(own_run, prop("font.latin")))).alias("font"),
        first(prop("firstLineIndent")).alias("ind_first_line"), first(prop("lineRule")).alias("line_rule"), F.when(first(F.col("type")) == "table", 1 + F.count_if(F.col("type") == "row")).cast("int").alias("rows"),
        first(F.when(F.col("type") == "table", F.size(F.split(prop("colWidths"), ",")))).alias("cols"),
    )
    new = new.withColumn("key", _key(0, 1, F.col("at"))).withColumn("para_id", F.lit(None).cast("string")).withColumn("tbl_index", F.lit(None).cast("int"))
    out = old.unionByName(new.select(*old.columns))
    return out.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("key"))).drop("key")


def apply_summary(plan_ops: DataFrame, failed: DataFrame, degraded: DataFrame) -> DataFrame:
    """(doc_id, total, succeeded, failed, degraded); failed: (doc_id, op_seq)."""
    f = failed.select(F.col("doc_id").alias("_d"), F.col("op_seq").alias("_s")).distinct()
    p = plan_ops.join(f, (F.col("doc_id") == F.col("_d")) & (F.col("op_seq") == F.col("_s")), "left")
    g = p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("_d").isNotNull()).alias("failed"))
    g = g.join(degraded, "doc_id", "left").withColumn("degraded", F.coalesce("degraded", F.lit(0)))
    return g.select("doc_id", "total", (F.col("total") - F.col("failed")).alias("succeeded"), "failed", "degraded")
