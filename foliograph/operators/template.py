"""Template profiling: paragraph records to body style, body format, prototypes and heading formats.

Tables are keyed by template_id; ties always go to the first paragraph in document order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions import text as T

HEADINGS = ["Heading1", "Heading2", "Heading3"]
RAW_SCHEMA = "template_id long, seq long, text string, path string, format map<string,string>"


def _first(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def load_template_paras(raw: DataFrame) -> DataFrame:
    """Paragraph records (RAW_SCHEMA; format holds the readback keys) to typed rows."""
    f = lambda k: F.col("format")[k]
    style = F.when(_first(f("style")).isNotNull(), T.norm_style(f("style")))
    text = T.strip(F.coalesce(F.col("text"), F.lit("")))
    p = raw.select(
        "template_id", "seq", f("paraId").alias("para_id"), style.alias("style"), text.alias("text"), F.coalesce("path", F.lit("")).alias("path"),
        F.when(f("outlineLevel").rlike("^[0-9]+$"), f("outlineLevel").cast("int")).alias("outline_level"),
        _first(f("size"), f("markRPr.size"), f("effective.size")).alias("eff_size"),
        _first(f("effective.font.ascii"), f("font.ascii"), f("font.hAnsi")).alias("eff_font"),
        f("align").alias("align"), f("lineSpacing").alias("line_spacing"), f("lineRule").alias("line_rule"), f("effective.spaceAfter").alias("space_after"),
    )
    return p.select("*", *[c.alias(n) for n, c in structural_flags().items()])


def structural_flags() -> dict[str, Column]:
    path = F.col("path")
    outside = path.contains("/tbl[") | path.contains("note[") | ~path.startswith("/body/p")
    return {"has_text": F.col("text") != "", "is_heading": F.coalesce(F.col("style").isin(HEADINGS), F.lit(False)), "in_table": outside, "text_len": F.length("text")}


def load_template_tables(raw: DataFrame) -> DataFrame:
    """(template_id, tbl_index, path, rows) of the body's own tables from records (template_id, path, rows)."""
    index = F.regexp_extract("path", r"^/body/tbl\[(\d+)\]", 1)
    return raw.filter(F.col("path").startswith("/body/tbl")).select("template_id", F.when(index != "", index.cast("int")).alias("tbl_index"), "path", "rows")


def load_prototypes(raw: DataFrame, styles: DataFrame | None = None) -> DataFrame:
    """Paragraphs of Heading1-3, Normal and each template's body style (styles: template_id, body_style) as prototypes."""
    f = lambda *ks: _first(*[F.col("format")[k] for k in ks])
    name = F.coalesce(T.norm_style(f("style")), F.lit("Normal"))
    p = raw.withColumn("style_name", name)
    wanted = F.col("style_name").isin([*HEADINGS, "Normal"])
    if styles is not None:
        p = p.join(styles.select(F.col("template_id").alias("_t"), "body_style"), F.col("template_id") == F.col("_t"), "left")
        wanted = wanted | F.coalesce(F.col("style_name") == F.col("body_style"), F.lit(False))
    size, font = f("size", "markRPr.size"), f("font.ascii", "font.hAnsi")
    given = F.try_to_number(F.col("format")["outlineLevel"], F.lit("999")).cast("int")
    level = F.coalesce(given, F.when(F.col("style_name").isin(HEADINGS), F.substring("style_name", 8, 1).cast("int")))
    return p.filter(wanted).select(
        "template_id", "seq", "style_name", F.col("format")["paraId"].alias("para_id"), T.strip(F.coalesce(F.col("text"), F.lit(""))).alias("text"),
        F.coalesce(size, f("effective.size")).alias("effective_size"), F.coalesce(font, f("effective.font.ascii")).alias("effective_font"),
        F.coalesce(F.col("format")["bold"] == "true", F.lit(False)).alias("bold"), level.alias("outline_level"), f("ind.firstLine").alias("ind_first_line"),
        f("spaceBefore").alias("space_before"), f("spaceAfter").alias("space_after"), f("align").alias("alignment"), f("lineSpacing").alias("line_spacing"),
        size.alias("explicit_size"), font.alias("explicit_font"), f("lineRule").alias("line_rule"),
    )


def template_outline(paras: DataFrame) -> DataFrame:
    """(template_id, index, text, style) of the headings in order."""
    w = Window.partitionBy("template_id").orderBy("seq")
    return paras.filter("is_heading").select("template_id", F.row_number().over(w).alias("index"), "text", "style")


def prose_cohort(paras: DataFrame) -> DataFrame:
    """Real body prose: from the first heading on (everything without headings), with text, no heading, not in a table or note."""
    first = F.min(F.when(F.col("is_heading"), F.col("seq"))).over(Window.partitionBy("template_id"))
    p = paras.withColumn("_first", first).filter("_first is null or seq >= _first").drop("_first")
    return p.filter("has_text and not is_heading and not in_table")


def _mode(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value): the most frequent non-empty value of each key, the first seen of equals."""
    n = rows.filter(F.coalesce(F.col(value), F.lit("")) != "").groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("at"))
    return n.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col("at"))).alias(value))


def body_style(paras: DataFrame) -> DataFrame:
    """(template_id, body_style): the cohort's most frequent style; no style counts as Normal."""
    p = prose_cohort(paras).withColumn("body_style", F.coalesce(F.nullif("style", F.lit("")), F.lit("Normal")))
    return _mode(p, ["template_id"], "body_style")


def body_format(paras: DataFrame) -> DataFrame:
    """(template_id, body_format map): the cohort's most frequent (font, size), and the most frequent align, spacing and rule among its rows."""
    p = prose_cohort(paras).filter(F.coalesce(F.col("eff_size"), F.lit("")) != "")
    pair = p.groupBy("template_id", "eff_font", "eff_size").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("at"))
    pair = pair.groupBy("template_id").agg(F.max_by(F.struct("eff_font", "eff_size"), F.struct("n", -F.col("at"))).alias("pair"))
    own = p.join(pair.hint("merge"), "template_id").filter(F.col("eff_font").eqNullSafe(F.col("pair.eff_font")) & (F.col("eff_size") == F.col("pair.eff_size")))
    out = pair
    for c in ("align", "line_spacing", "line_rule"):
        out = out.join(_mode(own, ["template_id"], c).hint("merge"), "template_id", "left")
    spaced = F.col("line_spacing").isNotNull()
    font = F.nullif(F.col("pair.eff_font"), F.lit(""))
    keys = {"size": F.col("pair.eff_size"), "font.ascii": font, "font.hAnsi": font, "align": F.col("align"), "lineSpacing": F.col("line_spacing"), "lineRule": F.when(spaced, F.col("line_rule"))}
    return out.select("template_id", _map(keys).alias("body_format"))


def _map(keys: dict[str, Column]) -> Column:
    pairs = [x for k, v in keys.items() for x in (F.lit(k), v)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def content_region(paras: DataFrame) -> DataFrame:
    """Paragraphs from the first heading to the last one that is a heading or has text."""
    w = Window.partitionBy("template_id")
    p = paras.withColumn("_lo", F.min(F.when(F.col("is_heading"), F.col("seq"))).over(w))
    p = p.withColumn("_hi", F.max(F.when(F.col("is_heading") | F.col("has_text"), F.col("seq"))).over(w))
    return p.filter("seq between _lo and _hi").drop("_lo", "_hi")


def section_context(prototypes: DataFrame, paras: DataFrame) -> DataFrame:
    """prototypes with section_context: CONTENT inside the content region, else FRONT."""
    ids = content_region(paras).filter(F.coalesce(F.col("para_id"), F.lit("")) != "").select(F.col("template_id").alias("_t"), F.col("para_id").alias("_p")).distinct()
    p = prototypes.drop("section_context").join(ids, (F.col("template_id") == F.col("_t")) & (F.col("para_id") == F.col("_p")), "left")
    return p.withColumn("section_context", F.when(F.col("_p").isNotNull(), "CONTENT").otherwise("FRONT")).drop("_t", "_p")


def _used() -> Column:
    return F.when(T.strip(F.coalesce(F.col("text"), F.lit(""))) != "", 0).otherwise(1)


def _sized() -> Column:
    return F.when(F.coalesce(F.col("explicit_size"), F.lit("")) != "", 0).otherwise(1)


def best_prototype(prototypes: DataFrame) -> DataFrame:
    """One prototype for each style: in the content region, with text, explicitly sized, first."""
    front = F.when(F.col("section_context") == "CONTENT", 0).otherwise(1)
    w = Window.partitionBy("template_id", "style_name").orderBy(front, _used(), _sized(), "seq")
    return prototypes.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def outline_para_ids(outline: DataFrame, prototypes: DataFrame) -> DataFrame:
    """outline with para_id: of the heading with the same text (the last of several), else of the first that begins alike.

    Titles are matched in the order of styles and paragraphs. Alike are a title that begins with the outline text, and an outline text that begins with the title's first 10 (or as many as the text has)
    characters; so the first min(10, length) characters of the shorter are equal, and the join is an equality on that many: titles give their prefixes of up to 10 characters, and texts their shorter ones.
    """
    heads = prototypes.filter(F.col("style_name").isin(HEADINGS) & (F.coalesce("para_id", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != ""))
    order = F.struct("style_name", "seq")
    titles = heads.groupBy(F.col("template_id").alias("_t"), T.strip(F.col("text")).alias("title")).agg(F.min(order).alias("place"), F.max_by("para_id", order).alias("pid"))
    o = outline.withColumn("_txt", T.strip(F.col("text")))
    o = o.join(titles.select("_t", "title", F.col("pid").alias("exact")), (F.col("template_id") == F.col("_t")) & (F.col("_txt") == F.col("title")), "left").drop("_t", "title")
    prefixes = lambda c, n: F.transform(F.sequence(F.lit(1), n), lambda k: F.substr(c, F.lit(1), k))
    ten = lambda c: F.least(F.length(c), F.lit(10))
    begun = titles.filter("title <> ''").withColumn("_key", F.explode(prefixes(F.col("title"), ten("title"))))
    short = titles.filter("title <> '' and length(title) < 10").withColumn("_key", F.col("title"))
    open_ = o.filter("exact is null and _txt <> ''").select("template_id", "index", "_txt")
    whole = open_.withColumn("_own", F.substr("_txt", F.lit(1), ten("_txt")))
    shorter = open_.filter(F.length("_txt") > 1).withColumn("_own", F.explode(prefixes(F.col("_txt"), ten("_txt") - 1)))
    meets = (F.col("template_id") == F.col("_t")) & (F.col("_own") == F.col("_key"))
    both = whole.join(begun, meets).select("_t", "index", "pid", "place").union(shorter.join(short, meets).select("_t", "index", "pid", "place"))
    loose = both.groupBy("_t", F.col("index").alias("_i")).agg(F.min_by("pid", "place").alias("near"))
    o = o.join(loose, (F.col("template_id") == F.col("_t")) & (F.col("index") == F.col("_i")), "left")
    return o.withColumn("para_id", F.coalesce("exact", "near")).drop("_txt", "exact", "_t", "_i", "near")


def heading_ids(prototypes: DataFrame) -> DataFrame:
    """(template_id, heading_ids): para ids of headings by style and order."""
    h = prototypes.filter(F.col("style_name").isin(HEADINGS) & (F.coalesce("para_id", F.lit("")) != ""))
    ids = F.array_sort(F.collect_list(F.struct("style_name", "seq", "para_id")))
    return h.groupBy("template_id").agg(F.transform(ids, lambda x: x["para_id"]).alias("heading_ids"))


def build_props() -> Column:
    """A prototype's properties, by the keys that set them."""
    size, font = _first(F.col("explicit_size"), F.col("effective_size")), _first(F.col("explicit_font"), F.col("effective_font"))
    indent = F.nullif("ind_first_line", F.lit(""))
    spacing = F.nullif("line_spacing", F.lit(""))
    return _map(
        {
            "style": F.nullif("style_name", F.lit("")), "size": size, "font.ascii": font, "font.hAnsi": font,
            "firstLineIndent": F.when(~indent.isin("0", "0pt", "0cm"), indent), "align": F.nullif("alignment", F.lit("")),
            "lineSpacing": spacing, "lineRule": F.when(spacing.isNotNull(), F.nullif("line_rule", F.lit(""))),
        }
    )


def candidates(prototypes: DataFrame) -> DataFrame:
    """Prototypes in the content region; all of a style that has none there."""
    inside = (F.col("section_context") == "CONTENT").cast("int")
    any_inside = F.max(inside).over(Window.partitionBy("template_id", "style_name"))
    return prototypes.withColumn("_any", any_inside).filter((F.col("_any") == 0) | (F.col("section_context") == "CONTENT")).drop("_any")


def match_heading_prototype(titles: DataFrame, prototypes: DataFrame) -> DataFrame:
    """(doc_id, node_id, props) for titles (doc_id, node_id, template_id, style_name, title) that a candidate's text matches.

    The same normalised text wins, else the longest common prefix of at least 10 characters and half the shorter text. That prefix makes the second join an equality on 10 characters.
    """
    c = candidates(prototypes).select(F.col("template_id").alias("_t"), F.col("style_name").alias("_s"), "seq", T.norm_title(F.col("text")).alias("cn"), build_props().alias("props"))
    t = titles.withColumn("n", T.norm_title(F.col("title"))).filter(F.length("n") >= 3)
    same = (F.col("template_id") == F.col("_t")) & (F.col("style_name") == F.col("_s"))
    exact = t.join(c, same & (F.col("n") == F.col("cn"))).withColumn("lcp", F.lit(1_000_000))
    ten = lambda x: F.substring(x, 1, 10)
    near = t.filter(F.length("n") >= 10).join(c, same & (ten("n") == ten("cn")) & (F.length("cn") >= 10)).withColumn("lcp", T.lcp_length(F.col("n"), F.col("cn")))
    near = near.filter((F.col("lcp") >= 10) & (F.col("lcp") >= 0.5 * F.least(F.length("n"), F.length("cn"))))
    both = exact.unionByName(near)
    return both.groupBy("doc_id", "node_id").agg(F.max_by("props", F.struct("lcp", -F.col("seq"))).alias("props"))


def representative_prototype(prototypes: DataFrame) -> DataFrame:
    """(template_id, style_name, props): among candidates with the most frequent alignment, one with text and explicit size, first."""
    c = candidates(prototypes).withColumn("_align", F.coalesce("alignment", F.lit("")))
    n = c.groupBy("template_id", "style_name", "_align").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("at"))
    n = n.groupBy("template_id", "style_name").agg(F.max_by("_align", F.struct("n", -F.col("at"))).alias("_modal"))
    own = c.join(n.hint("merge"), ["template_id", "style_name"]).filter("_align = _modal")
    return own.groupBy("template_id", "style_name").agg(F.min_by(build_props(), F.struct(_used(), _sized(), "seq")).alias("props"))


def props_for_style(best: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (template_id, style_name) with props: the best prototype's; Heading3 borrows from Heading2; else the style alone."""
    b = best.select(F.col("template_id").alias("_t"), F.col("style_name").alias("_s"), build_props().alias("_p"))
    two = b.filter("_s = 'Heading2'").select(F.col("_t").alias("_t2"), F.col("_p").alias("_p2"))
    w = wanted.join(b.hint("merge"), (F.col("template_id") == F.col("_t")) & (F.col("style_name") == F.col("_s")), "left")
    w = w.join(two.hint("merge"), F.col("template_id") == F.col("_t2"), "left")
    alone = F.when(F.coalesce("style_name", F.lit("")) == "", F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("style"), F.col("style_name")))
    borrowed = F.when(F.col("style_name") == "Heading3", with_style(F.col("_p2"), F.col("style_name")))
    return w.withColumn("props", F.coalesce("_p", borrowed, alone)).drop("_t", "_s", "_p", "_t2", "_p2")


def with_style(props: Column, style: Column) -> Column:
    return F.map_concat(F.map_filter(props, lambda k, _: k != "style"), F.create_map(F.lit("style"), style))


def heading_props(titles: DataFrame, prototypes: DataFrame) -> DataFrame:
    """titles with props: of the matching candidate, else the representative, else of the style; the style is the title's own."""
    m = match_heading_prototype(titles, prototypes).withColumnsRenamed({"doc_id": "_d", "node_id": "_n", "props": "_matched"}).hint("merge")
    r = representative_prototype(prototypes).select(F.col("template_id").alias("_t"), F.col("style_name").alias("_s"), F.col("props").alias("_common")).hint("merge")
    t = titles.join(m, (F.col("doc_id") == F.col("_d")) & (F.col("node_id") == F.col("_n")), "left")
    t = t.join(r, (F.col("template_id") == F.col("_t")) & (F.col("style_name") == F.col("_s")), "left").drop("_d", "_n", "_t", "_s")
    t = props_for_style(best_prototype(prototypes), t)
    return t.withColumn("props", F.coalesce(with_style(F.coalesce("_matched", "_common"), F.col("style_name")), "props")).drop("_matched", "_common")


def prototypes_by_style(prototypes: DataFrame) -> DataFrame:
    """(template_id, prototypes map<style, array<prototype>>) for the JSON sink."""
    rest = [c for c in prototypes.columns if c not in ("template_id", "style_name")]
    one = prototypes.groupBy("template_id", "style_name").agg(F.array_sort(F.collect_list(F.struct("seq", *[c for c in rest if c != "seq"]))).alias("p"))
    return one.groupBy("template_id").agg(F.map_from_entries(F.collect_list(F.struct("style_name", "p"))).alias("prototypes"))
