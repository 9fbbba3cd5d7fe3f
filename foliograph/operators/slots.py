"""Slots and furniture: which parts of a template the content replaces. Keyed by (doc_id, template_id), as titles decide too."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions import text as T

_KEY = ["doc_id", "template_id"]


def emitted_nodes(logical: DataFrame) -> DataFrame:
    """Nodes that the plan emits: neither preserved nor removed."""
    return logical.filter(~F.col("intent").isin("preserve", "remove"))


def content_titles(sections: DataFrame, emitted: DataFrame | None = None) -> DataFrame:
    """(doc_id, title): normalised titles, of emitted sections only if emitted (doc_id, node_id) is given."""
    s = sections.filter(T.strip(F.coalesce("title", F.lit(""))) != "")
    if emitted is not None:
        e = emitted.select(F.col("doc_id").alias("_d"), F.col("node_id").alias("_n"))
        s = s.join(e, (F.col("doc_id") == F.col("_d")) & (F.col("tag") == F.col("_n")), "left_semi")
    return s.select("doc_id", T.norm_title(F.col("title")).alias("title")).distinct()


def aligned_paras(children: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, template_id, pos) of paragraphs whose text is a title, or shares the whole shorter text of at least 10 characters. titles: (doc_id, template_id, title)."""
    c = children.filter("kind = 'p'").withColumn("n", T.norm_title(F.col("text"))).filter(F.length("n") >= 3)
    t = titles.filter("title <> ''").withColumnRenamed("template_id", "_t")
    c = c.hint("merge")
    exact = t.join(c, (F.col("template_id") == F.col("_t")) & (F.col("n") == F.col("title")))
    ten = lambda x: F.substring(x, 1, 10)
    shorter = F.col("n").startswith(F.col("title")) | F.col("title").startswith(F.col("n"))
    near = t.filter(F.length("title") >= 10).join(c.filter(F.length("n") >= 10), (F.col("template_id") == F.col("_t")) & (ten("n") == ten("title")) & shorter)
    return exact.select(*_KEY, "pos").union(near.select(*_KEY, "pos")).distinct()


def body_children(paras: DataFrame) -> DataFrame:
    """(template_id, pos, kind, para_id, text, has_text, is_heading, tbl_index): direct children; a table stands where its first cell paragraph does, notes are gone."""
    index = F.regexp_extract("path", r"^/body/tbl\[(\d+)\]", 1)
    p = paras.withColumn("tbl_index", F.when(index != "", index.cast("int")))
    tables = p.filter("tbl_index is not null").groupBy("template_id", "tbl_index").agg(F.min("seq").alias("seq"))
    tables = tables.withColumn("kind", F.lit("tbl"))
    own = p.filter("tbl_index is null and not in_table").select("template_id", "seq", F.lit("p").alias("kind"), "para_id", "text", "has_text", "is_heading")
    both = own.unionByName(tables, allowMissingColumns=True)
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("template_id").orderBy("seq")) - 1).drop("seq")


def per_document(children: DataFrame, docs: DataFrame) -> DataFrame:
    """children for each document (doc_id, template_id, front_matter_strategy) that uses the template."""
    return docs.select("doc_id", "template_id", "front_matter_strategy").join(children.hint("merge"), "template_id")


def anchors(children: DataFrame) -> DataFrame:
    """(template_id, lo, hi, last, headed): first and last heading or placeholder, last child, and whether there is a heading. Once for each template."""
    p = F.col("kind") == "p"
    heading = p & F.coalesce("is_heading", F.lit(False))
    at = F.when(heading | (p & F.coalesce(T.is_placeholder(F.col("text")), F.lit(False))), F.col("pos"))
    return children.groupBy("template_id").agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.max("pos").alias("last"), F.bool_or(heading).alias("headed"))


def slot_span(children: DataFrame, docs: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, template_id, lo, hi) of documents whose template has an anchor; the strategy 'replace' widens it to all children.

    Only in a template without headings do a document's titles count: paragraphs that align with one are anchors too. No row of a child is made for a document here.
    """
    a = anchors(children).withColumnRenamed("template_id", "_t").hint("merge")  # it grows with the templates: none of these joins goes through the driver
    d = docs.select("doc_id", "template_id", "front_matter_strategy").join(a, F.col("template_id") == F.col("_t")).drop("_t")
    plain = children.join(a.filter("not headed").select("_t"), F.col("template_id") == F.col("_t"), "left_semi")
    own = d.filter("not headed").select("doc_id", "template_id").join(titles.withColumnRenamed("doc_id", "_d").hint("merge"), F.col("doc_id") == F.col("_d")).drop("_d")
    found = aligned_paras(plain, own).groupBy(F.col("doc_id").alias("_d")).agg(F.min("pos").alias("_lo"), F.max("pos").alias("_hi")).hint("merge")
    d = d.join(found, F.col("doc_id") == F.col("_d"), "left").withColumns({"lo": F.least("lo", "_lo"), "hi": F.greatest("hi", "_hi")}).filter("lo is not null")
    whole = F.col("front_matter_strategy") == "replace"
    return d.select(*_KEY, F.when(whole, 0).otherwise(F.col("lo")).alias("lo"), F.when(whole, F.col("last")).otherwise(F.col("hi")).alias("hi"))


def classify_elements(children: DataFrame, docs: DataFrame, titles: DataFrame) -> DataFrame:
    """The children of each document's template with role (slot, slot_table, furniture, furniture_table) and trailing; without a span all is furniture."""
    span = slot_span(children, docs, titles).withColumnsRenamed({"doc_id": "_d", "template_id": "_t"}).hint("merge")
    spans = docs.select("doc_id", "template_id", "front_matter_strategy").join(span, (F.col("doc_id") == F.col("_d")) & (F.col("template_id") == F.col("_t")), "left").drop("_d", "_t")
    c = spans.join(children.hint("merge"), "template_id")
    inside = F.coalesce(F.col("pos").between(F.col("lo"), F.col("hi")), F.lit(False))
    table = F.col("kind") == "tbl"
    role = F.when(inside, F.when(table, "slot_table").otherwise("slot")).otherwise(F.when(table, "furniture_table").otherwise("furniture"))
    named = table | (F.coalesce("para_id", F.lit("")) != "")
    return c.withColumn("role", role).withColumn("trailing", F.coalesce(F.col("pos") > F.col("hi"), F.lit(False)) & named)


def trailing_order(classified: DataFrame) -> DataFrame:
    """Trailing elements with their order and the number of kept tables before them."""
    w = Window.partitionBy(*_KEY)
    kept = F.sum(((F.col("role") == "furniture_table") & ~F.col("trailing")).cast("int")).over(w)
    c = classified.withColumn("kept_tables_before_trailing", kept).filter("trailing")
    return c.withColumn("order", F.row_number().over(w.orderBy("pos")))


def furniture_ids(classified: DataFrame) -> DataFrame:
    """(doc_id, template_id, para_id) of paragraphs that must survive."""
    return classified.filter((F.col("role") == "furniture") & (F.coalesce("para_id", F.lit("")) != "")).select(*_KEY, "para_id").distinct()
