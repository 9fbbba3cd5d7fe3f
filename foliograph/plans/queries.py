"""Named queries over the test tables, each with its equivalent SQL where SQL can express it.

A query is a function (spark, sf_dir) -> DataFrame. Chains of stages keep the tables that several later stages read in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.functions import text as T
from foliograph.operators import checks, content, placement, plan, profiles, readback, roles, slots, template
from foliograph.plans import fixtures as X
from foliograph.plans import sql as S
from foliograph.sources import tables
from foliograph.sources.scratch import dropped, kept, once, shared_dir, spread, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ---- content ----------------------------------------------------------------------------------

_SECTIONS_SQL = S.sections()


def _heads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = X.md_corpus(spark, sf_dir)
    return content.document_lines(docs), content.section_tags(content.section_heads(content.document_headings(docs)))


@query("outline", f"WITH {_SECTIONS_SQL} SELECT doc_id, CAST(sec_no AS BIGINT) AS sec_no, CAST(level AS INT) AS level, tag, 'heading' || level AS type, CAST(line_no AS BIGINT) AS line_no FROM tagged")
def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of every document with tags and types."""
    return _heads(spark, sf_dir)[1].select("doc_id", F.col("sec_no").cast("long").alias("sec_no"), "level", "tag", "type", F.col("line_no").cast("long").alias("line_no"))


@query(
    "outline_tree",
    f"""WITH {_SECTIONS_SQL}, s AS (SELECT t.*, w.word_count FROM tagged t JOIN words w USING (doc_id, sec_no)),
e AS (SELECT *, (SELECT max(p.sec_no) FROM s p WHERE p.doc_id = s.doc_id AND p.sec_no < s.sec_no AND p.level < s.level) AS parent_no,
  coalesce((SELECT min(n.sec_no) FROM s n WHERE n.doc_id = s.doc_id AND n.sec_no > s.sec_no AND n.level <= s.level), 1000000000) AS subtree_end FROM s)
SELECT e.doc_id, e.tag AS node_id, p.tag AS parent_id, CAST(e.word_count AS BIGINT) AS word_count,
  CAST(coalesce((SELECT sum(c.word_count) FROM s c WHERE c.doc_id = e.doc_id AND c.sec_no > e.sec_no AND c.sec_no < e.subtree_end), 0) AS BIGINT) AS child_word_count
FROM e LEFT JOIN s p ON p.doc_id = e.doc_id AND p.sec_no = e.parent_no""",
)
def outline_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section tree with words of each section's lines and of its subtree."""
    numbered, heads = _heads(spark, sf_dir)
    words = numbered.groupBy("doc_id", "sec_no").agg(F.sum(F.when(F.col("is_heading"), 0).otherwise(T.word_count(F.col("line")))).alias("word_count"))
    tree = content.document_tree(heads.join(words, ["doc_id", "sec_no"]))
    return tree.select("doc_id", "node_id", "parent_id", F.col("word_count").cast("long").alias("word_count"), F.col("child_word_count").cast("long").alias("child_word_count"))


@query("content_blocks", S.content_blocks())
def content_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed blocks of every section, of the corpus with real fence bodies."""
    b = content.document_blocks(X.md_corpus(spark, sf_dir, "plain"))
    return b.select("doc_id", "sec_no", "block_no", "part_no", "kind", "text", "label", "lang", "formula", "ordered", "ncols", "header", "heading_like", F.size("runs").alias("n_runs"))


@query("section_stats", S.section_stats())
def section_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph counts, words, flags and first paragraphs of every section."""
    s = content.document_tree(content.sections(X.md_corpus(spark, sf_dir, "plain")))
    return s.select("doc_id", "sec_no", "tag", "title", "source_anchor", "parent_id", "depth", "paragraph_count", "word_count", "child_word_count", "first_paragraph", *content.FLAGS)


@query("doc_summary", f"WITH {_SECTIONS_SQL} SELECT d.doc_id, CAST(count(t.sec_no) AS BIGINT) AS section_count FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN tagged t USING (doc_id) GROUP BY d.doc_id")
def doc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.doc_summary(_documents(spark, sf_dir), _heads(spark, sf_dir)[1])


@query("published_sections", f"WITH {_SECTIONS_SQL} SELECT doc_id, CAST(count(*) AS BIGINT) AS n_sections, CAST(count(*) FILTER (level = 1) AS BIGINT) AS n_top, min(tag) AS first_tag FROM tagged GROUP BY 1")
def published_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections and documents, published as one version and read again: counts of each document with sections."""
    heads = _heads(spark, sf_dir)[1].select("doc_id", "sec_no", "level", "tag")
    path = f"{shared_dir(spark).rstrip('/')}/published-{uuid.uuid4().hex}"
    tables.publish_tables({"documents": _documents(spark, sf_dir).select("doc_id").distinct(), "sections": heads}, path)
    back = tables.read_published(spark, path)
    s = back["sections"].groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sections"), F.count_if(F.col("level") == 1).alias("n_top"), F.min("tag").alias("first_tag"))
    return back["documents"].join(s, "doc_id")


@query("tree_nodes", S.tree_nodes())
def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of every document's tree, depth first by sec_no."""
    nodes = content.tree_nodes(chain(spark, sf_dir).tree)
    return nodes.withColumns({"sec_no": F.col("sec_no").cast("long"), "word_count": F.col("word_count").cast("long"), "child_word_count": F.col("child_word_count").cast("long")})


@query(
    "line_text_functions",
    """WITH l AS (SELECT doc_id, line_no, line FROM documents, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) WITH ORDINALITY AS u(line, line_no) WHERE text <> '')
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(len(list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '')) AS INT) AS words,
 trim(regexp_replace(regexp_replace(translate(trim(lower(line)), 'àáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđ', 'aaaaaaaaaaaaaaaaaeeeeeeeeeeeiiiiiooooooooooooooooouuuuuuuuuuuyyyyyd'), '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), '-') AS slug,
 strip_accents(lower(line)) AS folded,
 trim(line) <> '' AND (regexp_matches(line, '[.…]{3,}|_{3,}|\\{\\{.*?\\}\\}|^\\s*\\[[^\\]]*\\]\\s*$|(?i:\\bx{3,}\\b)|(?i:lorem ipsum)|…')) AS placeholder
FROM l""",
)
def line_text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts, slugs, folded texts and placeholder marks of every line of the documents."""
    lines = content.corpus_lines(_documents(spark, sf_dir))
    c = F.col("line")
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), T.word_count(c).alias("words"), T.slugify(c).alias("slug"), T.fold_text(c).alias("folded"), T.is_placeholder(c).alias("placeholder"))


@query("inline_runs", S.inline_runs())
def inline_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styled runs of every line of the Markdown corpus."""
    lines = content.corpus_lines(X.md_corpus(spark, sf_dir))
    return lines.select("doc_id", "line_no", F.posexplode(T.tokenize_runs(F.col("line"))).alias("run_no", "run")).select("doc_id", "line_no", "run_no", "run.*")


# ---- templates --------------------------------------------------------------------------------

_TITLE_SQL = "CASE CAST((seq // 10) % 12 AS INT) " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(X.TITLES)) + " END"
_PARAS_SQL = f"""g AS (SELECT (p_partkey - 1) // {X.PER_TEMPLATE} AS template_id, * FROM part),
t AS (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY p_partkey) AS seq, count(*) OVER (PARTITION BY template_id) AS n FROM g),
k AS (SELECT *, CASE WHEN seq <= 3 OR seq > n - 4 THEN 9 ELSE seq % 10 END AS kind, {_TITLE_SQL} AS title FROM t),
q AS (SELECT template_id, seq, kind, lpad(upper(to_hex(p_partkey)), 8, '0') AS para_id,
   CASE WHEN kind = 0 AND template_id % 4 <> 3 THEN 'Heading1' WHEN kind = 1 AND template_id % 4 <> 3 THEN 'Heading2' WHEN p_size % 2 = 1 THEN 'Normal' END AS style,
   CASE WHEN kind IN (0, 1) AND template_id % 4 <> 3 THEN title WHEN kind = 2 THEN ['……', '{{{{name}}}}', '[fill in]', 'xxx'][CAST((seq // 10) % 4 + 1 AS INT)] WHEN kind = 4 THEN ''
        WHEN kind = 5 AND template_id % 4 = 3 AND seq BETWEEN 10 AND n - 10 THEN title ELSE p_name END AS text,
   kind = 3 AS in_table, CASE WHEN p_size % 3 = 0 THEN '13pt' WHEN p_size % 3 = 1 THEN '12pt' ELSE '11pt' END AS eff_size,
   CASE WHEN p_brand < 'Brand#3' THEN 'Times New Roman' ELSE 'Arial' END AS eff_font,
   CASE WHEN p_type LIKE '%STEEL%' THEN 'both' WHEN p_type LIKE '%COPPER%' THEN 'center' END AS align,
   CASE WHEN p_size % 3 = 0 THEN '1.5' END AS line_spacing, CASE WHEN p_size % 2 = 1 THEN '1cm' END AS ind_first_line FROM k),
paras AS (SELECT *, text <> '' AS has_text, coalesce(style IN ('Heading1', 'Heading2', 'Heading3'), false) AS is_heading FROM q),
cohort AS (SELECT * FROM (SELECT *, min(CASE WHEN is_heading THEN seq END) OVER (PARTITION BY template_id) AS first_heading FROM paras)
   WHERE (first_heading IS NULL OR seq >= first_heading) AND has_text AND NOT is_heading AND NOT in_table)"""


def _paras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.load_template_paras(X.template_raw(spark, sf_dir))


def _prototypes(spark: SparkSession, sf_dir: str, paras: DataFrame) -> DataFrame:
    return template.section_context(template.load_prototypes(X.template_raw(spark, sf_dir), template.body_style(paras)), paras)


@query("template_paras", f"WITH {_PARAS_SQL} SELECT template_id, CAST(seq AS BIGINT) AS seq, para_id, style, text, eff_size, eff_font, align, line_spacing, has_text, is_heading, in_table, CAST(length(text) AS INT) AS text_len FROM paras")
def template_paras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paras(spark, sf_dir).select("template_id", F.col("seq").cast("long").alias("seq"), "para_id", "style", "text", "eff_size", "eff_font", "align", "line_spacing", "has_text", "is_heading", "in_table", "text_len")


@query(
    "template_body",
    f"""WITH {_PARAS_SQL},
s AS (SELECT template_id, style AS body_style FROM (SELECT template_id, coalesce(style, 'Normal') AS style, row_number() OVER (PARTITION BY template_id ORDER BY count(*) DESC, min(seq)) AS r FROM cohort GROUP BY 1, 2) WHERE r = 1),
p AS (SELECT * FROM (SELECT template_id, eff_font, eff_size, row_number() OVER (PARTITION BY template_id ORDER BY count(*) DESC, min(seq)) AS r FROM cohort GROUP BY 1, 2, 3) WHERE r = 1),
m AS (SELECT c.* FROM cohort c JOIN p USING (template_id, eff_font, eff_size)),
a AS (SELECT * FROM (SELECT template_id, align, row_number() OVER (PARTITION BY template_id ORDER BY count(*) DESC, min(seq)) AS r FROM m WHERE align IS NOT NULL GROUP BY 1, 2) WHERE r = 1),
l AS (SELECT DISTINCT template_id, line_spacing FROM m WHERE line_spacing IS NOT NULL)
SELECT p.template_id, s.body_style, p.eff_size AS size, p.eff_font AS font, a.align, l.line_spacing, CASE WHEN l.line_spacing IS NOT NULL THEN 'auto' END AS line_rule
FROM p JOIN s USING (template_id) LEFT JOIN a USING (template_id) LEFT JOIN l USING (template_id)""",
)
def template_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body style and format of each template."""
    paras = _paras(spark, sf_dir)
    f = template.body_format(paras).join(template.body_style(paras), "template_id")
    value = lambda k: F.try_element_at("body_format", F.lit(k))
    return f.select("template_id", "body_style", value("size").alias("size"), value("font.ascii").alias("font"), value("align").alias("align"), value("lineSpacing").alias("line_spacing"), value("lineRule").alias("line_rule"))


@query(
    "template_best_prototypes",
    f"""WITH {_PARAS_SQL}, r AS (SELECT *, min(CASE WHEN is_heading THEN seq END) OVER (PARTITION BY template_id) AS lo, max(CASE WHEN is_heading OR has_text THEN seq END) OVER (PARTITION BY template_id) AS hi FROM paras),
c AS (SELECT template_id, seq, para_id, coalesce(style, 'Normal') AS style_name, has_text, coalesce(seq BETWEEN lo AND hi, false) AS inside, eff_size <> '11pt' AS sized FROM r)
SELECT template_id, style_name, para_id, CASE WHEN inside THEN 'CONTENT' ELSE 'FRONT' END AS section_context FROM
 (SELECT *, row_number() OVER (PARTITION BY template_id, style_name ORDER BY inside DESC, has_text DESC, sized DESC, seq) AS n FROM c) WHERE n = 1""",
)
def template_best_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = template.best_prototype(_prototypes(spark, sf_dir, _paras(spark, sf_dir)))
    return p.select("template_id", "style_name", "para_id", "section_context")


@query("template_outline_ids", S.template_outline_ids(_PARAS_SQL))
def template_outline_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    paras = _paras(spark, sf_dir)
    return template.outline_para_ids(template.template_outline(paras), _prototypes(spark, sf_dir, paras))


@query(
    "template_children",
    f"""WITH {_PARAS_SQL}, c AS (SELECT template_id, seq, CASE WHEN in_table THEN 'tbl' ELSE 'p' END AS kind, CASE WHEN NOT in_table THEN para_id END AS para_id,
  CASE WHEN in_table THEN CAST(seq // 10 + 1 AS INT) END AS tbl_index FROM paras)
SELECT template_id, CAST(row_number() OVER (PARTITION BY template_id ORDER BY seq) - 1 AS INT) AS pos, kind, para_id, tbl_index FROM c""",
)
def template_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct body children of each template."""
    return slots.body_children(_paras(spark, sf_dir)).select("template_id", "pos", "kind", "para_id", "tbl_index")


@query("template_heading_ids", S.heading_ids(_PARAS_SQL))
def template_heading_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headings' paragraph ids of each template, by style and order."""
    return template.heading_ids(_prototypes(spark, sf_dir, _paras(spark, sf_dir))).select("template_id", F.array_join("heading_ids", ",").alias("heading_ids"))


@query("template_prototypes", S.prototype_counts(_PARAS_SQL))
def template_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many prototypes each style of a template has, and the first one's paragraph id, from the grouped form."""
    grouped = template.prototypes_by_style(_prototypes(spark, sf_dir, _paras(spark, sf_dir)))
    p = grouped.select("template_id", F.explode("prototypes").alias("style_name", "p"))
    return p.select("template_id", "style_name", F.size("p").cast("long").alias("n"), F.get("p", F.lit(0))["para_id"].alias("first_para"))


@query("template_tables", S.template_tables(_PARAS_SQL))
def template_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.load_template_tables(X.template_tables_raw(spark, sf_dir))


# ---- roles and profiles -----------------------------------------------------------------------

_TERMS = [(i, role, term) for i, (role, _, terms, _, _) in enumerate(profiles.SIGNALS) for term in terms]
_TERMS_SQL = "terms AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{r}', '{t}')" for i, r, t in _TERMS) + ") AS v(rule_idx, role, term))"


@query(
    "keyword_roles",
    f"""WITH {_SECTIONS_SQL}, {_TERMS_SQL}, hit AS (SELECT doc_id, sec_no, min(rule_idx) AS rule_idx FROM tagged JOIN terms ON contains(upper(title), term) GROUP BY 1, 2)
SELECT t.doc_id, t.tag AS node_id, coalesce((SELECT any_value(role) FROM terms WHERE terms.rule_idx = h.rule_idx), 'generic') AS semantic_role,
  CASE WHEN h.rule_idx IS NULL THEN 0.3 ELSE 0.9 END::DOUBLE AS confidence, CASE WHEN h.rule_idx IS NULL THEN 'fallback' ELSE 'heading' END AS evidence FROM tagged t LEFT JOIN hit h USING (doc_id, sec_no)""",
)
def keyword_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of all headings by the paper profile's keyword rules."""
    resolved, _ = profiles.resolve_profiles(X.profiles(spark))
    nodes = _heads(spark, sf_dir)[1].select("doc_id", F.col("tag").alias("node_id"), "title", F.lit("paper").alias("profile_id"))
    return roles.keyword_classify(nodes, resolved).select("doc_id", "node_id", "semantic_role", F.col("confidence").cast("double").alias("confidence"), "evidence")


_ROLE_DOCS = [(i, r, f"{r.replace('_', ' ')} {d}") for i, (r, _, _, d) in enumerate(X.BASE_ROLES) if r != "generic"]


@query(
    "role_similarity",
    f"""WITH {_SECTIONS_SQL}, docs AS (SELECT 0 AS kind, role AS key, text FROM (VALUES {", ".join(f"({i}, '{r}', '{t}')" for i, r, t in _ROLE_DOCS)}) AS v(i, role, text) UNION ALL SELECT DISTINCT 1, title, title FROM tagged),
w AS (SELECT kind, key, ' ' || unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}_]+')) || ' ' AS word FROM docs),
g AS (SELECT kind, key, gram, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT kind, key, unnest(list_transform(range(1, length(word) - n + 2), lambda i: substr(word, i, n))) AS gram FROM w, (VALUES (3), (4), (5)) AS s(n) WHERE length(word) >= n) GROUP BY 1, 2, 3),
idf AS (SELECT gram, ln((SELECT count(DISTINCT key) FROM g WHERE kind = 0) + 1.0) - ln(count(DISTINCT key) + 1.0) + 1 AS idf FROM g WHERE kind = 0 GROUP BY gram),
v AS (SELECT g.*, coalesce(idf, 1.0) AS idf FROM g LEFT JOIN idf USING (gram)),
nrm AS (SELECT kind, key, sqrt(sum((tf * idf) ** 2)) AS norm FROM v GROUP BY 1, 2)
SELECT q.key AS query, r.key AS role, round(sum(q.tf * r.tf * r.idf ** 2) / (any_value(a.norm) * any_value(b.norm)), 6) AS similarity
FROM v q JOIN v r ON q.gram = r.gram AND q.kind = 1 AND r.kind = 0 JOIN nrm a ON a.kind = 1 AND a.key = q.key JOIN nrm b ON b.kind = 0 AND b.key = r.key GROUP BY 1, 2""",
)
def role_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of all distinct titles with the base profile's roles."""
    resolved, _ = profiles.resolve_profiles(X.profiles(spark))
    texts = _heads(spark, sf_dir)[1].select(F.lit("base").alias("profile_id"), F.col("title").alias("query")).distinct()
    return roles.role_cosine(texts, resolved.filter("id = 'base'")).select("query", "role", F.round("similarity", 6).alias("similarity"))


@query("content_signals", f"WITH {_SECTIONS_SQL}, {_TERMS_SQL}, b AS (SELECT doc_id, string_agg(upper(title), ' || ' ORDER BY sec_no) AS blob FROM tagged GROUP BY 1) SELECT DISTINCT doc_id, CAST(rule_idx AS INT) AS priority, role FROM b JOIN terms ON contains(blob, term)")
def content_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genre signals of every document."""
    return profiles.detect_signals(_heads(spark, sf_dir)[1])


@query("profile_errors", S.profile_errors())
def profile_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose profile can't be resolved: every twelfth is assigned a broken one."""
    _, errors = profiles.resolve_profiles(X.profiles(spark))
    docs = _documents(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 12 == 0, "orphan").when(F.col("doc_id") % 12 == 1, "a").otherwise("paper").alias("id"))
    return docs.join(F.broadcast(errors), "id")  # a row per broken profile


# ---- the whole chain --------------------------------------------------------------------------


@dataclass
class Chain:
    """Tables of the chain from content and templates to placement; those that several later stages read are written."""

    docs: DataFrame
    sections: DataFrame
    blocks: DataFrame
    paras: DataFrame
    prototypes: DataFrame
    profiles: DataFrame
    tree: DataFrame


@once
def chain(spark: SparkSession, sf_dir: str) -> Chain:
    md = written(X.md_corpus(spark, sf_dir), "md")
    blocks = kept(content.document_blocks(spread(md, "doc_id")), "blocks")  # files are read in tasks by bytes
    sections = kept(content.sections(md, block_rows=blocks), "sections")
    paras = kept(_paras(spark, sf_dir), "paras")
    assigned = kept(X.assignments(spark, sf_dir, md), "assigned")
    dropped(md)
    return Chain(assigned, sections, blocks, paras, kept(_prototypes(spark, sf_dir, paras), "prototypes"), profiles.resolve_profiles(X.profiles(spark))[0], content.document_tree(sections))


@once
def _routed(spark: SparkSession, sf_dir: str, lazy: bool = False) -> DataFrame:
    c = chain(spark, sf_dir)
    return written(roles.router_classify(roles.nodes_of(c.tree, c.docs), c.profiles, lazy), "routed")


@query("router_roles", S.router_roles())
def router_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles by keyword, similarity, and similarity with the first paragraph."""
    return _routed(spark, sf_dir, lazy=True).select("doc_id", "node_id", "semantic_role", "confidence", "evidence")


@query("role_review", S.role_review())
def role_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings (joined by ' | ') after answers for unsure nodes are merged, and the budget of each document."""
    c = chain(spark, sf_dir)
    merged, warnings = roles.merge_answers(_routed(spark, sf_dir), X.stage2_answers(spark, sf_dir), c.profiles)
    merged = written(merged, "merged")
    all_ = warnings.select("doc_id", "warning").union(roles.quality_gate(merged, c.profiles, c.docs))
    return roles.evidence_budget(merged).join(all_.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("warning")), " | ").alias("warnings")), "doc_id", "left")


@query("logical_placement", S.logical_placement())
def logical_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chain(spark, sf_dir)
    return placement.logical_nodes(_routed(spark, sf_dir), c.profiles)


@query("stage2_worklist", S.stage2_worklist())
def stage2_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes whose role is unsure, with what a reviewer needs."""
    c = chain(spark, sf_dir)
    work = roles.stage2_worklist(_routed(spark, sf_dir), c.tree, c.profiles)
    return work.select("doc_id", "node_id", "profile_id", "semantic_role", "confidence", "title", "level", "first_paragraph")


@query("logical_docs", S.logical_docs())
def logical_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placement totals of every document with the features that its profile degrades."""
    c = chain(spark, sf_dir)
    report = profiles.negotiate_capabilities(profiles.detect_features(c.sections, c.blocks), c.docs, c.profiles)
    d = placement.apply_capabilities(placement.logical_docs(placement.logical_nodes(_routed(spark, sf_dir), c.profiles)), report)
    degraded = F.coalesce(F.array_join(F.transform("capability_report", lambda r: r["feature"]), ","), F.lit(""))
    return d.select("doc_id", "profile_id", "strategy", "front_matter_strategy", "outline_shift", "emitted", "preserved", degraded.alias("degraded"))


@query("synthesized_profiles", S.synthesized_profiles(_PARAS_SQL))
def synthesized_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chain(spark, sf_dir)
    p = profiles.synthesize_profile(c.sections, c.blocks, c.docs, c.paras)
    return p.select("doc_id", "template_id", "id", "extends", "front_matter_strategy", F.to_json("keyword_rules").alias("keyword_rules"), F.array_join("role_vocabulary", ",").alias("role_vocabulary"), F.array_join(F.array_sort(F.map_keys("capabilities")), ",").alias("capabilities"))


@query("capability_report", S.capability_report())
def capability_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chain(spark, sf_dir)
    return profiles.negotiate_capabilities(profiles.detect_features(c.sections, c.blocks), c.docs, c.profiles)


@query("slot_classes", S.slot_classes(_PARAS_SQL))
def slot_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots and furniture of each document's template."""
    c = chain(spark, sf_dir)
    return slots.classify_elements(slots.body_children(c.paras), c.docs, slots.content_titles(c.sections)).select("doc_id", "template_id", "pos", "kind", "para_id", "tbl_index", "role", "trailing")


@once
def _classified(spark: SparkSession, sf_dir: str) -> tuple[Chain, DataFrame, DataFrame, DataFrame]:
    """The chain, logical nodes, templates' children, and the children of each document's template with the roles that its emitted titles give them."""
    c = chain(spark, sf_dir)
    logical = kept(placement.logical_nodes(_routed(spark, sf_dir), c.profiles), "logical")
    children = kept(slots.body_children(c.paras), "children")
    return c, logical, children, kept(slots.classify_elements(children, c.docs, slots.content_titles(c.sections, slots.emitted_nodes(logical))), "classified")


@once
def _planned(spark: SparkSession, sf_dir: str) -> tuple[Chain, DataFrame, DataFrame]:
    c, logical, _, classified = _classified(spark, sf_dir)
    return c, logical, kept(plan.plan(c.docs, logical, c.sections, c.blocks, c.paras, c.prototypes, classified=classified), "plan")


@query("rebuild_plan", S.rebuild_plan(_PARAS_SQL))
def rebuild_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All operations of every document, in order."""
    ops = _planned(spark, sf_dir)[2]
    return ops.select("doc_id", "op_seq", "command", "type", "parent", "path", "before", F.to_json(F.array_sort(F.map_entries("props"))).alias("props"))


@query("plan_operations", S.plan_operations(_PARAS_SQL))
def plan_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All operations of every document in order, with the text or formula and the style that they set."""
    prop = lambda k: F.try_element_at("props", F.lit(k))
    return _planned(spark, sf_dir)[2].select("doc_id", "op_seq", "command", "type", "parent", "path", "before", F.coalesce(prop("text"), prop("formula")).alias("text"), prop("style").alias("style"))


@query("plan_summary", S.plan_summary(_PARAS_SQL))
def plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.plan_summary(_planned(spark, sf_dir)[2])


def _failed(ops: DataFrame) -> DataFrame:
    return ops.filter("type = 'equation' and op_seq % 2 = 0").select("doc_id", "op_seq")


@once
def _built(spark: SparkSession, sf_dir: str):
    c, logical, ops = _planned(spark, sf_dir)
    ops = kept(plan.degrade_equations(ops, _failed(ops))[0], "ops")  # applying and checking read them ten times
    formats = c.paras.select("template_id", "para_id", "style", "align", "eff_size", "eff_font", "line_rule")
    children = slots.per_document(_classified(spark, sf_dir)[2].join(formats, ["template_id", "para_id"], "left"), c.docs)
    elements = plan.apply_plan(children, ops)
    return c, logical, ops, children, kept(elements, "elements")


def build_shared(spark: SparkSession, sf_dir: str) -> None:
    """Builds the tables that the chain's queries share, once for a session and folder."""
    _built(spark, sf_dir)


@query("applied_plan", S.applied_plan(_PARAS_SQL))
def applied_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of the built documents; every second equation is taken as failed."""
    return _built(spark, sf_dir)[-1]


@query("applied_elements", S.applied_elements(_PARAS_SQL))
def applied_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, origin, style, text and size of the built documents' elements."""
    return _built(spark, sf_dir)[-1].select("doc_id", "seq", "kind", "para_id", "style", "text", "tbl_index", "rows", "cols")


@query("apply_summary", S.apply_summary(_PARAS_SQL))
def apply_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many operations of each document were applied, failed, and were replaced by text."""
    ops = _planned(spark, sf_dir)[2]
    failed = _failed(ops)
    return plan.apply_summary(ops, failed, plan.degrade_equations(ops, failed)[1])


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, logical, ops, _, elements = _built(spark, sf_dir)
    return checks.run_checks(c.docs, ops, elements, c.paras, c.sections, logical, template.best_prototype(c.prototypes), template.body_format(c.paras), template.body_style(c.paras), _classified(spark, sf_dir)[3])


@query("check_errors", S.check_errors(_PARAS_SQL))
def check_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which structural checks each built document passes."""
    names = ["nonempty", "add_p_style", "runs_nonempty", "para_count", "S1", "S5", "S7", "S8", "S9"]
    return _checked(spark, sf_dir).filter(F.col("name").isin(names)).select("doc_id", "name", "passed")


@query("rule_checks", S.rule_checks(_PARAS_SQL))
def rule_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks over the built documents, details joined by ' | '."""
    return _checked(spark, sf_dir).withColumn("details", F.array_join("details", " | "))


@query("check_verdicts", S.check_verdicts(_PARAS_SQL))
def check_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.check_verdict(_checked(spark, sf_dir))


@query("readback_observations", S.readback_observations(_PARAS_SQL))
def readback_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the built documents differ from their sources."""
    c, *_, elements = _built(spark, sf_dir)
    return readback.observations(elements, written(readback.source_blob(c.sections, c.blocks), "blobs"))


@query("readback_counts", S.readback_counts(_PARAS_SQL))
def readback_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counted signals of the readback."""
    return readback_observations(spark, sf_dir).select("doc_id", "signal", "value")


@query("readback_view", S.readback_view(_PARAS_SQL))
def readback_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readback.render_view(_built(spark, sf_dir)[-1])


@query("content_json", S.content_json())
def content_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested content of every document, written as JSON and read again: what its sections and its tree hold."""
    c = chain(spark, sf_dir)
    ir = tables.content_ir(_documents(spark, sf_dir).select("doc_id"), c.sections, c.blocks, c.tree)
    inner = ir.select("doc_id", F.to_json(F.struct(*ir.columns)).alias("json"))
    back = inner.select("doc_id", F.from_json("json", ir.schema).alias("r")).select("doc_id", "r.source_file", "r.section_count", "r.sections", "r.document_tree")
    listed = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), "|"), F.lit(""))
    kinds = lambda s: F.concat_ws(":", s["tag"], F.array_join(F.transform(F.coalesce(s["body_blocks"], F.array()), lambda b: b["kind"]), ","))
    node = lambda n: F.concat_ws("<", n["node_id"], n["parent_id"])
    return back.select("doc_id", "source_file", "section_count", listed("sections", kinds).alias("kinds"), listed("document_tree", node).alias("tree"))
