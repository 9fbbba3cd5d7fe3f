"""Tables that the queries derive from the test tables: a Markdown corpus, templates, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.sources.scratch import spread

TITLES = ["Introduction", "Related Work", "Method", "Results", "Discussion", "Conclusion", "References", "Appendix A", "Abstract", "Ethics Statement", "Overview of Tools", "Funding"]


def _title(key: str) -> str:
    return f"CASE CAST({key} % 12 AS INT) " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TITLES)) + " END"


def _chunk(fence: str) -> str:
    """The chunk of Markdown that line n of a document becomes, in SQL that both engines know."""
    k = "((doc_id * 5 + n) % 12)"
    t = _title("(doc_id + n)")
    return f"""CASE WHEN n = 1 THEN '# ' || {t}
 WHEN {k} IN (0, 6) THEN repeat('#', CAST(1 + (doc_id * 7 + n) % 3 AS INT)) || ' ' || {t}
 WHEN {k} = 1 THEN '- ' || line
 WHEN {k} = 2 THEN '1. ' || line || chr(10) || '2) ' || substr(line, 1, 20)
 WHEN {k} = 3 THEN '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| ' || CAST(n AS STRING) || ' | ' || replace(substr(line, 1, 12), '|', '') || ' |'
 WHEN {k} = 4 THEN '```sql' || chr(10) || {fence} || chr(10) || '```'
 WHEN {k} = 5 THEN '$$ x_{{' || CAST(n AS STRING) || '}} ' || chr(92) || 'tag{{1}} $$'
 WHEN {k} = 7 THEN '**Note** ' || line
 WHEN {k} = 8 THEN '---'
 WHEN {k} = 9 THEN '**bold** and _it_ combined_loss ' || line
 WHEN {k} = 10 THEN line || chr(10)
 ELSE '> ' || line END"""


#: Fence bodies: the first starts like a heading (which it then is), the second doesn't.
FENCES = {"heading": "'# ' || substr(line, 1, 30)", "plain": "'x = ' || substr(line, 1, 30)"}


def md_corpus(spark: SparkSession, sf_dir: str, fence: str = "heading") -> DataFrame:
    """(doc_id, text): every document's lines as Markdown."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    chunks = docs.selectExpr("doc_id", "CAST(pos + 1 AS BIGINT) AS n", "line").selectExpr("doc_id", "n", f"{_chunk(FENCES[fence])} AS chunk")
    rows = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "chunk"))).alias("c"))
    return rows.select("doc_id", F.array_join(F.transform("c", lambda x: x["chunk"]), "\n").alias("text"))


def md_corpus_sql(fence: str = "heading") -> str:
    return f"""md_corpus AS (SELECT doc_id, string_agg(chunk, chr(10) ORDER BY n) AS text FROM (
 SELECT doc_id, n, {_chunk(FENCES[fence])} AS chunk FROM (SELECT doc_id, n, line FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, n))) GROUP BY doc_id)"""


#: Paragraphs of a template: more rows of part are more templates, not longer ones.
PER_TEMPLATE = 40


def template_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph records (RAW_SCHEMA of the template operators) of templates of PER_TEMPLATE rows of part. Every fourth has no headings; the last four paragraphs of each are trailing prose."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return spark.sql(
        f"""
WITH g AS (SELECT (p_partkey - 1) div {PER_TEMPLATE} AS template_id, * FROM {{part}}),
t AS (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY p_partkey) AS seq, count(*) OVER (PARTITION BY template_id) AS n FROM g),
k AS (SELECT *, CASE WHEN seq <= 3 OR seq > n - 4 THEN 9 ELSE seq % 10 END AS kind, {_title("seq div 10")} AS title FROM t)
SELECT template_id, seq,
  CASE WHEN kind IN (0, 1) AND template_id % 4 <> 3 THEN title WHEN kind = 2 THEN element_at(array('……', '{{{{{{{{name}}}}}}}}', '[fill in]', 'xxx'), CAST(seq div 10 % 4 + 1 AS INT)) WHEN kind = 4 THEN ''
       WHEN kind = 5 AND template_id % 4 = 3 AND seq BETWEEN 10 AND n - 10 THEN title ELSE p_name END AS text,
  CASE WHEN kind = 3 THEN concat('/body/tbl[', seq div 10 + 1, ']/tr[1]/tc[1]/p[1]') ELSE concat('/body/p[', seq, ']') END AS path,
  map_filter(map('paraId', lpad(upper(hex(p_partkey)), 8, '0'),
      'style', CASE WHEN kind = 0 AND template_id % 4 <> 3 THEN 'heading 1' WHEN kind = 1 AND template_id % 4 <> 3 THEN 'heading 2' WHEN p_size % 2 = 1 THEN 'Normal' END,
      'markRPr.size', CASE WHEN p_size % 3 = 0 THEN '13pt' WHEN p_size % 3 = 1 THEN '12pt' END, 'effective.size', '11pt',
      'effective.font.ascii', CASE WHEN p_brand < 'Brand#3' THEN 'Times New Roman' ELSE 'Arial' END,
      'align', CASE WHEN p_type LIKE '%STEEL%' THEN 'both' WHEN p_type LIKE '%COPPER%' THEN 'center' END,
      'lineSpacing', CASE WHEN p_size % 3 = 0 THEN '1.5' END, 'lineRule', CASE WHEN p_size % 3 = 0 THEN 'auto' END,
      'ind.firstLine', CASE WHEN p_size % 2 = 1 THEN '1cm' END), (k, v) -> v IS NOT NULL) AS format
FROM k""",
        part=p,
    )


def template_tables_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(template_id, path, rows) of the templates' tables, with one nested table that isn't the body's own."""
    raw = template_raw(spark, sf_dir).filter("path like '/body/tbl%'")
    own = raw.select("template_id", F.regexp_extract("path", r"^(/body/tbl\[\d+\])", 1).alias("path"), F.lit(1).alias("rows")).distinct()
    return own.union(own.select("template_id", F.concat(F.lit("/footnotes"), "path"), "rows"))


# The base profile's placements (role, section, toc) and descriptions.
BASE_ROLES = [
    ("abstract", "Abstract", False, "Tóm tắt / structured abstract."),
    ("literature_review", "RelatedWork", True, "Tổng quan, cơ sở lý thuyết, related work, nghiên cứu trước."),
    ("methodology", "Methods", True, "Phương pháp, cách tiếp cận, thiết kế, mô hình, training."),
    ("results", "Results", True, "Kết quả, thực nghiệm, số liệu, đánh giá."),
    ("discussion", "Discussion", True, "Bàn luận, phân tích, diễn giải kết quả."),
    ("conclusion", "Conclusion", True, "Kết luận và kiến nghị / future work."),
    ("references", "References", False, "Tài liệu tham khảo / bibliography."),
    ("appendix", "Appendix", False, "Phụ lục / supplementary."),
    ("generic", "Body", True, "Nội dung thường, không thuộc vai trò đặc thù nào."),
]


def profiles(spark: SparkSession) -> DataFrame:
    """A base, a paper overlay with the signal rules, a report overlay over it, a cyclic pair and an orphan."""
    from foliograph.operators import profiles as P

    place = lambda section, toc, intent="replace": (section, intent, toc, "FROM_LEVEL", "FROM_LEVEL")
    rules = [(r, None, terms) for r, _, terms, _, _ in P.SIGNALS]
    new = [(r, s, t) for r, base, _, s, t in P.SIGNALS if not base]
    none = dict.fromkeys(x.split(" ")[0] for x in ("description", "strategy", "default_role", "front_matter_strategy", "role_vocabulary", "role_descriptions", "keyword_rules", "keyword_rules_extra", "front_matter_roles", "role_to_logical", "role_overrides", "capabilities"))
    rows = [
        {"id": "base", "extends": None, **none, "strategy": "clone", "default_role": "generic", "front_matter_strategy": "preserve", "role_vocabulary": [r for r, *_ in BASE_ROLES], "role_descriptions": {r: d for r, _, _, d in BASE_ROLES}, "keyword_rules": [], "front_matter_roles": [], "role_to_logical": {r: place(s, t) for r, s, t, _ in BASE_ROLES}},
        {"id": "paper", "extends": "base", **none, "keyword_rules": rules, "role_vocabulary": [r for r, _, _ in new], "role_descriptions": P.NEW_ROLE_DESCRIPTIONS, "role_to_logical": {r: place(s, t) for r, s, t in new}},
        {"id": "report", "extends": "paper", **none, "front_matter_strategy": "replace", "front_matter_roles": ["abstract"], "keyword_rules_extra": [("discussion", ["OVERVIEW"], None)], "role_overrides": {"abstract": place("Abstract", False, "preserve")}, "capabilities": {"toc": False, "equation": False, "table": True}},
        {"id": "a", "extends": "b", **none}, {"id": "b", "extends": "a", **none}, {"id": "orphan", "extends": "nowhere", **none},
    ]
    return spark.createDataFrame([tuple(r[c] for c in ("id", "extends", *none)) for r in rows], P.SCHEMA)


def assignments(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """docs with template_id and profile_id: every third document is a report. The number of templates is one row."""
    report = F.col("doc_id") % 3 == 1
    n = spark.read.parquet(f"{sf_dir}/part.parquet").agg((F.max(F.expr(f"(p_partkey - 1) div {PER_TEMPLATE}")) + 1).alias("templates"))
    return docs.crossJoin(F.broadcast(n)).select("doc_id", F.expr("doc_id % templates").alias("template_id"), F.when(report, "report").otherwise("paper").alias("profile_id"), F.when(report, "replace").otherwise("preserve").alias("front_matter_strategy"))


def stage2_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers for each labelled document's first section; some name a role that no profile has."""
    l = spark.read.parquet(f"{sf_dir}/labels.parquet")
    role = F.when(F.col("quality") == 1, "results").when(F.col("toxic") == 1, "discussion").otherwise("not_a_role")
    return l.select("doc_id", F.lit("h1_1").alias("node_id"), role.alias("semantic_role"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("evidence"))
