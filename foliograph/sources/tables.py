"""Sources and sinks: JSON tables with fixed schemas, quarantined bad records, nested content files, plain tables."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BAD = "_corrupt_record"


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, source_file, text) of a folder of Markdown files, one row each; doc_id is a hash of the path."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    return files.select(F.xxhash64("file").alias("doc_id"), F.regexp_extract("file", r"([^/]+)$", 1).alias("source_file"), "text")


def read_ir(spark: SparkSession, path: str, schema: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines, and the lines that don't fit the schema; if strict, such a line fails the job."""
    if strict:
        rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
        return rows, rows.limit(0).select(F.lit("").alias(BAD))
    # The bad lines are parsed from text, as a file scan may not select the corrupt column alone.
    text = spark.read.text(path)
    parsed = text.select("value", F.from_json("value", f"{schema}, {BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("r"))
    bad = F.col("r").isNull() | F.col(f"r.{BAD}").isNotNull()
    return parsed.filter(~bad).select("r.*").drop(BAD), parsed.filter(bad).select(F.col("value").alias(BAD))


_BLOCK = ["kind", "text", "label", "lang", "lines", "formula", "mode", "ordered", "items", "ncols", "header", "rows", "heading_like", "runs"]
_NODE = ["node_id", "parent_id", "depth", "title", "level", "word_count", "child_word_count", "first_paragraph"]


def content_ir(docs: DataFrame, sections: DataFrame, block_rows: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """(doc_id, source_file, generated_at, section_count, sections array<struct>, document_tree array<struct>): the nested form, a row per document.

    A section's body_blocks are structs. document_tree lists the nodes in document order, which is depth first; without tree it is null. generated_at is the day of the run.
    """
    order = ["block_no", "part_no"]
    b = block_rows.groupBy("doc_id", "sec_no").agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(*[c for c in _BLOCK if c in block_rows.columns]).alias("block")))).alias("body_blocks"))
    s = sections.join(b, ["doc_id", "sec_no"], "left")
    keep = ["sec_no", "tag", "type", "title", "level", "body_paragraphs", "paragraph_count", "verbatim", "source_anchor", "has_image", "has_math", "has_bold", "has_italic"]
    s = s.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*keep, F.transform("body_blocks", lambda x: x["block"]).alias("body_blocks")))).alias("sections"))
    named = F.col("source_file") if "source_file" in docs.columns else F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    d = docs.select("doc_id", named.alias("source_file")).join(s, "doc_id", "left")
    nodes = F.lit(None)
    if tree is not None:
        t = tree.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sec_no", *_NODE))).alias("nodes"))
        d, nodes = d.join(t, "doc_id", "left"), F.transform("nodes", lambda n: F.struct(*[n[c].alias(c) for c in _NODE]))
    return d.select("doc_id", "source_file", F.current_date().cast("string").alias("generated_at"), F.coalesce(F.size("sections"), F.lit(0)).alias("section_count"), "sections", nodes.alias("document_tree"))


def write_content_ir(docs: DataFrame, sections: DataFrame, block_rows: DataFrame, path: str, tree: DataFrame | None = None) -> None:
    """One JSON object per document."""
    content_ir(docs, sections, block_rows, tree).write.mode("overwrite").json(path)


def write_tables(tables: dict[str, DataFrame], path: str, format: str = "parquet") -> None:
    """Each table to a folder of its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(format).save(f"{path.rstrip('/')}/{name}")


_MANIFEST = "version string, published_at bigint, name string, format string, schema string"


def publish_tables(tables: dict[str, DataFrame], path: str, format: str = "parquet") -> str:
    """All tables of a run as one version, whose name is returned: each goes to a folder of the version, and one file then names them all, so readers see every table of a run or none.

    A run that ends before that file leaves the newest version as it was; runs at the same time don't touch each other's folders, and the one that ends later is the newest.
    """
    if not tables:
        raise ValueError("there is no table to publish")
    root, version = path.rstrip("/"), uuid.uuid4().hex
    for name, df in tables.items():
        df.write.format(format).save(f"{root}/data/{version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    rows = [(version, time.time_ns(), name, format, df.schema.json()) for name, df in tables.items()]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").json(f"{root}/versions")
    return version


def published_versions(spark: SparkSession, path: str) -> DataFrame:
    """(version, published_at, name, format, schema): a row for each table of every whole version. A path where nothing was published is an error."""
    return spark.read.schema(_MANIFEST).json(f"{path.rstrip('/')}/versions")


def read_published(spark: SparkSession, path: str, version: str | None = None) -> dict[str, DataFrame]:
    """The tables of a version, or of the newest whole one; an unknown version is an error."""
    m = published_versions(spark, path)
    if version is None:
        version = m.agg(F.max(F.struct("published_at", "version")).alias("v")).first()["v"]["version"]
    found = m.filter(F.col("version") == version).collect()  # a row for each table of one run
    if not found:
        raise ValueError(f"no version {version} at {path}")
    return {r["name"]: spark.read.format(r["format"]).schema(StructType.fromJson(json.loads(r["schema"]))).load(f"{path.rstrip('/')}/data/{version}/{r['name']}") for r in found}
