"""Logical placement: roles to sections, intents and presentation tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the confidence that a preserved front-matter role needs.
PRESERVE = 0.85


def role_placement(nodes: DataFrame, profiles: DataFrame) -> DataFrame:
    """nodes with role and placement entry: the role's, else the default role's, else empty (intent replace)."""
    p = profiles.select(F.col("id").alias("profile_id"), "default_role", "front_matter_roles", "role_to_logical", "capabilities", "strategy", "front_matter_strategy")
    n = nodes.join(p, "profile_id").withColumn("role", F.coalesce("semantic_role", "default_role"))
    entry = F.coalesce(F.try_element_at("role_to_logical", F.col("role")), F.try_element_at("role_to_logical", F.col("default_role")))
    n = n.withColumn("entry", entry)
    return n.withColumn("intent", F.coalesce("entry.intent", F.lit("replace")))


def confidence_gate(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """placed with unsure preserved front matter demoted to the default role, and the demotions (doc_id, node_id, role, confidence)."""
    front = F.coalesce(F.array_contains("front_matter_roles", F.col("role")), F.lit(False))
    n = placed.withColumn("_low", (F.col("intent") == "preserve") & front & F.coalesce(F.col("confidence") < PRESERVE, F.lit(False)))
    demoted = n.filter("_low").select("doc_id", "node_id", "role", "confidence")
    default = F.try_element_at("role_to_logical", F.col("default_role"))
    n = n.withColumns({"entry": F.when(F.col("_low"), default).otherwise(F.col("entry")), "role": F.when(F.col("_low"), F.col("default_role")).otherwise(F.col("role"))})
    return n.withColumn("intent", F.when(F.col("_low"), F.coalesce("entry.intent", F.lit("replace"))).otherwise(F.col("intent"))).drop("_low"), demoted


def outline_shift(placed: DataFrame) -> DataFrame:
    """placed with outline_shift: the lowest level of the document's emitted nodes that the content knows, less one."""
    emitted = ~F.col("intent").isin("preserve", "remove") & F.col("level").isNotNull()
    low = F.min(F.when(emitted, F.col("level"))).over(Window.partitionBy("doc_id"))
    return placed.withColumn("outline_shift", F.coalesce(low - 1, F.lit(0)))


def presentation_tier(tier: Column) -> Column:
    return F.when(tier <= 1, "major_section").when(tier == 2, "minor_section").otherwise("sub_section")


def logical_nodes(nodes: DataFrame, profiles: DataFrame) -> DataFrame:
    """Logical nodes of classified nodes (doc_id, sec_no, node_id, profile_id, level, semantic_role, confidence)."""
    n = outline_shift(confidence_gate(role_placement(nodes, profiles))[0])
    tier = F.coalesce("level", F.lit(1)) - F.col("outline_shift")
    from_level = lambda c: F.coalesce(c, F.lit("FROM_LEVEL")) == "FROM_LEVEL"
    toc = F.coalesce("entry.toc", F.lit(True)) & ~F.coalesce(F.try_element_at("capabilities", F.lit("toc")) == F.lit(False), F.lit(False))
    return n.select(
        "doc_id", "sec_no", "node_id", "profile_id", "intent",
        F.when(from_level(F.col("entry.presentation")), presentation_tier(tier)).otherwise(F.col("entry.presentation")).alias("presentation"),
        F.coalesce("entry.section", F.lit("Body")).alias("logical_section"),
        F.when(from_level(F.col("entry.outline_level")), F.greatest(F.lit(1), tier)).otherwise(F.expr("try_cast(entry.outline_level AS INT)")).cast("int").alias("outline_level"),
        toc.alias("toc"), F.concat(F.lit("role:"), "role").alias("resolved_by"), "confidence", F.coalesce("strategy", F.lit("clone")).alias("strategy"),
        F.coalesce("front_matter_strategy", F.lit("preserve")).alias("front_matter_strategy"), "outline_shift",
    )


def logical_docs(logical: DataFrame) -> DataFrame:
    """(doc_id, profile_id, strategy, front_matter_strategy, outline_shift, emitted, preserved)."""
    out = F.col("intent").isin("preserve", "remove")
    return logical.groupBy("doc_id", "profile_id", "strategy", "front_matter_strategy", "outline_shift").agg(F.count_if(~out).alias("emitted"), F.count_if(F.col("intent") == "preserve").alias("preserved"))


def apply_capabilities(docs: DataFrame, report: DataFrame) -> DataFrame:
    """logical_docs with capability_report, the degraded features of each document in order."""
    r = report.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("feature", "capability", "status", "note"))).alias("capability_report"))
    return docs.join(r, "doc_id", "left")


def intent_defaults(rows: DataFrame) -> DataFrame:
    """Nodes of the older intent table with defaults where columns are missing or null."""
    for name, value in (("intent", "insert"), ("presentation", "body_text"), ("target_context", None)):
        given = F.col(name) if name in rows.columns else F.lit(None).cast("string")
        rows = rows.withColumn(name, F.coalesce(given, F.lit(value)) if value else given)
    return rows
