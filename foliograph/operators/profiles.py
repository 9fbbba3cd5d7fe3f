"""Profiles as rows: layering, contract checks, synthesis from content, capability negotiation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions import text as T
from foliograph.operators import registry
from foliograph.sources.scratch import small, written

_RULE = "struct<role:string,keywords:array<string>,any:array<string>>"
_PLACE = "struct<section:string,intent:string,toc:boolean,presentation:string,outline_level:string>"
SCHEMA = (
    "id string, extends string, description string, strategy string, default_role string, front_matter_strategy string, role_vocabulary array<string>, role_descriptions map<string,string>, "
    f"keyword_rules array<{_RULE}>, keyword_rules_extra array<{_RULE}>, front_matter_roles array<string>, role_to_logical map<string,{_PLACE}>, role_overrides map<string,{_PLACE}>, capabilities map<string,boolean>"
)

# Signals in priority order (role, part of the base, terms, section, toc), descriptions, features and notes.
SIGNALS = [
    ("competing_interests", False, ["COMPETING INTEREST", "CONFLICT OF INTEREST", "DECLARATION"], "BackMatter", False),
    ("ethics", False, ["ETHICS", "ETHICAL", "CONSENT", "IRB"], "BackMatter", False),
    ("acknowledgments", False, ["ACKNOWLEDG", "FUNDING"], "BackMatter", False),
    ("references", True, ["REFERENCES", "BIBLIOGRAPHY", "WORKS CITED"], None, None),
    ("appendix", True, ["APPENDIX", "SUPPLEMENT", "ANNEX"], None, None),
    ("abstract", True, ["ABSTRACT", "TÓM TẮT", "SUMMARY"], None, None),
    ("introduction", False, ["INTRODUCTION", "GIỚI THIỆU", "MỞ ĐẦU"], "Introduction", True),
    ("literature_review", True, ["RELATED WORK", "BACKGROUND", "LITERATURE", "TỔNG QUAN", "ARCHITECTURE", "ENCODER", "MECHANISM", "TRANSFORMER", "ATTENTION"], None, None),
    ("methodology", True, ["METHOD", "PHƯƠNG PHÁP", "TRAINING", "AUGMENTATION", "STRATEGIES", "LEARNING", "LOSS", "MODEL"], None, None),
    ("results", True, ["RESULT", "EXPERIMENT", "EVALUATION", "KẾT QUẢ", "DATASET", "METRIC"], None, None),
    ("discussion", True, ["DISCUSSION", "BÀN LUẬN", "ANALYSIS"], None, None),
    ("conclusion", True, ["CONCLUSION", "FUTURE", "KẾT LUẬN"], None, None),
]
NEW_ROLE_DESCRIPTIONS = {
    "competing_interests": "Competing / conflict of interest statement.",
    "ethics": "Ethics approval / consent statement.",
    "acknowledgments": "Funding and acknowledgments.",
    "introduction": "Problem statement, motivation, contributions.",
}
FRONT_MARK = r"(?iu)(abstract|keywords?|tóm tắt|từ kho)"
EMAIL = r"(?U)[\w.+-]+@[\w-]+\.[\w.-]+"
FEATURES = {
    "table": ("table", "tables render as plain paragraphs"),
    "code": ("code", "code renders as plain monospace paragraphs"),
    "equation": ("equation", "equations/inline math render as raw text"),
    "math": ("equation", "math not supported"),
    "image": ("image", "images are dropped (no anchor in template)"),
    "list": ("list", "list items render as plain paragraphs"),
    "callout": ("callout", "callouts render as indented paragraphs"),
}


def strip_comment_keys(raw: Column) -> Column:
    """A raw profile map without keys that start with //."""
    return F.map_filter(raw, lambda k, _: ~k.startswith("//"))


def _over(base: Column, top: Column) -> Column:
    """Entries of both maps; top wins."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(top, k))
    return F.when(top.isNull(), base).when(base.isNull(), top).otherwise(F.map_concat(kept, top))


def _union(base: Column, top: Column) -> Column:
    return F.when(top.isNull(), base).when(base.isNull(), top).otherwise(F.array_distinct(F.concat(base, top)))


def merge_profile(base: Column, top: Column) -> Column:
    """A profile struct layered over its base: scalars of top win, lists unite in order, maps merge, rules replace, extra rules lead, overrides come last."""
    rules = F.coalesce(top["keyword_rules"], base["keyword_rules"])
    extra = top["keyword_rules_extra"]
    merged = {
        "id": top["id"], "extends": top["extends"],
        **{c: F.coalesce(top[c], base[c]) for c in ("description", "strategy", "default_role", "front_matter_strategy")},
        "role_vocabulary": _union(base["role_vocabulary"], top["role_vocabulary"]),
        "role_descriptions": _over(base["role_descriptions"], top["role_descriptions"]),
        "keyword_rules": F.when(extra.isNull(), rules).when(rules.isNull(), extra).otherwise(F.concat(extra, rules)),
        "keyword_rules_extra": F.lit(None).cast(f"array<{_RULE}>"),
        "front_matter_roles": _union(base["front_matter_roles"], top["front_matter_roles"]),
        "role_to_logical": _over(_over(base["role_to_logical"], top["role_to_logical"]), top["role_overrides"]),
        "role_overrides": F.lit(None).cast(f"map<string,{_PLACE}>"),
        "capabilities": _over(base["capabilities"], top["capabilities"]),
    }
    return F.struct(*[v.alias(k) for k, v in merged.items()])


def extension_paths(profiles: DataFrame) -> DataFrame:
    """(id, path, next, state): each profile and all it extends, nearest first; state is whole, cycle (next is the first to come again) or missing (next is no profile). ids are unique.

    Pointer doubling: in a round each unfinished path takes on the path of the profile it stopped at, so paths grow twofold and a chain of n profiles takes log n rounds. Rounds end, as an unfinished path has no profile twice.
    """
    p = profiles.select("id", F.array("id").alias("path"), F.col("extends").alias("next"), F.when(F.col("extends").isNull(), "whole").otherwise("open").alias("state"))
    while True:
        on = p.select(F.col("id").alias("_i"), F.col("path").alias("_path"), F.col("next").alias("_next"), F.col("state").alias("_state"))
        step = p.filter("state = 'open'").join(on, F.col("next") == F.col("_i"), "left")
        step = step.select("id", "path", "next", F.col("_i").isNull().alias("lost"), "_next", "_state", F.concat("path", "_path").alias("both"))
        again = F.array_position(F.transform("both", lambda x, i: F.array_position("both", x) < i + 1), True).cast("int")
        step = step.withColumn("again", again)
        cut = F.col("again") > 0
        state = F.when(F.col("lost"), "missing").when(cut | F.array_contains("both", F.col("_next")), "cycle").when(F.col("_state") == "missing", "missing").when(F.col("_next").isNull(), "whole").otherwise("open")
        step = step.select(
            "id", F.when(F.col("lost"), F.col("path")).when(cut, F.slice("both", F.lit(1), F.greatest(F.col("again") - 1, F.lit(1)))).otherwise(F.col("both")).alias("path"),
            F.when(F.col("lost"), F.col("next")).when(cut, F.get("both", F.col("again") - 1)).otherwise(F.col("_next")).alias("next"), state.alias("state"),
        )
        p = written(p.filter("state <> 'open'").union(step), "extension_paths")
        if p.filter("state = 'open'").isEmpty():
            return p


def resolve_profiles(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles merged with all they extend, and errors (id, error) for cycles and missing parents; the layers of a profile are folded from the root down."""
    paths = extension_paths(profiles)
    errors = paths.filter("state <> 'whole'").select("id", F.when(F.col("state") == "cycle", F.concat(F.lit("cycle: "), F.array_join(F.concat("path", F.array("next")), " -> "))).otherwise(F.concat(F.lit("missing parent: "), "next")).alias("error"))
    rows = profiles.select(F.col("id").alias("_layer"), F.struct(*profiles.columns).alias("row"))
    layers = paths.filter("state = 'whole'").select("id", F.posexplode("path").alias("depth", "layer")).join(rows, F.col("layer") == F.col("_layer"))
    stack = layers.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("depth", "row"))).alias("m"), F.max("depth").alias("top"))
    stack = stack.withColumn("s", F.transform(F.sequence(F.col("top"), F.lit(0), F.lit(-1)), lambda i: F.element_at("m", i)))
    # Every layer goes through the same merge, the root over nothing, so extra rules and overrides count at each level.
    none = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in profiles.schema.fields])
    merged = F.aggregate("s", none, lambda acc, x: merge_profile(acc, x).cast(profiles.schema))
    return written(stack.select(merged.alias("p")).select("p.*"), "profiles"), written(errors, "profile_errors")


def contract_violations(raw: DataFrame, schema: str, key: str, value: str, required: list[str], allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, path, message) for rows of JSON text: text that isn't valid for the schema, missing required fields, values outside an enumeration."""
    full = f"{schema}, _corrupt_record string"
    r = raw.select(key, F.from_json(value, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    broken = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    found = [F.when(broken, F.struct(F.lit("$").alias("path"), F.lit("not valid for the schema").alias("message")))]
    for name in required:
        found.append(F.when(~broken & F.col(f"r.{name}").isNull(), F.struct(F.lit(f"$.{name}").alias("path"), F.lit("required field is missing").alias("message"))))
    for name, values in (allowed or {}).items():
        wrong = ~broken & F.col(f"r.{name}").isNotNull() & ~F.col(f"r.{name}").isin(values)
        found.append(F.when(wrong, F.struct(F.lit(f"$.{name}").alias("path"), F.concat(F.lit("not one of the allowed values: "), F.col(f"r.{name}")).alias("message"))))
    return r.select(key, F.explode(F.array_compact(F.array(*found))).alias("v")).select(key, "v.path", "v.message")


def detect_signals(tree: DataFrame) -> DataFrame:
    """(doc_id, priority, role): roles with a term in any title."""
    has = lambda terms: F.bool_or(F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.upper("title"), t)))
    docs = tree.groupBy("doc_id").agg(F.array_compact(F.array(*[F.when(has(terms), F.struct(F.lit(i).alias("priority"), F.lit(role).alias("role"))) for i, (role, _, terms, _, _) in enumerate(SIGNALS)])).alias("active"))
    return docs.select("doc_id", F.explode("active").alias("s")).select("doc_id", "s.*")


def content_front_matter(sections: DataFrame, block_rows: DataFrame) -> DataFrame:
    """(doc_id, content_front): a level-1 title with an abstract or keyword mark, or a first section of level 1 with an email or a text that starts with a mark."""
    first = F.min("sec_no").over(_doc())
    s = sections.withColumn("_first", (F.col("sec_no") == first) & (F.col("level") == 1))
    runs = F.array_join(F.transform(F.coalesce("runs", F.array().cast(f"array<{T.RUN}>")), lambda r: r["text"]), " ")
    texts = block_rows.select("doc_id", "sec_no", F.coalesce("text", runs).alias("t"))
    mark = F.col("t").rlike(EMAIL) | T.strip(F.col("t")).rlike(FRONT_MARK.replace("(?iu)", "(?iu)^"))
    opened = texts.groupBy("doc_id", "sec_no").agg(F.bool_or(mark).alias("_mark"))
    s = s.join(opened, ["doc_id", "sec_no"], "left")
    titled = (F.col("level") == 1) & F.col("title").rlike(FRONT_MARK)
    return s.groupBy("doc_id").agg(F.bool_or(titled | (F.col("_first") & F.coalesce("_mark", F.lit(False)))).alias("content_front"))


def _doc():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id")


def template_front_matter(paras: DataFrame) -> DataFrame:
    """(template_id, template_front): a paragraph with text precedes the first heading."""
    text, head = F.min(F.when(F.col("has_text") & ~F.col("is_heading"), F.col("seq"))), F.min(F.when(F.col("is_heading"), F.col("seq")))
    return paras.groupBy("template_id").agg(F.coalesce(text < head, text.isNotNull() & head.isNull()).alias("template_front"))


def detect_features(sections: DataFrame, block_rows: DataFrame) -> DataFrame:
    """(doc_id, feature): kinds of blocks, and math and images in paragraphs."""
    kinds = block_rows.filter(F.col("kind").isin("table", "code", "equation", "list", "callout", *registry.features())).select("doc_id", F.col("kind").alias("feature"))
    flags = F.array_compact(F.array(F.when(F.col("has_math"), F.lit("math")), F.when(F.col("has_image"), F.lit("image"))))
    return kinds.union(sections.select("doc_id", F.explode(flags))).distinct()


def negotiate_capabilities(features: DataFrame, docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """(doc_id, feature, capability, status, note): features whose capability the document's profile denies."""
    known = {**FEATURES, **registry.features()}
    key = F.create_map(*[F.lit(x) for k, (c, _) in known.items() for x in (k, c)])
    note = F.create_map(*[F.lit(x) for k, (_, n) in known.items() for x in (k, n)])
    p = docs.select("doc_id", "profile_id").join(small(profiles.select(F.col("id").alias("profile_id"), "capabilities")), "profile_id")
    f = features.join(p, "doc_id").withColumn("capability", F.coalesce(F.try_element_at(key, F.col("feature")), "feature"))
    f = f.filter(F.try_element_at("capabilities", F.col("capability")) == F.lit(False))
    return f.select("doc_id", "feature", "capability", F.lit("degraded").alias("status"), F.coalesce(F.try_element_at(note, F.col("feature")), F.concat("feature", F.lit(" not supported"))).alias("note"))


def synthesize_profile(sections: DataFrame, block_rows: DataFrame, docs: DataFrame, paras: DataFrame, base_id: str = "_base") -> DataFrame:
    """An overlay profile for each document (doc_id, template_id): rules of its active signals, roles and placements beyond the base, strategy, capabilities of used features."""
    table = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(b).alias("base"), F.array(*[F.lit(t) for t in ts]).alias("terms"), F.lit(s).cast("string").alias("section"), F.lit(c).cast("boolean").alias("toc")) for r, b, ts, s, c in SIGNALS])
    active = detect_signals(sections).groupBy("doc_id").agg(F.array_sort(F.collect_list("priority")).alias("p"))
    active = active.select("doc_id", F.transform("p", lambda i: F.get(table, i)).alias("active"))
    features = detect_features(sections, block_rows).groupBy("doc_id").agg(F.array_sort(F.collect_set("feature")).alias("features"))
    d = docs.select("doc_id", "template_id").join(active, "doc_id", "left").join(features, "doc_id", "left")
    d = d.join(content_front_matter(sections, block_rows), "doc_id", "left").join(template_front_matter(paras), "template_id", "left")
    d = d.withColumn("active", F.coalesce("active", F.array().cast("array<struct<role:string,base:boolean,terms:array<string>,section:string,toc:boolean>>")))
    new = F.filter("active", lambda a: ~a["base"])
    said = F.create_map(*[F.lit(x) for kv in NEW_ROLE_DESCRIPTIONS.items() for x in kv])
    key = F.create_map(*[F.lit(x) for k, (c, _) in {**FEATURES, **registry.features()}.items() for x in (k, c)])
    place = lambda a: F.struct(a["section"].alias("section"), F.lit("replace").alias("intent"), F.coalesce(a["toc"], F.lit(False)).alias("toc"), F.lit("FROM_LEVEL").alias("presentation"), F.lit("FROM_LEVEL").alias("outline_level"))
    rule = lambda a: F.struct(a["role"].alias("role"), F.lit(None).cast("array<string>").alias("keywords"), a["terms"].alias("any"))
    strategy = F.when(F.coalesce("content_front", F.lit(False)) & F.coalesce("template_front", F.lit(False)), "replace").otherwise("preserve")
    filled = lambda c: F.when(F.size(c) > 0, c)
    return d.select(
        "doc_id", "template_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), F.lit(base_id).alias("extends"), strategy.alias("front_matter_strategy"),
        F.transform("active", rule).alias("keyword_rules"), filled(F.transform(new, lambda a: a["role"])).alias("role_vocabulary"),
        filled(F.map_from_arrays(F.transform(F.filter(new, lambda a: F.map_contains_key(said, a["role"])), lambda a: a["role"]), F.transform(F.filter(new, lambda a: F.map_contains_key(said, a["role"])), lambda a: F.element_at(said, a["role"])))).alias("role_descriptions"),
        filled(F.map_from_arrays(F.transform(F.filter(new, lambda a: a["section"].isNotNull()), lambda a: a["role"]), F.transform(F.filter(new, lambda a: a["section"].isNotNull()), place))).alias("role_to_logical"),
        F.map_from_arrays(F.array_distinct(F.transform("features", lambda f: F.element_at(key, f))), F.transform(F.array_distinct(F.transform("features", lambda f: F.element_at(key, f))), lambda _: F.lit(True))).alias("capabilities"),
    )
