"""Secret scan: fixed patterns plus sliding-window Shannon entropy, as one projection without a shuffle.

Everything is a built-in expression. A document's spans are `array<struct<kind, start, end>>` in code points,
end exclusive, ordered by start and then by the order of KINDS.

Rules for odd rows: a null text counts as empty and has no spans; an empty text has none; repeated rows are
scanned each for itself; other columns pass through, and a column named like an output is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import in_row, out_of_row

# The patterns of the contract, the kinds in their order, and the allow-list.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUID
    r"(?i)example|sample|placeholder|dummy|changeme|x{6,}|0{8,}|1234567890|abcdefghij",  # stand-ins
    r"^[A-Za-z]{2,}(?:[-_/][A-Za-z]{2,})+[-_/]?[0-9]{0,4}$",  # words joined to a name or path
    r"^[0-9]{1,4}(?:[-_/][0-9]{1,4})+$",  # dates and number ranges
)
#: Characters of a window, and the bits a window needs by character class (the most that 20 characters reach is 4.32).
WINDOW = 20
LEAST_BITS = {"entropy_hex": 3.0, "entropy_base64": 3.7}
_SPAN = "struct<start:int,rank:int,end:int>"


def _spans(text: Column, pattern: str, found: Column, rank: int) -> Column:
    """Spans of all matches: texts between matches come from split(), so that positions are running lengths."""
    between = F.split(text, pattern, -1)
    steps = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        one = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans"))

    run = F.aggregate(steps, start, step, lambda acc: acc["spans"])
    return F.when(F.size(found) > 0, run).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _plogp(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))


def _hot_range(word: Column, least: Column) -> Column:
    """First and last window start of word whose entropy reaches `least` bits, or null.

    One pass; counts of the 128 ASCII codes change by the entering and the leaving character only, and with them
    the sum of c*log2(c). Entropy of a window is log2(WINDOW) - sum / WINDOW.
    """
    codes = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.ascii(c) + 1)
    zero = F.struct(
        F.array_repeat(F.lit(0), 128).alias("n"), F.lit(0.0).alias("s"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last")
    )

    def put(counts: Column, code: Column, value: Column) -> Column:
        return F.concat(F.slice(counts, F.lit(1), code - 1), F.array(value), F.slice(counts, code + 1, F.lit(128)))

    def step(acc: Column, x: Column) -> Column:
        i, new, old = x["i"], x["new"], x["old"]
        was = F.element_at(acc["n"], new)
        counts, total = put(acc["n"], new, was + 1), acc["s"] + _plogp(was + 1) - _plogp(was)
        entered = F.struct(counts.alias("n"), total.alias("s"))
        left = F.when(
            old.isNotNull(),
            F.transform(
                F.array(entered),
                lambda e: F.struct(
                    put(e["n"], old, F.element_at(e["n"], old) - 1).alias("n"),
                    (e["s"] + _plogp(F.element_at(e["n"], old) - 1) - _plogp(F.element_at(e["n"], old))).alias("s"),
                ),
            )[0],
        ).otherwise(entered)

        def judged(e: Column) -> Column:
            hot = (i >= WINDOW - 1) & (F.log2(F.lit(float(WINDOW))) - e["s"] / WINDOW >= least)
            at = i - (WINDOW - 1)
            return F.struct(
                e["n"].alias("n"), e["s"].alias("s"), F.when(hot & acc["first"].isNull(), at).otherwise(acc["first"]).alias("first"), F.when(hot, at).otherwise(acc["last"]).alias("last")
            )

        return F.transform(F.array(left), judged)[0]

    moves = F.transform(codes, lambda c, i: F.struct(i.alias("i"), c.alias("new"), F.when(i >= WINDOW, F.get(codes, i - WINDOW)).alias("old")))
    return F.aggregate(moves, zero, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _allowed(word: Column) -> Column:
    """Whether the allow-list names what a candidate holds: of its parts around `=` all those of WINDOW or more characters, or, if none is that long, the last one. A name before the `=` allows nothing."""
    parts = F.filter(F.split(word, "=+"), lambda p: p != "")
    long = F.filter(parts, lambda p: F.length(p) >= WINDOW)
    judged = F.when(F.size(long) > 0, long).otherwise(F.slice(parts, -1, 1))

    def named(part: Column) -> Column:
        found = F.lit(False)
        for pattern in ALLOWED:
            found = found | part.rlike(pattern)
        return found

    return (F.size(parts) > 0) & F.forall(judged, named)


def _entropy_spans(spans: Column, words: Column) -> Column:
    def judge(span: Column, i: Column) -> Column:
        word = F.get(words, i)
        is_hex = word.rlike("^[0-9a-f]+$") | word.rlike("^[0-9A-F]+$")
        least = F.when(is_hex, LEAST_BITS["entropy_hex"]).otherwise(LEAST_BITS["entropy_base64"])
        mixed = word.rlike("[0-9]") & word.rlike("[A-Za-z]")
        hot = F.when(mixed & ~_allowed(word), _hot_range(word, least))
        return F.transform(
            F.array(hot),
            lambda h: F.when(
                h["first"].isNotNull(),
                F.struct((span["start"] + h["first"]).alias("start"), F.when(is_hex, 3).otherwise(4).alias("rank"), (span["start"] + h["last"] + WINDOW).alias("end")),
            ),
        )[0]

    return F.filter(F.transform(spans, judge), lambda s: s.isNotNull())


def scan_secrets(docs: DataFrame, text: str = "text", out: str = "secret_spans") -> DataFrame:
    """docs with `out`: all spans of secrets, and `out`_base: those of the fixed patterns alone."""
    names = [c for c in docs.columns if c not in (out, f"{out}_base")]
    given = F.coalesce(docs[text], F.lit(""))
    df = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), given.alias("_text"))
    candidate = rf"[A-Za-z0-9+/=_-]{{{WINDOW},}}"
    for name, pattern in (("_assign", ASSIGN), ("_access", ACCESS), ("_hex", HEX[:-1] + "{24,}"), ("_word", candidate)):
        df = df.withColumn(name, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)))
    df = df.select(
        "_row",
        "_word",
        F.filter(
            F.transform(
                F.arrays_zip(_spans(F.col("_text"), ASSIGN, F.col("_assign"), 0).alias("s"), F.transform("_assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2))).alias("n")),
                lambda x: F.when(x["n"] >= 6, x["s"]),
            ),
            lambda s: s.isNotNull(),
        ).alias("_a"),
        F.filter(_spans(F.col("_text"), ACCESS, F.col("_access"), 1), lambda s: s["end"] - s["start"] >= 20).alias("_b"),
        _spans(F.col("_text"), HEX[:-1] + "{24,}", F.col("_hex"), 2).alias("_c"),
        _spans(F.col("_text"), candidate, F.col("_word"), 9).alias("_w"),
    )
    df = df.withColumn("_base", F.array_sort(F.concat("_a", "_b", "_c"))).withColumn("_more", _entropy_spans(F.col("_w"), F.col("_word")))
    covered = lambda s: F.exists("_base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))
    df = df.withColumn("_all", F.array_sort(F.concat("_base", F.filter("_more", lambda s: ~covered(s)))))
    kind = F.array(*[F.lit(k) for k in KINDS])
    named = lambda c: F.transform(c, lambda s: F.struct(F.get(kind, s["rank"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return df.select("_row.*", named("_all").alias(out), named("_base").alias(f"{out}_base"))


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span of `text` replaced by `mark` (overlapping spans by one mark). Columns stay as they are; n_chars, if there, is counted again for changed texts."""
    df = scan_secrets(in_row(docs, given=F.col(f"`{text}`")), "given", "spans")

    def disjoint(acc: Column, s: Column) -> Column:
        late = F.greatest(acc["end"], s["start"])
        return F.when(
            s["end"] > acc["end"],
            F.struct(s["end"].alias("end"), F.concat(acc["cuts"], F.array(F.struct((s["start"] <= acc["end"]).alias("joined"), acc["end"].alias("after"), late.alias("start")))).alias("cuts")),
        ).otherwise(acc)

    empty = F.array().cast("array<struct<joined:boolean,after:int,start:int>>")
    folded = F.aggregate("spans", F.struct(F.lit(0).alias("end"), empty.alias("cuts")), disjoint)
    df = df.withColumn("fold", F.when(F.size("spans") > 0, folded))
    given = F.col("given")
    pieces = F.transform(
        "fold.cuts",
        lambda c: F.when(c["joined"] & (c["after"] > 0), F.lit("")).otherwise(F.concat(F.substring(given, c["after"] + 1, c["start"] - c["after"]), F.lit(mark))),
    )
    whole = F.concat(F.array_join(pieces, ""), F.substring(given, F.col("fold.end") + 1, F.length(given)))
    found = F.col("fold").isNotNull()
    df = df.withColumn("masked", F.when(found, whole).otherwise(given))
    changed = {text: F.col("masked")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(found, F.length("masked").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out_of_row(df, docs.columns, **changed)


def digest(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(docs)
    n = lambda k: F.size(F.filter("secret_spans_base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(digest("secret_spans_base"), 256).alias("base_sha256"), digest("secret_spans").alias("spans")
    )
