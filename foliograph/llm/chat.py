"""Chat formatting in budgeted windows: prefix sums of turn tokens choose turn-aligned spans.

Every window holds the conversation's system turn, a limited history of the turns before it, and its own
turns; only assistant texts of own turns are under the loss mask, so a repeated turn is never a target twice. All steps are built-in expressions.

Template: a turn is `<s>[INST]role[/INST]text</s>`, a repeated one `<s>[AGAIN]role[/INST]text</s>`. Inside roles and texts a
backslash is doubled and a control string gets a backslash after its first character, so no control string is
left in them and removing the backslashes gives the text back.

Rules for odd rows: null texts and roles count as empty; turns are ordered by turn (nulls first), then role, then
text, and repeated rows are turns of their own; a null conv_id is a conversation of its own; a turn above the budget is kept whole in a window of
its own (over_budget); an empty table gives no windows. Extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template's control strings.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[AGAIN]", "<<SYS>>", "<</SYS>>")
#: Tokens of a window and of its repeated history; characters counted as one token.
BUDGET, HISTORY, CHARS_A_TOKEN = 1024, 192, 4
#: Turn numbers of a block: prefix sums run inside blocks first and over the blocks' totals then, so that a very long conversation is not one task's work.
BLOCK = 256


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _turns(rows: DataFrame) -> DataFrame:
    """(conv, pos, role, text, tokens, before): escaped turns, their position, and the tokens of all turns before them."""
    t = rows.select(
        F.col("conv_id").alias("conv"), F.col("turn").alias("turn"), escape(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text")
    )
    t = t.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK).cast("long"), F.lit(-(2**62))))
    t = t.withColumn("tokens", F.ceil((F.length("role") + F.length("text") + F.lit(20)) / CHARS_A_TOKEN).cast("long"))
    inside = Window.partitionBy("conv", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({"pos": F.count(F.lit(1)).over(inside), "upto": F.sum("tokens").over(inside)})
    blocks = t.groupBy(F.col("conv").alias("b_conv"), F.col("block").alias("b_block")).agg(F.max("pos").alias("n"), F.max("upto").alias("sum"))
    earlier = Window.partitionBy("b_conv").orderBy("b_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({"n": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "sum": F.coalesce(F.sum("sum").over(earlier), F.lit(0))})
    same = t["conv"].eqNullSafe(blocks["b_conv"]) & (t["block"] == blocks["b_block"])
    return t.join(blocks, same).select("conv", (F.col("pos") + F.col("n")).alias("pos"), "role", "text", "tokens", (F.col("upto") + F.col("sum") - F.col("tokens")).alias("before"))


def format_windows(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows (conv_id, window_start, formatted, loss array<struct<start,end>>, n_tokens, over_budget) of conversations (conv_id, turn, role, text).

    window_start is the tokens before the window's first own turn and orders the windows of a conversation. A span holds the turns whose
    prefix sum ends in the same stride; the stride is half of what system turn and history leave, and a turn longer than a stride has
    a span of its own, so only such a turn can exceed the budget.
    """
    t = _turns(rows)
    system = t.filter("role = 'system'").groupBy(F.col("conv").alias("s_conv")).agg(F.min_by(F.struct("pos", "role", "text", "tokens"), "pos").alias("sys"))
    t = t.join(system, t["conv"].eqNullSafe(system["s_conv"]), "left").drop("s_conv")
    room = F.greatest(F.lit(2), F.lit(budget - history) - F.coalesce(F.col("sys.tokens"), F.lit(0)))
    t = t.withColumn("stride", F.floor(room / 2)).withColumn("long", (F.col("tokens") > F.col("stride")).cast("int"))
    upto = Window.partitionBy("conv").orderBy("before").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("span", F.struct(F.floor((F.col("before") + F.col("tokens") - 1) / F.col("stride")), 2 * F.sum("long").over(upto) - F.col("long")))
    span = Window.partitionBy("conv", "span")
    t = t.withColumns({"first": F.min("before").over(span), "next": F.max(F.col("before") + F.col("tokens")).over(span)})
    shown = lambda at, again: F.struct(F.col(at).alias("at"), F.lit(again).alias("again"))
    repeated = F.when(F.col("next") - F.col("before") <= history, F.array(shown("first", False), shown("next", True))).otherwise(F.array(shown("first", False)))
    t = t.select("conv", "pos", "role", "text", "tokens", "sys", F.explode(repeated).alias("shown"))
    w = t.groupBy("conv", F.col("shown.at").alias("at")).agg(
        F.array_sort(F.collect_list(F.struct("pos", F.col("shown.again").alias("again"), "role", "text", "tokens"))).alias("turns"), F.any_value("sys").alias("sys")
    )
    w = w.filter(F.exists("turns", lambda x: ~x["again"]))
    lead = F.struct(F.col("sys.pos").alias("pos"), F.lit(True).alias("again"), F.col("sys.role").alias("role"), F.col("sys.text").alias("text"), F.col("sys.tokens").alias("tokens"))
    absent = F.col("sys").isNotNull() & ~F.exists("turns", lambda x: x["pos"] == F.col("sys.pos"))
    w = w.withColumn("turns", F.when(absent, F.concat(F.array(lead), "turns")).otherwise(F.col("turns")))
    head = lambda x: F.concat(F.when(x["again"], F.lit("<s>[AGAIN]")).otherwise(F.lit("<s>[INST]")), x["role"], F.lit("[/INST]"))
    zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))

    def masked(acc: Column, x: Column) -> Column:
        begin = acc["n"] + F.length(head(x))
        end = begin + F.length(x["text"])
        own = (x["role"] == "assistant") & ~x["again"]
        return F.struct((end + F.length(F.lit("</s>"))).alias("n"), F.when(own, F.concat(acc["loss"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(acc["loss"]).alias("loss"))

    tokens = F.aggregate("turns", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    return w.select(
        F.col("conv").alias("conv_id"),
        F.col("at").alias("window_start"),
        F.array_join(F.transform("turns", lambda x: F.concat(head(x), x["text"], F.lit("</s>"))), "").alias("formatted"),
        F.aggregate("turns", zero, masked, lambda a: a["loss"]).alias("loss"),
        tokens.alias("n_tokens"),
        (tokens > budget).alias("over_budget"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Windows parsed again: own turns as array<struct<role,text>> and the text under the loss mask, both unescaped."""
    parts = F.filter(F.split("formatted", "</s>", -1), lambda p: p.startswith("<s>[INST]"))
    turn = lambda p: F.struct(
        unescape(F.regexp_extract(p, r"(?s)^<s>\[INST\](.*?)\[/INST\]", 1)).alias("role"), unescape(F.regexp_replace(p, r"(?s)^<s>\[INST\].*?\[/INST\]", "")).alias("text")
    )
    under = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return windows.select("conv_id", "window_start", F.transform(parts, turn).alias("turns"), F.array_join(under, "").alias("loss_text"), F.length("formatted").cast("long").alias("chars"))


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT CAST(-7 AS BIGINT) AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    back = read_back(format_windows(rows.unionByName(probe)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    w = back.select("conv_id", F.struct(F.col("window_start").alias("at"), said.alias("said"), F.col("loss_text").alias("loss")).alias("w"), F.size("turns").cast("long").alias("n"), "chars")
    # A digest of a whole conversation needs its text in one row.
    c = w.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return c.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.transform("w", lambda x: x["said"]), ""), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars"
    )
