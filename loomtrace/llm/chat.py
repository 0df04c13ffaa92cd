"""Chat formatting in budgeted windows, with DataFrame functions alone.

Prefix sums of turn tokens place turns on an axis that strides of a quarter of the
budget cut into turn-aligned spans.  Each window repeats the conversation's first system
turn and the last few turns before it, a quarter of the budget each at most; the loss
mask covers assistant texts of the window's own turns, so a repeated target is masked
out and every assistant text is learned once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"
#: Tokens of a window with all that it repeats, and earlier turns repeated.
BUDGET, HISTORY = 2048, 2


def escape(text: Column) -> Column:
    """Text without control strings: backslashes double, then ``<|`` becomes ``<\\|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """A role on one line: like a text, and a line feed becomes ``<\\n``."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def tokens(text: Column) -> Column:
    """Token estimate of a turn: a quarter of its code points, and four for its marks."""
    return F.ceil(F.length(text) / 4) + 4


def windows(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """``conv_col``, ``window``, ``formatted``, ``n_repeated``, ``loss`` of every window.

    ``formatted`` holds the window's turns, the first ``n_repeated`` of them repeated;
    ``loss`` lists (start, length) in code points of ``formatted``.  A window keeps to the
    budget: under half of it for its own turns, a quarter for the system turn, a quarter
    for ``history`` earlier turns in equal parts.  Turns are never cut, so there are two
    exceptions: a turn over a quarter of the budget has a window to itself, however long
    it is; a system or earlier turn over its part is not repeated, it stands in its own
    place alone.  So the output is bounded by a constant times the input.  Null
    roles and texts read as empty; turns are ordered by turn (null first), role and text;
    a null conversation is one of its own; an empty table has no windows.
    """
    conv, role, text = F.col("conv"), F.col("role"), F.col("text")
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tokens", tokens(text))
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "text")
    stride = budget // 4
    wide = F.col("tokens") > stride
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("pos", F.row_number().over(order)).withColumn("end", F.sum("tokens").over(upto))
    # a turn over the stride has a window to itself: it and the turn after it begin anew
    placed = placed.withColumn("part", F.sum(F.when(wide, 2).otherwise(0)).over(upto) - F.when(wide, 1).otherwise(0))
    placed = placed.withColumn("cell", F.floor((F.col("end") - F.col("tokens")) / stride))
    fresh = F.coalesce((F.lag("part").over(order) != F.col("part")) | (F.lag("cell").over(order) != F.col("cell")), F.lit(True))
    placed = placed.withColumn("fresh", fresh.cast("int")).withColumn("window", F.sum("fresh").over(upto))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = placed.withColumn("system_pos", F.min(F.when(role == "system", F.col("pos"))).over(whole)).withColumn("last_window", F.max("window").over(whole))
    system = F.col("pos") == F.col("system_pos")
    later = [F.lead("window", k).over(order) for k in range(1, history + 1)]
    short = F.col("tokens") <= budget // (4 * max(history, 1))
    # the k-th turn after this one opens a window exactly if it and the turn before it differ in theirs;
    # a turn is history of that window if it is among the last few before its opening turn
    opened = [F.when(F.lead("fresh", k).over(order) == 1, w) for k, w in enumerate(later, 1)]
    own = F.array(F.struct(F.col("window").alias("window"), F.lit(0).alias("kind")))
    past = F.transform(F.array_distinct(F.array_compact(F.array(*opened))), lambda w: F.struct(w.alias("window"), F.lit(1).alias("kind"))) if history else F.slice(own, 1, 0)
    kept = F.transform(F.sequence(F.col("window") + 1, F.col("last_window")), lambda w: F.struct(w.alias("window"), F.lit(1).alias("kind")))
    none = F.slice(own, 1, 0)
    copies = F.when(system, F.when((F.col("last_window") > F.col("window")) & ~wide, F.concat(own, kept)).otherwise(own)).otherwise(F.concat(own, F.when(short, past).otherwise(none)))
    each = placed.withColumn("copies", copies).select("conv", "pos", "role", F.explode("copies").alias("c"), F.concat(F.lit(START), escape_role(role), F.lit("\n")).alias("head"), escape(text).alias("body"))
    each = each.select("conv", F.col("c.window").alias("window"), F.struct("pos", (F.col("c.kind") == 1).alias("repeated"), (F.col("role") == "assistant").alias("target"), "head", "body").alias("t"))
    grouped = each.groupBy("conv", "window").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    tail = END + "\n"
    formatted = F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(tail))), "")
    empty = F.expr("struct(0 as at, cast(array() as array<struct<start:int,length:int>>) as spans)")

    def mask(done: Column, t: Column) -> Column:
        at = done["at"] + F.length(t["head"])
        span = F.array(F.struct(at.alias("start"), F.length(t["body"]).alias("length")))
        learned = t["target"] & ~t["repeated"]
        return F.struct((at + F.length(t["body"]) + len(tail)).alias("at"), F.when(learned, F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    return grouped.select(conv.alias(conv_col), "window", formatted.alias("formatted"), F.size(F.filter("ts", lambda t: t["repeated"])).alias("n_repeated"), F.aggregate("ts", empty, mask)["spans"].alias("loss"))


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Digests of conversations, from windows alone.

    Windows are parsed by their control strings; each conversation's own turns and the
    texts under its loss masks are joined in window order.
    """
    blocks = F.split(F.col("formatted"), F.lit(r"\Q" + END + r"\E\n"))
    turns = F.transform(F.slice(blocks, F.col("n_repeated") + 1, F.size(blocks) - 1 - F.col("n_repeated")), lambda b: F.substring(b, len(START) + 1, 1 << 30))

    def digestible(t: Column) -> Column:
        at = F.position(F.lit("\n"), t)
        return F.concat(unescape_role(F.left(t, at - 1)), F.lit("\n"), unescape(F.substring(t, at + 1, F.length(t))), F.lit("\n"))

    learned = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    parts = formatted.select(F.col(conv_col), F.struct("window", F.size(turns).cast("bigint").alias("n"), F.array_join(F.transform(turns, digestible), "").alias("turns"), learned.alias("learned"), F.length("formatted").cast("bigint").alias("chars")).alias("w"))
    whole = parts.groupBy(conv_col).agg(F.array_sort(F.collect_list("w")).alias("ws"))
    total = lambda field: F.aggregate("ws", F.lit(0).cast("bigint"), lambda n, w: n + w[field])
    joined = lambda field: F.array_join(F.transform("ws", lambda w: w[field]), "")
    return whole.select(conv_col, total("n").alias("n_turns"), F.sha2(joined("turns"), 256).alias("turns_sha256"), F.length(joined("learned")).cast("bigint").alias("loss_chars"), F.sha2(joined("learned"), 256).alias("loss_sha256"), total("chars").alias("formatted_chars"))
