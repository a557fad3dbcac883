"""Chat formatting: conversations as turn-aligned windows of a token budget, with a loss mask.

Prefix sums of turn costs put every turn into one window as a fresh turn. Each window starts with the conversation's
system turn, then repeats the turns that end the previous window as far as ``history`` tokens reach, then has its fresh
turns. Only fresh assistant turns are under the loss mask, so a repeated target is masked and each target is learnt once.

DataFrame operations only. A conversation of any length is spread: prefix sums are taken in blocks of turn numbers and
then over block totals, and windows are joined with their history on grid cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
BLOCK = 256  # turn numbers in one block of the prefix sums
OVERHEAD = 4  # tokens for the marks of a turn


def escape(text: Column) -> Column:
    """No ``<|`` is left, and ``unescape`` gives the text back."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def turn_cost(text: Column) -> Column:
    """Tokens of a turn as the budget counts them: a token per four UTF-8 bytes, and the marks."""
    return F.floor((F.octet_length(text) + 3) / 4).cast("long") + OVERHEAD


def chat_windows(conversations: DataFrame, budget: int = 512, history: int = 128) -> DataFrame:
    """One row per window: conv_id, window, formatted, loss_spans, n_context, n_fresh, n_tokens.

    ``formatted`` is a run of ``<|im_start|>role\\ntext<|im_end|>\\n``; ``loss_spans`` are (start, length) in code points
    of it; ``n_context`` leading turns are repeated ones. Budget left for fresh turns is ``budget - history - system``;
    a single turn beyond that stays whole in a window of its own.

    Null text or role: empty. Null conv_id: a conversation of its own. Turns go by (turn, role, text), null turn first;
    repeated rows are kept. No rows: no windows. Other columns are not read.
    """
    c = conversations.select(
        F.col("conv_id"),
        F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("k"),
        F.col("turn"),
        F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62))).cast("long").alias("blk"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    cost = turn_cost(F.col("text"))
    in_block = Window.partitionBy("k", "blk").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = in_block.rowsBetween(Window.unboundedPreceding, -1)
    c = c.select(
        "*", cost.alias("cost"), F.row_number().over(in_block).alias("rn"),
        F.coalesce(F.sum(cost).over(upto), F.lit(0)).alias("before"),
    )
    # One row per block of turn numbers; its window sees block totals only.
    by_conv = Window.partitionBy("k")
    order = by_conv.orderBy("blk")
    totals = (
        c.groupBy("k", "blk")
        .agg(
            F.sum("cost").alias("t_cost"),
            F.count("*").alias("t_rows"),
            F.max(F.when((F.col("rn") == 1) & (F.col("role") == "system"), F.col("cost"))).alias("sys_cost"),
        )
        .select(
            "k", "blk",
            F.coalesce(F.sum("t_cost").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o_cost"),
            F.coalesce(F.sum("t_rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o_rows"),
            F.first("sys_cost").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("sys"),
        )
    )
    sys = F.coalesce("sys", F.lit(0))
    t = c.join(totals, ["k", "blk"]).select(
        "conv_id", "k", "role", "text", "cost",
        (F.col("o_rows") + F.col("rn") - 1).alias("pos"),
        F.greatest(F.lit(1), F.lit(budget - history) - sys).alias("room"),
        (F.col("sys").isNotNull() & (F.col("o_rows") + F.col("rn") == 1)).alias("is_sys"),
        F.greatest(F.lit(0), F.col("o_cost") + F.col("before") - sys).alias("s"),
    )
    cell = F.floor(F.col("s") / F.col("room")).cast("long")
    last = F.floor((F.col("s") + F.col("cost") - 1) / F.col("room")).cast("long")
    crosses = ~F.col("is_sys") & (last > cell) & (F.col("s") > cell * F.col("room"))
    t = t.select("*", cell.alias("cell"), (cell * 2 + crosses.cast("int")).alias("window"))

    starts = t.groupBy("k", "window").agg(
        F.first("conv_id").alias("conv_id"), F.min("s").alias("w_start"), F.min("pos").alias("w_pos"), F.max("room").alias("room")
    )
    # A window's history lies in the cells that its last `history` tokens touch.
    reach = starts.filter("w_pos > 0").select(
        "*",
        F.explode(
            F.sequence(
                F.floor(F.greatest(F.lit(0), F.col("w_start") - history) / F.col("room")).cast("long"),
                F.floor(F.col("w_start") / F.col("room")).cast("long"),
            )
        ).alias("cell"),
    )
    said = t.filter(~F.col("is_sys")).select("k", "cell", "role", "text", "cost", "pos", "s")
    repeated = (
        reach.join(said, ["k", "cell"])
        .filter((F.col("s") >= F.col("w_start") - history) & (F.col("pos") < F.col("w_pos")))
        .select("conv_id", "k", "window", "role", "text", "cost", "pos", F.lit(True).alias("ctx"))
    )
    system = (
        starts.filter("w_pos > 0")
        .join(t.filter("is_sys").select("k", "role", "text", "cost", "pos"), "k")
        .select("conv_id", "k", "window", "role", "text", "cost", "pos", F.lit(True).alias("ctx"))
    )
    fresh = t.select("conv_id", "k", "window", "role", "text", "cost", "pos", F.lit(False).alias("ctx"))

    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    rows = fresh.unionByName(repeated).unionByName(system).select(
        "conv_id", "k", "window", "pos", "ctx", "cost",
        F.concat(head, body, F.lit(END + "\n")).alias("turn"),
        F.length(head).alias("h"), F.length(body).alias("b"),
        (~F.col("ctx") & (F.col("role") == "assistant")).alias("loss"),
    )
    inside = Window.partitionBy("k", "window").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("turn")).over(inside), F.lit(0)))
    parts = F.array_sort(F.collect_list(F.struct("pos", "turn", "ctx", "loss", (F.col("at") + F.col("h")).alias("start"), F.col("b").alias("len"))))
    return (
        rows.groupBy("k", "window")
        .agg(F.first("conv_id").alias("conv_id"), parts.alias("p"), F.sum("cost").alias("n_tokens"))
        .select(
            "conv_id",
            "window",
            F.array_join(F.transform("p", lambda x: x["turn"]), "").alias("formatted"),
            F.transform(
                F.filter("p", lambda x: x["loss"]),
                lambda x: F.struct(x["start"].cast("long").alias("start"), x["len"].cast("long").alias("len")),
            ).alias("loss_spans"),
            F.size(F.filter("p", lambda x: x["ctx"])).alias("n_context"),
            F.size(F.filter("p", lambda x: ~x["ctx"])).alias("n_fresh"),
            "n_tokens",
        )
    )


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows say, per conversation: each turn and each target once, in order.

    The digests are of whole conversations, so here, and only here, one conversation is one row.
    """
    pieces = F.split("formatted", r"<\|im_end\|>\n")
    bodies = F.transform(
        F.slice(pieces, F.col("n_context") + 1, F.col("n_fresh")), lambda x: F.substr(x, F.lit(len(START) + 1))
    )

    def said(x: Column) -> Column:
        return F.concat(
            unescape_role(F.substring_index(x, "\n", 1)), F.lit("\n"),
            unescape(F.substr(x, F.instr(x, F.lit("\n")) + 1)), F.lit("\n"),
        )

    target = F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["start"].cast("int") + 1, s["len"].cast("int"))))
    w = windows.select(
        "conv_id", "window", "n_fresh",
        F.array_join(F.transform(bodies, said), "").alias("turns"),
        F.array_join(target, "").alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
    )
    all_of = lambda name: F.array_join(F.transform("p", lambda x: x[name]), "")
    return (
        w.groupBy("conv_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("p"),
            F.sum("n_fresh").cast("long").alias("n_turns"),
            F.sum("chars").cast("long").alias("formatted_chars"),
            F.count("*").alias("n_windows"),
        )
        .select(
            "conv_id", "n_turns",
            F.sha2(all_of("turns"), 256).alias("turns_sha256"),
            F.length(all_of("loss")).cast("long").alias("loss_chars"),
            F.sha2(all_of("loss"), 256).alias("loss_sha256"),
            "formatted_chars", "n_windows",
        )
    )
