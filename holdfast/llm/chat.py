"""Chat formatting: conversations become training windows of a bounded number of tokens.

Prefix sums of turn tokens choose the windows. Only built-in functions run; no Python touches a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count

END = "</turn>"
MARK = "### "


def escaped(text: Column) -> Column:
    r"""``\`` becomes ``\b``, ``###`` becomes ``\h`` and ``</turn>`` becomes ``\t``: reversible, and free of control strings."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("###"), F.lit("\\h")), F.lit(END), F.lit("\\t"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\t"), F.lit(END)), F.lit("\\h"), F.lit("###")), F.lit("\\b"), F.lit("\\"))


def _role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(":"), F.lit("\\c"))


def chat_windows(
    turns: DataFrame,
    budget: int = 2048,
    history: int = 512,
    overhead: int = 4,
    target_role: str = "assistant",
    system_role: str = "system",
) -> DataFrame:
    """Windows of turns with a loss mask: conv_id, window, n_context, n_turns, n_tokens, formatted, loss_spans.

    ``turns`` has conv_id, turn, role and text; other columns are ignored. A turn costs its words plus
    ``overhead`` tokens. Turns of a conversation stand in the order of (turn, role, text), missing
    values first. Each window holds, in this order: the system turn (where the first turn has the
    system role), repeated in every window; the last turns of the window before, as many as fit into
    ``history`` tokens; and new turns that fit into the rest of the ``budget``. The first two are the
    window's context, its first ``n_context`` turns (in the first window none). A turn is never cut: one that is too long for a
    window stands alone in one of its own, which is then longer than the budget.

    Every turn is written as ``### role: text</turn>\\n`` with escaped role and text. ``loss_spans``
    lists start and end (code points, end exclusive) of the escaped texts of the new turns of
    ``target_role``, in order; repeated turns are masked, so every target is learned once.

    A missing text or role is the empty text; a missing conv_id is a conversation of its own. Repeated
    rows are turns like others. An empty table gives an empty result.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    conv = Window.partitionBy("conv_id")
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("tokens", word_count() + overhead)
    rows = rows.withColumns(
        {
            "at": F.row_number().over(conv.orderBy(*order)),
            "upto": F.sum("tokens").over(conv.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    system = (F.col("at") == 1) & (F.col("role") == system_role)
    rows = rows.withColumn("system_tokens", F.max(F.when(system, F.col("tokens")).otherwise(0)).over(conv))
    # Half of what is left: turns that begin in one step of this size end before the next step's end.
    step = F.greatest(F.lit(1), F.floor((F.lit(budget - history) - F.col("system_tokens")) / 2)).cast("long")
    long_turn = F.col("tokens") > step
    rows = rows.withColumn("alone", long_turn & ~system).withColumn(
        "runs", F.sum(F.col("alone").cast("int")).over(conv.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    )
    place = F.when(system, F.lit(0)).otherwise(F.floor((F.col("upto") - F.col("tokens") - F.col("system_tokens")) / step))
    rows = rows.withColumn("cell", F.struct((2 * F.col("runs") - F.col("alone").cast("int")).alias("run"), F.when(F.col("alone"), F.lit(0)).otherwise(place).alias("place")))
    rows = rows.withColumn("window", F.dense_rank().over(conv.orderBy("cell")) - 1)
    own = Window.partitionBy("conv_id", "window")
    rows = rows.withColumns({"windows": F.max("window").over(conv) + 1, "window_end": F.max("upto").over(own)})
    near = (F.col("window_end") - (F.col("upto") - F.col("tokens")) <= history) & ~system & (F.col("window") + 1 < F.col("windows"))
    again = F.when(system, F.sequence(F.lit(0), F.col("windows") - 1)).when(near, F.array(F.col("window"), F.col("window") + 1)).otherwise(F.array("window"))
    rows = rows.select("*", F.explode(again).alias("shown"))
    opening = F.concat(F.lit(MARK), _role(F.col("role")), F.lit(": "))
    body = escaped(F.col("text"))
    segment = F.struct(
        "at",
        (F.col("window") < F.col("shown")).alias("context"),
        F.concat(opening, body, F.lit(END + "\n")).alias("written"),
        F.length(opening).cast("long").alias("before"),
        F.length(body).cast("long").alias("length"),
        ((F.col("role") == target_role) & (F.col("window") == F.col("shown"))).alias("target"),
        "tokens",
    )
    windows = rows.groupBy("conv_id", F.col("shown").cast("long").alias("window")).agg(F.array_sort(F.collect_list(segment)).alias("segments"))
    tail = len(END) + 1
    spans = F.aggregate(
        "segments",
        F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda seen, s: F.struct(
            (seen["end"] + s["before"] + s["length"] + tail).alias("end"),
            F.when(
                s["target"],
                F.concat(
                    seen["spans"],
                    F.array(F.struct((seen["end"] + s["before"]).alias("start"), (seen["end"] + s["before"] + s["length"]).alias("end"))),
                ),
            )
            .otherwise(seen["spans"])
            .alias("spans"),
        ),
        lambda seen: seen["spans"],
    )
    return windows.select(
        "conv_id",
        "window",
        F.size(F.filter("segments", lambda s: s["context"])).alias("n_context"),
        F.size("segments").alias("n_turns"),
        F.aggregate("segments", F.lit(0).cast("long"), lambda n, s: n + s["tokens"]).alias("n_tokens"),
        F.array_join(F.transform("segments", lambda s: s["written"]), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def turns_of(formatted: Column) -> Column:
    """Read a window back: its turns as an array of (role, text)."""
    parts = F.filter(F.split(formatted, F.lit(END + "\n"), -1), lambda p: p != "")

    def turn(part: Column) -> Column:
        head = F.substring_index(part, ": ", 1)
        role = F.replace(F.substr(head, F.lit(len(MARK) + 1)), F.lit("\\c"), F.lit(":"))
        return F.struct(unescaped(role).alias("role"), unescaped(F.substr(part, F.length(head) + 3)).alias("text"))

    return F.transform(parts, turn)


def conversation_digest(windows: DataFrame) -> DataFrame:
    """One row per conversation, read back from its windows: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A hash of a whole conversation needs it in one row; only this digest brings it together.
    """
    turns = turns_of(F.col("formatted"))
    fresh = F.slice(turns, F.col("n_context") + 1, F.greatest(F.lit(0), F.size(turns) - F.col("n_context")))
    said = F.array_join(F.transform(fresh, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(
        F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), ""
    )
    part = windows.select(
        "conv_id", "window", F.size(fresh).cast("long").alias("n"), said.alias("said"), learned.alias("learned"), F.length("formatted").cast("long").alias("chars")
    )
    whole = part.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("window", "said", "learned"))).alias("parts"),
        F.sum("chars").alias("formatted_chars"),
    )
    loss = F.array_join(F.transform("parts", lambda p: p["learned"]), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.transform("parts", lambda p: p["said"]), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
