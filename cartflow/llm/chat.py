"""Chat formatting into budgeted windows with a loss mask.

A conversation's turns in order carry prefix sums of their tokens.  Cut at
every ``budget`` tokens, the sums give turn-aligned spans: a span holds the
turns that lie wholly in one stretch; a turn across a border is a span of its
own.  A window is one span; before it stand the system turn and up to
``history`` turns that directly precede the span, back to the first one of
more than ``history_tokens``, repeated and outside the loss mask.  Every assistant turn is a target in the
one window whose span has it.

Template: each turn is ``<s>role`` newline ``text</s>``.  Inside roles and
texts a backslash becomes ``\\e``, ``<`` becomes ``\\l`` and ``[`` becomes
``\\b``, so no control string can stand in them and the way back is exact; a
null role is ``\\z``, a line break in a role is ``\\n``.

DataFrame functions only.  Turns are range-partitioned by conversation and
turn, so a hot conversation spans many partitions; a window is gathered by its
span, which the budget bounds.

Null text counts as empty, null conversation ids form one conversation; rows
of equal turn numbers go by role and text.  An empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartflow.llm.common import cut, ranged, running

BUDGET = 1024
HISTORY = 2
HISTORY_TOKENS = 128
TURN = ["role", "text"]


def escaped(s: Column) -> Column:
    for char, code in (("\\", "\\e"), ("<", "\\l"), ("[", "\\b")):
        s = F.replace(s, F.lit(char), F.lit(code))
    return s


def unescaped(s: Column) -> Column:
    for char, code in (("[", "\\b"), ("<", "\\l"), ("\\", "\\e")):
        s = F.replace(s, F.lit(code), F.lit(char))
    return s


def turn_tokens(text: Column) -> Column:
    """Tokens of a turn for the budget: words and single other marks, and three for the template."""
    return (F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")) + 3).cast("long")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """``conv_id, span, n_repeated, text, loss``: one row per window.

    ``n_repeated``: its first turns that stand elsewhere; ``loss``: array of
    struct(start, end), code points of ``text`` that are targets.
    """
    rows = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    placed = ranged(rows.withColumn("n", turn_tokens(F.col("text"))), ["conv_id"], order)
    rows = running(placed, ["conv_id"], order, {"at": F.col("n"), "i": F.lit(1), "long": (F.col("n") > history_tokens).cast("long")})
    first, last = F.floor(F.col("at") / budget), F.floor((F.col("at") + F.col("n") - 1) / budget)
    rows = cut(rows.withColumn("span", (2 * first + (first != last).cast("long")).cast("long"))
               .select("conv_id", "i", "role", "text", "n", "span", "long"))
    spans = rows.groupBy("conv_id", "span").agg(F.min("i").alias("from"), F.min("long").alias("upto"))
    own = rows.withColumn("part", F.lit(2))
    key = ["conv_id", "span"]
    # the turns before a span, by their number: at most ``history`` rows for each span
    wanted = spans.select(F.col("conv_id").alias("c"), F.col("span").alias("s"), "upto",
                          F.explode(F.array_except(F.transform(F.sequence(F.lit(1), F.lit(history)), lambda k: F.col("from") - k),
                                                   F.array(F.lit(-1).cast("long")))).alias("j")).where("j >= 0")
    before = (rows.join(wanted, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("i") == F.col("j")))
              .where(F.col("long") == F.col("upto"))  # no long turn from it to the span
              .withColumn("span", F.col("s")).withColumn("part", F.lit(1)).drop("c", "s", "j", "upto"))
    # the system turn opens every later window
    system = rows.where("i = 0 and role = 'system'").select(F.col("conv_id").alias("c"), "role", "text", "n")
    opening = (spans.where("from > 0").join(system, F.col("conv_id").eqNullSafe(F.col("c")))
               .select("conv_id", F.lit(0).cast("long").alias("i"), "role", "text", "n", "span", F.lit(0).cast("long").alias("long"), F.lit(0).alias("part")))
    before = before.where(~((F.col("i") == 0) & F.coalesce(F.col("role") == "system", F.lit(False))))
    role = F.replace(F.coalesce(escaped(F.col("role")), F.lit("\\z")), F.lit("\n"), F.lit("\\n"))
    shown = F.concat(F.lit("<s>"), role, F.lit("\n"), escaped(F.col("text")), F.lit("</s>"))
    is_target = (F.col("part") == 2) & F.coalesce(F.col("role") == "assistant", F.lit(False))
    made = (own.unionByName(before).unionByName(opening)
            .select(*key, F.struct("part", "i", shown.alias("shown"), F.length(shown).alias("size"),
                                   F.when(is_target, F.length(escaped(F.col("text")))).alias("target")).alias("t"))
            .groupBy(*key).agg(F.array_sort(F.collect_list("t")).alias("ts")))

    def step(acc: Column, t: Column) -> Column:
        end = acc["at"] + t["size"]
        mark = F.struct((end - 4 - t["target"]).alias("start"), (end - 4).alias("end"))
        return F.struct(end.alias("at"), F.when(t["target"] > 0, F.concat(acc["loss"], F.array(mark))).otherwise(acc["loss"]).alias("loss"))

    loss = F.aggregate("ts", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss")), step,
                       lambda acc: acc["loss"])
    return made.select("conv_id", "span", F.size(F.filter("ts", lambda t: t["part"] < 2)).alias("n_repeated"),
                       F.array_join(F.transform("ts", lambda t: t["shown"]), "").alias("text"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per window: conv_id, span, its own turns as array of struct(role, text), the text under the mask, and its length.

    Reads only the formatted text, the mask and the number of repeated turns.
    """
    parts = F.slice(F.split(F.col("text"), "</s>"), F.col("n_repeated") + 1, F.size(F.split(F.col("text"), "</s>")) - F.col("n_repeated") - 1)

    def turn(t: Column) -> Column:
        body = F.substring(t, F.lit(4), F.length(t))
        cut_at = F.instr(body, F.lit("\n"))
        role = F.substring(body, F.lit(1), cut_at - 1)
        role = F.when(role == "\\z", F.lit(None)).otherwise(unescaped(F.replace(role, F.lit("\\n"), F.lit("\n"))))
        return F.struct(role.alias("role"), unescaped(F.substring(body, cut_at + 1, F.length(body))).alias("text"))

    masked = F.array_join(F.transform("loss", lambda m: unescaped(F.substring(F.col("text"), m["start"] + 1, m["end"] - m["start"]))), "")
    return formatted.select("conv_id", "span", F.transform(parts, turn).alias("turns"), masked.alias("masked"), F.length("text").alias("chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the windows: turns, digest of roles and texts, the text under the mask, and all characters."""
    w = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    per = w.groupBy("conv_id").agg(
        F.sum(F.size("turns")).cast("long").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("span", said.alias("said"), "masked"))).alias("ws"), F.sum("chars").cast("long").alias("formatted_chars"))
    whole = F.array_join(F.transform("ws", lambda x: x["said"]), "")
    target = F.array_join(F.transform("ws", lambda x: x["masked"]), "")
    return per.select("conv_id", "n_turns", F.sha2(whole.cast("binary"), 256).alias("turns_sha256"), F.length(target).cast("long").alias("loss_chars"),
                      F.sha2(target.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
