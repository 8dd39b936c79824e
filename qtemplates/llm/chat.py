"""Chat formatting: one example per assistant turn, only that turn trainable.

The template writes a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``.  Control
strings inside a role or text are escaped reversibly: each backslash is
doubled and a backslash goes in after the first character of each control
string, so none of them is left; a newline in a role gets one before it.

``examples`` explodes every assistant turn into an example of its own: all
turns before it are context, its text is trained on.  The text of an example
is a prefix of its conversation's formatted text, so an example row refers to
the conversation's pieces by turn number and ``materialize`` spells the texts
out, each with all turns before it, as a trainer reads them; what is stored
before that grows with the conversations, not with their square.  Turns
after the last assistant turn are kept as an example without target, so that
the output holds every turn.

Spans (``loss_start``, ``loss_end``) are code points of the formatted text, end
exclusive, over the escaped reply without the template's marks.

A conversation is put together in one task, as its digests and its order ask
for; its turns are rows only before and after that.

Cases: null texts count as empty, null roles as the empty role; conversations
are ordered by turn (null first), then role and text, so ties and repeated
rows have a fixed place; a null conv_id is a conversation of its own; a
conversation without assistant turns gives one example without target; an empty
table gives an empty result; only conv_id, turn, role and text are read, so
other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qtemplates.llm.common import let

TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"
#: Strings that a tokenizer may treat as marks.
CONTROL = (TURN_START, TURN_END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TARGET_ROLE = "assistant"
_TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def escape(text: Column) -> Column:
    """No control string is left in the result; ``unescape`` restores it."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id and its turns in order, null texts and roles as empty."""
    turn = F.struct(F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).cast(_TURNS).alias("turns"))


def formatted_turns(turns: Column) -> Column:
    """Array of (head, body, tail): the parts of each turn's formatted text."""
    return F.transform(turns, lambda t: F.struct(
        F.concat(F.lit(TURN_START), F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\\n")), F.lit("\n")).alias("head"),
        escape(t["text"]).alias("body"), F.lit(TURN_END + "\n").alias("tail"), (t["role"] == TARGET_ROLE).alias("target")))


def examples(rows: DataFrame) -> DataFrame:
    """conv_id, example (from 0), first_turn and last_turn (places from 0 of
    the turns that this example adds to the one before), context_chars,
    piece (formatted text of those turns), has_target, loss_start and
    loss_end.

    The text of example k is the pieces of examples 0..k of its conversation
    end to end; ``context_chars`` is the length of pieces 0..k-1."""
    done = conversations(rows).withColumn("parts", formatted_turns(F.col("turns")))
    n = F.size("parts")
    places = F.filter(F.transform("parts", lambda p, i: F.when(p["target"], i)), lambda i: i.isNotNull())
    ends = let(places, lambda p: F.when(F.coalesce(F.element_at(F.when(F.size(p) > 0, p), -1), F.lit(-1)) < n - 1, F.concat(p, F.array(n - 1))).otherwise(p))
    cut = done.select("conv_id", "parts", F.posexplode(let(ends, lambda e: F.transform(e, lambda last, i: F.struct(
        F.when(i == 0, F.lit(0)).otherwise(F.get(e, i - 1) + 1).alias("first"), last.alias("last"))))).alias("example", "at"))
    own = cut.select("conv_id", "example", F.col("at.first").alias("first_turn"), F.col("at.last").alias("last_turn"),
                     F.slice("parts", F.col("at.first") + 1, F.col("at.last") - F.col("at.first") + 1).alias("own"))
    spelled = F.array_join(F.transform("own", lambda p: F.concat(p["head"], p["body"], p["tail"])), "")
    last = F.element_at("own", -1)
    cols = own.select("conv_id", "example", "first_turn", "last_turn", spelled.alias("piece"), last["target"].alias("has_target"),
                      F.length(last["body"]).alias("body_chars"), F.length(last["tail"]).alias("tail_chars"))
    before = Window.partitionBy("conv_id").orderBy("example").rowsBetween(Window.unboundedPreceding, -1)
    context = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).cast("long")
    placed = cols.withColumn("context_chars", context).withColumn("end", F.col("context_chars") + F.length("piece") - F.col("tail_chars"))
    return placed.select("conv_id", "example", "first_turn", "last_turn", "context_chars", "piece", "has_target",
                         F.when(F.col("has_target"), F.col("end") - F.col("body_chars")).alias("loss_start"),
                         F.when(F.col("has_target"), F.col("end")).alias("loss_end"))


def materialize(rows: DataFrame) -> DataFrame:
    """``examples`` with ``text``, each example's whole text.  This spells
    contexts out again for every example, as a trainer wants them."""
    upto = Window.partitionBy("conv_id").orderBy("example").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("text", F.array_join(F.collect_list("piece").over(upto), ""))


def read_back(rows: DataFrame) -> DataFrame:
    """What materialised example rows say, by conversation: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars (of all examples'
    texts) and n_examples.  Only the examples' texts and masks are read; the
    last example's text holds all turns."""
    loss = F.when(F.col("has_target"), unescape(F.substr("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))).otherwise("")
    back = rows.groupBy("conv_id").agg(F.max(F.struct("example", "text")).alias("last"), F.sort_array(F.collect_list(F.struct("example", loss.alias("loss")))).alias("e"),
                                       F.sum(F.length("text")).cast("long").alias("formatted_chars"))
    # no control string is left inside a turn, so the marks cut the text
    end = F.lit("\\Q" + TURN_END + "\n\\E")
    raw = F.transform(F.filter(F.split("last.text", end), lambda t: t != ""), lambda t: F.substr(t, F.lit(len(TURN_START) + 1)))
    said = F.array_join(F.transform("raw", lambda t: F.concat(unescape(t), F.lit("\n"))), "")
    back = back.withColumn("raw", raw).withColumn("loss", F.array_join(F.col("e.loss"), ""))
    return back.select("conv_id", F.size("raw").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       "formatted_chars", F.size("e").cast("long").alias("n_examples"))
