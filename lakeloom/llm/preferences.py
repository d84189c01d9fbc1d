"""Preference formatting of chosen and rejected conversations, in DataFrame operations only.

Turns of the two sides are aligned by turn number; the longest common prefix
ends at the first turn whose contents differ. The prefix is rendered once as
the prompt; what follows on each side is a completion with the spans (code
points of the completion, ends exclusive) that carry loss: assistants' texts
and their end marks. A text is shuffled once, to its pair.

There is one row per pair, whatever its turns' numbers; as that row holds both
renderings, a conversation must fit a row (2 GB), and only a pair's own turns
are gathered. Exact repeats of a row count once; different rows of one turn are
rendered in the order of role and text. A null role reads as "unknown", a null
text as empty; rows with a null pair or turn are dropped, having no place.
Markers within texts and roles are broken by a space, so that neither can open
a turn. Pairs with equal sides have empty completions. Other columns are not
read and may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOSS_ROLE = "assistant"
OPEN, SHUT, END = "<|", "|>\n", "<|end|>\n"
#: What a row of the input is: a turn of the chosen or the rejected side, or a reply lent by another conversation.
CHOSEN, REJECTED, LENT = 1, 2, 3


def _turns(turns: DataFrame, kind: int, pair: str, turn: str, role: str, text: str) -> DataFrame:
    """pair, turn, role, text and kind of the rows that have a place, markers broken."""
    # A "<" at a role's end would meet the bar that closes the head.
    role_ = F.regexp_replace(F.coalesce(F.col(role), F.lit("unknown")), r"<(\||\z)", "< $1")
    text_ = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(OPEN), F.lit("< |"))
    placed = turns.where(F.col(pair).isNotNull() & F.col(turn).isNotNull())
    return placed.select(F.col(pair).alias("pair"), F.col(turn).cast("long").alias("turn"), role_.alias("role"), text_.alias("text"), F.lit(kind).alias("kind"))


def _gathered(rows: DataFrame) -> DataFrame:
    """pair and said, its rows."""
    return rows.groupBy("pair").agg(F.collect_list(F.struct("turn", "role", "text", "kind")).alias("said"))


def _side(said: Column) -> Column:
    """The rows' contents in order, each once."""
    return F.sort_array(F.array_distinct(F.transform(said, lambda x: F.struct(x["turn"].alias("turn"), x["role"].alias("role"), x["text"].alias("text")))))


def _head(said: Column) -> Column:
    return F.concat(F.lit(OPEN), said["role"], F.lit(SHUT))


def _render(turns: Column) -> Column:
    """Contents in a row as text."""
    return F.array_join(F.transform(turns, lambda s: F.concat(_head(s), s["text"], F.lit(END))), "")


def _spans(turns: Column) -> Column:
    """start:end of each loss span in the rendering of contents in a row."""

    def step(state: Column, said: Column) -> Column:
        start = state["at"] + F.length(_head(said))
        end = start + F.length(said["text"]) + len(END)
        # The end mark without its line feed.
        span = F.concat(start.cast("string"), F.lit(":"), (end - 1).cast("string"))
        spans = F.when(said["role"] == LOSS_ROLE, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.cast("long").alias("at"), spans.alias("spans"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.array_join(F.aggregate(turns, start, step)["spans"], ",")


def _formatted(sides: DataFrame) -> DataFrame:
    """The result from pair, c and r (both sides' contents in order)."""
    # The first place where the sides part, counted from 1; 0 if they don't.
    parting = F.array_position(F.zip_with("c", "r", lambda a, b: a.eqNullSafe(b)), F.lit(False))
    at = (F.col("parting") - 1).cast("int")
    end = F.when(F.col("parting") > 0, F.least(F.get("c", at)["turn"], F.get("r", at)["turn"]))
    before = lambda x: F.col("end").isNull() | (x["turn"] < F.col("end"))
    cut = (
        sides.withColumn("parting", parting)
        .withColumn("end", end)
        .select("pair", F.filter("c", before).alias("p"), F.filter("c", lambda x: ~before(x)).alias("c"), F.filter("r", lambda x: ~before(x)).alias("r"))
    )
    return cut.select(
        "pair",
        F.size(F.array_distinct(F.col("p.turn"))).cast("long").alias("n_prefix"),
        _render(F.col("p")).alias("prompt"),
        _render(F.col("c")).alias("chosen"),
        _spans(F.col("c")).alias("chosen_mask"),
        _render(F.col("r")).alias("rejected"),
        _spans(F.col("r")).alias("rejected_mask"),
    )


def format_preferences(chosen: DataFrame, rejected: DataFrame, pair: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """pair, n_prefix, prompt, chosen, chosen_mask, rejected and rejected_mask for every pair on either side."""
    rows = _turns(chosen, CHOSEN, pair, turn, role, text).unionByName(_turns(rejected, REJECTED, pair, turn, role, text))
    side = lambda kind: _side(F.filter("said", lambda x: x["kind"] == kind))
    return _formatted(_gathered(rows).select("pair", side(CHOSEN).alias("c"), side(REJECTED).alias("r")))


def format_with_borrowed_replies(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """format_preferences of each conversation against itself with another's last reply, for tables without pairs.

    The rejected side's last assistant turn holds the last reply (the greatest
    text of its last assistant turn) of the conversation whose number is one
    greater; it is missing where there is none. The sides share their other
    turns, so those are shuffled once for both.
    """
    own = _turns(turns, CHOSEN, conv, turn, role, text)
    # The greatest of (turn, text): combined before it is shuffled.
    last = own.where(F.col("role") == LOSS_ROLE).groupBy("pair").agg(F.max(F.struct("turn", "text")).alias("last"))
    lent = last.select((F.col("pair") - 1).alias("pair"), F.lit(None).cast("long").alias("turn"), F.lit(LOSS_ROLE).alias("role"), F.col("last.text").alias("text"), F.lit(LENT).alias("kind"))
    is_own = lambda x: x["kind"] == CHOSEN
    replies = F.filter("said", lambda x: is_own(x) & (x["role"] == LOSS_ROLE))
    found = (
        _gathered(own.unionByName(lent))
        .where(F.exists("said", is_own))
        .withColumn("at", F.array_max(F.transform(replies, lambda x: x["turn"])))
        .withColumn("lent", F.filter("said", lambda x: x["kind"] == LENT))
        .withColumn("said", F.filter("said", is_own))
    )
    kept = F.filter("said", lambda x: F.col("at").isNull() | (x["role"] != LOSS_ROLE) | (x["turn"] != F.col("at")))
    given = F.transform(F.filter("lent", lambda x: F.col("at").isNotNull()), lambda x: F.struct(F.col("at").alias("turn"), x["role"].alias("role"), x["text"].alias("text"), x["kind"].alias("kind")))
    return _formatted(found.select("pair", _side(F.col("said")).alias("c"), _side(F.concat(kept, given)).alias("r")))
