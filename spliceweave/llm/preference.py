"""Preference records: one prompt, and a chosen and a rejected completion with loss masks.

The prompt is the longest prefix of turns that the chosen and the rejected conversation share; it is rendered once. What follows
on either side is its completion; only what the assistant says in it is to be learnt from, which the spans mark.

The first turn that differs is found by a join of the two sides on (pair, turn) and a minimum, so no conversation is gathered for that. A
record holds one pair of conversations, as long as they are; nothing larger is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|{}|>\n", "\n<|end|>\n"


def render_turn(role: Column, text: Column) -> Column:
    """One turn as text; a null role or text counts as empty."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit(CLOSE))


def _side(turns: DataFrame, name: str) -> DataFrame:
    """One row a (pair, turn): of repeated turns the smallest role and text stays."""
    content = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.filter(F.col("pair_id").isNotNull() & F.col("turn").isNotNull())
    return rows.groupBy("pair_id", "turn").agg(F.min(content).alias(name))


def aligned_turns(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair_id, turn, chosen, rejected, shared): the turns of both sides; shared for those before the first difference."""
    both = _side(chosen, "chosen").join(_side(rejected, "rejected"), ["pair_id", "turn"], "full")
    first = both.filter(~F.col("chosen").eqNullSafe(F.col("rejected"))).groupBy("pair_id").agg(F.min("turn").alias("differs"))
    return both.join(first, "pair_id", "left").select(
        "pair_id", "turn", "chosen", "rejected", F.coalesce(F.col("turn") < F.col("differs"), F.lit(True)).alias("shared"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: render_turn(t["role"], t["text"])), "")


def _mask(turns: Column) -> Column:
    """[start, end) characters of assistant texts with their end mark, in the rendered turns."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        head = F.length(F.concat(F.lit("<|"), t["role"], F.lit("|>\n")))
        begin = acc["at"] + head
        end = begin + F.length(t["text"]) + len(CLOSE)
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row a pair: pair_id, prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans.

    Both inputs have pair_id, turn, role and text; other columns are ignored. Pairs that only one side has, and pairs whose sides are equal, teach nothing and give no
    row. Null roles and texts count as empty; rows without pair_id or turn are left out; of repeated turns one stays.
    A completion may be empty where one conversation is the beginning of the other.
    """
    turns = aligned_turns(chosen, rejected)
    item = F.struct("turn", "shared", "chosen", "rejected")
    records = turns.groupBy("pair_id").agg(
        F.array_sort(F.collect_list(item)).alias("turns"),
        F.max(F.col("chosen").isNotNull()).alias("has_chosen"), F.max(F.col("rejected").isNotNull()).alias("has_rejected"),
        F.max(~F.col("shared")).alias("differs"),
    ).filter("has_chosen AND has_rejected AND differs")

    def after(side: str) -> Column:
        rest = F.filter("turns", lambda t: ~t["shared"] & t[side].isNotNull())
        return F.transform(rest, lambda t: t[side])

    prompt = F.transform(F.filter("turns", lambda t: t["shared"]), lambda t: t["chosen"])
    parts = records.select("pair_id", prompt.alias("p"), after("chosen").alias("c"), after("rejected").alias("r"))
    return parts.select(
        "pair_id", F.size("p").alias("prompt_turns"), _rendered(F.col("p")).alias("prompt"), _rendered(F.col("c")).alias("chosen"),
        _rendered(F.col("r")).alias("rejected"), _mask(F.col("c")).alias("chosen_spans"), _mask(F.col("r")).alias("rejected_spans"),
    )


def repetition_pairs(conversations: DataFrame, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides from plain conversations. Chosen is the conversation up to its last answer. Rejected goes astray at one of
    the answers: that answer and all later ones repeat what was said just before it (the answer before it, else the turn before it), since a model
    should neither repeat itself nor echo. With a ``seed`` a digest of seed, id and turn chooses the answer, so the two sides share prefixes of every
    length; without one it is the last answer.

    Only answers with a turn before them can go astray; conversations without such an answer give no pair. Null texts count as empty;
    of repeated turns all rows are kept here, and one is used by ``format_preferences``.
    """
    rows = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text").filter("pair_id IS NOT NULL AND turn IS NOT NULL")
    answer = F.col("role") == "assistant"
    turns = rows.groupBy("pair_id", "turn").agg(F.max(F.coalesce(answer, F.lit(False))).alias("answer"))
    bounds = turns.groupBy("pair_id").agg(F.min("turn").alias("first"), F.max(F.when(F.col("answer"), F.col("turn"))).alias("last"))
    able = turns.join(bounds, "pair_id").filter("answer AND turn > first")
    digest = F.sha2(F.concat_ws(":", F.lit(seed).cast("string"), F.col("pair_id").cast("string"), F.col("turn").cast("string")), 256)
    astray = F.max("turn") if seed is None else F.min_by("turn", F.struct(digest, "turn"))
    picked = able.groupBy("pair_id").agg(astray.alias("astray"), F.max("last").alias("last"))
    until = rows.join(picked, "pair_id").filter(F.col("turn") <= F.col("last"))
    said = until.filter(F.col("turn") < F.col("astray")).groupBy("pair_id").agg(
        F.max(F.struct(F.coalesce(answer, F.lit(False)).alias("by_assistant"), "turn", F.coalesce("text", F.lit("")).alias("text"))).alias("before"))
    both = until.join(said, "pair_id")
    text = F.when((F.col("turn") >= F.col("astray")) & answer, F.col("before.text")).otherwise(F.col("text"))
    return both.select("pair_id", "turn", "role", "text"), both.select("pair_id", "turn", "role", text.alias("text"))
