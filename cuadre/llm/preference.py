"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions.

The prompt is the longest common prefix of turns (same role and text), rendered once. What each conversation has
beyond it is its completion; the mask marks, as (start, length) in characters of the completion, the texts of the
turns that are trained: those of the assistant, with their end mark. DataFrame functions only; no Python.

``pairs_of`` makes pairs of a table of turns: conversations with the same first turn are alternatives, in the order of
their ids; each is chosen once, against the next one as rejected (the last against the first). A conversation alone
with its first turn is paired with itself without its last assistant turn. Ranks inside a group of alternatives come
from range-partitioned rows (``common.ranked``), so a group may hold any share of the table.

Null text counts as empty; a null role is a role of its own, rendered empty and not trained. Turns are ordered by turn
number (null first), then role and text; a repeated turn row stays in the conversation. Nothing tells which turns without
conversation id belong together, and any share of the table may have none: each is a conversation of its own, with the
null id. Identical conversations have empty completions. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuadre.llm.common import ranked, stage

#: Fixed values of the template.
OPEN, AFTER_ROLE, CLOSE = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns array<struct<role, text>>) with each conversation's turns in order; a turn without id is one."""
    q = lambda c: F.col(f"`{c}`")
    rows = turns.select(q(id_col).alias("conv_id"), F.struct(q(turn_col).alias("turn"), q(role_col).cast("string").alias("role"),
                                                             F.coalesce(q(text_col), F.lit("")).alias("text")).alias("t"))
    got = rows.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    got = got.unionByName(rows.where(F.col("conv_id").isNull()).select("conv_id", F.array("t").alias("t")))
    return got.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns from the first on are the same in both."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, False)
    return F.when(first > 0, first.cast("int") - 1).otherwise(n)


def head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("")), F.lit(AFTER_ROLE))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), t["text"], F.lit(CLOSE))), "")


def mask(turns: Column) -> Column:
    """(start, length) of what is trained in the rendered turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc, t):
        begin = acc["at"] + F.length(head(t))
        length = F.length(t["text"]) + len(CLOSE)
        span = F.array(F.struct(begin.cast("int").alias("start"), length.cast("int").alias("length")))
        trained = F.coalesce(t["role"] == TRAINED, F.lit(False))
        return F.struct((begin + length).cast("int").alias("at"), F.when(trained, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_pairs(pairs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """From (``keep``, chosen, rejected): common turns, prompt, and text and mask of either completion."""
    out = pairs.withColumn("n_common", common_turns(F.col("chosen"), F.col("rejected")))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.size(c))
    return out.select(*keep, "n_common", rendered(F.slice("chosen", F.lit(1), F.col("n_common"))).alias("prompt"),
                      rendered(rest("chosen")).alias("chosen"), mask(rest("chosen")).alias("chosen_mask"),
                      rendered(rest("rejected")).alias("rejected"), mask(rest("rejected")).alias("rejected_mask"))


def without_last_answer(turns: Column) -> Column:
    """The turns before the last one of the assistant; all but the last if it has none."""
    back = F.array_position(F.reverse(F.transform(turns, lambda t: F.coalesce(t["role"] == TRAINED, F.lit(False)))), True)
    cut = F.when(back > 0, F.size(turns) - back).otherwise(F.size(turns) - 1)
    return F.slice(turns, F.lit(1), cut.cast("int"))


def pairs_of(turns: DataFrame, **columns) -> DataFrame:
    """(chosen_id, rejected_id, chosen, rejected) for every conversation of a table of turns."""
    convs = stage(conversations(turns, **columns).withColumn("prompt_key", F.sha2(F.to_json(F.struct(F.col("turns")[0].alias("t"))), 256))
                  .withColumn("row", F.monotonically_increasing_id()), "conversations")
    place = ranked(convs.select("prompt_key", "conv_id", "row"), ["conv_id", "row"], "prompt_key", name="alternatives")
    size = place.groupBy("prompt_key").agg(F.max("rank").alias("size"))
    place = stage(place.join(size, "prompt_key"), "places")
    after = place.select("prompt_key", F.col("rank").alias("next"), F.col("row").alias("other"))
    pair = place.withColumn("next", F.col("rank") % F.col("size") + 1).join(after, ["prompt_key", "next"]).select("row", "other", "size")
    chosen = convs.select("row", F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen"))
    rejected = convs.select(F.col("row").alias("other"), F.col("conv_id").alias("rejected_id"), F.col("turns").alias("rejected"))
    both = pair.join(chosen, "row").join(rejected, "other")
    return both.select("chosen_id", "rejected_id", "chosen", F.when(F.col("size") == 1, without_last_answer(F.col("chosen"))).otherwise(F.col("rejected")).alias("rejected"))
