"""Digital lines: edges, resting state and pulses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurolake.functions.columns import bit
from neurolake.operators.intervals import numbered, with_previous


def line_states(words: DataFrame, line: int) -> DataFrame:
    """``hi`` (0/1) of one line of packed words."""
    return words.withColumn("hi", bit(F.col("word"), line))


def rests_low(states: DataFrame, keys: list[str]) -> DataFrame:
    """Per recording whether the line rests low, so that events begin with a rise; a tie counts as low."""
    return states.groupBy(*keys).agg((F.sum("hi") <= F.count("*") - F.sum("hi")).alias("rests_low"))


def edges(states: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Changes of ``hi``: the first sample after each, with ``direction`` 1 or -1. The first sample is no edge; other values fail."""
    ok = F.when(F.col("hi").isin(0, 1), F.col("hi")).otherwise(F.raise_error(F.lit("states must be 0 or 1")).cast("int"))
    stepped = with_previous(states.withColumn("hi", ok), F.col("hi"), "tick", keys)
    return stepped.where("hi != previous").select(*keys, "tick", (F.col("hi") - F.col("previous")).alias("direction"))


def _causal(edge_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each edge but the first with the one before, if that goes the other way, and the direction of that."""
    before = with_previous(edge_rows.select(*keys, "tick", "direction"), F.struct("tick", "direction"), "tick", keys)
    paired = before.where(F.col("direction") == -F.col("previous.direction"))
    return paired.select(*keys, F.col("previous.tick").alias("onset_tick"), F.col("tick").alias("offset_tick"), F.col("previous.direction").alias("_sign"))


def pulses(edge_rows: DataFrame, keys: list[str] = (), rising: bool = True, mode: str = "causal") -> DataFrame:
    """Onsets paired with offsets.

    ``causal``: an onset with the next edge, which is its offset. ``reference``: by position, after dropping the first onset if
    there are more onsets and the last offset if there are more offsets.
    """
    sign = 1 if rising else -1
    keys = list(keys)
    if mode == "causal":
        return _causal(edge_rows, keys).where(F.col("_sign") == sign).drop("_sign")
    on, off = (edge_rows.where(F.col("direction") == d).select(*keys, F.col("tick").alias(c)) for d, c in ((sign, "onset_tick"), (-sign, "offset_tick")))
    count = lambda rows, name: rows.groupBy(*keys).agg(F.count("*").alias(name))
    sizes = count(on, "n_on").join(count(off, "n_off"), keys) if keys else count(on, "n_on").crossJoin(F.broadcast(count(off, "n_off")))  # one row a key
    on = numbered(on, "onset_tick", keys, name="i")
    on = on.join(sizes, keys) if keys else on.crossJoin(F.broadcast(sizes))
    on = on.withColumn("j", F.col("i") - F.when(F.col("n_on") > F.col("n_off"), 1).otherwise(0))
    return on.join(numbered(off, "offset_tick", keys, name="j"), [*keys, "j"]).select(*keys, "onset_tick", "offset_tick")


def line_pulses(words: DataFrame, line: int, keys: list[str] = (), rising: bool | None = None, mode: str = "causal") -> DataFrame:
    """Pulses of a line; without ``rising`` each recording's resting state says which edges begin them."""
    states = line_states(words, line)
    found = edges(states, keys)
    if rising is not None:
        return pulses(found, keys, rising, mode)
    rest = rests_low(states, list(keys)) if keys else states.agg((F.sum("hi") <= F.count("*") - F.sum("hi")).alias("rests_low"))
    if mode == "causal":
        both = _causal(found, list(keys)).withColumn("_up", F.col("_sign") == 1).drop("_sign")
    else:
        up = pulses(found, keys, True, mode).withColumn("_up", F.lit(True))
        both = up.unionByName(pulses(found, keys, False, mode).withColumn("_up", F.lit(False)))
    both = both.join(rest, list(keys)) if keys else both.crossJoin(F.broadcast(rest))  # one row
    return both.where("_up = rests_low").drop("_up", "rests_low")
