"""Joins of points with intervals and with their neighbours in time, and what needs the row before."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neurolake.cluster import stored


def range_join(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, width: float, keys: list[str] = (), closed: str = "left") -> DataFrame:
    """Pairs of a point and an interval that holds it, as an equi-join of buckets ``width`` wide.

    ``closed``: which ends belong to the interval: both, left, or neither. An interval is repeated for each bucket it touches, a
    point lies in one, so no pair comes twice. ``width`` should be near the usual length of an interval.
    """
    w = F.lit(width)
    left = points.withColumn("_bucket", F.floor(F.col(at) / w))
    right = intervals.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / w), F.floor(F.greatest(F.col(high), F.col(low)) / w))))
    above = F.col(at) > F.col(low) if closed == "neither" else F.col(at) >= F.col(low)
    below = F.col(at) <= F.col(high) if closed == "both" else F.col(at) < F.col(high)
    return left.join(right, [*keys, "_bucket"]).where(above & below).drop("_bucket")


def counted_in(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, ids: list[str], width: float, keys: list[str] = (), closed: str = "both") -> DataFrame:
    """Each interval with the number ``n`` of its points, zero included. An interval that ends before it starts is an error."""
    wrong = F.raise_error(F.lit("an interval ends before it starts")).cast(intervals.schema[high].dataType)
    intervals = intervals.withColumn(high, F.when(F.col(high) < F.col(low), wrong).otherwise(F.col(high)))
    hits = range_join(points.select(*keys, at), intervals.select(*dict.fromkeys([*ids, *keys, low, high])), at, low, high, width, keys, closed)
    counts = hits.groupBy(*ids).agg(F.count(at).alias("n"))
    return intervals.join(counts, ids, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


#: Quantiles of a sketch: a key has one block more at most.
QUANTILES = 255


def busy_keys(rows: DataFrame, at: str, keys: list[str]) -> list[tuple]:
    """Keys that hold more rows than a task's share, each with borders that cut it into shares, from a sketch of its times.

    There are fewer of them than tasks, so they may come to the driver. One job counts all rows and sketches the keys.
    """
    seen, tasks = Observation(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks = F.array(*[F.lit((i + 1) / (QUANTILES + 1)) for i in range(QUANTILES)])
    each = rows.observe(seen, F.count(F.lit(1)).alias("rows")).groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx(at, marks, 1000).alias("_q"))
    top = each.orderBy(F.desc("_n")).limit(tasks).collect()
    if not top:
        return []
    share, out = max(1, -(-seen.get["rows"] // tasks)), []
    for r in top:
        n = min(QUANTILES + 1, -(-r["_n"] // share))
        if n > 1 and r["_q"]:
            out.append((*[r[k] for k in keys], sorted({r["_q"][i * (QUANTILES + 1) // n - 1] for i in range(1, n)})))
    return out


def blocks(rows: DataFrame, at: str, keys: list[str], width: int | None = None, busy: list[tuple] | None = None, name: str = "_block") -> DataFrame:
    """Rows with the block of time, within their key, that they lie in: rising in ``at``, equal times together.

    A key with few rows is one block. A key with more than a task's share is cut by the quantiles of its times into as many as it
    holds shares, so blocks follow the rows whatever their times are counted in and wherever they crowd. ``width``: blocks of a fixed width instead;
    ``busy``: keys and borders that are known.
    """
    if width is not None:
        return rows.withColumn(name, F.floor(F.col(at) / width))
    busy = busy_keys(rows, at, keys) if busy is None else busy
    if not busy:
        return rows.withColumn(name, F.lit(0).cast("long"))
    place = lambda borders: F.size(F.filter(borders, lambda b: b <= F.col(at))).cast("long")
    if not keys:
        return rows.withColumn(name, place(F.array(*[F.lit(b) for b in busy[0][0]]).cast(T.ArrayType(rows.schema[at].dataType))))
    kinds = T.StructType([T.StructField(f"_k{i}", rows.schema[k].dataType) for i, k in enumerate(keys)] + [T.StructField("_borders", T.ArrayType(rows.schema[at].dataType))])
    table = F.broadcast(rows.sparkSession.createDataFrame(busy, kinds))  # fewer rows than tasks
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    out = rows.join(table, same, "left").withColumn(name, F.when(F.col("_borders").isNull(), F.lit(0).cast("long")).otherwise(place(F.col("_borders"))))
    return out.drop("_borders", *[f"_k{i}" for i in range(len(keys))])


def with_previous(rows: DataFrame, value: Column, order: str, keys: list[str] = (), block: int | None = None, name: str = "previous", second: str | None = None) -> DataFrame:
    """``value`` of the row before in ``order``, within ``keys``, without sorting a busy key in one task; ``second``: also of the one before that.

    Rows are sorted in ``blocks``; a block's first rows take the last values of the blocks before, from a table of one row a block.
    """
    keys = list(keys)
    rows = blocks(rows.withColumn("_value", value), order, keys, block)
    inner = Window.partitionBy(*keys, "_block").orderBy(order)
    last = F.max_by(F.struct("_value", "_lag"), F.struct(order, "_place"))
    rows = rows.withColumn("_lag", F.lag("_value").over(inner)).withColumn("_place", F.row_number().over(inner))
    across = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_block")
    ends = rows.groupBy(*keys, "_block").agg(last.alias("_last"), F.count("*").alias("_n"))
    ends = ends.withColumn("_carried", F.lag("_last").over(across)["_value"])
    ends = ends.withColumn("_carried2", F.when(F.lag("_n").over(across) > 1, F.lag("_last").over(across)["_lag"]).otherwise(F.lag("_last", 2).over(across)["_value"])).drop("_last", "_n")
    joined = _with_ends(rows.withColumn("_lag2", F.lag("_value", 2).over(inner)), ends, keys)
    out = joined.withColumn(name, F.when(F.col("_place") == 1, F.col("_carried")).otherwise(F.col("_lag")))
    if second:
        out = out.withColumn(second, F.when(F.col("_place") == 1, F.col("_carried2")).when(F.col("_place") == 2, F.col("_carried")).otherwise(F.col("_lag2")))
    return out.drop("_value", "_block", "_lag", "_lag2", "_place", "_carried", "_carried2")


def numbered(rows: DataFrame, order: str, keys: list[str] = (), block: int | None = None, name: str = "n") -> DataFrame:
    """Rows with their number from 1 in ``order``, within ``keys``: counted in ``blocks``, of which only a row each is summed in one task."""
    keys = list(keys)
    rows = blocks(rows, order, keys, block)
    counts = rows.groupBy(*keys, "_block").agg(F.count("*").alias("_c"))
    across = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_ahead", F.coalesce(F.sum("_c").over(across), F.lit(0))).drop("_c")
    inner = Window.partitionBy(*keys, "_block").orderBy(order)
    out = _with_ends(rows.withColumn("_n", F.row_number().over(inner)), counts, keys)
    return out.withColumn(name, F.col("_n") + F.col("_ahead")).drop("_block", "_n", "_ahead")


def _with_ends(rows: DataFrame, ends: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beside their block's row of ``ends``; keys and times may be null."""
    same = [*keys, "_block"]
    ends = ends.withColumnsRenamed({k: f"_e{i}" for i, k in enumerate(same)})
    on = [rows[k].eqNullSafe(ends[f"_e{i}"]) for i, k in enumerate(same)]
    return rows.join(ends, on, "left").drop(*[f"_e{i}" for i in range(len(same))])


def as_of(targets: DataFrame, sources: DataFrame, target_at: str, source_at: str, value: str, keys: list[str], clamp: bool = False, block: int | None = None) -> DataFrame:
    """Each target with ``value`` of the last source at or before it, per ``keys``; of equal source times the last by value.

    ``clamp``: targets before the first source take that one's value, else null. No pairs are made: sources and targets are sorted
    together in ``blocks``, so a key that holds much of the table is many tasks, and a block takes what the blocks before it
    end with from a table of one row a block.
    """
    s = sources.select(*keys, F.col(source_at).alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_value"))
    t = targets.select(*keys, F.col(target_at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(sources.schema[value].dataType).alias("_value"), F.struct(*targets.columns).alias("_row"))
    both = blocks(t.unionByName(s, allowMissingColumns=True), "_at", keys, block)
    held = F.last("_value", ignorenulls=True).over(Window.partitionBy(*keys, "_block").orderBy("_at", "_side", "_value").rowsBetween(Window.unboundedPreceding, 0))
    own = both.groupBy(*keys, "_block")
    known = F.when(F.col("_value").isNotNull(), F.struct("_at", "_value"))
    ends = own.agg(F.max(known).alias("_last"), F.min(known).alias("_first"))
    line = Window.partitionBy(*keys).orderBy("_block")
    ends = ends.withColumn("_carried", F.last("_last", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))["_value"])
    ends = ends.withColumn("_begin", F.min("_first").over(Window.partitionBy(*keys))["_value"]).drop("_last", "_first")
    out = _with_ends(both.withColumn("_held", held).where("_side = 1"), ends, keys)
    return out.select("_row.*", F.coalesce("_held", "_carried", *(["_begin"] if clamp else [])).alias(value))


def nearest(targets: DataFrame, sources: DataFrame, target_at: str, source_at: str, keys: list[str], block: int | None = None) -> DataFrame:
    """Each target with the nearest source's time ``near``; ties go to the earlier one. Sorted in ``blocks``, as ``as_of`` is."""
    s = sources.select(*keys, F.col(source_at).alias("_at"), F.lit(1).alias("_src")).distinct()
    t = targets.select(*keys, F.col(target_at).alias("_at"), F.lit(0).alias("_src"), F.struct(*targets.columns).alias("_row"))
    both = blocks(t.unionByName(s, allowMissingColumns=True), "_at", keys, block)
    mark = F.when(F.col("_src") == 1, F.col("_at"))
    inner, so_far = Window.partitionBy(*keys, "_block"), (Window.unboundedPreceding, 0)
    # a frame that ends at the last row would be read anew for each row; the same order backwards isn't
    both = both.withColumn("_in_before", F.last(mark, ignorenulls=True).over(inner.orderBy("_at", F.desc("_src")).rowsBetween(*so_far)))
    both = both.withColumn("_in_after", F.last(mark, ignorenulls=True).over(inner.orderBy(F.desc("_at"), "_src").rowsBetween(*so_far)))
    line, earlier = Window.partitionBy(*keys), (Window.unboundedPreceding, -1)
    ends = both.select(*keys, "_block", mark.alias("_mark")).groupBy(*keys, "_block").agg(F.max("_mark").alias("_max"), F.min("_mark").alias("_min"))
    ends = ends.withColumn("_from_before", F.last("_max", ignorenulls=True).over(line.orderBy("_block").rowsBetween(*earlier)))
    ends = ends.withColumn("_from_after", F.last("_min", ignorenulls=True).over(line.orderBy(F.desc("_block")).rowsBetween(*earlier))).drop("_max", "_min")
    out = _with_ends(both.where("_src = 0"), ends, keys)
    before, after = F.coalesce("_in_before", "_from_before"), F.coalesce("_in_after", "_from_after")
    back = F.col("_at") - before <= after - F.col("_at")
    return out.select("_row.*", F.when(after.isNull() | back, before).otherwise(after).alias("near"))


def _tails(gap: int, at: str):
    """Of a block's times: the last that is kept in it, if one is kept."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(at, ignore_index=True)
        t = b[at].to_numpy()
        after, tail = np.searchsorted(t, t + gap), np.arange(len(t))
        for i in range(len(t) - 1, -1, -1):
            if after[i] < len(t):
                tail[i] = tail[after[i]]
        return b.assign(_tail=t[tail])

    return run


def _walk(gap: int, at: str):
    """The times of a block that are kept, from the one that is the first of them."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(at, ignore_index=True)
        t, keep = b[at].to_numpy(), []
        i = int(np.argmax(b["_entry"].to_numpy())) if b["_entry"].any() else len(t)
        while i < len(t):
            keep.append(i)
            i = int(np.searchsorted(t, t[i] + gap))
        return b.iloc[keep].drop(columns=["_block", "_entry"])

    return run


def thinned(events: DataFrame, at: str, half_window: int, keys: list[str], block: int | None = None) -> DataFrame:
    """Events kept greedily from the earliest: each at least two half windows after the last kept. Equal times collapse.

    What is kept depends on all that was kept before; but of a block of time only the first kept event matters, and what follows it there, and
    where that leads. So blocks are solved side by side for each event as their first; the events that follow on a block's last ones are found
    by one as-of join; and from a key's first event on those that are reached are found by pointer doubling over these few, in as
    many rounds as the number of blocks has bits. Then each block is walked once. Keys of one block need none of that.
    """
    if half_window <= 0:
        raise ValueError("the window must be positive")
    gap, keys = 2 * half_window, list(keys)
    times = events.select(*keys, at).distinct()
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in times.schema.fields)
    busy = busy_keys(times, at, keys) if block is None else []
    cut = blocks(times, at, keys, block, busy)
    if block is None and not busy:
        alone = cut.withColumn("_entry", F.col(at) == F.min(at).over(Window.partitionBy(*keys, "_block")))
        return alone.groupBy(*keys, "_block").applyInPandas(_walk(gap, at), kinds)
    each = stored(cut.groupBy(*keys, "_block").applyInPandas(_tails(gap, at), f"{kinds}, _block long, _tail {times.schema[at].dataType.simpleString()}"))
    begin = each.groupBy(*keys).agg(F.min(at).alias(at))
    back = lambda rows, c, name: rows.withColumn(name, -F.col(c))
    tails = back(each.select(*keys, "_tail", (F.col("_tail") + gap).alias("_goal")).distinct(), "_goal", "_from")
    follow = as_of(tails, back(each.select(*keys, F.col(at).alias("_next"), F.col(at).alias("_at0")), "_at0", "_place").drop("_at0"), "_from", "_place", "_next", keys, block=None)
    follow = stored(follow.where("_next is not null").select(*keys, "_tail", "_next"))
    some = begin.unionByName(follow.select(*keys, F.col("_next").alias(at))).distinct()
    jump = stored(some.join(each, [*keys, at]).join(follow, [*keys, "_tail"]).select(*keys, at, "_next"))
    reached = begin
    while True:
        more = stored(reached.join(jump, [*keys, at]).select(*keys, F.col("_next").alias(at)).join(reached, [*keys, at], "left_anti"))
        if not more.limit(1).count():
            break
        reached = stored(reached.unionByName(more).distinct())
        on = jump.select(*keys, F.col(at).alias("_next"), F.col("_next").alias("_after"))
        jump = stored(jump.join(on, [*keys, "_next"]).select(*keys, at, F.col("_after").alias("_next")))
    entered = each.drop("_tail").join(reached.withColumn("_in", F.lit(True)), [*keys, at], "left").withColumn("_entry", F.coalesce("_in", F.lit(False))).drop("_in")
    return entered.groupBy(*keys, "_block").applyInPandas(_walk(gap, at), kinds)
