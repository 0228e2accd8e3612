"""Tables behind figures: summaries of draws, ratios, histograms and limits of paired values, raster layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neurolake.cluster import stored
from neurolake.functions.columns import finite, log2_ratio, positive_finite


def linspace(low: float, high: float, n: int) -> list[float]:
    """``n`` bins' edges."""
    return [low + (high - low) * k / n for k in range(n)] + [high]


def percentiles(rows: DataFrame, value: str, keys: list[str], shares: list[float], accuracy: int = 10_000) -> DataFrame:
    """``*keys, q``: exact percentiles of each group's values, in the order of ``shares``, interpolated as Spark's ``percentile`` does; nulls don't count.

    A sketch brackets each percentile; then what lies below a bracket is only counted, the next values beside it are kept, and the few ten-thousandths of a group within it are
    counted by value and summed up to the wanted ranks. So no task holds a group's values. A bracket that misses its rank (a sketch doesn't) would be taken whole.
    """
    same = [f"_g{i}" for i in range(len(keys))]
    each = rows.select(*[F.col(k).alias(g) for k, g in zip(keys, same, strict=True)], F.col(value).cast("double").alias("_v")).where("_v is not null")
    near = [min(max(s + d / accuracy, 0.0), 1.0) for s in shares for d in (-3, 3)]
    marks = stored(each.groupBy(*same).agg(F.percentile_approx("_v", F.array(*[F.lit(x) for x in near]), F.lit(accuracy)).alias("_m"), F.count("*").alias("_n")))

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        named = right.withColumnsRenamed({g: f"{g}r" for g in same})  # a row a group
        return left.join(F.broadcast(named), [left[g].eqNullSafe(named[f"{g}r"]) for g in same]).drop(*[f"{g}r" for g in same])

    met, places = beside(each, marks), range(len(shares))
    low, high = (lambda i: F.get("_m", F.lit(2 * i))), (lambda i: F.get("_m", F.lit(2 * i + 1)))
    below = stored(met.groupBy(*same).agg(F.array(*[F.count_if(F.col("_v") < low(i)) for i in places]).alias("_below"), F.array(*[F.min(F.when(F.col("_v") > high(i), F.col("_v"))) for i in places]).alias("_above"), F.array(*[F.max(F.when(F.col("_v") < low(i), F.col("_v"))) for i in places]).alias("_under"), F.first("_n").alias("_n")))
    inside = F.filter(F.array(*[F.when((F.col("_v") >= low(i)) & (F.col("_v") <= high(i)), i) for i in places]), lambda i: i.isNotNull())
    counts = beside(met.drop("_n").select(*same, "_v", F.explode(inside).alias("_i")).groupBy(*same, "_i", "_v").agg(F.count("*").alias("_c")), below)
    ahead = F.get("_below", F.col("_i"))
    upto = ahead + F.sum("_c").over(Window.partitionBy(*same, "_i").orderBy("_v"))
    at = (F.col("_n") - 1) * F.get(F.array(*[F.lit(float(s)) for s in shares]), F.col("_i"))
    first, last = F.floor("_at"), F.ceil("_at")
    picked = counts.withColumn("_upto", upto).withColumn("_at", at).groupBy(*same, "_i", "_at", ahead.alias("_ahead"), F.get("_above", F.col("_i")).alias("_next"), F.get("_under", F.col("_i")).alias("_prior")).agg(
        F.min(F.when(F.col("_upto") > first, F.col("_v"))).alias("_a"), F.coalesce(F.min(F.when(F.col("_upto") > last, F.col("_v"))), F.when(F.max("_upto") == last, F.col("_next"))).alias("_b"),
    )
    picked = picked.withColumn("_a", F.when(F.col("_ahead") == first + 1, F.col("_prior")).otherwise(F.col("_a")))
    between = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((last - F.col("_at")) * F.col("_a") + (F.col("_at") - first) * F.col("_b"))
    picked = picked.where((F.col("_ahead") <= first + 1) & (F.col("_ahead") <= last) & F.col("_a").isNotNull() & F.col("_b").isNotNull()).groupBy(*same).agg(F.array_sort(F.collect_list(F.struct("_i", between.alias("_q")))).alias("_s"))
    done = stored(picked.where(F.size("_s") == len(shares)).select(*same, F.transform("_s", lambda x: x["_q"]).alias("q")))
    if done.count() < marks.count():
        missed = each.join(F.broadcast(done.drop("q").withColumnsRenamed({g: f"{g}r" for g in same})), [F.col(g).eqNullSafe(F.col(f"{g}r")) for g in same], "left_anti")
        done = done.unionByName(missed.groupBy(*same).agg(F.percentile("_v", F.array(*[F.lit(float(s)) for s in shares])).alias("q")))
    return done.withColumnsRenamed(dict(zip(same, keys, strict=True)))


def forest(draws: DataFrame, value: str, keys: list[str], percent: float = 95.0) -> DataFrame:
    """Median and central interval of each group's draws without NaN, and ``place`` (from 0) by the median, ties by the keys.

    A row a group is numbered in one task: a figure has as many rows as groups."""
    tail = (100.0 - percent) / 200.0
    v = F.when(~F.isnan(value), F.col(value))
    out = percentiles(draws.select(*keys, v.alias("_draw")), "_draw", keys, [tail, 0.5, 1.0 - tail]).select(*keys, F.col("q")[0].alias("low"), F.col("q")[1].alias("median"), F.col("q")[2].alias("high"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("median", *keys)) - 1)


def forest_limit(summary: DataFrame) -> DataFrame:
    """One row: 1.1 times the farthest bound from zero."""
    return summary.agg((1.1 * F.max(F.greatest(F.abs("low"), F.abs("high")))).alias("limit"))


def ratios(pairs: DataFrame) -> DataFrame:
    """log2 of y over x for pairs that are both positive and finite."""
    return pairs.where(positive_finite(F.col("x"), F.col("y"))).withColumn("log2_ratio", log2_ratio(F.col("y"), F.col("x")))


def padded_limits(rows: DataFrame, value: str, explicit: tuple[float, float] | None = None, pad: float = 0.06, flat: float = 1.0) -> DataFrame:
    """One row ``low, high``: given, or the extremes of finite values and a share of their span; around one value alone ``flat``."""
    if explicit is not None:
        return rows.sparkSession.createDataFrame([(float(explicit[0]), float(explicit[1]))], "low double, high double")
    good = F.when(finite(F.col(value)), F.col(value))
    span = F.col("b") - F.col("a")
    margin = F.when(span > 0, span * pad).otherwise(flat)
    return rows.agg(F.min(good).alias("a"), F.max(good).alias("b")).select((F.col("a") - margin).alias("low"), (F.col("b") + margin).alias("high"))


def scatter_limits(pairs: DataFrame, both=None, xlim=None, ylim=None, pad: float = 0.06) -> DataFrame:
    """One row ``lo_x, hi_x, lo_y, hi_y``; ``both`` holds for both axes and goes before the others."""
    x = padded_limits(pairs, "x", both or xlim, pad).select(F.col("low").alias("lo_x"), F.col("high").alias("hi_x"))
    y = padded_limits(pairs, "y", both or ylim, pad).select(F.col("low").alias("lo_y"), F.col("high").alias("hi_y"))
    return x.crossJoin(F.broadcast(y))  # one row each


def log_limits(pairs: DataFrame, pad: float = 0.08) -> DataFrame:
    """One row of limits padded in decades; values of zero or less are an error."""
    def log(c: str) -> Column:
        return F.when(F.col(c) > 0, F.log10(c)).otherwise(F.raise_error(F.lit("values must be positive")).cast("double"))

    logs = pairs.select(log("x").alias("x"), log("y").alias("y"))
    lim = {c: padded_limits(logs, c, None, pad, 0.1) for c in "xy"}
    both = lim["x"].toDF("a", "b").crossJoin(F.broadcast(lim["y"].toDF("c", "d")))  # one row each
    return both.select(*[F.pow(F.lit(10.0), F.col(c)).alias(n) for c, n in zip("abcd", ("lo_x", "hi_x", "lo_y", "hi_y"), strict=True)])


def unity_segment(limits: DataFrame) -> DataFrame:
    """Where the line y = x crosses the panel."""
    return limits.select(F.greatest("lo_x", "lo_y").alias("low"), F.least("hi_x", "hi_y").alias("high"))


def histogram(rows: DataFrame, value: Column, low: float, high: float, n: int) -> DataFrame:
    """Dense counts of ``n`` even bins of [low, high], the last closed."""
    edges = linspace(low, high, n)
    place = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= value)) - 1
    b = F.when((value >= low) & (value < high), place).when(value == high, n - 1)
    counts = rows.select(b.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("count"))
    return _dense(rows, counts, 0, n - 1)


def _dense(rows: DataFrame, counts: DataFrame, first: int, last: int) -> DataFrame:
    every = rows.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def difference_bars(pairs: DataFrame, half_extent: float, n: int, overflow: bool = True) -> DataFrame:
    """Dense counts of y - x over [-h, h]; with ``overflow`` bin -1 counts below and bin ``n`` above."""
    d = F.col("y") - F.col("x")
    edges = linspace(-half_extent, half_extent, n)
    place = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= d)) - 1
    b = F.when((d >= -half_extent) & (d < half_extent), place).when(d == half_extent, n - 1)
    if overflow:
        b = F.when(d < -half_extent, -1).when(d > half_extent, n).otherwise(b)
    counts = pairs.select(b.cast("int").alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("count"))
    return _dense(pairs, counts, -1 if overflow else 0, n if overflow else n - 1)


def marginals(pairs: DataFrame, limits: tuple[float, float, float, float], n: int) -> DataFrame:
    """Counts of x and of y within closed limits, and the scale both share."""
    lo_x, hi_x, lo_y, hi_y = limits
    x = histogram(pairs.where(F.col("x").between(lo_x, hi_x)), F.col("x"), lo_x, hi_x, n).withColumn("axis", F.lit("x"))
    y = histogram(pairs.where(F.col("y").between(lo_y, hi_y)), F.col("y"), lo_y, hi_y, n).withColumn("axis", F.lit("y"))
    both = x.unionByName(y)
    top = both.agg((F.max("count") * 1.02).alias("scale"))
    return both.crossJoin(F.broadcast(top))  # one row


def row_offsets(y0: Column, height: Column, n: Column, half: Column) -> Column:
    """Centres of ``n`` raster rows in a band: none, its middle, or even within its inset."""
    low = y0 + half
    high = F.greatest(y0 + height - half, low)
    many = F.transform(F.sequence(F.lit(0), n - 1), lambda i: low + (high - low) * i / (n - 1))
    return F.when(n <= 0, F.array().cast("array<double>")).when(n == 1, F.array(y0 + height / 2)).otherwise(many)


def line_length(height: Column, a: Column, b: Column, cap: Column) -> Column:
    """Height of a raster's marks in two equal bands of ``a`` and ``b`` rows."""
    rows = F.greatest(a, b)
    return F.when(rows <= 1, F.least(cap, height * 0.28)).otherwise(F.least(cap, 0.82 * height / rows))


def grid_ratios(xspan: float, yspan: float, height_ratio: float, width_ratio: float) -> tuple[float, float, float, float]:
    """Relative sizes of a panel and its margins when both axes have one scale."""
    if xspan <= 0 or yspan <= 0:
        raise ValueError("spans must be positive")
    return max(height_ratio * xspan / yspan, 1e-3), 1.0, 1.0, max(width_ratio * yspan / xspan, 1e-3)


def diagonal_anchor(limits: tuple[float, float, float, float], enabled: bool, centre: float | None = None) -> float | None:
    """Where on y = x a difference inset stands: as given, or the middle of the line's stretch in the panel."""
    if not enabled and centre is None:
        return None
    if centre is not None:
        return float(centre)
    low, high = max(limits[0], limits[2]), min(limits[1], limits[3])
    return (low + high) / 2 if high > low else None


def point_at_difference(d: float, s: float) -> tuple[float, float]:
    return s - d / 2, s + d / 2


def inset_bar_corners(d0: float, d1: float, s: float, height: float) -> list[tuple[float, float]]:
    """A bar's corners on the diagonal: its base at ``s``, its top ``height`` further along."""
    return [point_at_difference(d, t) for d, t in ((d0, s), (d1, s), (d1, s + height), (d0, s + height))]


def inset_default_height(half_extent: float, n_bins: int = 0) -> float:
    """Height of the tallest bar: 0.85 of a bin if the differences' extent held ten, however many bins there are."""
    return 2.0 * half_extent / 10 * 0.85


def tick_label(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else f"{x:g}"


def same_limits(a: tuple[float, float], b: tuple[float, float]) -> bool:
    return all(abs(p - q) <= 1e-12 + 1e-5 * abs(q) for p, q in zip(a, b, strict=True))


def microvolts_per_unit(low: float, high: float) -> float:
    """1000 where an axis is so small that it must be millivolts."""
    return 1000.0 if max(abs(low), abs(high)) < 3 else 1.0
