"""Sampled series: z-scores, envelopes, impulses, temporal bases and design columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neurolake.functions.columns import finite
from neurolake.operators.intervals import as_of, counted_in


def zscored(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """``z`` by population deviation over finite values; 0 for others and where the deviation is next to nothing."""
    good = F.when(finite(F.col(value)), F.col(value))
    stats = rows.groupBy(*keys).agg(F.avg(good).alias("_mean"), F.stddev_pop(good).alias("_sd"), F.count(good).alias("_n"))
    none = F.raise_error(F.lit("no finite value")).cast("double")
    z = F.when(F.col("_n") == 0, none).when(~finite(F.col(value)) | F.col(value).isNull() | (F.col("_sd") <= 1e-8), 0.0).otherwise((F.col(value) - F.col("_mean")) / F.col("_sd"))
    return rows.join(stats, keys).withColumn("z", z).drop("_mean", "_sd", "_n")


def envelope(rows: DataFrame, value: str, size: int, keys: list[str] = ()) -> DataFrame:
    """Least and greatest value of each whole bin of ``size`` ticks; ticks count from 0, and the last part bin falls out."""
    if size < 1:
        raise ValueError("a bin has at least one sample")
    parts = rows.withColumn("bin", F.floor(F.col("tick") / size)).groupBy(*keys, "bin")
    return parts.agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("_n")).where(F.col("_n") == size).select(*keys, (F.col("bin") * size).alias("start"), "low", "high")


def sample_hold(targets: DataFrame, samples: DataFrame, target_at: str, sample_at: str, value: str, keys: list[str]) -> DataFrame:
    """The last sample at or before each target; before the first, that one."""
    return as_of(targets, samples, target_at, sample_at, value, keys, clamp=True)


def impulses(bins: DataFrame, events: DataFrame, at: str, width: float, keys: list[str] = ()) -> DataFrame:
    """``x``: events in [start, start + width) of each bin; bins may overlap and leave gaps."""
    ends = bins.withColumn("_end", F.col("start") + width)
    return counted_in(events, ends, at, "start", "_end", [*keys, "start"], width, keys, "left").select(*bins.columns, F.col("n").cast("double").alias("x"))


def _cosine(phase: Column) -> Column:
    inside = F.abs(phase) <= 1
    return F.when(inside, 0.5 * (1 + F.cos(phase * math.pi))).otherwise(0.0)


def _columns_to_unit_sum(rows: DataFrame) -> DataFrame:
    total = F.sum("weight").over(Window.partitionBy("col"))
    return rows.withColumn("weight", F.when(total > 0, F.col("weight") / total).otherwise(F.col("weight")))


#: Kinds of bases of lags: cosines even in time, or even in log(1 + lag).
KINDS = ("raised_cosine", "log_raised_cosine")


def _known(kind: str) -> None:
    if kind not in KINDS:
        raise ValueError(f"a basis is one of {KINDS}, not {kind!r}")


def lag_knots(n_lags: int, n_cols: int, dt: float, offset: float = 0.0, kind: str = "raised_cosine") -> list[tuple[float, float]]:
    """Centre and width in seconds of each knot at and after the event: even in time, or in log(1 + lag)."""
    if n_lags <= 0 or n_cols <= 0:
        raise ValueError("lags and columns must be positive")
    _known(kind)
    step = lambda top: top / (n_cols - 1) if n_cols > 1 else 0.0
    if kind == "raised_cosine":
        d = step(n_lags * dt)
        return [(offset + k * d, d if n_cols > 1 else n_lags * dt) for k in range(n_cols)]
    d = step(math.log1p(n_lags - 1))
    if n_cols > 1 and d == 0:
        return [(0.0, dt)] * n_cols
    w = d if n_cols > 1 else 1.0
    half = lambda c: (math.expm1(c + w) - math.expm1(c - w)) * dt / 2
    return [(math.expm1(k * d) * dt + offset, max(half(k * d), 1.5 * dt)) for k in range(n_cols)]


def lead_knots(n_cols: int, lead: float) -> list[tuple[float, float]]:
    """Centre and width of each knot before the event, even over ``lead`` seconds."""
    if n_cols <= 0 or lead <= 0:
        raise ValueError("columns and lead must be positive")
    return [(-lead * k / n_cols, lead / n_cols) for k in range(n_cols, 0, -1)]


def knot_centres(n_lags: int, n_cols: int, dt: float, n_lead_cols: int = 0, lead: float = 0.0, offset: float = 0.0, kind: str = "raised_cosine") -> list[float]:
    before = [c for c, _ in lead_knots(n_lead_cols, lead)] if n_lead_cols and lead > 0 else []
    return before + [c for c, _ in lag_knots(n_lags, n_cols, dt, offset, kind)]


def whole_bins(seconds: float, dt: float, least: int = 0) -> int:
    """Bins of a time, rounded half to even; none for a time of zero or less if ``least`` is 0."""
    if seconds <= 0 and least == 0:
        return 0
    n = round(seconds / dt)
    if n < max(least, 1) and (least or seconds > 0) and n < 1:
        raise ValueError(f"{seconds} s is less than a bin of {dt} s")
    return n


def offset_bins(seconds: float, dt: float) -> int:
    return max(0, round(seconds / dt)) if seconds > 0 else 0


@dataclass(frozen=True)
class BasisOptions:
    """What a temporal basis is made with, checked when it is put together: rows and columns at and after the event, those before it, the seconds that these
    cover, and the seconds between the event and the first lag."""

    n_lags: int
    n_cols: int
    kind: str = "raised_cosine"
    n_leads: int = 0
    n_lead_cols: int = 0
    lead: float = 0.0
    offset: float = 0.0

    def __post_init__(self) -> None:
        whole = (self.n_lags, self.n_cols, self.n_leads, self.n_lead_cols)
        if any(isinstance(v, bool) or not isinstance(v, int) for v in whole):
            raise TypeError("rows and columns are whole numbers")
        if self.n_lags <= 0 or self.n_cols <= 0 or self.n_leads < 0 or self.n_lead_cols < 0:
            raise ValueError("lags and columns must be positive")
        if not (math.isfinite(self.lead) and math.isfinite(self.offset)):
            raise ValueError("seconds must be finite")
        _known(self.kind)
        if self.n_leads and (self.n_lead_cols <= 0 or self.lead <= 0):
            raise ValueError("rows before the event need columns and a lead in seconds")
        if not self.n_leads and self.n_lead_cols:
            raise ValueError("columns before the event need rows there")

    def rows(self, spark) -> DataFrame:
        return basis(spark, self.n_lags, self.n_cols, self.kind, self.n_leads, self.n_lead_cols, self.lead, self.offset)

    def centres(self, dt: float) -> list[float]:
        """Seconds of each column's knot, for bins of ``dt`` seconds."""
        return knot_centres(self.n_lags, self.n_cols, dt, self.n_lead_cols, self.lead, self.offset, self.kind)


def basis(spark, n_lags: int, n_cols: int, kind: str = "raised_cosine", n_leads: int = 0, n_lead_cols: int = 0, lead: float = 0.0, offset: float = 0.0) -> DataFrame:
    """``row, tau, col, weight`` of a temporal basis: raised cosines, even or logarithmic, each column summing to one.

    Without leads the axis is the lag, scaled to 0..1 or in log(1 + lag). With leads each bump lies on the whole axis from
    -``lead`` seconds on, lead columns first.
    """
    BasisOptions(n_lags, n_cols, kind, n_leads, n_lead_cols, lead, offset)  # checks them
    grid = spark.range(n_leads + n_lags).select(F.col("id").cast("int").alias("row"))
    if n_leads:
        dt = lead / n_leads
        knots = lead_knots(n_lead_cols, lead) + lag_knots(n_lags, n_cols, dt, offset, kind)
        x = (F.col("row") - n_leads) * F.lit(dt)
    elif kind == "raised_cosine":
        width = 1.0 / (n_cols - 1) if n_cols > 1 else 1.0
        knots = [(k * width if n_cols > 1 else 0.0, width) for k in range(n_cols)]
        x = F.col("row") / F.lit(float(n_lags - 1)) if n_lags > 1 else F.lit(0.0)
    else:
        top = math.log1p(n_lags - 1)
        width = top / (n_cols - 1) if n_cols > 1 else 1.0
        knots = [(k * width if n_cols > 1 else 0.0, width) for k in range(n_cols)]
        x = F.log1p(F.col("row").cast("double"))
        if width == 0:
            return grid.select("row", F.col("row").alias("tau"), F.explode(F.sequence(F.lit(0), F.lit(n_cols - 1))).alias("col"), F.when(F.col("row") == 0, 1.0).otherwise(0.0).alias("weight"))
    bumps = F.array(*[F.struct(F.lit(i).alias("col"), _cosine((x - c) / w).alias("weight")) for i, (c, w) in enumerate(knots)])
    rows = grid.select("row", (F.col("row") - n_leads).alias("tau"), F.explode(bumps).alias("b")).select("row", "tau", "b.*")
    return _columns_to_unit_sum(rows).select("row", "tau", "col", "weight")


def split_basis(spark, n_leads: int, n_lags: int, n_lead_cols: int, n_lag_cols: int, kind: str, lead: float = 0.0, offset: float = 0.0) -> DataFrame:
    """``basis`` over leads and lags, by the older order of arguments."""
    return basis(spark, n_lags, n_lag_cols, kind, n_leads, n_lead_cols, lead, offset)


def lead_basis(spark, n_leads: int, n_cols: int, lead: float) -> DataFrame:
    """Rows before the event only."""
    if n_leads <= 0:
        raise ValueError("leads must be positive")
    dt = lead / n_leads
    x = (F.col("row") - n_leads) * F.lit(dt)
    bumps = F.array(*[F.struct(F.lit(i).alias("col"), _cosine((x - c) / w).alias("weight")) for i, (c, w) in enumerate(lead_knots(n_cols, lead))])
    grid = spark.range(n_leads).select(F.col("id").cast("int").alias("row"))
    rows = grid.select("row", (F.col("row") - n_leads).alias("tau"), F.explode(bumps).alias("b")).select("row", "tau", "b.*")
    return _columns_to_unit_sum(rows).select("row", "tau", "col", "weight")


def design_columns(signal: DataFrame, weights: DataFrame, keys: list[str], shift: int = 0) -> DataFrame:
    """``y`` of each sample and basis column: the sum over lags of weight times the signal that long before.

    The signal is taken as zero outside; the basis is small and given to every task. Samples that are zero send nothing, so a
    sparse train of impulses costs its impulses. ``shift`` delays by that many samples (dead time, or a spike's own bin).
    """
    kernel = F.broadcast(weights.where("weight != 0").select("tau", "col", "weight"))
    sent = signal.where("x != 0").crossJoin(kernel).select(*keys, (F.col("tick") + F.col("tau") + shift).alias("tick"), "col", (F.col("x") * F.col("weight")).alias("_y"))
    sums = sent.groupBy(*keys, "tick", "col").agg(F.sum("_y").alias("_y"))
    dense = signal.select(*keys, "tick").crossJoin(F.broadcast(weights.select("col").distinct()))
    return dense.join(sums, [*keys, "tick", "col"], "left").select(*keys, "tick", "col", F.coalesce("_y", F.lit(0.0)).alias("y"))


def history_columns(spikes: DataFrame, weights: DataFrame, keys: list[str], shift: int = 0) -> DataFrame:
    """Design columns of the past: a spike never explains its own bin."""
    return design_columns(spikes, weights, keys, shift + 1)
