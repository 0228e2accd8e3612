"""Column expressions on ticks, values and arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
MAD_TO_SD = 1.4826


def tick_of(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def ticks_from_seconds(seconds: Column, fs: float, rounding: str = "half_even") -> Column:
    """Ticks of seconds: rounded half to even, or cut off towards zero (``rounding="truncate"``)."""
    x = seconds * F.lit(float(fs))
    return (F.rint(x) if rounding == "half_even" else x).cast("long")


def finite(x: Column) -> Column:
    """False for NaN and infinities; NaN compares as the greatest value."""
    return F.abs(x) < INF


def positive_finite(x: Column, y: Column) -> Column:
    """Whether both of a pair are above zero and finite."""
    ok = (x > 0) & (x < INF) & (y > 0) & (y < INF)
    return F.coalesce(ok, F.lit(False))


def log2_ratio(y: Column, x: Column) -> Column:
    return F.log2(y / x)


def rate_hz(count: Column, duration_ticks: Column, fs: float) -> Column:
    """Events a second; a duration of zero or less, or a negative count, is an error."""
    bad = (duration_ticks <= 0) | (count < 0)
    return F.when(bad, F.raise_error(F.lit("duration must be positive and count not negative")).cast("double")).otherwise(
        count.cast("double") * F.lit(float(fs)) / duration_ticks.cast("double")
    )


def bit(word: Column, line: int) -> Column:
    """0 or 1: the state of a digital line in a packed word."""
    if not 0 <= line <= 15:
        raise ValueError(f"a word has lines 0 to 15, not {line}")
    return F.getbit(word, F.lit(line)).cast("int")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a computed value, as a lambda's variable: a computed column that is named inside a lambda is computed anew for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def median_of(values: Column) -> Column:
    """Exact median of an array without nulls: the mean of the two middle values."""
    at = lambda s, n: F.get(s, F.floor(n).cast("int"))
    return once(F.sort_array(values), lambda s: (at(s, (F.size(s) - 1) / 2) + at(s, F.size(s) / 2)) / 2)


def picked(values: Column, positions: list[int]) -> Column:
    wanted = F.array(*[F.lit(p) for p in positions])
    return once(values, lambda all_: F.transform(wanted, lambda i: F.get(all_, i)))


def quantised(microvolts: Column, bit_depth: float, rounding: str = "half_even", overflow: str = "clamp") -> Column:
    """16-bit samples: rounded half to even or cut off; out of range clamped, or wrapped as two's complement."""
    x = microvolts / F.lit(float(bit_depth))
    x = (F.rint(x) if rounding == "half_even" else x).cast("long")
    if overflow == "clamp":
        return F.greatest(F.least(x, F.lit(32767)), F.lit(-32768)).cast("short")
    return (F.pmod(x + 32768, F.lit(65536)) - 32768).cast("short")
