"""Spikes about events: alignment, counts, histograms, rates, intervals between spikes, and orders of trials."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neurolake.functions.columns import finite
from neurolake.operators.intervals import numbered, range_join, with_previous

INF = float("inf")
TRIAL = ["unit_id", "trial_id"]


def aligned(spikes: DataFrame, trials: DataFrame, half_window: int, fs: float, closed: str = "left") -> DataFrame:
    """Seconds of each unit's spikes from its trials' events, within a half window: closed at the left, or open (``neither``)."""
    if half_window <= 0 or fs <= 0:
        raise ValueError("the window and the rate must be positive")
    windows = trials.select(*TRIAL, "event_tick", (F.col("event_tick") - half_window).alias("_low"), (F.col("event_tick") + half_window).alias("_high"))
    hits = range_join(spikes.select("unit_id", "tick"), windows, "tick", "_low", "_high", 2 * half_window, ["unit_id"], closed)
    # two divisions: a difference of quotients isn't always the quotient of a difference
    return hits.select(*TRIAL, "tick", (F.col("tick") / F.lit(float(fs)) - F.col("event_tick") / F.lit(float(fs))).alias("rel_s"))


def before_cutoff(rel: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Spikes strictly before their trial's ``cutoff_s``."""
    return rel.join(cutoffs, TRIAL).where("rel_s < cutoff_s").drop("cutoff_s")


def bins(spark, edges: list[float]) -> DataFrame:
    """``bin, lo, hi, is_last`` of rising edges."""
    if any(b <= a for a, b in zip(edges, edges[1:], strict=False)):
        raise ValueError("edges must rise")
    rows = [(i, float(a), float(b), i == len(edges) - 2) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    return spark.createDataFrame(rows, "bin int, lo double, hi double, is_last boolean")


def bin_of(x: Column, edges: list[float]) -> Column:
    """The bin that holds a value, by comparing with the edges; the last is closed; null outside and for NaN."""
    e = [float(v) for v in edges]
    place = F.size(F.filter(F.array(*[F.lit(v) for v in e]), lambda b: b <= x)) - 1
    return F.when((x >= e[0]) & (x < e[-1]), place).when(x == e[-1], len(e) - 2)


def trial_histograms(rel: DataFrame, trials: DataFrame, edges: list[float]) -> DataFrame:
    """``count`` of every trial and bin, zeros included."""
    counts = rel.withColumn("bin", bin_of(F.col("rel_s"), edges)).where("bin is not null").groupBy(*TRIAL, "bin").agg(F.count("*").alias("count"))
    dense = trials.select(*TRIAL).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(len(edges) - 2))))
    return dense.join(counts, [*TRIAL, "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))


def mean_histogram(histograms: DataFrame) -> DataFrame:
    """Mean count of a bin over a unit's trials, as ``p``; nothing for a unit without trials."""
    return histograms.groupBy("unit_id", "bin").agg((F.sum("count") / F.count("*")).alias("p"))


def smoothed(dense: DataFrame, keys: list[str], value: str, n_bins: int, sigma: float) -> DataFrame:
    """Gaussian smoothing along bins: weights to four sigma, edges mirrored (half-sample symmetric)."""
    radius = int(4.0 * sigma + 0.5)
    weights = F.transform(F.sequence(F.lit(-radius), F.lit(radius)), lambda k: F.exp(-0.5 * k * k / (sigma * sigma)))
    rows = dense.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", F.col(value).cast("double").alias("v")))).alias("_a"))
    total = F.aggregate("_w", F.lit(0.0), lambda a, w: a + w)

    def mirrored(i: Column) -> Column:
        m = F.pmod(i, F.lit(2 * n_bins))
        return F.least(m, 2 * n_bins - 1 - m).cast("int")

    def at(b: Column) -> Column:
        terms = F.transform(F.sequence(F.lit(-radius), F.lit(radius)), lambda k: F.get("_a", mirrored(b + k))["v"] * F.get("_w", k + radius))
        return F.struct(b.alias("bin"), (F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / F.col("_t")).alias("smooth"))

    out = rows.withColumn("_w", weights).withColumn("_t", total)
    return out.select(*keys, F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_bins - 1)), at)).alias("_s")).select(*keys, "_s.*")


def spike_rate(histograms: DataFrame, bin_rows: DataFrame, cutoffs: DataFrame | None = None, probability: bool = False) -> DataFrame:
    """Counts of a bin over its trials, a second (or a bin, with ``probability``).

    With ``cutoffs`` a bin's trials are those whose ``cutoff_s`` isn't before its left edge; a bin without any has a null rate.
    """
    sums = histograms.groupBy("unit_id", "bin").agg(F.sum("count").alias("total"), F.count("*").alias("n")).join(F.broadcast(bin_rows), "bin")
    if cutoffs is not None:
        # cutoffs are counted by how many left edges they reach before they are spread over those bins
        edges = bin_rows.agg(F.array_sort(F.collect_list(F.struct("lo", "bin"))).alias("_edges"))  # one row of bins
        reached = F.size(F.filter("_edges", lambda e: e["lo"] <= F.col("cutoff_s")))
        ends = cutoffs.crossJoin(F.broadcast(edges)).groupBy("unit_id", "_edges", reached.alias("_k")).agg(F.count("*").alias("c"))
        ends = ends.select("unit_id", "c", F.explode(F.slice("_edges", F.lit(1), F.col("_k"))).alias("e")).groupBy("unit_id", F.col("e.bin").alias("bin")).agg(F.sum("c").alias("alive"))
        sums = sums.join(ends, ["unit_id", "bin"], "left").withColumn("n", F.col("alive"))
    rate = F.col("total") / F.when(F.col("n") > 0, F.col("n"))
    rate = rate if probability else rate / (F.col("hi") - F.col("lo"))
    return sums.select("unit_id", "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), rate.alias("rate"))


#: Units with more trials than this draw row by row: a unit's trials by bins are a matrix in a task, some hundred bytes a trial.
MOST_TRIALS = 100_000
#: Draws that are made at once, and those that a job of a unit's replicates has at most, but for one replicate of a unit with more trials.
AT_ONCE, JOB = 1 << 17, 1 << 21

_MD5_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_MD5_TURNS = [(np.uint32(s), np.uint32(32 - s)) for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in row * 4]
_MD5_START = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _md5_words(words: list) -> list[np.ndarray]:
    """The four words of the MD5 digests of messages of one block, whose 16 words are arrays of a word a message, or one number for all."""
    n = next(len(w) for w in words if isinstance(w, np.ndarray))
    a, b, c, d = (np.full(n, v) for v in _MD5_START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        x, y, z, g = ((c, d, b, i), (b, c, d, 5 * i + 1), (b, c, d, 3 * i + 5), (d, b, c, 7 * i))[i // 16]
        if i < 32:
            np.bitwise_xor(x, y, out=f)
            np.bitwise_and(f, z, out=f)
            np.bitwise_xor(f, y, out=f)
        elif i < 48:
            np.bitwise_xor(x, y, out=f)
            np.bitwise_xor(f, z, out=f)
        else:
            np.invert(x, out=f)
            np.bitwise_or(f, y, out=f)
            np.bitwise_xor(f, z, out=f)
        f += a
        w, k, (up, down) = words[g % 16], _MD5_ADDED[i], _MD5_TURNS[i]
        if isinstance(w, np.ndarray):
            f += w
            f += np.uint32(k)
        else:
            f += np.uint32((k + int(w)) & 0xFFFFFFFF)
        np.right_shift(f, down, out=t)
        np.left_shift(f, up, out=f)
        f |= t
        f += b
        a, d, c, b, f = d, c, b, f, a
    return [x + v for x, v in zip((a, b, c, d), _MD5_START, strict=True)]


def _written(numbers: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in decimal from a message's byte ``at`` on: a row of 16 words each; and where each ends."""
    digits = np.ones(len(numbers), dtype=np.int64)
    for k in range(1, len(str(int(numbers.max())))):
        digits += numbers >= 10**k
    out = np.zeros((len(numbers), 64), dtype=np.uint8)
    rest, rows = numbers.copy(), np.arange(len(numbers))
    for k in range(int(digits.max())):
        some = digits > k
        out[rows[some], at + digits[some] - 1 - k] = 48 + rest[some] % 10
        rest //= 10
    return out.view("<u4"), at + digits


def _digest_words(start: bytes, replicates: range, n: int) -> np.ndarray:
    """A row a replicate: as many words as ``n`` draws take, of the MD5 digests of ``start``, the replicate, a colon and a counter from 0."""
    groups = -(-n // 4)
    if len(start) + len(str(replicates[-1])) + 1 + len(str(groups - 1)) > 55:  # more than a block of MD5
        words = []
        for replicate in replicates:
            base = hashlib.md5(start + f"{replicate}:".encode(), usedforsecurity=False)
            for g in range(groups):
                m = base.copy()
                m.update(str(g).encode())
                words.append(m.digest())
        return np.frombuffer(b"".join(words), dtype=">u4").reshape(len(replicates), -1)
    head = np.frombuffer(start.ljust(64, b"\0"), dtype="<u4")
    reps, ends = _written(np.arange(replicates[0], replicates[-1] + 1), len(start))
    out = np.empty((len(replicates), groups, 4), dtype=np.uint32)
    vary = {*range(len(start) // 4, (int(ends.max()) + 1 + len(str(groups - 1))) // 4 + 1), 14}  # the words that aren't the same in all messages
    words: list = [np.empty((len(reps), groups), np.uint32) if j in vary else int(head[j]) for j in range(16)]
    for end in np.unique(ends):
        rows = np.nonzero(ends == end)[0]
        rows = slice(rows[0], rows[-1] + 1)  # replicates rise, so those of one length follow one another
        counters, stops = _written(np.arange(groups), int(end) + 1)
        tail = np.zeros((groups, 64), dtype=np.uint8)
        tail[:, end] = ord(":")
        tail[np.arange(groups), stops] = 0x80
        tail = tail.view("<u4") | counters
        tail[:, 14] |= (stops * 8).astype(np.uint32)
        for j in vary:
            words[j][rows] = (head[j] | reps[rows, j])[:, None] | tail[:, j]
    for k, w in enumerate(_md5_words([w.ravel() if j in vary else w for j, w in enumerate(words)])):
        out[:, :, k] = w.byteswap().reshape(len(replicates), groups)
    return out.reshape(len(replicates), -1)


def _times_drawn(seed: int, unit, replicates: range, n: int) -> np.ndarray:
    """How often each replicate draws each of n trials: words of 32 bits of MD5 digests of seed, unit, replicate and a counter, modulo n."""
    drawn = _digest_words(f"{seed}:{unit}:".encode(), replicates, n)[:, :n] % np.uint32(n)
    return np.bincount((drawn + np.arange(len(replicates))[:, None] * n).ravel(), minlength=len(replicates) * n).reshape(len(replicates), n)


def _came_up(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column, value and number of times of the whole numbers that columns hold."""
    rows, columns = sums.shape
    span = int(sums.max()) + 1
    if span > 4 * rows + 64:
        each = [np.unique(sums[:, k], return_counts=True) for k in range(columns)]
        return np.repeat(np.arange(columns), [len(v) for v, _ in each]), np.concatenate([v for v, _ in each]), np.concatenate([c for _, c in each])
    times = np.bincount((sums + np.arange(columns) * span).ravel(), minlength=span * columns)
    at = np.nonzero(times)[0]
    return at // span, at % span, times[at]


def _drawn_sums(cells: DataFrame, sizes: DataFrame, replicates: int, seed: int, chunk: int | None) -> DataFrame:
    """``unit_id, n, rep, bin, total`` counted to ``unit_id, n, bin, total, times``: a chunk of replicates is a matrix of how often each trial was drawn, times the unit's
    trials by bins. Bins that no trial has a spike in sum to 0 in every replicate, whatever is drawn."""
    matrices = cells.groupBy("unit_id").agg(F.collect_list(F.struct("i", "bin", "count")).alias("cells"))
    step = F.lit(chunk) if chunk else F.greatest(F.lit(1), F.least(F.lit(replicates), F.floor(F.lit(JOB) / F.col("n")))).cast("int")
    jobs = sizes.join(matrices, "unit_id", "left").withColumn("step", F.when(F.col("cells").isNull(), replicates).otherwise(step))
    jobs = jobs.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.col("step"))))
    kind = sizes.schema["unit_id"].dataType.simpleString()

    def draw(batches):
        for b in batches:
            out: list[tuple] = []
            held = 0

            def frame(out=out):
                cols = [np.concatenate([o[k] for o in out]) for k in (2, 3, 4)]
                size = [len(o[2]) for o in out]
                unit = pd.Series([o[0] for o in out], dtype=b["unit_id"].dtype).repeat(size).reset_index(drop=True)
                return pd.DataFrame({"unit_id": unit, "n": np.repeat([o[1] for o in out], size), "bin": cols[0], "total": cols[1], "times": cols[2]})

            for unit, n, bins_, some, first, step in zip(b["unit_id"], b["n"], b["bins"], b["cells"], b["first"], b["step"], strict=True):
                last, some = min(first + step, replicates), some if some is not None else ()
                full = np.array(sorted({c["bin"] for c in some}), dtype=np.int64)
                empty = np.setdiff1d(np.arange(bins_), full)
                out.append((unit, n, empty, np.zeros(len(empty), np.int64), np.full(len(empty), last - first)))
                held += len(empty)
                if len(full):
                    h = np.zeros((n, bins_), dtype=np.float64)
                    for c in some:
                        h[c["i"], c["bin"]] += c["count"]
                    h = h[:, full]
                    per = max(1, AT_ONCE // n)
                    for at in range(first, last, per):
                        times = _times_drawn(seed, unit, range(at, min(at + per, last)), n)
                        k, total, seen = _came_up(np.rint(times.astype(np.float64) @ h).astype(np.int64))
                        out.append((unit, n, full[k], total, seen))
                        held += len(k)
                if held > 100_000:
                    yield frame()
                    out.clear()
                    held = 0
            if held:
                yield frame()

    spark = sizes.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)  # a job is few bytes and much work: as many tasks, however small
    return jobs.repartition(tasks, "unit_id", "first").mapInPandas(draw, f"unit_id {kind}, n long, bin int, total long, times long")


def _drawn_rows(cells: DataFrame, sizes: DataFrame, replicates: int, seed: int) -> DataFrame:
    """The same draws as rows, for units of very many trials."""
    draws = sizes.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("unit_id").cast("string"), "rep", F.floor(F.col("k") / 4).cast("string")))
    word = F.conv(F.substring(digest, (F.col("k") % 4 * 8 + 1).cast("int"), F.lit(8)), 16, 10).cast("long")
    draws = draws.select("unit_id", "n", "bins", "rep", (word % F.col("n")).alias("i")).groupBy("unit_id", "n", "bins", "rep", "i").agg(F.count("*").alias("drawn"))
    sums = draws.join(cells, ["unit_id", "i"]).groupBy("unit_id", "rep", "bin").agg(F.sum(F.col("drawn") * F.col("count")).alias("total"))
    every = sizes.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    sums = every.join(sums, ["unit_id", "rep", "bin"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    return sums.groupBy("unit_id", "n", "bin", "total").agg(F.count("*").alias("times"))


def bootstrap_interval(histograms: DataFrame, trials: DataFrame, width: float, replicates: int = 10_000, percent: float = 95.0, seed: int = 0, chunk: int | None = None) -> DataFrame:
    """Percentile interval of a unit's mean rate in each bin, over trials drawn with replacement.

    Draws come from a counter: the words of an MD5 of seed, unit, replicate and position, so they are the same on every run, in any chunks and however they are made.
    ``chunk``: replicates of a job; if it isn't given, as many as make JOB draws. A replicate's sum in a bin is a whole number, so what is shuffled is how often each sum came up, and percentiles are taken over these.
    """
    numbers = numbered(trials.select(*TRIAL), "trial_id", ["unit_id"], name="i").withColumn("i", F.col("i") - 1)
    sizes = trials.groupBy("unit_id").agg(F.count("*").alias("n"))
    bins_ = histograms.agg(F.max("bin") + 1).first()[0] or 0  # a bin's number is an edge's, so a few
    sizes = sizes.withColumn("bins", F.lit(int(bins_)))
    cells = histograms.where(F.col("count") > 0).join(numbers, TRIAL).select("unit_id", "i", F.col("bin").cast("int").alias("bin"), "count")
    few = sizes.where(F.col("n") <= MOST_TRIALS)
    many = sizes.where(F.col("n") > MOST_TRIALS)
    sums = _drawn_sums(cells.join(few.select("unit_id"), "unit_id"), few, replicates, seed, chunk)
    if many.limit(1).count():
        sums = sums.unionByName(_drawn_rows(cells, many, replicates, seed))
    rates = sums.groupBy("unit_id", "n", "bin", "total").agg(F.sum("times").alias("times")).withColumn("rate", F.col("total") / F.col("n") / F.lit(float(width)))
    tail = (100.0 - percent) / 200.0
    cut = rates.groupBy("unit_id", "bin").agg(F.percentile("rate", F.array(F.lit(tail), F.lit(1.0 - tail)), F.col("times")).alias("q"))
    return cut.select("unit_id", "bin", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def burst_fraction(rel: DataFrame, trials: DataFrame, start_s: float = 0.0, end_s: float = 0.005) -> DataFrame:
    """Share of a unit's trials with more than one spike in the closed window."""
    counts = rel.where(F.col("rel_s").between(start_s, end_s)).groupBy(*TRIAL).agg(F.count("*").alias("c"))
    each = trials.select(*TRIAL).join(counts, TRIAL, "left")
    return each.groupBy("unit_id").agg(F.avg((F.coalesce("c", F.lit(0)) > 1).cast("double")).alias("fraction"))


def spike_intervals(rows: DataFrame, at: str, keys: list[str]) -> DataFrame:
    """Differences of successive finite times within ``keys``, as ``isi``; a busy key is many tasks."""
    each = with_previous(rows.where(finite(F.col(at))).select(*keys, at), F.col(at), at, keys)
    return each.select(*keys, at, (F.col(at) - F.col("previous")).alias("isi")).where("isi is not null")


def interval_variability(rows: DataFrame, at: str, keys: list[str]) -> DataFrame:
    """``cv2`` of adjacent intervals a, b within ``keys``: 2 |b - a| / (a + b), where a + b > 0."""
    each = with_previous(rows.where(finite(F.col(at))).select(*keys, at), F.col(at), at, keys, second="earlier")
    each = each.select(*keys, at, (F.col(at) - F.col("previous")).alias("b"), (F.col("previous") - F.col("earlier")).alias("a"))
    return each.where("a + b > 0").select(*keys, at, (2 * F.abs(F.col("b") - F.col("a")) / (F.col("a") + F.col("b"))).alias("cv2"))


def trial_keys(rel: DataFrame, trials: DataFrame) -> DataFrame:
    """What trials are ordered by: spikes, earliest time (infinite without), first positive time in order of ticks (0 without)."""
    keys = rel.groupBy(*TRIAL).agg(F.count("*").alias("n"), F.min("rel_s").alias("first_s"), F.min(F.when(F.col("rel_s") > 0, F.col("rel_s"))).alias("positive_s"))
    each = trials.select(*TRIAL).join(keys, TRIAL, "left")
    return each.select(*TRIAL, F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("first_s", F.lit(INF)).alias("first_s"), F.coalesce("positive_s", F.lit(0.0)).alias("positive_s"))


def ranked(rows: DataFrame, *order: Column | str, keys: list[str] = ("unit_id",)) -> DataFrame:
    """``place`` from 0 within ``keys``; ties by trial."""
    return rows.withColumn("place", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "trial_id")) - 1).cast("long"))


def order_by_first_positive(keys: DataFrame) -> DataFrame:
    return ranked(keys, "positive_s")


def order_by_first_spike(keys: DataFrame) -> DataFrame:
    return ranked(keys, "first_s")


def order_by_count_descending(keys: DataFrame) -> DataFrame:
    return ranked(keys, F.desc("n"))


def order_by_count_then_first(keys: DataFrame) -> DataFrame:
    return ranked(keys, "n", "first_s")


def order_by_covariate(rows: DataFrame, value: str, ascending: bool = True) -> DataFrame:
    """NaN last in both directions."""
    return ranked(rows, F.isnan(value), F.col(value).asc() if ascending else F.col(value).desc())


def subset_order(keys: DataFrame, subset: DataFrame, by: str) -> DataFrame:
    """Order of the trials of ``subset`` (with their position ``pos``): by first spike; by count, ties from the last position; by both."""
    some = keys.join(subset, TRIAL)
    order = {"first_spike": ["first_s", "pos"], "count": ["n", F.desc("pos")], "count_first": ["n", "first_s", "pos"]}[by]
    return some.withColumn("place", (F.row_number().over(Window.partitionBy("unit_id").orderBy(*order)) - 1).cast("long"))


def in_order(rows: DataFrame, order: DataFrame) -> DataFrame:
    """Rows of trials under their places: the order applied."""
    return rows.join(order.select(*TRIAL, "place"), TRIAL)


def peak_bins(means: DataFrame, edges: list[float]) -> DataFrame:
    """Centre of each unit's first highest bin, and the units' order by it."""
    centre = [(a + b) / 2 for a, b in zip(edges, edges[1:], strict=False)]
    top = means.groupBy("unit_id").agg(F.max_by("bin", F.struct("p", (-F.col("bin")).alias("b"))).alias("bin"))
    return top.select("unit_id", F.get(F.array(*[F.lit(c) for c in centre]), F.col("bin")).alias("peak_s"))


def merged_rows(rel: DataFrame, per_row: int) -> DataFrame:
    """Trials merged, ``per_row`` in turn, to one raster row; one or less keeps them."""
    return rel.withColumn("row_id", F.floor(F.col("trial_pos") / max(per_row, 1)).cast("long"))
