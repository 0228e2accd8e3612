"""Filters and resampling along time, on blocks: ``recording_id, channel, block, samples``."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurolake.cluster import stored


def _bessel_poles(order: int) -> np.ndarray:
    """Roots of the reverse Bessel polynomial, scaled so that the phase is the asymptotic Butterworth one."""
    c = [math.factorial(2 * order - k) / (2 ** (order - k) * math.factorial(k) * math.factorial(order - k)) for k in range(order + 1)]
    return np.roots(c[::-1]) / c[0] ** (1.0 / order)


def bandpass_sections(low: float = 300.0, high: float = 5000.0, fs: float = 30000.0, order: int = 3, kind: str = "butterworth") -> np.ndarray:
    """Second-order sections of a band-pass: analog prototype, to the band, by the bilinear transform with warped corners."""
    if kind == "butterworth":
        k = np.arange(order)
        poles = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    elif kind == "bessel":
        poles = _bessel_poles(order)
    else:
        raise ValueError(f"no filter of kind {kind}")
    if not 0 < low < high < fs / 2:
        raise ValueError("corners must rise, below half the rate")
    w1, w2 = (4.0 * math.tan(math.pi * f / fs) for f in (low, high))
    band, centre = w2 - w1, math.sqrt(w1 * w2)
    half = poles * band / 2
    root = np.sqrt(half**2 - centre**2 + 0j)
    analog = np.concatenate([half + root, half - root])
    gain = band**order * np.real(np.prod(4.0 - np.zeros(order)) / np.prod(4.0 - analog)) * (np.real(np.prod(-poles)))
    z = (4.0 + analog) / (4.0 - analog)
    up = sorted(z[z.imag > 1e-12], key=abs)
    real = sorted(z[np.abs(z.imag) <= 1e-12].real)
    pairs = [(p, np.conj(p)) for p in up] + [(real[i], real[i + 1]) for i in range(0, len(real) - 1, 2)]
    sections = [[1.0, 0.0, -1.0, 1.0, -float(np.real(a + b)), float(np.real(a * b))] for a, b in pairs]
    sos = np.array(sections)
    sos[0, :3] *= gain
    return sos


@lru_cache(maxsize=512)
def _step_matrices(b0: float, b1: float, b2: float, _: float, a1: float, a2: float, step: int) -> tuple[np.ndarray, ...]:
    """Of a section and ``step`` samples: what they make of a state, what a state adds to each output, what each sample leaves, and what samples add to outputs. Not to be written to."""
    turn, feed = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
    powers = [np.eye(2)]
    for _k in range(step):
        powers.append(turn @ powers[-1])
    seen = np.array([m[0] for m in powers[:step]])  # what a state adds to the next outputs
    pushed = np.array([m @ feed for m in powers[:step]])  # what a sample leaves in the state so many samples later
    response = np.concatenate([[b0], pushed[:-1, 0]])
    lag = np.arange(step)[:, None] - np.arange(step)
    return powers[step], seen, pushed, np.where(lag >= 0, response[np.maximum(lag, 0)], 0.0)


def _section(section: np.ndarray, x: np.ndarray, state: np.ndarray, step: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """One section along the rows' last axis, ``step`` samples at once: two matrix products a step instead of a loop over samples.

    ``state``: the two values of the transposed direct form, of each row; those after the last sample come back too.
    """
    n = x.shape[1]
    if n < step:
        step = max(n, 1)
    turn, seen, pushed, near = _step_matrices(*map(float, section), step)
    parts = x[:, : n // step * step].reshape(len(x), -1, step)
    y, left = parts @ near.T, parts @ pushed[::-1]
    z = state.T
    for j in range(parts.shape[1]):
        y[:, j] += z @ seen.T
        z = z @ turn.T + left[:, j]
    y = y.reshape(len(x), -1)
    if y.shape[1] < n:
        rest, last = _section(section, x[:, y.shape[1] :], z.T, n - y.shape[1])
        return np.concatenate([y, rest], axis=1), last
    return y, z.T


def _run(sos: np.ndarray, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sections in turn, and their states after the last sample; ``state``: two values a section and row."""
    ends = []
    for section, start in zip(sos, state, strict=True):
        x, end = _section(section, x, start)
        ends.append(end)
    return x, np.array(ends)


def _settled(sos: np.ndarray) -> np.ndarray:
    """Each section's state for a steady input of one at the first."""
    out, level = np.zeros((len(sos), 2)), 1.0
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        out[i] = level * (gain - b0), level * (b2 - a2 * gain)
        level *= gain
    return out


def edge_samples(sos: np.ndarray) -> int:
    """Samples that a recording is extended by at either end."""
    return 3 * (2 * len(sos) + 1 - min(int((sos[:, 2] == 0).sum()), int((sos[:, 5] == 0).sum())))


def both_ways(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Zero-phase filtering of rows: odd extension, forward, backward, cut."""
    pad = min(edge_samples(sos), x.shape[1] - 1)
    ext = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], axis=1) if pad else x
    start = _settled(sos)[:, :, None]
    y, _ = _run(sos, ext, start * ext[None, None, :, 0])
    y = _run(sos, y[:, ::-1], start * y[None, None, :, -1])[0][:, ::-1]
    return y[:, pad : y.shape[1] - pad] if pad else y


def halo_samples(sos: np.ndarray, tolerance: float = 1e-9) -> int:
    """Samples after which the slowest pole has died away, with a margin for repeated sections."""
    slowest = max(max(abs(np.roots(s[3:]))) for s in sos)
    return math.ceil(1.5 * math.log(tolerance) / math.log(slowest))


def _with_halo(blocks: DataFrame, halo: int) -> DataFrame:
    """Each block with enough of its neighbours: they send it their ends, so no task holds a recording."""
    size = F.size("samples")
    own = blocks.select("recording_id", "channel", "block", F.lit(0).alias("side"), "samples")
    after = blocks.select("recording_id", "channel", (F.col("block") + 1).alias("block"), F.lit(-1).alias("side"), F.slice("samples", F.greatest(size - halo + 1, F.lit(1)), F.lit(halo)).alias("samples"))
    before = blocks.select("recording_id", "channel", (F.col("block") - 1).alias("block"), F.lit(1).alias("side"), F.slice("samples", F.lit(1), F.lit(halo)).alias("samples"))
    parts = own.unionByName(after).unionByName(before).groupBy("recording_id", "channel", "block")
    parts = parts.agg(F.array_sort(F.collect_list(F.struct("side", "samples"))).alias("parts")).where(F.exists("parts", lambda p: p["side"] == 0))
    side = lambda k: F.coalesce(F.get(F.filter("parts", lambda p: p["side"] == k), F.lit(0))["samples"], F.array().cast("array<double>"))
    return parts.select("recording_id", "channel", "block", side(-1).alias("before"), side(0).alias("samples"), side(1).alias("after"))


def filtered(blocks: DataFrame, sos: np.ndarray, halo: int | None = None) -> DataFrame:
    """Zero-phase filtering of block rows; blocks, numbered from 0, must be at least as long as the halo, else it is an error.
    Ends of a recording are extended. Rows of one length are filtered together."""
    halo = halo_samples(sos) if halo is None else halo

    def run(batches):
        for b in batches:
            if ((b["before"].str.len() < halo) & (b["block"] > 1)).any():
                raise ValueError(f"blocks are shorter than the halo of {halo} samples")
            rows = [np.concatenate(parts).astype(float) for parts in zip(b["before"], b["samples"], b["after"], strict=True)]
            out = [None] * len(rows)
            lengths = np.array([len(r) for r in rows])
            for n in np.unique(lengths):
                at = np.nonzero(lengths == n)[0]
                for i, y in zip(at, both_ways(sos, np.stack([rows[i] for i in at])), strict=True):
                    lead = len(b["before"].iloc[i])
                    out[i] = y[lead : lead + len(b["samples"].iloc[i])]
            yield pd.DataFrame({"recording_id": b["recording_id"], "channel": b["channel"], "block": b["block"], "samples": out})

    return _with_halo(blocks.withColumn("samples", F.col("samples").cast("array<double>")), halo).mapInPandas(run, "recording_id string, channel int, block long, samples array<double>")


def _turn(sos: np.ndarray) -> np.ndarray:
    """What one sample of nothing makes of the states of all sections: a matrix."""
    k = 2 * len(sos)
    return _run(sos, np.zeros((k, 1)), np.eye(k).reshape(len(sos), 2, k))[1].reshape(k, k)


#: Blocks that one row of the scan holds; as many such rows make one of the next level.
FAN = 512


def _starts(ends: DataFrame, sos: np.ndarray, forward: bool, fan: int | None = None) -> DataFrame:
    """``recording_id, channel, block, state``: each block's exact state at its start, of blocks' ``n`` samples and the state ``left`` that they end with from nothing.

    A block maps the state that comes in affinely: a power of one matrix, and what its own samples leave. Such maps compose: those of ``fan`` successive
    blocks to one map of them all, and so on until one row holds a recording's. Back down, each row takes the state that comes in through its blocks.
    Every level is a ``fan``-th of the one below, so the work grows as the number of blocks. The first block's state is known (``left`` of its row begins with it).
    """
    fan, k, turn = fan or FAN, 2 * len(sos), _turn(sos)
    key, kinds = ["recording_id", "channel", "block"], "recording_id string, channel int, block long"
    powers: dict[int, np.ndarray] = {}

    def power(n: int) -> np.ndarray:
        if n not in powers:
            powers[n] = np.linalg.matrix_power(turn, n)
        return powers[n]

    def composed(batches):
        for b in batches:
            total, left = [], []
            for parts in b["parts"]:
                z = np.zeros(k)
                for p in parts if forward else parts[::-1]:
                    z = power(int(p["n"])) @ z + np.asarray(p["left"])
                left.append(z)
                total.append(sum(int(p["n"]) for p in parts))
            yield pd.DataFrame({"recording_id": b["recording_id"], "channel": b["channel"], "block": b["block"], "n": total, "left": left})

    def passed(batches):
        for b in batches:
            out = []
            for name, channel, parts, state in zip(b["recording_id"], b["channel"], b["parts"], b["state"], strict=True):
                z = np.zeros(k) if state is None else np.asarray(state)
                for p in parts if forward else parts[::-1]:
                    out.append((name, channel, p["block"], z))
                    z = power(int(p["n"])) @ z + np.asarray(p["left"])
            yield pd.DataFrame(out, columns=[*key, "state"])

    levels, most = [], ends.agg(F.max("block")).first()[0] or 0
    while True:
        parts = ends.groupBy("recording_id", "channel", F.floor(F.col("block") / fan).alias("up")).agg(F.array_sort(F.collect_list(F.struct("block", "n", "left"))).alias("parts"))
        levels.append(stored(parts.withColumnRenamed("up", "block")))
        most //= fan
        if not most:
            break
        ends = levels[-1].mapInPandas(composed, f"{kinds}, n long, left array<double>")
    states = None
    for rows in reversed(levels):
        rows = rows.withColumn("state", F.lit(None).cast("array<double>")) if states is None else rows.join(states, key, "left")
        states = stored(rows.mapInPandas(passed, f"{kinds}, state array<double>"))
    return states


def filtered_exactly(blocks: DataFrame, sos: np.ndarray) -> DataFrame:
    """Zero-phase filtering of block rows of any length: for corners so low that a filter remembers more than a block.

    Each block's state at its start is computed, not warmed up over a halo: from what every block leaves when it starts from nothing, by an associative
    scan over blocks, one row each, first forwards, then backwards. Ends of a recording are extended by what the nearest block and its neighbour hold;
    blocks are numbered from 0 without gaps.
    """
    pad, k = edge_samples(sos), 2 * len(sos)
    key = ["recording_id", "channel", "block"]
    settled = _settled(sos)
    wide = _with_halo(blocks.withColumn("samples", F.col("samples").cast("array<double>")), pad + 1)
    last = blocks.groupBy("recording_id", "channel").agg(F.max("block").alias("last"))
    wide = stored(wide.join(F.broadcast(last), ["recording_id", "channel"]))  # a row a channel

    def extended(r) -> tuple[np.ndarray, int]:
        """A block's samples with a recording's extension, where it is the first or last; and how many were put in front."""
        x, front = np.array(r.samples, dtype=float), 0
        near = np.concatenate([r.before, x, r.after])
        if r.block == r.last:
            m = min(pad, len(near) - len(r.after) - 1)
            tail = near[: len(near) - len(r.after)]
            x = np.concatenate([x, 2 * tail[-1] - tail[-2 : -m - 2 : -1]]) if m else x
        if r.block == 0:
            head = near[len(r.before) :]
            m = min(pad, len(head) - 1)
            x = np.concatenate([2 * head[0] - head[m:0:-1], x]) if m else x
            front = m
        short = (r.block == 0 or r.block == r.last) and r.last > 0 and m < pad
        if short and r.last > 1:
            raise ValueError(f"two blocks at an end hold less than {pad} samples")
        return x, front

    def first_state(x: np.ndarray) -> np.ndarray:
        return (settled * x).ravel()

    def ends(forward: bool):
        def run(batches):
            for b in batches:
                n, left = [], []
                for r in b.itertuples():
                    x, _ = extended(r)
                    begins = r.block == (0 if forward else r.last)
                    if forward:
                        state = first_state(x[0]) if begins else np.zeros(k)
                    else:
                        x = _run(sos, x[None], _state_of(r, x))[0][0][::-1]
                        state = first_state(x[0]) if begins else np.zeros(k)
                    left.append(_run(sos, x[None], state.reshape(len(sos), 2, 1))[1].ravel())
                    n.append(len(x))
                yield pd.DataFrame({"recording_id": b["recording_id"], "channel": b["channel"], "block": b["block"], "n": n, "left": left})

        return run

    def _state_of(r, x: np.ndarray) -> np.ndarray:
        state = first_state(x[0]) if r.block == 0 else np.array(r.state)
        return state.reshape(len(sos), 2, 1)

    def final(batches):
        for b in batches:
            out = []
            for r in b.itertuples():
                x, front = extended(r)
                y = _run(sos, x[None], _state_of(r, x))[0][0][::-1]
                state = first_state(y[0]) if r.block == r.last else np.array(r.back)
                y = _run(sos, y[None], state.reshape(len(sos), 2, 1))[0][0][::-1]
                out.append(y[front : front + len(r.samples)])
            yield pd.DataFrame({"recording_id": b["recording_id"], "channel": b["channel"], "block": b["block"], "samples": out})

    kinds = "recording_id string, channel int, block long, n long, left array<double>"
    states = _starts(wide.mapInPandas(ends(True), kinds), sos, True)
    held = wide.join(states, key, "left")
    back = _starts(held.mapInPandas(ends(False), kinds), sos, False).withColumnRenamed("state", "back")
    return held.join(back, key, "left").mapInPandas(final, "recording_id string, channel int, block long, samples array<double>")


def _sinc(up: int, down: int, beta: float) -> tuple[np.ndarray, int]:
    half = 10 * max(up, down)
    k = np.arange(-half, half + 1)
    taps = np.sinc(k / max(up, down)) * np.kaiser(2 * half + 1, beta)
    return taps / taps.sum() * up, half


def reach(up: int, down: int = 1) -> int:
    """Samples on either side that a resampled one depends on."""
    return 10 * max(up, down) // up + 2


def resample_rows(x: np.ndarray, up: int, down: int = 1, beta: float = 5.0, lead: int = 0, keep: int | None = None) -> np.ndarray:
    """Windowed-sinc resampling of rows, of the samples from ``lead`` on; nothing stands outside a row.

    A polyphase filter bank: on the ``up`` times finer grid a place's phase says which taps meet samples, so all phases of all
    samples are one product of the samples' neighbourhoods and a matrix of a column a phase.
    """
    taps, half = _sinc(up, down, beta)
    keep = x.shape[1] - lead if keep is None else keep
    r = reach(up, down)
    at = np.arange(up)[None, :] - np.arange(-r, r + 1)[:, None] * up + half
    bank = np.where((at >= 0) & (at < len(taps)), taps[np.clip(at, 0, len(taps) - 1)], 0.0)
    near = np.lib.stride_tricks.sliding_window_view(np.pad(x, [(0, 0), (r, r)]), 2 * r + 1, axis=1)[:, lead : lead + keep]
    if down == 1:
        return (near @ bank).reshape(len(x), -1)
    place = np.arange(-(-keep * up // down)) * down
    return (near[:, place // up] * bank.T[place % up]).sum(axis=2)


def resampled(blocks: DataFrame, up: int, down: int = 1, beta: float = 5.0) -> DataFrame:
    """Each block ``up``/``down`` times as long: the filter is finite, so a halo of its length is exact.

    Before, each recording's and channel's line from its first to its last sample is taken off, and added again after. Block
    lengths must be multiples of ``down``.
    """
    blocks = blocks.withColumn("samples", F.col("samples").cast("array<double>"))
    halo = reach(up, down)
    sizes = blocks.groupBy("recording_id", "channel").agg(
        F.min_by(F.get("samples", F.lit(0)), "block").alias("first"), F.max_by(F.element_at("samples", -1), "block").alias("last"),
        F.sum(F.size("samples")).alias("n"), F.min_by(F.size("samples"), "block").alias("per"),
    )

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples():
                x = np.concatenate([r.before, r.samples, r.after]).astype(float)
                slope = (r.last - r.first) / max(r.n - 1, 1)
                origin = r.block * r.per
                line = r.first + slope * (np.arange(len(x)) - len(r.before) + origin)
                y = resample_rows((x - line)[None], up, down, beta, len(r.before), len(r.samples))[0]
                out.append(y + r.first + slope * (np.arange(len(y)) * down / up + origin))
            yield pd.DataFrame({"recording_id": b["recording_id"], "channel": b["channel"], "block": b["block"], "samples": out})

    wide = _with_halo(blocks, halo).join(sizes, ["recording_id", "channel"])
    return wide.mapInPandas(run, "recording_id string, channel int, block long, samples array<double>")


def frames_to_blocks(frames: DataFrame, size: int) -> DataFrame:
    """One row a channel and block of ``size`` ticks; ticks are 0, 1, 2 ... within a recording.

    A batch of frames is turned where it is: what is shuffled is a row a channel and run of successive ticks of a block, not a row a sample.
    """

    def turned(batches):
        for b in batches:
            if not len(b):
                continue
            b = b.sort_values(["recording_id", "tick"], ignore_index=True)
            x, tick, name = np.stack(b["uv"].to_numpy()).astype(float), b["tick"].to_numpy(), b["recording_id"].to_numpy()
            new = (np.diff(tick) != 1) | (np.diff(tick // size) != 0) | (name[1:] != name[:-1])
            cuts = [0, *(np.nonzero(new)[0] + 1), len(b)]
            rows = [(name[i], c, tick[i] // size, tick[i], x[i:j, c]) for i, j in zip(cuts, cuts[1:], strict=False) for c in range(x.shape[1])]
            yield pd.DataFrame(rows, columns=["recording_id", "channel", "block", "first", "samples"])

    runs = frames.select("recording_id", F.col("tick").cast("long"), "uv").mapInPandas(turned, "recording_id string, channel int, block long, first long, samples array<double>")
    packed = runs.groupBy("recording_id", "channel", "block").agg(F.array_sort(F.collect_list(F.struct("first", "samples"))).alias("s"))
    return packed.select("recording_id", "channel", "block", F.flatten(F.transform("s", lambda x: x["samples"])).alias("samples"))


def blocks_to_frames(blocks: DataFrame, size: int) -> DataFrame:
    """Frames of blocks: a block's channels meet as they are, a row each, and are turned in the task."""

    def turned(batches):
        for b in batches:
            for name, block, s in zip(b["recording_id"], b["block"], b["s"], strict=True):
                x = np.stack([np.asarray(c["samples"]) for c in s]).T
                yield pd.DataFrame({"recording_id": name, "tick": block * size + np.arange(len(x)), "uv": list(x)})

    met = blocks.groupBy("recording_id", "block").agg(F.array_sort(F.collect_list(F.struct("channel", "samples"))).alias("s"))
    return met.mapInPandas(turned, "recording_id string, tick long, uv array<double>")
