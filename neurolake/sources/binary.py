"""Flat binary recordings in and out, and the other files of a recording."""

from __future__ import annotations

import json
from dataclasses import asdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurolake.functions.columns import ticks_from_seconds
from neurolake.operators.spatial import Whitening
from neurolake.sources.flat import registered

UV_PER_BIT = 0.195


def _load(spark: SparkSession, path: str, ticks: list[tuple[int, int]] | None, **options) -> DataFrame:
    if ticks is not None:
        options["ticks"] = json.dumps(ticks)
    return registered(spark).read.format("flat_recording").options(**{k: v for k, v in options.items() if v is not None}).load(path)


def read_digital(spark: SparkSession, path: str, header: int = 0, width: int = 2, ticks: list[tuple[int, int]] | None = None, recording: str | None = None) -> DataFrame:
    """``recording_id, tick, word`` of unsigned little-endian words, one or two bytes wide; ``ticks`` and ``recording`` as for ``read_voltage``."""
    if width not in (1, 2):
        raise ValueError("words are one or two bytes wide")
    return _load(spark, path, ticks, word_bytes=width, header=header, recording=recording)


def read_voltage(
    spark: SparkSession, path: str, channels: int, scale: float = UV_PER_BIT, offset: int = 0, header: int = 0, sections: np.ndarray | None = None, up: int = 1, beta: float = 5.0,
    per_task: int = 32 << 20, ticks: list[tuple[int, int]] | None = None, recording: str | None = None, segments: int | None = None, length: int = 30000,
) -> DataFrame:
    """Frames of interleaved 16-bit samples, in microvolts; ``offset`` is what a word of zero volts holds (32768: unsigned words).

    ``sections``: of a zero-phase filter. ``up``: frames that many times as dense. Ranges are read with as many neighbours as these need, so
    samples are filtered and resampled where they are read, without an exchange. ``ticks``: only these ranges, half open, of what comes out; ``recording``: only
    the one of that name; ``segments``: only so many runs of ``length`` of each recording, as ``spatial.subsample`` takes them. Nothing else is planned or opened.
    """
    sos = json.dumps(sections.tolist()) if sections is not None else None
    runs = {"segments": segments, "length": length} if segments else {}
    return _load(spark, path, ticks, channels=channels, scale=scale, offset=offset, header=header, sections=sos, up=up, beta=beta, per_task=per_task, recording=recording, **runs)


def read_spike_csv(spark: SparkSession, path: str, fs: float) -> DataFrame:
    """``unit_id, channel, tick, row`` of a sorter's table of time, unit and channel, after its two head lines; ticks are cut off."""
    lines = spark.read.format("text").load(path).select("value", "_metadata.file_path")
    # a file's first two lines lie at its beginning: its first block, in order
    head = F.monotonically_increasing_id()
    numbered = lines.withColumn("at", head)
    first = numbered.groupBy("file_path").agg(F.min("at").alias("first"))
    body = numbered.join(first, "file_path").where(F.col("at") >= F.col("first") + 2)
    cell = F.split("value", ",")
    seconds = F.trim(cell[0]).cast("double")
    rows = body.select(F.trim(cell[1]).cast("double").cast("long").alias("unit_id"), F.trim(cell[2]).cast("double").cast("int").alias("channel"), ticks_from_seconds(seconds, fs, "truncate").alias("tick"), F.col("at").alias("row"))
    return rows


def unit_trains(spikes: DataFrame) -> DataFrame:
    """Each unit's ticks as an array, in the file's order."""
    packed = spikes.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("row", "tick"))).alias("s"))
    return packed.select("unit_id", F.transform("s", lambda x: x["tick"]).alias("ticks"))


def best_channels(spikes: DataFrame) -> DataFrame:
    """The channel that most of a unit's spikes are on; of equal ones the lowest."""
    return spikes.groupBy("unit_id").agg(F.mode("channel", True).alias("channel"))


def read_unit_arrays(spark: SparkSession, path: str) -> DataFrame:
    """``unit_id, tick`` of a Parquet table of ``unit_id, spike_indices``. Pickled unit files are never opened: they can run code."""
    return spark.read.parquet(path).select("unit_id", F.posexplode("spike_indices").alias("row", "tick")).select("unit_id", F.col("tick").cast("long").alias("tick"))


def save_whitening(spark: SparkSession, fit: Whitening, path: str) -> None:
    schema = (
        "good_channels array<int>, covariance array<array<double>>, channel_medians array<double>, mean_robust_std double, epsilon double, robust_cov boolean, "
        "artifact_pad_samples int, sampling_rate_hz double, lowcut_hz double, highcut_hz double, filter_order int, version int"
    )
    row = asdict(fit)
    spark.createDataFrame([tuple(row[c.strip().split(" ")[0]] for c in schema.split(", "))], schema).coalesce(1).write.mode("overwrite").parquet(path)


def load_whitening(spark: SparkSession, path: str) -> Whitening:
    """A saved fit of version 1 (which had no pad) or 2."""
    row = spark.read.parquet(path).first().asDict(recursive=True)
    if row.get("version") not in (1, 2):
        raise ValueError(f"version {row.get('version')} can't be read")
    row["artifact_pad_samples"] = row.get("artifact_pad_samples") or 0
    return Whitening(**row)


def write_samples(
    frames: DataFrame, path: str, bit_depth: float = UV_PER_BIT, rounding: str = "half_even", overflow: str = "clamp", layout: str = "parts", in_order: bool = True, mode: str = "error",
) -> None:
    """16-bit samples, channel after channel within a tick, as ``read_voltage`` reads them.

    Every task writes the runs of successive ticks that it holds; no row passes through the driver, and nothing is shuffled: frames that were read from files, filtered and
    referenced are in order. Others (``in_order=False``) are dealt by ranges of ticks and sorted first. ``layout="parts"``: files with a manifest, on any store;
    ``"file"``: one flat file a recording, on a folder that all machines have mounted. Gaps, repeated ticks, ragged, null and non-finite frames are errors, and leave nothing.
    """
    frames = frames.select("recording_id", F.col("tick").cast("long").alias("tick"), F.col("uv").cast("array<double>").alias("uv"))
    if not in_order:
        frames = frames.repartitionByRange("recording_id", "tick").sortWithinPartitions("recording_id", "tick")
    registered(frames.sparkSession)
    mode = "append" if mode == "error" else mode  # the sink itself refuses a folder that holds something
    frames.write.format("flat_recording").options(bit_depth=bit_depth, rounding=rounding, overflow=overflow, layout=layout).mode(mode).save(path)
