"""Whole paths of a recording: preprocessing, upsampling of a channel, pulses of a camera line."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from neurolake.cluster import checkpointed
from neurolake.operators import signal, spatial
from neurolake.operators.ttl import line_pulses
from neurolake.sources.binary import UV_PER_BIT, read_digital, read_voltage, write_samples

MODES = ("zca", "cmr", "cmr_zca")


def _referenced(filtered: DataFrame, good: list[int], mode: str, fs: float, low: float, high: float, order: int, epsilon: float, pad: int | None) -> DataFrame:
    if "cmr" in mode:
        filtered = spatial.common_median_reference(filtered, good)
    if "zca" in mode:
        filtered = spatial.whiten(filtered, good, fs=fs, epsilon=epsilon, pad=pad, lowcut=low, highcut=high, order=order)
    return filtered


def _mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"the mode is one of {MODES}")
    return mode


def preprocess(
    frames: DataFrame, good: list[int], mode: str = "cmr_zca", fs: float = 30000.0, low: float = 300.0, high: float = 5000.0, order: int = 2, kind: str = "bessel",
    block: int = 30000, epsilon: float = 10.0, pad: int | None = None,
) -> DataFrame:
    """Band-pass every channel, then reference to the common median, whiten, or both. Dead channels are filtered only.

    Frames of a table are dealt to blocks of channels and back; ``preprocess_file`` filters a file's ranges where they are read.
    """
    sos = signal.bandpass_sections(low, high, fs, order, kind)
    out = signal.blocks_to_frames(signal.filtered(signal.frames_to_blocks(frames, block), sos), block)
    return _referenced(out, good, _mode(mode), fs, low, high, order, epsilon, pad)


def filtered_voltage(spark: SparkSession, path: str, channels: int, sos: np.ndarray, **options) -> DataFrame:
    """Band-passed frames of a file, without an exchange of samples: each range is read with the filter's halo."""
    return read_voltage(spark, path, channels, sections=sos, **options)


def preprocess_file(
    spark: SparkSession, path: str, target: str, channels: int, good: list[int], mode: str = "cmr_zca", fs: float = 30000.0, low: float = 300.0, high: float = 5000.0, order: int = 2,
    kind: str = "bessel", epsilon: float = 10.0, pad: int | None = None, layout: str = "parts",
) -> None:
    """``preprocess`` from a file to 16-bit samples. Whitening looks at the filtered frames several times, so these are checkpointed and filtered once."""
    out = filtered_voltage(spark, path, channels, signal.bandpass_sections(low, high, fs, order, kind))
    if "zca" in _mode(mode):
        out = checkpointed(out)
    write_samples(_referenced(out, good, mode, fs, low, high, order, epsilon, pad), target, layout=layout)


def _motion(filtered: DataFrame, good: list[int], fs: float) -> tuple[DataFrame, DataFrame]:
    return spatial.common_median_reference(filtered, good, "all"), spatial.whiten(filtered, good, fs=fs, epsilon=0.1)


def motion_inputs(frames: DataFrame, good: list[int], fs: float = 30000.0, block: int = 30000) -> tuple[DataFrame, DataFrame]:
    """What motion is estimated from and what it is applied to: band-passed and referenced on all channels, and whitened. The
    estimate itself is another program's and isn't part of this package."""
    return _motion(signal.blocks_to_frames(signal.filtered(signal.frames_to_blocks(frames, block), signal.bandpass_sections(fs=fs)), block), good, fs)


def motion_inputs_of_file(spark: SparkSession, path: str, channels: int, good: list[int], fs: float = 30000.0) -> tuple[DataFrame, DataFrame]:
    """``motion_inputs`` of a file, whose ranges are filtered where they are read: no sample is exchanged."""
    return _motion(checkpointed(filtered_voltage(spark, path, channels, signal.bandpass_sections(fs=fs))), good, fs)


def upsample_channel(spark: SparkSession, path: str, up: int = 4, unsigned: bool = False, fs: float = 30000.0, bit_depth: float = UV_PER_BIT, header: int = 0) -> DataFrame:
    """Frames of one channel, band-passed and ``up`` times as dense, in microvolts; both where its ranges are read."""
    return filtered_voltage(spark, path, 1, signal.bandpass_sections(fs=fs), scale=bit_depth, offset=32768 if unsigned else 0, up=up, header=header)


def upsample_file(
    spark: SparkSession, path: str, target: str, up: int = 4, unsigned: bool = False, fs: float = 30000.0, bit_depth: float = UV_PER_BIT, header: int = 0, layout: str = "parts",
) -> None:
    """``upsample_channel`` to signed 16-bit samples, cut off, not rounded; values out of range wrap."""
    write_samples(upsample_channel(spark, path, up, unsigned, fs, bit_depth, header), target, bit_depth, "truncate", "wrap", layout)


def camera_pulses(spark: SparkSession, path: str, line: int = 1, rising: bool | None = None) -> DataFrame:
    return line_pulses(read_digital(spark, path), line, ["recording_id"], rising)
