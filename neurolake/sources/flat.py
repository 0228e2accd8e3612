"""Flat binary recordings as a Spark data source: ranges planned from sizes, filtered and resampled where they are read; parts
written by tasks and committed with a manifest."""

from __future__ import annotations

import fnmatch
import json
import os
import posixpath
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from neurolake.operators import signal, spatial

MANIFEST = "_manifest.json"
#: Ticks in a batch of rows.
STEP = 1 << 15
#: A task's frames come in runs of successive ticks; a task of more runs than this was given frames out of order.
MOST_RUNS = 10_000


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


@dataclass(frozen=True)
class Recording:
    """A recording as parts of whole ticks: path, byte of its first tick, that tick, number of ticks."""

    name: str
    width: int
    parts: list[tuple[str, int, int, int]] = field(default_factory=list)

    @property
    def ticks(self) -> int:
        return self.parts[-1][2] + self.parts[-1][3] if self.parts else 0

    def read(self, store: fs.FileSystem, first: int, n: int) -> bytes:
        """The bytes of those of ``n`` ticks that there are, over the borders of parts."""
        out, end = [], min(first + n, self.ticks)
        at = bisect_right([p[2] for p in self.parts], first) - 1
        while first < end:
            path, begin, start, length = self.parts[at]
            take = min(end, start + length) - first
            with store.open_input_file(path) as f:
                out.append(f.read_at(take * self.width, begin + (first - start) * self.width))
            first, at = first + take, at + 1
        return b"".join(out)


def recordings(path: str, width: int, header: int = 0) -> list[Recording]:
    """The recordings at a path: a file, the files of a folder or of a pattern, or those that a folder's manifest names."""
    store, inner = store_of(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.File:
        files = [info]
    else:
        pattern = None
        if info.type == fs.FileType.NotFound:
            inner, pattern = posixpath.split(inner)
            if not any(c in pattern for c in "*?["):
                raise FileNotFoundError(path)
        elif store.get_file_info(f"{inner}/{MANIFEST}").type == fs.FileType.File:
            with store.open_input_file(f"{inner}/{MANIFEST}") as f:
                known = json.loads(f.read())
            if known["bytes"] * known["channels"] != width:
                raise ValueError(f"this was written with {known['channels']} channels of {known['bytes']} bytes")
            return [Recording(name, width, [(f"{inner}/{p}", 0, first - parts[0][1], n) for p, first, n in parts]) for name, parts in known["recordings"].items()]
        files = [f for f in store.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File and f.base_name[0] not in "._" and (pattern is None or fnmatch.fnmatch(f.base_name, pattern))]
    out = []
    for f in sorted(files, key=lambda f: f.path):
        if (f.size - header) % width:
            raise ValueError(f"{f.path} isn't a whole number of records of {width} bytes")
        out.append(Recording(f.base_name, width, [(f.path, header, 0, (f.size - header) // width)]))
    return [r for r in out if r.ticks]


@dataclass
class TickRange(InputPartition):
    """Ticks of a recording, counted in what is given out: after resampling."""

    recording: Recording
    first: int
    end: int


class FlatReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        o = self.options = options
        self.channels, self.up = int(o.get("channels", 0)), int(o.get("up", 1))
        self.word_bytes = int(o.get("word_bytes", 2))
        self.width = 2 * self.channels or self.word_bytes
        self.sos = np.array(json.loads(o["sections"])) if o.get("sections") else None
        self.per_task = max(1, int(o.get("per_task", 32 << 20)) // self.width)

    def partitions(self) -> list[TickRange]:
        """Ranges of the ticks and recordings that the options ask for; nothing else is opened.

        That is an option, not a predicate that is pushed down: Spark keeps what one query pushed for all frames of the same load, and
        gives the next query its rows.
        """
        o, out, step = self.options, [], self.per_task * self.up
        for r in recordings(o["path"], self.width, int(o.get("header", 0))):
            if o.get("recording", r.name) != r.name:
                continue
            n = r.ticks * self.up
            runs = spatial.sample_runs(n, int(o["segments"]), int(o["length"])) if "segments" in o else json.loads(o.get("ticks", "null")) or [(0, n)]
            for low, high in runs:
                out += [TickRange(r, first, min(first + step, high, n)) for first in range(max(low, 0), min(high, n), step)]
        return out or [TickRange(Recording("", self.width), 0, 0)]

    def read(self, part: TickRange) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.options["path"])
        step = max(1, STEP // self.up) * self.up
        ends = self._ends(store, part.recording) if self.up > 1 and part.end else None
        for at in range(part.first, part.end, step):
            n = min(step, part.end - at)
            columns = [pa.array([part.recording.name] * n), pa.array(np.arange(at, at + n))]
            if not self.channels:
                words = np.frombuffer(part.recording.read(store, at, n), dtype=f"<u{self.word_bytes}")
                yield pa.RecordBatch.from_arrays([*columns, pa.array(words.astype(np.int32))], ["recording_id", "tick", "word"])
                continue
            uv = np.ascontiguousarray(self._voltage(store, part.recording, at, n, ends).T)
            flat = pa.array(uv.ravel().astype(np.float32 if self.sos is None and self.up == 1 else np.float64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * self.channels), flat)
            yield pa.RecordBatch.from_arrays([*columns, lists], ["recording_id", "tick", "uv"])

    def _filtered(self, store: fs.FileSystem, r: Recording, first: int, n: int) -> np.ndarray:
        """Channels by ticks ``first`` on, in microvolts; filtered with as many ticks on either side as the filter remembers."""
        halo = signal.halo_samples(self.sos) if self.sos is not None else 0
        lead, n = min(halo, first), min(n, r.ticks - first)
        offset, scale = int(self.options.get("offset", 0)), float(self.options["scale"])
        x = np.frombuffer(r.read(store, first - lead, lead + n + halo), dtype="<u2" if offset else "<i2").reshape(-1, self.channels)
        uv = ((x.astype(np.float64) - offset) * scale).astype(np.float32).T
        if self.sos is None:
            return uv
        return signal.both_ways(self.sos, uv.astype(np.float64))[:, lead : lead + n]

    def _ends(self, store: fs.FileSystem, r: Recording) -> tuple[np.ndarray, np.ndarray]:
        return tuple(self._filtered(store, r, t, 1)[:, -1:].astype(np.float64) for t in (0, r.ticks - 1))

    def _voltage(self, store: fs.FileSystem, r: Recording, at: int, n: int, ends: tuple | None) -> np.ndarray:
        if ends is None:
            return self._filtered(store, r, at, n)
        begin, end = at // self.up, -(-(at + n) // self.up)
        reach = signal.reach(self.up)
        lead = min(reach, begin)
        x = self._filtered(store, r, begin - lead, lead + end - begin + reach).astype(np.float64)
        slope = (ends[1] - ends[0]) / max(r.ticks - 1, 1)
        line = lambda t: ends[0] + slope * t
        x = x - line(begin - lead + np.arange(x.shape[1]))
        y = signal.resample_rows(x, self.up, 1, float(self.options.get("beta", 5.0)), lead, end - begin)
        y = y + line(begin + np.arange(y.shape[1]) / self.up)
        return y[:, at - begin * self.up : at - begin * self.up + n]


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: recording, file, first tick, ticks of each run; and the number of channels."""

    runs: list[tuple[str, str, int, int]]
    channels: int | None


def to_int16(uv: np.ndarray, bit_depth: float, rounding: str, overflow: str) -> np.ndarray:
    """Samples in bits: rounded half to even or cut off; out of range clamped, or wrapped as two's complement."""
    if not np.isfinite(uv).all():
        raise ValueError("a sample isn't finite")
    x = uv / bit_depth
    x = np.rint(x) if rounding == "half_even" else np.trunc(x)
    if overflow == "clamp":
        return np.clip(x, -32768, 32767).astype("<i2")
    return ((x.astype(np.int64) + 32768) % 65536 - 32768).astype("<i2")


class FlatWriter(DataSourceArrowWriter):
    """Frames as 16-bit samples, tick after tick.

    ``layout=parts``: each run of successive ticks of a task is a file of its own; the commit checks that a recording's runs follow on each other
    and writes a manifest, and without one nothing can be read. ``layout=file``, on a folder that all machines have mounted: tasks write
    at a run's place in one file a recording, which gets its name at the commit. What failed or repeated tasks wrote goes at the commit or the abort.
    """

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.options, self.overwrite = options, overwrite
        self.layout, self.attempt = options.get("layout", "parts"), f"data-{uuid.uuid4().hex}"
        if self.layout not in ("parts", "file"):
            raise ValueError("the layout is parts or file")
        store, inner = self._store()
        there = store.get_file_info(inner).type != fs.FileType.NotFound
        if there and not overwrite and any(True for _ in store.get_file_info(fs.FileSelector(inner))):
            raise FileExistsError(inner)

    def _store(self) -> tuple[fs.FileSystem, str]:
        store, inner = store_of(self.options["path"])
        if self.layout == "file" and not isinstance(store, fs.LocalFileSystem):
            raise ValueError("one file needs a folder that can be written at any place")
        return store, inner.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, inner = self._store()
        folder = f"{inner}/{self.attempt}"
        store.create_dir(folder, recursive=True)
        runs, channels, out = [], None, None
        depth, rounding, overflow = float(self.options["bit_depth"]), self.options.get("rounding", "half_even"), self.options.get("overflow", "clamp")
        try:
            for b in iterator:
                if not b.num_rows:
                    continue
                uv = b.column("uv")
                if uv.null_count or b.column("tick").null_count or b.column("recording_id").null_count:
                    raise ValueError("a frame is null")
                widths = np.unique(np.diff(uv.offsets.to_numpy()))
                channels = int(widths[0]) if channels is None else channels
                if widths.tolist() != [channels] or uv.flatten().null_count:
                    raise ValueError("frames differ in their numbers of samples, or a sample is null")
                x = to_int16(uv.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, channels), depth, rounding, overflow)
                ticks, names = b.column("tick").to_numpy(), b.column("recording_id").to_pylist()
                new = np.nonzero((np.diff(ticks) != 1) | (np.array(names[1:], dtype=object) != np.array(names[:-1], dtype=object)))[0] + 1
                for begin, end in zip([0, *new], [*new, len(x)], strict=True):
                    name, first, n = names[begin], int(ticks[begin]), int(end - begin)
                    if runs and runs[-1][0] == name and runs[-1][2] + runs[-1][3] == first:
                        runs[-1] = (*runs[-1][:3], runs[-1][3] + n)
                    else:
                        if len(runs) >= MOST_RUNS:
                            raise ValueError("frames come out of order: sort them by recording and tick in their partitions")
                        if out is not None:
                            out.close()
                        file = name if self.layout == "file" else f"{uuid.uuid4().hex}.dat"
                        runs.append((name, f"{self.attempt}/{file}", first, n))
                        out = self._opened(store, f"{folder}/{file}", first * 2 * channels)
                    out.write(x[begin:end].tobytes())
            if out is not None:
                out.close()
        except BaseException:
            if out is not None:
                out.close()
            if self.layout == "parts":
                for _, file, _, _ in runs:
                    store.delete_file(f"{inner}/{file}")
            raise
        return Written(runs, channels)

    def _opened(self, store: fs.FileSystem, path: str, at: int):
        if self.layout == "parts":
            return store.open_output_stream(path)
        f = os.fdopen(os.open(path, os.O_RDWR | os.O_CREAT, 0o644), "r+b")
        f.seek(at)
        return f

    def commit(self, messages: list[Written | None]) -> None:
        by: dict[str, list[tuple[str, int, int]]] = {}
        channels = {m.channels for m in messages if m is not None and m.channels is not None}
        for m in messages:
            for name, file, first, n in m.runs if m is not None else ():
                by.setdefault(name, []).append((file, first, n))
        store, inner = self._store()
        try:
            if len(channels) > 1:
                raise ValueError("frames differ in their numbers of samples")
            for name, runs in by.items():
                runs.sort(key=lambda r: r[1])
                if any(a[1] + a[2] != b[1] for a, b in zip(runs, runs[1:], strict=False)) or (self.layout == "file" and runs[0][1]):
                    raise ValueError(f"the ticks of {name} have gaps or repeat")
        except ValueError:
            self.abort(messages)
            raise
        old = [f for f in store.get_file_info(fs.FileSelector(inner)) if f.base_name != self.attempt] if store.get_file_info(inner).type == fs.FileType.Directory else []
        store.create_dir(f"{inner}/{self.attempt}", recursive=True)
        if self.layout == "file":
            for name in by:
                store.move(f"{inner}/{self.attempt}/{name}", f"{inner}/{name}")
            store.delete_dir(f"{inner}/{self.attempt}")
        else:
            used = {f"{inner}/{file}" for runs in by.values() for file, _, _ in runs}
            for f in store.get_file_info(fs.FileSelector(f"{inner}/{self.attempt}")):
                if f.path not in used:
                    store.delete_file(f.path)
            with store.open_output_stream(f"{inner}/{self.attempt}.json") as f:
                f.write(json.dumps({"channels": channels.pop() if channels else 0, "bytes": 2, "recordings": by}).encode())
            store.move(f"{inner}/{self.attempt}.json", f"{inner}/{MANIFEST}")
        for f in old:
            if f.base_name != MANIFEST and f.base_name not in (by if self.layout == "file" else ()):
                store.delete_dir(f.path) if f.type == fs.FileType.Directory else store.delete_file(f.path)

    def abort(self, messages: list[Written | None]) -> None:
        store, inner = self._store()
        if store.get_file_info(f"{inner}/{self.attempt}").type == fs.FileType.Directory:
            store.delete_dir(f"{inner}/{self.attempt}")
        if store.get_file_info(inner).type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(inner)):
            store.delete_dir(inner)


class FlatRecording(DataSource):
    """Options: ``path``; ``channels`` of 16-bit samples with ``scale`` and ``offset``, or else ``word_bytes`` of a digital word; ``header`` bytes;
    ``per_task`` bytes; ``sections`` of a filter in JSON; ``up`` and ``beta`` of resampling; what is read: one ``recording``, ``ticks`` as pairs in JSON, or
    ``segments`` of a ``length`` (``spatial.sample_runs``). Of the sink: ``bit_depth, rounding, overflow, layout``."""

    @classmethod
    def name(cls) -> str:
        return "flat_recording"

    def schema(self) -> str:
        if not int(self.options.get("channels", 0)):
            return "recording_id string, tick long, word int"
        exact = self.options.get("sections") or int(self.options.get("up", 1)) > 1
        return f"recording_id string, tick long, uv array<{'double' if exact else 'float'}>"

    def reader(self, schema) -> FlatReader:
        return FlatReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> FlatWriter:
        return FlatWriter(dict(self.options), overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """The session with this source."""
    if not getattr(spark, "_neurolake_flat", False):
        spark.dataSource.register(FlatRecording)
        spark._neurolake_flat = True
    return spark
