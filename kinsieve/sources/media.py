"""Python data sources for raw media: frames of PPM streams and sound of WAV files, sampled in the middle of a file.

    spark.dataSource.register(Frames); spark.read.format("frames").option("size", 64).load("hdfs://.../content")

Both list the files below a path by metadata, deal them into partitions of about `partitionBytes` each (a file counts `openBytes` more than its size), and give one row
for each file; a file that can't be read gives nulls and an error tag, never a failed task. Paths may be of any
file system that Arrow knows. A PPM stream is a file of P6 images one after the other, whose comments
may tell `time <seconds>`, `key` and, in the first, `duration <seconds>` and `rate <frames a second>`.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.numeric import container_duration
from ..options import Options

PARTITION_BYTES = 64 * 2**20
#: What a file counts for beside its bytes: opening it and working out its row takes as long as reading so many.
OPEN_BYTES = 2**18
#: Longest window that a second attempt looks at, in seconds.
WIDEST = 60.0
#: Samples a second of the sound that is handed on.
RATE = 11025
HEADER = re.compile(rb"P6((?:\s+|#[^\n]*\n)+)(\d+)((?:\s+|#[^\n]*\n)+)(\d+)((?:\s+|#[^\n]*\n)+)255\s")


@dataclass(frozen=True)
class Files(InputPartition):
    """Files (path, size) that one task reads."""

    files: tuple[tuple[str, int], ...]


def packed(files: list[tuple[str, int]], most: int, opening: int = 0) -> list[Files]:
    """Files in order of their paths, in partitions of about `most` bytes, each with `opening` bytes more; a file is never split."""
    out, own, size = [], [], 0
    for path, n in sorted(files):
        if own and size + n + opening > most:
            out.append(Files(tuple(own)))
            own, size = [], 0
        own.append((path, n))
        size += n + opening
    return [*out, Files(tuple(own))] if own else out


class MediaReader(DataSourceReader):
    """One row of `columns` for each file with one of `suffixes` below the path."""

    def __init__(self, source: Media):
        self.source = source

    def partitions(self) -> list[Files]:
        o = self.source.options
        store, path = fs.FileSystem.from_uri(o["path"]) if "://" in o["path"] else (fs.LocalFileSystem(), o["path"])
        found = store.get_file_info(fs.FileSelector(path, recursive=True))
        wanted = [(f.path, f.size) for f in found if f.is_file and f.extension.lower() in self.source.suffixes]
        return packed(wanted, int(o.get("partitionbytes", PARTITION_BYTES)), int(o.get("openbytes", OPEN_BYTES))) or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        o = self.source.options
        store = fs.FileSystem.from_uri(o["path"])[0] if "://" in o["path"] else fs.LocalFileSystem()
        target = pa.schema(self.source.fields)
        for path, size in partition.files:
            row = {"path": path, "size": size}
            try:
                with store.open_input_file(path) as file:
                    row |= self.source.features(file, size)
            except (OSError, ValueError, struct.error) as bad:
                row["error"] = str(bad) if isinstance(bad, ValueError) else type(bad).__name__
            yield pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], f.type) for f in target], schema=target)


class Media(DataSource):
    """Options: path, partitionBytes, openBytes, window (seconds) and seekRatio, the middle of the window as a share of the duration."""

    suffixes: tuple[str, ...] = ()
    fields: list[pa.Field] = []

    def schema(self) -> str:
        names = {pa.string(): "string", pa.int64(): "long", pa.float64(): "double", pa.int32(): "int", pa.list_(pa.float64()): "array<double>", pa.list_(pa.binary()): "array<binary>", pa.list_(pa.float32()): "array<float>"}
        return ", ".join(f"{f.name} {names[f.type]}" for f in self.fields)

    def reader(self, schema) -> MediaReader:
        return MediaReader(self)

    def window(self, default: float) -> tuple[float, float]:
        return float(self.options.get("window", default)), float(self.options.get("seekratio", Options().seek_ratio))


COMMON = [pa.field("path", pa.string()), pa.field("size", pa.int64()), pa.field("container", pa.float64()), pa.field("streams", pa.list_(pa.float64()))]


def middle(duration: float | None, window: float, ratio: float) -> tuple[float, float]:
    """(start, end) of the window around that share of the duration, inside the file; from the start if the duration isn't known."""
    if duration is None:
        return 0.0, window
    w = min(window, duration)
    start = max(0.0, min(min(max(duration * ratio, 0.0), duration) - w / 2, duration - w))
    return start, start + w


@dataclass
class Frame:
    at: int
    width: int
    height: int
    time: float | None
    key: bool


def ppm_index(file, size: int) -> tuple[list[Frame], dict[str, float]]:
    """The frames of a PPM stream by their headers, pixels skipped, and the numbers that the first one's comments tell."""
    frames, told, at = [], {}, 0
    while at < size:
        file.seek(at)
        m = HEADER.match(head := file.read(512))
        if not m:
            if frames and not head.strip():
                break
            raise ValueError("bad_header" if not frames else "bad_frame")
        said = {k.decode(): v for k, v in re.findall(rb"#\s*(\w+)[ \t]*([\d.eE+-]*)", m[1] + m[3] + m[5])}
        if not frames:
            told = {k: float(said[k]) for k in ("duration", "rate") if said.get(k)}
        width, height, at = int(m[2]), int(m[4]), at + m.end()
        if at + width * height * 3 > size:
            break  # a frame that was cut off
        rate = told.get("rate")
        time = float(said["time"]) if said.get("time") else len(frames) / rate if rate else None
        frames.append(Frame(at, width, height, time, "key" in said))
        at += width * height * 3
    return frames, told


def evenly(frames: list[Frame], start: float, end: float, most: int) -> list[Frame]:
    """Frames at an even rate of the window: for each tick the first frame from it on, each frame once."""
    rate = max(1.0, min(15.0, most / max(1.0, end - start)))
    inside = [f for f in frames if f.time is not None and start <= f.time < end]
    picked, tick = [], start
    for f in inside:
        if f.time >= tick - 1e-9:
            picked.append(f)
            tick += (int((f.time - tick) * rate + 1e-9) + 1) / rate
    return picked[:most]


def keys_of(frames: list[Frame], start: float, end: float, most: int) -> list[Frame]:
    return [f for f in frames if f.key and (f.time is None or start <= f.time < end)][:most]


def chosen(frames: list[Frame], duration: float | None, window: float, ratio: float, most: int) -> tuple[str | None, list[Frame]]:
    """The first rule that finds frames, and those: an even rate, key frames, both again in a window twice as wide."""
    near = middle(duration, window, ratio)
    tries = [("even", evenly, near), ("key", keys_of, near)]
    if duration and near[1] - near[0] < min(duration, WIDEST):
        far = middle(duration, min(duration, WIDEST, 2 * (near[1] - near[0])), ratio)
        tries += [("even_wide", evenly, far), ("key_wide", keys_of, far)]
    for rule, pick, (start, end) in tries:
        if found := pick(frames, start, end, most):
            return rule, found
    return None, []


def resized(frame: np.ndarray, size: int) -> np.ndarray:
    """size x size pixels: means over the pixels that each covers, or the nearest of a smaller frame."""
    for axis in (0, 1):
        n = frame.shape[axis]
        edges = np.arange(size + 1) * n / size
        first = np.minimum(edges[:-1].astype(int), n - 1)
        last = np.maximum(np.ceil(edges[1:]).astype(int), first + 1)
        sums = np.concatenate([np.zeros_like(np.take(frame, [0], axis), np.float64), np.cumsum(frame, axis, np.float64)], axis)
        counts = (last - first).reshape([-1 if i == axis else 1 for i in range(3)])
        frame = (np.take(sums, last, axis) - np.take(sums, first, axis)) / counts
    return np.round(frame).astype(np.uint8)


class Frames(Media):
    """At most `frames` RGB frames of size x size pixels of each PPM stream, with the rule that found them."""

    suffixes = ("ppm",)
    fields = [*COMMON, pa.field("rule", pa.string()), pa.field("times", pa.list_(pa.float64())), pa.field("side", pa.int32()), pa.field("frames", pa.list_(pa.binary())), pa.field("error", pa.string())]

    @classmethod
    def name(cls) -> str:
        return "frames"

    def features(self, file, size: int) -> dict:
        o = Options()
        frames, told = ppm_index(file, size)
        if not frames:
            raise ValueError("no_frames")
        known = [f.time for f in frames if f.time is not None]
        step = 1 / told["rate"] if told.get("rate") else (known[-1] - known[0]) / (len(known) - 1) if len(known) > 1 else 0.0
        stream = known[-1] + step if known else None
        length = next((d for d in (told.get("duration"), stream) if d is not None and 0 < d < float("inf")), None)
        rule, picked = chosen(frames, length, *self.window(o.video_window_seconds), int(self.options.get("frames", o.sample_frames)))
        side = max(8, int(self.options.get("size", 64)))
        out = []
        for f in picked:
            file.seek(f.at)
            out.append(resized(np.frombuffer(file.read(f.width * f.height * 3), np.uint8).reshape(f.height, f.width, 3), side).tobytes())
        about = {"container": told.get("duration"), "streams": [] if stream is None else [stream]}
        return about | ({"rule": rule, "times": [f.time for f in picked], "side": side, "frames": out} if out else {"error": "no_frames"})


def wav_index(file, size: int) -> tuple[tuple[int, int, int, int], int, int]:
    """((format, channels, rate, bits), place and length of the samples) of a WAV file."""
    file.seek(0)
    head = file.read(12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise ValueError("bad_header")
    at, kind = 12, None
    while at + 8 <= size:
        file.seek(at)
        name, n = struct.unpack("<4sI", file.read(8))
        if name == b"fmt ":
            body = file.read(min(n, 40))
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            kind = (struct.unpack("<H", body[24:26])[0] if code == 0xFFFE and len(body) >= 26 else code, channels, rate, bits)
        elif name == b"data":
            if kind is None or not kind[1] or not kind[2] or (kind[0], kind[3]) not in ((1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)):
                raise ValueError("bad_format")
            return kind, at + 8, min(n, size - at - 8)
        at += 8 + n + n % 2
    raise ValueError("no_samples")


def samples_of(raw: bytes, code: int, bits: int) -> np.ndarray:
    """Samples between -1 and 1."""
    if code == 3:
        return np.frombuffer(raw, "<f4" if bits == 32 else "<f8").astype(np.float64)
    if bits == 8:
        return (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    if bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        return ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 2.0**23
    return np.frombuffer(raw, f"<i{bits // 8}") / 2.0 ** (bits - 1)


def resampled(x: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """x at another rate: means over a period of the slower one, then straight lines between them."""
    if rate == to or not len(x):
        return x
    width = max(1, round(rate / to))
    smooth = np.convolve(x, np.ones(width) / width, "same") if width > 1 else x
    return np.interp(np.arange(int(len(x) * to / rate)) * rate / to, np.arange(len(x)), smooth)


class Sound(Media):
    """Mono sound at 11025 samples a second of each WAV file's middle window."""

    suffixes = ("wav",)
    fields = [*COMMON, pa.field("rate", pa.int32()), pa.field("samples", pa.list_(pa.float32())), pa.field("error", pa.string())]

    @classmethod
    def name(cls) -> str:
        return "sound"

    def features(self, file, size: int) -> dict:
        (code, channels, rate, bits), at, n = wav_index(file, size)
        width = channels * bits // 8
        total = n // width
        if not total:
            raise ValueError("no_samples")
        length = total / rate
        start, end = middle(length, *self.window(60.0))
        first = int(start * rate)
        file.seek(at + first * width)
        raw = file.read((min(total, round(end * rate)) - first) * width)
        mono = samples_of(raw, code, bits).reshape(-1, channels).mean(1)
        if not np.isfinite(mono).all():
            raise ValueError("bad_samples")
        return {"container": length, "streams": [length], "rate": RATE, "samples": resampled(mono, rate).astype(np.float32)}


def read_media(spark: SparkSession, source: type[Media], path: str, **options) -> DataFrame:
    """Rows of a source, with duration: the container's, if valid, else the longest of the streams."""
    spark.dataSource.register(source)
    rows = spark.read.format(source.name()).options(**options).load(path)
    return rows.withColumn("duration", container_duration(F.col("container"), F.col("streams")))
