"""Scalar functions on numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_duration(d: Column) -> Column:
    return d.isNotNull() & ~F.isnan(d) & (d > 0) & (d < float("inf"))


def container_duration(container: Column, streams: Column) -> Column:
    """The container's duration if valid, else the longest valid one of its streams, else null."""
    return F.coalesce(F.when(valid_duration(container), container), F.array_max(F.filter(streams, valid_duration)))


def nearest_bucket(d: Column, mode: str = "nearest_0.5") -> Column:
    """Half-even rounding to half or whole seconds, as text ('30.0' or '30')."""
    if mode in ("nearest_0.5", "0.5", "half"):
        return (F.rint(d * 2) / 2).cast("string")
    return F.rint(d).cast("long").cast("string")


def middle_window_start(d: Column, window: float, ratio: float) -> Column:
    w = F.least(F.lit(window), d)
    start = F.least(F.greatest(d * ratio, F.lit(0.0)), d) - w / 2
    return F.when(d > 0, F.least(F.greatest(start, F.lit(0.0)), F.greatest(F.lit(0.0), d - w))).otherwise(0.0)


def sampling_rate(frames: int, window: Column) -> Column:
    return F.greatest(F.lit(1.0), F.least(F.lit(15.0), F.lit(float(frames)) / F.greatest(F.lit(1.0), window)))


def backoff(attempts: Column, delay: Column | float, reason: Column) -> Column:
    """Seconds to wait after the nth failed attempt; at least ten, doubling, when the server said 429."""
    delay = delay if isinstance(delay, Column) else F.lit(float(delay))
    step = F.pow(F.lit(2.0), (attempts - 1).cast("double"))
    plain = F.least(F.lit(120.0), delay * step)
    return F.when(F.coalesce(reason, F.lit("")).contains("429"), F.greatest(plain, F.least(F.lit(120.0), 10.0 * step))).otherwise(plain)


def retry_hint_ms(cooldown: Column, next_ts: Column, now: Column) -> Column:
    wait = (F.greatest(cooldown, F.coalesce(next_ts, now)) - now) * 1000
    return F.greatest(F.lit(250), F.least(F.lit(5000), wait.cast("long"))).cast("long")


def lenient_int(x: Column, default: int) -> Column:
    return F.coalesce(F.trim(x).try_cast("bigint"), F.lit(default).cast("bigint"))


def lenient_float(x: Column, default: float) -> Column:
    return F.coalesce(F.trim(x).try_cast("double"), F.lit(default))


def lenient_bool(x: Column, default: bool = False) -> Column:
    return F.coalesce(F.lower(F.trim(x)).isin("1", "true", "yes", "y", "on"), F.lit(default))


def workers(x: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(16), F.coalesce(x.cast("int"), F.lit(8))))


def format_bytes(n: Column) -> Column:
    v = F.coalesce(n.cast("double"), F.lit(0.0))
    out = F.concat(F.format_string("%.1f", F.bround(v / float(1024**4), 1)), F.lit(" TB"))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(v < float(1024 ** (power + 1)), F.concat(F.format_string("%.1f", F.bround(v / float(1024**power), 1)), F.lit(f" {unit}"))).otherwise(out)
    return out
