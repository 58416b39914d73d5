"""Sources of raw media, and acoustic fingerprints of what they read."""

import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinsieve.functions import images, numeric, sound
from kinsieve.functions import vectors as V
from kinsieve.sources import media


def ppm(frames, rate=None, duration=None, times=None, keys=()):
    out = b""
    for i, f in enumerate(frames):
        said = [f"duration {duration}"] * (i == 0 and duration is not None) + [f"rate {rate}"] * (i == 0 and rate is not None)
        said += [f"time {t}" for t in (times or [])[i : i + 1]] + ["key"] * (i in keys)
        out += b"P6\n" + b"".join(f"# {s}\n".encode() for s in said) + f"{f.shape[1]} {f.shape[0]}\n255\n".encode() + f.tobytes()
    return out


def wav(samples, rate=11025, channels=1, bits=16):
    x = np.repeat(samples[:, None], channels, 1)
    raw = {8: lambda: (x * 127 + 128).astype(np.uint8), 16: lambda: (x * 32767).astype("<i2"), 32: lambda: (x * (2**31 - 1)).astype("<i4"), 64: lambda: x.astype("<f8")}[bits]().tobytes()
    kind = struct.pack("<HHIIHH", 3 if bits == 64 else 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    body = b"WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", 16) + kind + b"data" + struct.pack("<I", len(raw)) + raw
    return b"RIFF" + struct.pack("<I", len(body)) + body


def pictures(n, h=20, w=30, seed=1):
    return list(np.random.default_rng(seed).integers(0, 256, (n, h, w, 3), dtype=np.uint8))


def tune(seed, seconds=30.0, rate=11025):
    """Chords that change every third of a second."""
    r, t = np.random.default_rng(seed), np.arange(int(seconds * rate)) / rate
    out = np.zeros(len(t))
    for k in range(int(seconds * 3) + 1):
        on = (t >= k / 3) & (t < (k + 1) / 3)
        for note in r.integers(-20, 15, 3):
            out[on] += np.sin(2 * np.pi * 440 * 2 ** (note / 12) * t[on])
    return out / 4


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("media")
    (at / "deep" / "er").mkdir(parents=True)
    put = lambda name, data: (at / name).write_bytes(data)
    put("even.ppm", ppm(pictures(100), rate=10))
    put("deep/short.PPM", ppm(pictures(3), rate=10, duration="nan"))
    put("deep/er/keys.ppm", ppm(pictures(6), keys=(1, 4)))
    put("wide.ppm", ppm(pictures(4), times=[0, 1, 38, 39], duration=40, keys=()))
    put("broken.ppm", b"no picture")
    put("cut.ppm", ppm(pictures(2), rate=5)[:-10])
    put("empty.ppm", b"")
    put("none.txt", b"P6")
    put("a.wav", wav(tune(1)))
    put("stereo.wav", wav(tune(1, rate=44100), 44100, 2, 32))
    put("byte.wav", wav(tune(1)[: 11025 * 4], bits=8))
    put("float.wav", wav(tune(1)[:11025], bits=64))
    put("bad.wav", b"RIFF....WAVEfmt ")
    put("silent.wav", wav(np.zeros(0)))
    return str(at)


def rows(df):
    return {r.path.rsplit("/", 1)[1]: r for r in df.collect()}


def test_frames(spark, folder):
    df = media.read_media(spark, media.Frames, folder, window="4", frames="8", size="16", partitionBytes="100000")
    assert dict(df.dtypes)["frames"] == "array<binary>" and df.rdd.getNumPartitions() > 1
    got = rows(df)
    assert set(got) == {"even.ppm", "short.PPM", "keys.ppm", "wide.ppm", "broken.ppm", "cut.ppm", "empty.ppm"}
    even = got["even.ppm"]
    assert (even.rule, even.duration, even.error, even.side, len(even.frames[0])) == ("even", 10.0, None, 16, 16 * 16 * 3)
    assert even.times == [3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0, 6.5]
    assert even.frames[0] == media.resized(pictures(100)[30], 16).tobytes()
    assert got["short.PPM"].duration == pytest.approx(0.3) and got["short.PPM"].times == [0.0, 0.2]
    assert (got["keys.ppm"].rule, got["keys.ppm"].duration, len(got["keys.ppm"].frames)) == ("key", None, 2)
    # nothing in the middle four or eight seconds
    assert (got["wide.ppm"].rule, got["wide.ppm"].error, got["wide.ppm"].frames, got["wide.ppm"].duration) == (None, "no_frames", None, 40.0)
    assert got["broken.ppm"].error == "bad_header" and got["empty.ppm"].error == "no_frames" and got["broken.ppm"].frames is None
    assert got["cut.ppm"].error is None and len(got["cut.ppm"].frames) == 1
    wider = rows(media.read_media(spark, media.Frames, folder, window="19.5", frames="40"))["wide.ppm"]
    assert (wider.rule, wider.times) == ("even_wide", [1.0, 38.0, 39.0])


def test_features_of_read_frames(spark, folder):
    read = media.read_media(spark, media.Frames, folder, size="64")
    got = rows(read.select("path", images.visual_features("frames", "side", "side").alias("f")))
    own = [media.resized(p, 64) for p in pictures(6)]
    assert got["keys.ppm"].f.phash_parts == [images.phash(own[1]), images.phash(own[4])]
    assert got["broken.ppm"].f.phash_parts == [] and got["broken.ppm"].f.color_histogram is None


def test_files_are_packed_in_order():
    files = [("c", 5), ("a", 4), ("b", 4), ("d", 30), ("e", 1)]
    assert [p.files for p in media.packed(files, 10)] == [(("a", 4), ("b", 4)), (("c", 5),), (("d", 30),), (("e", 1),)]
    assert media.packed([], 10) == []


def test_window_is_that_of_the_column_rule(spark):
    cases = [(d, w, r) for d in (0.3, 4.0, 10.0, 100.0) for w in (4.0, 15.0) for r in (0.0, 0.3, 0.5, 1.0)]
    df = spark.createDataFrame(cases, "d double, w double, r double")
    for (d, w, r), row in zip(cases, df.collect(), strict=True):
        start = df.sparkSession.range(1).select(numeric.middle_window_start(F.lit(d), w, r)).first()[0] if (d, w) in ((100.0, 15.0), (4.0, 15.0)) else None
        assert start is None or media.middle(d, w, r)[0] == pytest.approx(start)
        assert media.middle(d, w, r)[1] <= d + 1e-9


def test_sound(spark, folder):
    got = rows(media.read_media(spark, media.Sound, folder, window="10"))
    assert set(got) == {"a.wav", "stereo.wav", "byte.wav", "float.wav", "bad.wav", "silent.wav"}
    a = got["a.wav"]
    assert (a.duration, a.rate, len(a.samples), a.error) == (30.0, 11025, 110250, None)
    assert np.allclose(a.samples, tune(1)[110250:220500], atol=1e-4)
    assert len(got["stereo.wav"].samples) == 110250 and np.corrcoef(got["stereo.wav"].samples, a.samples)[0, 1] > 0.99
    assert np.allclose(got["byte.wav"].samples, tune(1)[: 11025 * 4], atol=0.02) and np.allclose(got["float.wav"].samples, tune(1)[:11025], atol=1e-6)
    assert got["bad.wav"].error == "no_samples" and got["silent.wav"].error == "no_samples" and got["silent.wav"].samples is None


def plain_words(samples):
    """The fingerprint, number by number."""
    n = 1 + (len(samples) - sound.WIDTH) // sound.HOP
    rows = []
    for i in range(n):
        power = abs(np.fft.rfft(samples[i * sound.HOP : i * sound.HOP + sound.WIDTH] * np.hanning(sound.WIDTH))) ** 2
        c = [0.0] * 12
        for k, e in enumerate(power):
            f = k * sound.RATE / sound.WIDTH
            if sound.LOW <= f <= sound.HIGH:
                p = 12 * np.log2(f / 440.0)
                c[int(np.floor(p)) % 12] += e * (1 - (p - np.floor(p)))
                c[(int(np.floor(p)) + 1) % 12] += e * (p - np.floor(p))
        rows.append([x / max(1e-9, sum(y * y for y in c) ** 0.5) for x in c])
    out, m = [], sound.REACH
    for t in range(n - 2 * m):
        b = [sum(r[k] for r in rows[t : t + m]) for k in range(12)]
        a = [sum(r[k] for r in rows[t + m : t + 2 * m]) for k in range(12)]
        w = [x + y for x, y in zip(a, b)]
        bits = [a[k] > b[k] for k in range(12)] + [w[k] > w[k - 1] for k in range(12)] + [w[k] > w[k + 6] for k in range(6)]
        bits += [sum(a[::2]) + sum(b[1::2]) > sum(b[::2]) + sum(a[1::2]), sum(a[:6]) + sum(b[6:]) > sum(b[:6]) + sum(a[6:])]
        out.append(sum(1 << k for k, bit in enumerate(bits) if bit))
    return out


def test_words_against_a_plain_version():
    x = tune(3, 6.0)
    assert np.mean([bin(a ^ b).count("1") for a, b in zip(sound.words_of(x).tolist(), plain_words(x), strict=True)]) < 0.05
    assert len(sound.words_of(x[:3000])) == 0 and len(sound.words_of(np.zeros(60_000))) > 0


def test_copies_are_near_and_others_far(spark):
    rng = np.random.default_rng(9)
    a = tune(1)
    kinds = {"same": a, "louder": 3 * a, "shifted": a[300:], "noisy": a + rng.normal(0, 0.05, len(a)), "again": media.resampled(media.resampled(a, 11025, 22050), 22050)}
    kinds |= {f"other{i}": tune(10 + i) for i in range(4)}
    df = spark.createDataFrame(pd.DataFrame({"kind": list(kinds), "samples": [x.tolist() for x in kinds.values()]}), "kind string, samples array<float>").withColumn("words", sound.fingerprint_words("samples")).cache()
    first = df.where("kind = 'same'").select(F.col("words").alias("own"))
    got = {r.kind: r.d for r in df.join(F.broadcast(first)).select("kind", V.fingerprint_distance(F.col("own"), F.col("words"), 40).alias("d")).collect()}
    assert got["same"] == 0 and all(got[k] < 0.15 for k in ("louder", "shifted", "noisy", "again")), got
    assert all(got[f"other{i}"] > 0.4 for i in range(4)), got
    assert spark.createDataFrame([(None,)], "s array<float>").select(sound.fingerprint_words("s")).first()[0] is None


def test_from_files_to_distances(spark, folder):
    words = media.read_media(spark, media.Sound, folder, window="60").where("error is null").select("path", sound.fingerprint_words("samples").alias("words"))
    got = rows(words)
    pair = spark.createDataFrame([(got["a.wav"].words, got["stereo.wav"].words)], "a array<long>, b array<long>")
    assert pair.select(V.fingerprint_distance(F.col("a"), F.col("b"), 40)).first()[0] < 0.15


def test_many_small_files_are_dealt_to_many_tasks(spark, tmp_path):
    """Their bytes alone would put them into one partition, their number doesn't."""
    files = [(f"f{i:05}", 2000) for i in range(10_000)]
    dealt = media.packed(files, media.PARTITION_BYTES, media.OPEN_BYTES)
    assert len(dealt) > 30 and [f for p in dealt for f in p.files] == files
    for i in range(300):
        (tmp_path / f"{i}.ppm").write_bytes(b"P6\n# rate 1\n1 1\n255\nabc")
    df = media.read_media(spark, media.Frames, str(tmp_path))
    assert df.rdd.getNumPartitions() == 2 and df.where("rule is not null").count() == 300
