"""Operator 2: text quality by a factorisation machine.

Features are hashed words (their share of the text), structure statistics of
words, characters and lines, and the n_chars metadata, each statistic as one of
its bins. Pairs of features interact through vectors of rank RANK; a text is
scored in time linear in its features by the sum-of-squares identity. Weights
come from a bounded sample of labels by Adagrad.

Cases: null and empty texts are scored by the bins of nothing; a null n_chars
counts as 0. Whole texts count. Without labels of both kinds the score is the
share of label 1, 0 if there is none. Repeated rows are scored each. Extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cache, fold, hash64, read
from .learn import sample

#: Training rows of each label at most.
MAX_ROWS = 3000
BUCKETS, RANK, BINS, FOLDS, HELD_OUT, THRESHOLD = 2**16, 6, 12, 5, 0, 0.3
STEPS, RATE, DECAY, SPREAD = 24_000, 0.05, 1e-4, 0.02
CHUNK = 300_000
#: Statistics of a text, in the order of statistics().
STATISTICS = ("words", "word_length", "distinct", "repeated_next", "upper", "digit", "symbol", "non_ascii", "bars", "lines", "line_length", "repeated_lines", "marked_words", "short_words", "n_chars")
_KIND = np.zeros(256, np.int64)  # 1 upper, 2 digit, 3 symbol, 4 beyond ASCII, 5 bar, else 0
_KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 4
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{}~":
    _KIND[_c] = 3
_KIND[ord("|")] = 5
_MARKS = frozenset(b"#$%&*+/<=>@\\^_`{|}~!")


def statistics(raw: bytes, words: list[bytes], hashes: np.ndarray, n_chars: int) -> list[float]:
    n, size = len(words), max(1, len(raw))
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=6) / size
    lines = raw.split(b"\n")
    lengths = np.fromiter(map(len, words), np.int64, n)
    return [
        np.log1p(n), lengths.mean() if n else 0.0, len(np.unique(hashes)) / n if n else 0.0, float((hashes[1:] == hashes[:-1]).mean()) if n > 1 else 0.0,
        kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], np.log1p(len(lines)), n / len(lines), 1 - len(set(lines)) / len(lines),
        sum(w[-1] in _MARKS for w in words) / n if n else 0.0, float((lengths <= 2).mean()) if n else 0.0, np.log1p(max(0, n_chars)),
    ]


def _features(batches):
    """(batch, first row, buckets, shares, owners, statistics) of stretches of rows; columns text, n_chars come first."""
    cache = Cache(hash64)
    for batch in batches:
        texts, n_chars = batch.column(0), batch.column(1)
        first, rows, words = 0, [], 0
        for i in range(len(texts)):
            raw = (texts[i].as_py() or "").encode()
            split = raw.split()
            rows.append((raw, split, n_chars[i].as_py() or 0))
            words += len(split)
            if words >= CHUNK or i + 1 == len(texts):
                counts = np.array([len(s) for _, s, _ in rows])
                hashes = np.fromiter((cache[w] for _, s, _ in rows for w in s), np.uint64, words)
                ends = np.cumsum(counts)
                stats = np.array([statistics(raw, s, hashes[e - len(s) : e], n) for (raw, s, n), e in zip(rows, ends, strict=True)])
                pairs, times = np.unique(np.repeat(np.arange(len(rows)), counts) * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
                owner = pairs // BUCKETS
                yield batch, first, pairs % BUCKETS, times / counts[owner], owner, stats
                first, rows, words = i + 1, [], 0


@dataclass
class Model:
    edges: np.ndarray  # statistics by BINS - 1
    bias: float
    linear: np.ndarray  # of buckets, then bins of each statistic
    factors: np.ndarray

    def binned(self, stats: np.ndarray) -> np.ndarray:
        """Feature numbers of the bins of each row's statistics."""
        return np.stack([BUCKETS + k * BINS + np.searchsorted(self.edges[k], stats[:, k], "right") for k in range(stats.shape[1])], 1)

    def margins(self, bucket, share, owner, stats) -> np.ndarray:
        """bias + sum w x + (square of sums - sum of squares) / 2, for all rows at once."""
        bins = self.binned(stats)
        n = len(stats)
        ids, x, own = np.r_[bucket, bins.ravel()], np.r_[share, np.ones(bins.size)], np.r_[owner, np.repeat(np.arange(n), bins.shape[1])]
        out = np.bincount(own, self.linear[ids] * x, n) + self.bias
        for f in range(self.factors.shape[1]):
            vx = self.factors[ids, f] * x
            out += 0.5 * (np.bincount(own, vx, n) ** 2 - np.bincount(own, vx * vx, n))
        return out


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]) -> Model:
    """rows: buckets, shares, statistics and label of each training text."""
    stats = np.array([s for _, _, s, _ in rows])
    edges = np.stack([np.quantile(column, np.arange(1, BINS) / BINS) for column in stats.T])
    random = np.random.default_rng(11)
    size = BUCKETS + stats.shape[1] * BINS
    model = Model(edges, 0.0, np.zeros(size), random.normal(0, SPREAD, (size, RANK)))
    bins = model.binned(stats)
    squares_w, squares_v, squares_b = np.full(size, 1e-2), np.full((size, RANK), 1e-2), 1e-2
    for _ in range(min(60, max(4, STEPS // len(rows)))):
        for i in random.permutation(len(rows)):
            bucket, share, _, label = rows[i]
            ids, x = np.r_[bucket, bins[i]], np.r_[share, np.ones(bins.shape[1])]
            v = model.factors[ids]
            sums = x @ v
            margin = model.bias + model.linear[ids] @ x + 0.5 * (sums @ sums - ((v * x[:, None]) ** 2).sum())
            error = 1 / (1 + np.exp(-np.clip(margin, -35, 35))) - label
            g_w = error * x + DECAY * model.linear[ids]
            g_v = error * x[:, None] * (sums - v * x[:, None]) + DECAY * v
            squares_b += error * error
            squares_w[ids] += g_w * g_w
            squares_v[ids] += g_v * g_v
            model.bias -= RATE * error / np.sqrt(squares_b)
            model.linear[ids] -= RATE * g_w / np.sqrt(squares_w[ids])
            model.factors[ids] -= RATE * g_v / np.sqrt(squares_v[ids])
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_ROWS) -> Model:
    """From the labelled rows out of the held-out fold, at most `most` of each label; docs: doc_id, text, n_chars."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold("doc_id", FOLDS) != HELD_OUT)).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    shares = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    picked = F.broadcast(sample(known, "label", most))  # at most 2 * most rows

    def run(batches):
        for batch, first, bucket, share, owner, stats in _features(batches):
            cuts = np.searchsorted(owner, np.arange(len(stats) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(cuts), pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(pa.array(cuts), pa.array(share)), pa.array(list(stats), pa.list_(pa.float64())), batch.column(2).slice(first, len(stats))],
                names=["bucket", "share", "stats", "label"],
            )

    table = docs.join(picked, "doc_id").select("text", "n_chars", "label").mapInArrow(run, "bucket array<int>, share array<double>, stats array<double>, label int").toArrow()
    rows = [(b.values.to_numpy().astype(np.int64), s.values.to_numpy(), np.array(t.as_py()), y) for b, s, t, y in zip(*(table.column(c).combine_chunks() for c in ("bucket", "share", "stats")), table.column("label").to_pylist(), strict=True)]
    rows.sort(key=lambda r: (r[3], len(r[0]), r[0].tobytes(), r[2].tobytes()))
    if len({r[3] for r in rows}) < 2:
        total = sum(shares.values())
        share = min(1 - 1e-6, max(1e-6, shares.get(1, 0) / total if total else 0.0))
        size = BUCKETS + len(STATISTICS) * BINS
        return Model(np.zeros((len(STATISTICS), BINS - 1)), float(np.log(share / (1 - share))), np.zeros(size), np.zeros((size, RANK)))
    model = fit(rows)
    ones = sum(r[3] for r in rows)
    model.bias += float(np.log(shares[1] / shares[0]) - np.log(ones / (len(rows) - ones)))
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row of docs(doc_id, text, n_chars)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, first, *features in _features(batches):
            score = 1 / (1 + np.exp(-np.clip(shared.value.margins(*features), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(2).slice(first, len(score)), pa.array(score)], names=["doc_id", "score"])

    return docs.select("text", F.col("n_chars").cast("long"), "doc_id").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "n_chars")
    model = train(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))
    return scored(docs, model).select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
