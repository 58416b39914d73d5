"""Operator 4: language by sparse multinomial logistic regression on TF-IDF of character n-grams.

Words are runs of letters, lower-cased; n-grams of 1 to 4 characters lie inside
a word and its two edges and are hashed. Document frequencies come from all
documents that may be learned from; the weights (FTRL, elastic net) from a
bounded sample of them, the temperature from a part of that sample which the
weights don't see. A text's value for an n-gram is its share of the text's
n-grams times idf, so its margins are a sum over its words.

Cases: a text that is null or has no letter is `und` with score 0, and so is any
text if nothing was learned. Whole texts count. Null languages teach nothing.
Repeated rows are scored each. Extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, fold, mixed, read
from .learn import Ftrl, sample

#: Training rows of each language at most, and of all languages (then fewer of each, one at least; every language is learned).
MAX_ROWS, MAX_ALL = 1000, 100_000
DIMS, GRAMS, EPOCHS, FOLDS, HELD_OUT = 2**16, 4, 3, 4, 2
CHUNK = 300_000
RUNS = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    """The runs of letters; fractions, superscripts and numbers in letters' shape are none."""
    runs = RUNS(text)
    if all(map(str.isalpha, runs)):
        return runs
    return [word for run in runs for word in "".join(c if c.isalpha() else " " for c in run).split()]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word's place, n-gram's bucket) of each n-gram of the words."""
    codes = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), np.uint32).astype(np.uint64)
    edge = codes == 0
    before = np.cumsum(edge)  # edges up to and with a place
    at, buckets = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, GRAMS + 1):
        h = h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(1)
        m = len(h)
        if m <= 0:
            break
        inner = before[n - 2 : n - 2 + m] - before[:m] if n > 2 else np.zeros(m, np.int64)
        keep = (inner == 0) & ~(edge[:m] & (n == 1))
        start = np.flatnonzero(keep)
        at.append(before[start] - 1)
        buckets.append((mixed(h[start] + np.uint64(n)) % np.uint64(DIMS)).astype(np.int64))
    return np.concatenate(at), np.concatenate(buckets)


def _rows(batches, column: int):
    """(batch, first row, words of each row) for stretches of rows of about CHUNK words."""
    for batch in batches:
        texts = batch.column(column)
        first, rows, n = 0, [], 0
        for i in range(len(texts)):
            rows.append(words_of((texts[i].as_py() or "").lower()))
            n += len(rows[-1])
            if n >= CHUNK or i + 1 == len(texts):
                yield batch, first, rows
                first, rows, n = i + 1, [], 0


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts of a column each bucket occurs, and the number of texts; DIMS + 1 rows reach the driver."""
    def run(batches):
        df = np.zeros(DIMS + 1, np.int64)
        for _, _, rows in _rows(batches, 0):
            distinct = [set(r) for r in rows]
            words = list(set().union(*distinct)) if distinct else []
            place = {w: i for i, w in enumerate(words)}
            at, bucket = grams(words) if words else (np.empty(0, np.int64), np.empty(0, np.int64))
            order = np.argsort(at, kind="stable")
            bucket, cuts = bucket[order], np.searchsorted(at[order], np.arange(len(words) + 1))
            seen = np.zeros(DIMS, bool)
            for own in distinct:
                if own:
                    places = np.fromiter(map(place.__getitem__, own), np.int64, len(own))
                    n = cuts[places + 1] - cuts[places]
                    flat = np.repeat(cuts[places] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    seen[:] = False
                    seen[bucket[flat]] = True
                    df[:DIMS] += seen
            df[DIMS] += len(rows)
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(df[found])], names=["bucket", "n"])

    df = np.zeros(DIMS + 1)
    for row in texts.toDF("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        df[row.bucket] = row.n
    return df[:DIMS], int(df[DIMS])


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # DIMS + 1 by languages, times idf
    temperature: float

    def scorer(self):
        """A function from lists of words to (language or None, score)."""
        place: dict[str, int] = {}
        table = np.zeros((0, len(self.languages) + 1))

        def score(rows: list[list[str]]):
            nonlocal table
            if len(place) > CACHE_ENTRIES:
                place.clear()
                table = table[:0]
            new = list({w for r in rows for w in r} - place.keys())
            if new:
                at, bucket = grams(new)
                more = np.empty((len(new), table.shape[1]))
                for k in range(len(self.languages)):
                    more[:, k] = np.bincount(at, self.weights[bucket, k], len(new))
                more[:, -1] = np.bincount(at, minlength=len(new))
                place.update(zip(new, range(len(table), len(table) + len(new)), strict=True))
                table = np.concatenate([table, more])
            lengths = np.array([len(r) for r in rows])
            picked = table[np.fromiter((place[w] for r in rows for w in r), np.int64, lengths.sum())]
            sums = np.zeros((len(rows), table.shape[1]))
            full = np.flatnonzero(lengths)
            if len(full):
                sums[full] = np.add.reduceat(picked, (np.cumsum(lengths) - lengths)[full])
            margins = (sums[:, :-1] / np.maximum(sums[:, -1:], 1) + self.weights[-1]) / self.temperature
            margins = np.exp(margins - margins.max(1, keepdims=True))
            chances = margins / margins.sum(1, keepdims=True)
            best = chances.argmax(1)
            return [(self.languages[b], float(c[b])) if n else (None, 0.0) for b, c, n in zip(best, chances, lengths, strict=True)]

        return score if self.languages else lambda rows: [(None, 0.0)] * len(rows)


def _temperature(margins: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section on its logarithm."""
    def loss(t: float) -> float:
        m = margins / np.exp(t)
        m = m - m.max(1, keepdims=True)
        return float((np.log(np.exp(m).sum(1)) - m[np.arange(len(labels)), labels]).mean())

    a, b, g = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(docs: DataFrame, text: str = "text", label: str = "lang", most: int = MAX_ROWS) -> Model:
    """From the rows out of the held-out fold that have a language."""
    known = docs.where(F.col(label).isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    languages = sorted(r[0] for r in known.select(label).distinct().collect())
    if not languages:
        return Model([], np.zeros((DIMS + 1, 0)), 1.0)
    df, total = document_frequencies(known.select(text))
    most = max(1, min(most, MAX_ALL // len(languages)))
    picked = F.broadcast(sample(known.select("doc_id", F.col(label).alias("label")).distinct(), "label", most))

    def run(batches):
        for batch, first, rows in _rows(batches, 0):
            ids, counts = [], []
            for words in rows:
                found, n = np.unique(grams(words)[1], return_counts=True) if words else (np.empty(0, np.int64), np.empty(0, np.int64))
                ids.append(found.astype(np.int32))
                counts.append(n.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())), batch.column(1).slice(first, len(rows))], names=["ids", "n", "label"])

    table = known.select("doc_id", text, F.col(label).alias("label")).join(picked, ["doc_id", "label"]).select(text, "label").mapInArrow(run, "ids array<int>, n array<int>, label string").toArrow()
    idf = np.log((1 + total) / (1 + df)) + 1
    rows = []
    for ids, n, y in zip(table.column("ids").combine_chunks(), table.column("n").combine_chunks(), table.column("label").to_pylist(), strict=True):
        ids, n = ids.values.to_numpy().astype(np.int64), n.values.to_numpy().astype(float)
        if len(ids):
            rows.append((ids, n / n.sum() * idf[ids], languages.index(y)))
    rows.sort(key=lambda r: (r[2], len(r[0]), r[0].tobytes(), r[1].tobytes()))
    kept, held = [r for i, r in enumerate(rows) if i % 5], rows[::5]
    model = Ftrl(DIMS, len(languages), alpha=0.5, l1=0.01, l2=0.05).fit(kept or rows, min(40, max(EPOCHS, 8_000 // max(1, len(rows)))))
    weights = model.weights()
    margins = np.array([(v[:, None] * weights[i]).sum(0) + weights[-1] for i, v, _ in held]) if held else np.zeros((0, len(languages)))
    temperature = _temperature(margins, np.array([y for *_, y in held])) if len(held) > 20 else 1.0
    weights[:-1] *= idf[:, None]
    return Model(languages, weights, temperature)


def identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = shared.value.scorer()
        for batch, first, rows in _rows(batches, 1):
            found = score(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(rows)), pa.array([x or "und" for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    found = identified(read(spark, sf_dir, "documents", "doc_id", "text"), model)
    return found.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
