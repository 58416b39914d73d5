"""Operator 9: toxicity of texts whose disguised words a noisy-channel decoder restores.

A character trigram model counts the letters of the whole corpus. A token with
leetspeak, repeated letters or letters set apart is a lattice: each sign may be
itself, a letter it imitates, or nothing; each run of a letter one or two of it.
Viterbi finds the likeliest path under the model and the channel's costs. In
letters set apart and in long runs without a separator, word boundaries are
placed under the model too, and the words of every likely placing count. A
linear model (FTRL, sparse) over the words of the text, as written and as
restored, and their beginnings, learned from a bounded sample of labels, scores
the text; its weights are not negative, so that no clean words hide a toxic one
and a short text is not suspect for what it lacks.

Cases: null and empty texts get the score of a text without words. Whole texts
count, each distinct word once. Without labels of both kinds the score is the
share of toxic labels, 0 if there is none. Repeated rows are scored each;
documents that repeat an id are all learned from. Extra columns pass through.
"""

from __future__ import annotations

import re
import weakref
from dataclasses import dataclass, field
from math import fsum

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cache, fold, read
from .learn import Ftrl, sample

#: Training rows of each label at most.
MAX_ROWS = 3000
DIMS, STEPS, FOLDS, HELD_OUT, THRESHOLD = 2**18, 24_000, 4, 2, 0.3

# The model's letters; what signs imitate; signs that may stand between letters.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøœùúûüýÿß"
SIZE = 64  # 0: no letter; then the letters; the last: any other letter
IMITATED = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "<": "c"}
BETWEEN = ".-_*'·~^`"
#: Costs (natural logarithm) of a sign as a letter, of a dropped sign, of a wild card, and of each repeated letter.
SWAP, DROP, WILD, REPEAT = 1.0, 1.5, 3.5, 1.0
SIGNS = re.compile(r"[0-9@$!|+€£¡(<.\-_*'·~^`]")
SUSPECT = re.compile(r"[^\W\d_].*[0-9@$!|+€£¡(<.\-_*'·~^`].*[^\W\d_]|[0-9@$!|+€£¡(<][^\W\d_]+|[^\W\d_]{2,}[0-9@$|+€£](?!\w)|([^\W\d_])\1\1", re.S)
SPACED = re.compile(r"(?<!\w)[\w@$!|](?:[ .\-_*·~]+[\w@$!|](?!\w)){3,}(?!\w)")
EDGE = re.compile(r"^[^\w@$!|+€£¡(<*]+|[^\w@$|+€£*]+$")
DOUBLED = re.compile(r"([^\W\d_])\1+")
LONGEST = 40  # longer stretches of letters are no single words: they are split by likely word boundaries
PIECE, OVERLAP = 2000, 80  # letters decoded at once, and how many of them the next piece repeats; bounds the worker's memory
SEPARATOR = re.compile(r"(?:[^\w@$!|+€£¡*]|_)+")
ENDS = ".,;:?!\"'"  # may end a plain word
UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]+")  # scripts without spaces
#: Words count that are this much less likely (natural logarithm) than the likeliest placing of word boundaries.
MARGIN = 5.0


def _classes() -> np.ndarray:
    table = np.zeros(0x2000, np.uint8)
    for code in range(len(table)):
        c = chr(code).lower()
        if c.isalpha():
            table[code] = LETTERS.index(c) + 1 if c in LETTERS else SIZE - 1
    return table


CLASSES = _classes()


def letter_counts(texts: DataFrame) -> np.ndarray:
    """Trigram counts of letter classes over all texts of a column; at most SIZE^3 rows reach the driver."""
    def run(batches):
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                    c = np.r_[0, np.where(codes < len(CLASSES), CLASSES[np.minimum(codes, len(CLASSES) - 1)], 0), 0].astype(np.int64)
                    total += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3) if len(c) > 20_000 else _sparse(total, c)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    def _sparse(total, c):
        np.add.at(total, (c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], 1)
        return 0

    counts = np.zeros(SIZE**3)
    for row in texts.toDF("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row.gram] = row.n
    return counts


class Decoder:
    """Restores tokens under a trigram model with the given counts."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(SIZE, SIZE, SIZE)
        one = c.sum((0, 1)) + 1.0
        one /= one.sum()
        two = c.sum(0) + 20.0 * one
        two /= two.sum(1, keepdims=True)
        three = c + 20.0 * two[None]
        self.logs = np.log(three / three.sum(2, keepdims=True)).tolist()
        self.code = {letter: i + 1 for i, letter in enumerate(LETTERS)}

    def choices(self, token: str):
        """For each run of a character its readings: (letters, cost)."""
        for m in re.finditer(r"(.)\1*", token, re.S):
            c, n = m[1], len(m[0])
            if c.isalpha():
                yield [(c, REPEAT * (n > 1) * 0.5 if n > 2 else REPEAT * (n > 1)), *([(c + c, 0.0 if n == 2 else REPEAT)] if n > 1 else [])]
            else:
                readings = [(x * k, SWAP * n if k == n else SWAP + REPEAT) for x in IMITATED.get(c, "") for k in {1, min(n, 2)}]
                if c in BETWEEN:
                    readings.append(("", DROP))
                if c == "*" and n == 1:
                    readings += [(x, WILD) for x in LETTERS[:26]]
                yield readings or [("", DROP * n)]

    def restore(self, token: str) -> str:
        states = {(0, 0): (0.0, "")}
        for readings in self.choices(token):
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, text) in states.items():
                for letters, cost in readings:
                    x, y, s = a, b, score - cost
                    for letter in letters:
                        z = self.code.get(letter, SIZE - 1)
                        s += self.logs[x][y][z]
                        x, y = y, z
                    old = after.get((x, y))
                    if old is None or s > old[0]:
                        after[x, y] = s, text + letters
            states = after
        return max((s + self.logs[a][b][0], text) for (a, b), (s, text) in states.items())[1]

    def words(self, joined: str) -> set[str]:
        """The likely words of letters without spaces, all of them: by pieces that overlap by more than a word."""
        found = set()
        for at in range(0, max(1, len(joined) - OVERLAP), PIECE - OVERLAP):
            piece = joined[at : at + PIECE]
            for letters in {self.restore(piece), *([piece] if piece.isalpha() else [])}:
                found |= self.placed(letters)
        return found

    def placed(self, letters: str) -> set[str]:
        """Words that stand in some way to place boundaries that is at most MARGIN less likely than the best one."""
        n, c, logs = len(letters), [self.code.get(x, SIZE - 1) for x in letters], self.logs
        inner = [0.0] * (n + 1)  # sums of the letters that have two of their word before them
        for i in range(2, n):
            inner[i + 1] = inner[i] + logs[c[i - 2]][c[i - 1]][c[i]]
        starts = [logs[c[i - 1] if i else 0][0][c[i]] + (logs[0][c[i]][c[i + 1]] if i + 1 < n else 0.0) for i in range(n)]
        ends = [0.0, *(logs[c[j - 2] if j > 1 else 0][c[j - 1]][0] for j in range(1, n + 1))]

        def word(i: int, j: int) -> float:
            if j == i + 1:
                return logs[c[i - 1] if i else 0][0][c[i]] + logs[0][c[i]][0]
            return starts[i] + inner[j] - inner[i + 2] + ends[j]

        before, after = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            before[j] = max(before[i] + word(i, j) for i in range(max(0, j - LONGEST), j))
        for i in range(n - 1, -1, -1):
            after[i] = max(word(i, j) + after[j] for j in range(i + 1, min(n, i + LONGEST) + 1))
        least = before[n] - MARGIN
        return {letters[i:j] for i in range(n) for j in range(i + 1, min(n, i + LONGEST) + 1) if before[i] + word(i, j) + after[j] >= least}


def _hashed(text: str) -> int:
    return xxhash.xxh32_intdigest(text) % DIMS


@dataclass
class Words:
    """Feature ids of a text's distinct words, as written and as restored."""

    decoder: Decoder
    cache: Cache = field(init=False)
    starts: Cache = field(init=False)

    def __post_init__(self):
        own = weakref.ref(self)  # no cycle: the caches go with the last reference, not when the collector runs
        self.cache = Cache(lambda token: own().one(token))
        self.starts = Cache(lambda start: _hashed(f"^{len(start)}{start}"))

    def features(self, word: str) -> list[int]:
        return [_hashed(word), *(self.starts[word[:k]] for k in (3, 4, 5) if len(word) > k)]

    def one(self, token: str) -> tuple[int, ...]:
        bare = token.rstrip(ENDS)
        if bare.isalpha() and len(bare) <= LONGEST and not DOUBLED.search(bare) and (bare.isascii() or not UNSPACED.search(bare)):
            return tuple(set(self.features(bare)))  # nothing to restore
        bare = EDGE.sub("", token)
        if not bare:
            return ()
        grams = {_hashed(run[i : i + k]) for run in UNSPACED.findall(bare) for k in (2, 3, 4, 5) for i in range(len(run) - k + 1)}
        # the token as one word, whatever stands between its letters, and each of its parts
        found = self.short(token, bare) if len(bare) <= LONGEST else set(self.features(bare))
        parts = set(SEPARATOR.split(bare))
        return tuple(found.union(grams, *(self.part(p) for p in parts if p != bare or len(bare) > LONGEST)))

    def part(self, part: str) -> set[int]:
        """A stretch between separators; one too long for a word by its likely boundaries."""
        if len(part) <= LONGEST:
            inner = EDGE.sub("", part)
            return self.short(part, inner) if inner else set()
        words = self.decoder.words(part) if any(c.isalpha() for c in part) else ()
        return {f for word in words for f in self.features(word)}

    def short(self, token: str, bare: str) -> set[int]:
        forms = {re.sub(r"[^\w]+", "", bare)}
        if SUSPECT.search(token):
            forms |= {self.decoder.restore(bare), self.decoder.restore(EDGE.sub("", token.rstrip("!|.,;:?\"')")))}
        if DOUBLED.search(bare):
            forms.add(DOUBLED.sub(r"\1", bare))
        return {f for form in forms if form for f in self.features(form)}

    def tokens(self, text: str | None) -> set[str]:
        if not text:
            return set()
        low = text.lower()
        found = set(low.split())
        for m in SPACED.finditer(low):
            found.add(re.sub(r"[ .\-_*·~]+", "", m[0]) + "\0")  # a mark, so that it is not the word as written
        return found

    def of(self, text: str | None):
        for token in self.tokens(text):
            yield self.cache[token] if token[-1] != "\0" else self.spaced(token[:-1])

    def spaced(self, joined: str) -> tuple[int, ...]:
        return tuple({f for word in {joined} | self.decoder.words(joined) for f in self.features(word)})


@dataclass
class Model:
    decoder: Decoder
    weights: np.ndarray
    bias: float

    def scorer(self):
        words = Words(self.decoder)
        known = np.flatnonzero(self.weights)
        w = dict(zip(known.tolist(), self.weights[known].tolist(), strict=True)).get  # the model is sparse
        added = lambda ids: fsum(w(f, 0.0) for f in ids)
        value = Cache(lambda token: added(words.one(token)))

        def score(text: str | None) -> float:
            total = self.bias + fsum(value[token] if token[-1] != "\0" else added(words.spaced(token[:-1])) for token in words.tokens(text))  # in whatever order
            return 1 / (1 + float(np.exp(-min(35.0, max(-35.0, total)))))

        return score


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", most: int = MAX_ROWS) -> Model:
    """From the labelled rows out of the held-out fold, at most `most` of each label; the letters of all texts."""
    decoder = Decoder(letter_counts(docs.select(text)))
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold("doc_id", FOLDS) != HELD_OUT)).select("doc_id", F.col(label).alias("label")).distinct()
    shares = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    picked = F.broadcast(sample(known, "label", most))  # at most 2 * most rows

    def run(batches):
        words = Words(decoder)
        for batch in batches:
            ids = [[f for fs in words.of(t) for f in fs] for t in batch.column(0).to_pylist()]
            found = [np.unique(np.array(x, np.int32), return_counts=True) for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.list_(pa.int32())), pa.array([n.astype(np.int32) for _, n in found], pa.list_(pa.int32())), batch.column(1)], names=["ids", "n", "label"])

    table = docs.select("doc_id", text).join(picked, "doc_id").select(text, F.col("label").cast("int")).mapInArrow(run, "ids array<int>, n array<int>, label int").toArrow()
    ids, counts, marks = (table.column(c).combine_chunks() for c in ("ids", "n", "label"))
    del table
    rows = [(i.values.to_numpy(), n.values.to_numpy(), y) for i, n, y in zip(ids, counts, marks.to_pylist(), strict=True)]  # views, no copies
    rows.sort(key=lambda r: (r[2], len(r[0]), xxhash.xxh3_128_digest(r[0].tobytes() + r[1].tobytes())))
    total = sum(shares.values())
    if len({y for *_, y in rows}) < 2:
        share = min(1 - 1e-6, max(1e-6, shares.get(1, 0) / total if total else 0.0))
        return Model(decoder, np.zeros(DIMS), float(np.log(share / (1 - share))))
    w = Ftrl(DIMS, alpha=0.3, l1=1.0, l2=0.5, positive=True).fit(rows, min(40, max(4, STEPS // len(rows)))).weights()[:, 0]
    ones = sum(y for *_, y in rows)
    shift = np.log(shares[1] / shares[0]) - np.log(ones / (len(rows) - ones))
    return Model(decoder, w[:-1], float(w[-1] + shift))


def scored(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """docs with the score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        score = shared.value.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([score(t.as_py()) for t in batch.column(at)], pa.float64())], names=[*batch.schema.names, into])

    return docs.mapInArrow(run, docs.withColumn(into, F.lit(0.0)).schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))
    return scored(docs, model).select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
