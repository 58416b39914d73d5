"""What the corpus operators share: reading, shared scratch tables, words and their hashes."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import dropped, shared_folder, written  # noqa: F401

#: Entries that a worker's word cache may hold before it starts afresh; bounds the worker's memory.
CACHE_ENTRIES = 400_000
#: Longer words are not kept; with the above it bounds the cache in bytes.
CACHED_LENGTH = 128
#: Words: everything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the doc_id as text, modulo n; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % n, F.lit(0))


def free(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


class Cache(dict):
    """word -> value, made on the first miss, with a bounded number of entries of bounded length."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word):
        if len(word) > CACHED_LENGTH:
            return self.make(word)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = self.make(word)
        return value


def hash64(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, elementwise."""
    x = x ^ (x >> _M3)
    x = x * _M1
    x ^= x >> _M3
    x *= _M2
    x ^= x >> _M3
    return x


def shingled(words: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hash of each k consecutive word hashes (polynomial in base modulo 2^64, then mixed)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = np.uint64(base | 1)
    out = words[:n].copy()
    for i in range(1, k):
        out *= base
        out += words[i : i + n]
    return mixed(out)
