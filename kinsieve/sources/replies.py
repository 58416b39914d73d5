"""Status replies of a remote service, asked for in chunks of ids, each chunk a unit of work that is tried again and may fail."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocking import batches
from ..operators.scratch import written

#: Ids of one request, and tries of each.
CHUNK, TRIES = 80, 3
REPLY = "item_id string, result int, banned int, ban_reason string, visibility int, title string"
Fetch = Callable[[list[str]], list[dict]]


def stored_replies(folder: str) -> Fetch:
    """A fetch that reads replies from JSON files, one for each id; files of any file system that Arrow knows."""
    def fetch(ids: list[str]) -> list[dict]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        out = []
        for info, own in zip(store.get_file_info([f"{path}/{i}.json" for i in ids]), ids, strict=True):
            if info.is_file:
                with store.open_input_file(info.path) as file:
                    out.append(json.loads(file.read()) | {"item_id": own})
        return out

    return fetch


def asked(ids: DataFrame, fetch: Fetch, key: str = "item_id", size: int = CHUNK, tries: int = TRIES, wait: float = 1.0) -> DataFrame:
    """Replies of each chunk of distinct ids, in numeric order, with batch and rank (place in its reply); a chunk that failed every try is one row of nulls with its error, written.

    fetch runs on workers: ids in, replies out (dicts of REPLY's names), an exception for a failure. A chunk without any reply is a row without error.
    """
    numbered = batches(ids.select(F.col(key).cast("string").alias("item_id")).where("item_id is not null").distinct(), "item_id", size)
    names = [c.split()[0] for c in REPLY.split(", ")]

    def ask(chunk: pd.DataFrame) -> pd.DataFrame:
        own, error = chunk.item_id.tolist(), None
        for attempt in range(tries):
            if attempt:
                time.sleep(wait * 2 ** (attempt - 1))
            try:
                replies, error = fetch(own), None
                break
            except Exception as failed:  # noqa: BLE001  whatever a service may raise
                replies, error = [], f"{type(failed).__name__}: {failed}"
        rows = [[r.get(n) for n in names] + [i, None] for i, r in enumerate(replies)] or [[None] * len(names) + [None, error]]
        return pd.DataFrame(rows, columns=[*names, "rank", "error"], dtype=object).assign(batch=chunk.batch.iloc[0])

    return written(numbered.groupBy("batch").applyInPandas(ask, f"{REPLY}, rank int, error string, batch long"))


def complete(replies: DataFrame) -> DataFrame:
    """The replies of asked(); running it fails if any chunk did, so nothing is made of a part of them."""
    failed = replies.agg(F.count("error").alias("_n"), F.min("error").alias("_why"))
    checked = failed.select(F.when(F.col("_n") > 0, F.raise_error(F.concat(F.col("_n").cast("string"), F.lit(" chunks of the status request failed: "), F.col("_why"))).cast("int")).otherwise(F.lit(0)).alias("_ok"))
    # one row
    return replies.join(F.broadcast(checked), F.col("_ok").isNull() | (F.col("_ok") == 0)).where("item_id is not null").drop("_ok", "error")
