"""Around an archive: protected items, delete plans, run counters and the stages of its two pipelines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import path_key

# Stages in order, the last leads to the first again.
STAGES = {"delisted": ("detect", "archive", "unsub"), "folder": ("archive", "unsub")}
# States of an update that concerns no page.
SETTLED = ("pending", "downloading", "installed", "error", "unsubscribed")


def protected(archives: DataFrame, visible: DataFrame) -> DataFrame:
    """(id, file) of archives (id, file, verified) that stand behind a visible, installed overlay (id, file, status, overlaid) of the same path."""
    shown = visible.where(F.col("overlaid") & (F.col("status") == "installed")).select("id", path_key(F.col("file")).alias("_path")).distinct()
    return archives.where("verified").withColumn("_path", path_key(F.col("file"))).join(shown, ["id", "_path"], "left_semi").select("id", "file")


def unprotected_requests(requests: DataFrame, safe: DataFrame) -> DataFrame:
    """Requests without protected ids; a request that held only such ids is gone."""
    return requests.join(safe.select("id").distinct(), "id", "left_anti")


def redirected(paths: DataFrame, safe: DataFrame, path: str = "path") -> DataFrame:
    """paths with target: the archive's file where the path names a protected item of the catalogue, else the path."""
    own = F.regexp_extract(path_key(F.col(path)), r"/workshop/content/[0-9]+/([0-9]+)/", 1)
    named = paths.withColumn("_id", F.when(own != "", own))
    return named.join(safe.select(F.col("id").cast("string").alias("_id"), F.col("file").alias("_file")), "_id", "left").withColumn("target", F.coalesce("_file", path)).drop("_id", "_file")


def outside_visible(updates: DataFrame, visible: DataFrame, batch: str = "batch", source: str = "installed") -> DataFrame:
    """(batch, outside): whether every update (batch, id, status, local, ispreset) of a batch is settled and of no visible item; only lists of installed or subscribed items can tell."""
    if source not in ("installed", "workshop"):
        return updates.select(batch).distinct().withColumn("outside", F.lit(False))
    shown = visible.select("id").distinct().withColumn("_shown", F.lit(True))
    fine = F.col("_shown").isNull() & F.col("id").isNotNull() & F.coalesce(F.col("status").isin(*SETTLED), F.lit(False)) & ~F.coalesce("local", F.lit(False)) & ~F.coalesce("ispreset", F.lit(False))
    return updates.join(shown, "id", "left").groupBy(batch).agg(F.bool_and(fine).alias("outside"))


def delete_plan(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, action) of each path once: delete for a direct child of the first myprojects folder in it, else why not. Nothing is deleted here."""
    clean = F.regexp_replace(F.replace(F.col(path), F.lit("\\"), F.lit("/")), "/+$", "")
    parts = F.split(F.lower("path"), "/")
    at = F.array_position(parts, "myprojects")
    action = F.when(F.coalesce(at, F.lit(0)) == 0, "skip_outside").when(F.size(parts) == at + 1, "delete").otherwise("skip_depth")
    return paths.select(clean.alias("path")).where("path is not null").distinct().withColumn("action", action)


def run_counters(plan: DataFrame, *keys: str) -> DataFrame:
    """Counts of a plan (action, failed, added): a failed copy counts as failed only, added are copies with a new folder entry."""
    done = (F.col("action") == "copy") & ~F.coalesce("failed", F.lit(False))
    return plan.groupBy(*keys).agg(
        F.count_if(done).alias("copied"), F.count_if(done & F.coalesce("added", F.lit(False))).alias("added"), F.count_if(F.col("action") == "skip").alias("skipped_already"),
        F.count_if(F.col("action") == "warn").alias("skipped_missing"), F.count_if((F.col("action") == "copy") & F.coalesce("failed", F.lit(False))).alias("failed"),
    )


def detection_totals(found: DataFrame) -> DataFrame:
    """(reason, n) of delisted items, and their total under reason null."""
    return found.rollup("reason").agg(F.count("*").alias("n"))


def next_stage(pipeline: Column, current: Column, completed: Column) -> Column:
    """The stage after a completed one; current unless that was completed, or for another pipeline."""
    steps = {(name, a): b for name, order in STAGES.items() for a, b in zip(order, order[1:] + order[:1], strict=True)}
    case = reduce(lambda c, s: c.when((pipeline == s[0][0]) & (completed == s[0][1]), s[1]), steps.items(), F.when(F.lit(False), ""))
    return F.coalesce(F.when(current == completed, case), current)


def folder_runs(folders: DataFrame, *keys: str) -> DataFrame:
    """Of folders (alive, rc) those with alive items run: planned, succeeded, and whether the stage may advance (all did, one at least)."""
    ran = folders.where("alive > 0").groupBy(*keys).agg(F.count("*").alias("planned"), F.count_if(F.coalesce("rc", F.lit(1)) == 0).alias("succeeded"))
    return ran.withColumn("advance", F.col("planned") == F.col("succeeded"))


def signature_errors(bucket: Column, hashes: Column, audio: Column, both: bool) -> Column:
    """Error tags of a signature: what is missing if both kinds are required, or if only the visual one is."""
    whole = bucket.isNotNull() & hashes.isNotNull()
    bad, tag = (~(whole & audio.isNotNull()), "incomplete_signature") if both else (~whole, "no_visual_signature")
    return F.when(bad, F.array(F.lit(tag))).otherwise(F.expr("cast(array() as array<string>)"))


def eligible_signatures(files: DataFrame, both: bool) -> DataFrame:
    """Files (bucket, hashes, audio) that may be compared."""
    return files.where(F.size(signature_errors(F.col("bucket"), F.col("hashes"), F.col("audio"), both)) == 0)


def audio_needed(both: bool, rescue: bool) -> bool:
    """Whether signatures need sound: as a part of their key, or to rescue a colour gate."""
    return both or rescue


def audio_ready(digest: Column, raw: Column, both: bool, rescue: bool) -> Column:
    """Whether a stored sound does for that; the rescue compares raw fingerprints."""
    there = lambda c: F.coalesce(c != "", F.lit(False))
    if not audio_needed(both, rescue):
        return F.lit(True)
    return there(digest) & there(raw) if rescue else there(digest)


def log_mode(previous: Column) -> Column:
    """w, a fresh log, after a completed run; a, the log goes on, after any other or none."""
    return F.when(previous == "completed", "w").otherwise("a")


def final_state(exit_code: Column) -> Column:
    return F.when(exit_code == 0, "completed").otherwise("incomplete")


# The reasons of removal_outcome().
REASONS = ("no_sessionid", "fast", "bad_response", "already_not_subscribed", "verify_unknown", "still_subscribed", "exhausted")


def removal_outcome(session: Column, fast: Column, http: Column, ok: Column, before: Column, after: Column, last: Column, tries: Column | None = None) -> Column:
    """(success, verified, reason) of one attempt to remove an item, reason again where another attempt is due.

    before and after are its page's states (subscribed, not_subscribed, unknown); fast attempts look at the reply only.
    tries, if given: attempts allowed; without any the item is exhausted.
    """
    result = lambda success, verified, reason: F.struct(F.lit(success).alias("success"), F.lit(verified).alias("verified"), (reason if isinstance(reason, Column) else F.lit(reason).cast("string")).alias("reason"))
    code = F.concat(F.lit("http_"), http.cast("string"))
    again = result(False, False, "again")
    return (
        F.when(~session, result(False, False, "no_sessionid"))
        .when(tries <= 0 if tries is not None else F.lit(False), result(False, False, "exhausted"))
        .when(fast, F.when(http != 200, result(False, False, code)).when(ok, result(True, False, "fast")).otherwise(result(False, False, "bad_response")))
        .when(before == "not_subscribed", result(True, True, "already_not_subscribed"))
        .when((http == 200) & ok & (after == "not_subscribed"), result(True, True, None))
        .when(~last, again)
        .when(http != 200, result(False, False, code))
        .when(~ok, result(False, False, "bad_response"))
        .when(after == "unknown", result(True, False, "verify_unknown"))
        .otherwise(result(False, False, "still_subscribed"))
    )


def idle_wait(polls: DataFrame, keys: list[str]) -> DataFrame:
    """polls (at, seq, found) with wait, the ms before the next poll: 2500, after each further empty one 1.4 times as long, up to 15000."""
    steps = [2500]
    while steps[-1] < 15000:
        steps.append(min(15000, int(steps[-1] * 1.4 + 0.5)))
    order = Window.partitionBy(*keys).orderBy("at", "seq")
    stretch = polls.withColumn("_stretch", F.count_if(F.col("found") > 0).over(order))
    empty = F.count_if(F.col("found") == 0).over(Window.partitionBy(*keys, "_stretch").orderBy("at", "seq"))
    return stretch.withColumn("wait", F.get(F.array(*map(F.lit, steps)), F.least(empty, F.lit(len(steps) - 1)).cast("int"))).drop("_stretch")
