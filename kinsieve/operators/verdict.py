"""Pair metrics and the cascade of gates, each pair with its verdict and the gate that gave it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..options import Options


def frame_stats(pairs: DataFrame, a: str, b: str, o: Options) -> DataFrame:
    """pairs with mean, max, p90, ratio, mid and above of their frame distances; null where a side has no frames."""
    d = F.col("_d")
    has = F.size(d) > 0
    stats = pairs.withColumn("_d", V.frame_distances(F.col(a), F.col(b)))
    mean = F.when(has, V.mean(d))
    return stats.select(
        "*", mean.alias("mean"), F.when(has, F.array_max(d)).alias("max"), V.percentile(d, 0.9).alias("p90"), F.when(has, F.array_max(d) / F.greatest(mean, F.lit(1e-9))).alias("ratio"),
        F.when(has, F.size(F.filter(d, lambda x: (x > o.mid_lower) & (x <= o.t_max)))).alias("mid"), F.when(has, F.size(F.filter(d, lambda x: x > o.t_max))).alias("above"),
    ).drop("_d")


def _ring(grid: int, cell: int) -> float:
    c = (grid - 1) / 2
    return max(abs(cell // grid - c), abs(cell % grid - c)) / (c or 1.0)


def _hot_frames(column: str, cell: int) -> Column:
    return F.size(F.filter(column, lambda frame: F.coalesce(F.get(frame, F.lit(cell)), F.lit(False))))


def patch_stats(pairs: DataFrame, a: str, b: str, grid: int, o: Options) -> DataFrame:
    """pairs with the spatial statistics and kind of their patch distances; a and b: frames of grid * grid vectors."""
    cells = grid * grid
    dist = V.zipped(F.col(a), F.col(b), lambda x, y: F.zip_with(x, y, lambda p, q: V.cosine_distance(p, q) > o.patch_hot_threshold))
    s = pairs.withColumn("_hot", dist)
    per_cell = F.array(*(_hot_frames("_hot", c) for c in range(cells)))
    s = s.withColumn("_cells", per_cell).withColumn("n_frames", F.size("_hot"))
    picked = lambda test: sum((F.get("_cells", F.lit(c)) for c in range(cells) if test(c)), F.lit(0))
    lasting = lambda test: sum(((F.get("_cells", F.lit(c)) / F.greatest(F.col("n_frames"), F.lit(1)) >= o.persistent_frac).cast("int") for c in range(cells) if test(c)), F.lit(0))
    quadrant = lambda c: 2 * (c // grid >= grid / 2) + (c % grid >= grid / 2)
    edge, centre, every = (lambda c: _ring(grid, c) >= o.edge_margin), (lambda c: _ring(grid, c) <= o.center_margin), (lambda c: True)
    s = s.select("*", picked(every).alias("hot"), picked(edge).alias("_edge"), picked(centre).alias("_centre"), lasting(every).alias("_pers"), lasting(edge).alias("_pers_edge"), F.greatest(*(picked(lambda c, q=q: quadrant(c) == q) for q in range(4))).alias("_quad"))
    few = F.col("hot") < o.patch_min_hot
    share = lambda x: F.when(few, 0.0).otherwise(F.col(x) / F.greatest(F.col("hot"), F.lit(1)))
    s = s.select(
        "*", (F.col("hot") / F.greatest(F.lit(1), F.col("n_frames") * cells)).alias("hot_ratio"), share("_edge").alias("corner"), share("_centre").alias("center"), share("_quad").alias("dom_q"),
        F.when(few, 0).otherwise(F.col("_pers")).alias("persistent"), F.when(few | (F.col("_pers") == 0), 0.0).otherwise(F.col("_pers_edge") / F.greatest(F.col("_pers"), F.lit(1))).alias("pers_corner"),
    )
    return s.withColumn("kind", patch_kind(o)).drop("_hot", "_cells", "_edge", "_centre", "_pers", "_pers_edge", "_quad")


def patch_kind(o: Options) -> Column:
    """First rule that holds, from hot, hot_ratio, corner, center, persistent and pers_corner."""
    hot_ratio, corner, center, persistent, pers_corner = (F.col(c) for c in ("hot_ratio", "corner", "center", "persistent", "pers_corner"))
    return (
        F.when(F.col("hot") < o.patch_min_hot, "uncertain")
        .when(persistent.between(o.persistent_min, o.persistent_max) & (pers_corner >= o.persistent_corner_min) & (corner >= o.corner_merge_frac), "watermark_strong")
        .when((corner >= o.corner_merge_frac) & (center < o.weak_center_max) & (hot_ratio < o.weak_hot_ratio_max), "watermark_weak")
        .when((persistent == 0) & (hot_ratio >= o.anim_hot_ratio_min) & (corner >= o.anim_corner_min) & (center < o.anim_center_max), "watermark_anim")
        .when((persistent >= o.heavy_persistent_min) & (hot_ratio >= o.heavy_hot_ratio_min) & (pers_corner < o.heavy_pers_corner_max), "content_diff_heavy")
        .when((persistent >= o.persistent_min) & (pers_corner <= o.center_persistent_corner_max) & (corner <= o.center_persistent_total_corner_max), "content_diff_center_persistent")
        .when(center >= o.center_split_frac, "content_diff")
        .otherwise("uncertain")
    )


def center_stats(pairs: DataFrame, a: str, b: str, grid: int, inner: int) -> DataFrame:
    """pairs with c_mean, c_max and c_p90: distances averaged over the inner cells of each frame."""
    lo = (grid - inner) // 2
    cells = [r * grid + c for r in range(lo, lo + inner) for c in range(lo, lo + inner)]
    one = lambda x, y: sum((V.cosine_distance(F.get(x, F.lit(c)), F.get(y, F.lit(c))) for c in cells), F.lit(0.0)) / len(cells)
    s = pairs.withColumn("_d", V.zipped(F.col(a), F.col(b), one))
    return s.select("*", V.mean(F.col("_d")).alias("c_mean"), F.array_max("_d").alias("c_max"), V.percentile(F.col("_d"), 0.9).alias("c_p90")).drop("_d")


def cascade(metrics: DataFrame, o: Options) -> DataFrame:
    """metrics with gate and matched.

    Columns: score, cd, audio_dist, mean, max, p90, mid, above, kind, corner, center, hot_ratio, dom_q,
    c_mean, c_max, c_p90; null score rejects, other nulls abstain.
    """
    c = {n: F.col(n) for n in ("score", "cd", "audio_dist", "mean", "max", "p90", "mid", "above", "corner", "center", "hot_ratio", "dom_q", "c_mean", "c_max", "c_p90")}
    kind = F.coalesce(F.col("kind"), F.lit("disabled"))
    yes = lambda x: F.coalesce(x, F.lit(False))
    ratio = c["max"] / F.greatest(c["mean"], F.lit(1e-9))
    strict = yes((c["hot_ratio"] <= o.strict_hot_ratio) & (c["c_mean"] <= o.strict_mean) & (c["c_max"] <= o.strict_max))
    relaxed = yes(
        (c["hot_ratio"] <= o.relaxed_hot_ratio) & (c["corner"] >= o.relaxed_corner) & (c["center"] <= o.relaxed_center) & (c["dom_q"] <= o.relaxed_dom_q)
        & (c["c_mean"] <= o.relaxed_mean) & (c["c_p90"] <= o.relaxed_p90) & (c["c_max"] <= o.relaxed_max)
    )
    if not o.center_mask:
        strict = F.lit(False)
    if not o.center_mask or not o.center_mask_relaxed:
        relaxed = F.lit(False)
    drift = (c["p90"] <= o.t_p90) | ((c["max"] > o.t_max) & (c["mid"] <= o.sparse_mid_count) & (c["above"] <= o.sparse_mid_count) & (c["mean"] <= o.t_mean))
    rescued = F.lit(o.audio_merge_override_color) & yes(c["audio_dist"] <= o.audio_merge_threshold)
    wide = c["max"] <= o.t_max * o.anim_max_override_factor
    corner_of = lambda corner, center, mean: (kind == "uncertain") & yes((c["corner"] >= corner) & (c["center"] <= center) & (c["mean"] <= mean))
    over, peak = c["max"] > o.t_max, (ratio > o.t_ratio) & (c["max"] > o.t_peakmin)
    gate = (
        F.when(~yes(c["score"] <= o.phash_distance_threshold), "NO phash")
        .when(yes(c["cd"] > o.color_distance_threshold) & ~rescued, "NO color")
        .when(c["mean"].isNull() | c["max"].isNull() | c["p90"].isNull(), "YES abstain")
        .when(c["mean"] > o.t_mean, "NO semantic_mean")
        .when(drift & (kind == "content_diff_center_persistent") & F.lit(o.drift_center_persistent_blocks), "NO drift_center_persistent")
        .when(drift, "YES drift_exempt")
        .when(over & (kind == "watermark_strong"), "YES max_strong")
        .when(over & (kind == "watermark_anim") & wide, "YES max_anim")
        .when(over & wide & corner_of(o.max_rescue_corner, o.max_rescue_center, o.max_rescue_mean) & (strict | relaxed), "YES max_corner")
        .when(over, "NO semantic_max")
        .when(peak & kind.isin("watermark_strong", "watermark_weak", "watermark_anim"), "YES peak_watermark")
        .when(peak & corner_of(o.ratio_rescue_corner, o.ratio_rescue_center, o.ratio_rescue_mean) & strict, "YES peak_corner")
        .when(peak, "NO semantic_peak")
        .when((kind == "content_diff_heavy") & (ratio < o.heavy_min_ratio), "YES heavy_degraded")
        .when(kind.isin("content_diff_heavy", "content_diff_center_persistent"), "NO patch_content")
        .otherwise("YES clean")
    )
    return metrics.withColumn("_gate", gate).select("*", F.substring_index("_gate", " ", -1).alias("gate"), F.col("_gate").startswith("YES").alias("matched")).drop("_gate")
