"""Every threshold of the near-duplicate engine, with its default."""

from __future__ import annotations

import hashlib
import json
import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Options:
    # blocking
    duration_rounding: str = "nearest_0.5"
    duration_cross_bucket_tolerance: float = 0.6
    cross_mode: str = "label"  # label: by bucket labels; duration: by true durations
    prune_before_cross: bool = True
    merge_by_item: bool = True
    require_both_signatures: bool = False
    # sampling
    sample_frames: int = 36
    video_window_seconds: float = 15.0
    seek_ratio: float = 0.5
    # hash score
    phash_size: int = 12
    phash_distance_threshold: float = 1.5
    phash_trimmed_mean_cap: float = 12.0
    phash_trim_ratio: float = 0.2
    phash_bimodal_gap_cap: float = 40.0
    # colour and sound
    color_hist_bins_h: int = 16
    color_hist_bins_s: int = 4
    color_distance_threshold: float = 0.15
    audio_merge_override_color: bool = False
    audio_merge_threshold: float = 0.15
    audio_min_length: int = 40
    # frames; off: frames and patches abstain
    frame_gates: bool = True
    t_mean: float = 0.015
    t_max: float = 0.040
    mid_lower: float = 0.020  # half of t_max
    t_ratio: float = 3.8
    t_peakmin: float = 0.015
    t_p90: float = 0.005
    sparse_mid_count: int = 2
    # patches; off: no verdict of theirs
    patch_gates: bool = True
    patch_grid: int = 8
    patch_hot_threshold: float = 0.015
    patch_min_hot: int = 12
    center_margin: float = 0.4
    edge_margin: float = 0.6
    corner_merge_frac: float = 0.55
    center_split_frac: float = 0.45
    persistent_frac: float = 0.5
    persistent_min: int = 2
    persistent_max: int = 8
    persistent_corner_min: float = 0.8
    weak_center_max: float = 0.12
    weak_hot_ratio_max: float = 0.10
    heavy_persistent_min: int = 10
    heavy_hot_ratio_min: float = 0.20
    heavy_pers_corner_max: float = 0.85
    heavy_min_ratio: float = 2.5
    center_persistent_corner_max: float = 0.20
    center_persistent_total_corner_max: float = 0.25
    drift_center_persistent_blocks: bool = True
    anim_hot_ratio_min: float = 0.15
    anim_corner_min: float = 0.65
    anim_center_max: float = 0.10
    anim_max_override_factor: float = 2.5
    # rescues and their confirmation on the centre
    ratio_rescue_corner: float = 0.60
    ratio_rescue_center: float = 0.15
    ratio_rescue_mean: float = 0.010
    max_rescue_corner: float = 0.75
    max_rescue_center: float = 0.10
    max_rescue_mean: float = 0.010
    center_mask: bool = True
    center_inner: int = 4
    strict_mean: float = 0.006
    strict_max: float = 0.025
    strict_hot_ratio: float = 0.06
    center_mask_relaxed: bool = True
    relaxed_hot_ratio: float = 0.14
    relaxed_dom_q: float = 0.30
    relaxed_corner: float = 0.85
    relaxed_center: float = 0.05
    relaxed_mean: float = 0.0065
    relaxed_p90: float = 0.010
    relaxed_max: float = 0.060


#: Scaled to sign hashes and random unit vectors, where unrelated frames are 0.5 apart.
SCALED = Options(
    phash_bimodal_gap_cap=40.0, phash_trimmed_mean_cap=33.0, phash_distance_threshold=8.0, t_mean=0.51, t_max=0.58, mid_lower=0.55, t_p90=0.53, sparse_mid_count=1,
    t_ratio=1.14, t_peakmin=0.5, heavy_min_ratio=1.10, patch_hot_threshold=0.80, weak_center_max=0.35, anim_center_max=0.35, weak_hot_ratio_max=0.14,
    color_distance_threshold=0.61, audio_merge_override_color=True, audio_merge_threshold=0.47, audio_min_length=1, center_inner=2,
)


# Names of options in a configuration file, where they differ from the fields'.
NAMES = {
    "t_mean": "semantic_distance_threshold", "t_max": "semantic_max_threshold", "t_ratio": "semantic_peak_ratio_threshold", "t_peakmin": "semantic_peak_min_max",
    "t_p90": "semantic_drift_p90_exempt", "sparse_mid_count": "semantic_drift_sparse_mid_count", "frame_gates": "semantic_feature_enabled", "patch_gates": "semantic_patch_enabled",
    "patch_grid": "semantic_patch_grid", "patch_hot_threshold": "semantic_patch_hot_threshold", "patch_min_hot": "semantic_patch_min_hot_patches", "center_margin": "semantic_patch_center_margin",
    "edge_margin": "semantic_patch_edge_margin", "corner_merge_frac": "semantic_patch_corner_merge_frac", "center_split_frac": "semantic_patch_center_split_frac",
    "persistent_frac": "semantic_patch_persistent_frame_frac", "persistent_min": "semantic_patch_persistent_min", "persistent_max": "semantic_patch_persistent_max",
    "persistent_corner_min": "semantic_patch_persistent_corner_min", "weak_center_max": "semantic_patch_weak_center_max", "weak_hot_ratio_max": "semantic_patch_weak_hot_ratio_max",
    "heavy_persistent_min": "semantic_patch_heavy_persistent_min", "heavy_hot_ratio_min": "semantic_patch_heavy_hot_ratio_min", "heavy_pers_corner_max": "semantic_patch_heavy_pers_corner_max",
    "heavy_min_ratio": "semantic_patch_heavy_min_ratio", "center_persistent_corner_max": "semantic_patch_center_persistent_corner_max",
    "center_persistent_total_corner_max": "semantic_patch_center_persistent_total_corner_max", "drift_center_persistent_blocks": "semantic_patch_drift_exempt_center_persistent_blocks",
    "anim_hot_ratio_min": "semantic_patch_anim_hot_ratio_min", "anim_corner_min": "semantic_patch_anim_corner_min", "anim_center_max": "semantic_patch_anim_center_max",
    "anim_max_override_factor": "semantic_patch_anim_max_override_factor", "ratio_rescue_corner": "semantic_patch_ratio_rescue_corner_min",
    "ratio_rescue_center": "semantic_patch_ratio_rescue_center_max", "ratio_rescue_mean": "semantic_patch_ratio_rescue_mean_max", "max_rescue_corner": "semantic_patch_max_rescue_corner_min",
    "max_rescue_center": "semantic_patch_max_rescue_center_max", "max_rescue_mean": "semantic_patch_max_rescue_mean_max", "center_mask": "semantic_patch_center_mask_enabled",
    "center_inner": "semantic_patch_center_mask_inner", "strict_mean": "semantic_patch_center_mask_mean_max", "strict_max": "semantic_patch_center_mask_max_max",
    "strict_hot_ratio": "semantic_patch_center_mask_hot_ratio_max", "center_mask_relaxed": "semantic_patch_center_mask_relaxed_enabled",
    "relaxed_hot_ratio": "semantic_patch_center_mask_relaxed_hot_ratio_max", "relaxed_dom_q": "semantic_patch_center_mask_relaxed_dom_q_max",
    "relaxed_corner": "semantic_patch_center_mask_relaxed_corner_min", "relaxed_center": "semantic_patch_center_mask_relaxed_center_max",
    "relaxed_mean": "semantic_patch_center_mask_relaxed_mean_max", "relaxed_p90": "semantic_patch_center_mask_relaxed_p90_max", "relaxed_max": "semantic_patch_center_mask_relaxed_max_max",
}


@dataclass(frozen=True)
class Settings:
    """What a configuration file says: options, pairs of items to split and to merge, and all it holds under its own names."""

    options: Options
    splits: tuple[tuple[str, str], ...] = ()
    merges: tuple[tuple[str, str], ...] = ()
    raw: dict | None = None


def item_pairs(lines: list) -> tuple[tuple[str, str], ...]:
    """Pairs of items from texts "a|b" or "a,b", or lists of two; others, and an item with itself, are skipped."""
    split = lambda x: x.replace(",", "|").split("|") if isinstance(x, str) else x
    pairs = [[str(i).strip() for i in split(x)] for x in lines if isinstance(x, str | list)]
    return tuple((p[0], p[1]) for p in pairs if len(p) == 2 and all(p) and p[0] != p[1])


def read_settings(path: str | Path | None) -> Settings:
    """Settings of a TOML file on the driver; names it lacks, or no file, leave the defaults, unknown names stay in raw. A value of the wrong kind is an error."""
    raw = tomllib.loads(Path(path).read_text(encoding="utf-8-sig")) if path and Path(path).exists() else {}
    kinds = {f.name: type(f.default) for f in fields(Options)}
    given = {name: kind(raw[NAMES.get(name, name)]) for name, kind in kinds.items() if NAMES.get(name, name) in raw}
    options = replace(Options(), **given)
    # the lower edge of the middle band follows the highest distance
    if "mid_lower" not in given:
        options = replace(options, mid_lower=options.t_max / 2)
    return Settings(options, item_pairs(raw.get("force_split_pairs") or []), item_pairs(raw.get("force_merge_pairs") or []), raw)


# The settings that each kind of feature depends on, and the version of its layout.
FEATURES = {
    "visual": (("sample_frames", int), ("phash_size", int), ("video_window_seconds", float), ("seek_ratio", float), ("color_hist_bins_h", int), ("color_hist_bins_s", int), ("visual_schema_version", 2)),
    "semantic": (("enabled", bool), ("model", str), ("semantic_sample_frames", int), ("semantic_schema_version", 2)),
    "patch": (("enabled", bool), ("model", str), ("semantic_sample_frames", int), ("grid", int), ("semantic_patch_schema_version", 1)),
    "audio": (("audio_window_seconds", int), ("seek_ratio", float), ("fpcalc_path", str), ("ffmpeg_path", str), ("audio_schema_version", 2)),
}


def feature_hash(kind: str, o: Options, **settings) -> str:
    """The configuration hash that a stored feature is looked up by: settings by name, else the option of that name; a missing one is an error."""
    value = lambda name: settings[name] if name in settings else getattr(o, name)
    chosen = {name: kind_of if isinstance(kind_of, int) else kind_of(value(name)) for name, kind_of in FEATURES[kind]}
    return hashlib.sha1(json.dumps(chosen, sort_keys=True).encode()).hexdigest()
