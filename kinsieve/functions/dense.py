"""The distances of vectors.py and the statistics of verdict.py for all pairs of two lists of files at once, in numpy.

Every function takes the padded lists of both sides (operators.tiles.padded) and gives arrays of one row for each file of
the left and one column for each of the right; not a number stands for null. A pair of vectors that cannot be compared
(null, of different lengths, with a null component) is 1.0 apart, one whose product is not a number 0.0, as in the expressions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np

from ..options import Options


def _fit(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[-1], b.shape[-1])
    fit = lambda x: x if x.shape[-1] == width else np.concatenate([x, np.zeros((*x.shape[:-1], width - x.shape[-1]), x.dtype)], axis=-1)
    return fit(a), fit(b)


def _by_size(a: np.ndarray, b: np.ndarray):
    """(rows, columns, places) of the pairs that compare so many places; lists that are null stay out."""
    one = len(np.unique(a)) == len(np.unique(b)) == 1
    for n in np.unique(a[a >= 0]):
        for m in np.unique(b[b >= 0]):
            at = (slice(None), slice(None)) if one else np.ix_(a == n, b == m)
            yield at, (slice(None) if one else a == n), (slice(None) if one else b == m), int(min(n, m))


def cosine(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, plain: bool = False, out: np.ndarray | None = None) -> np.ndarray:
    """plain: as _plain() found of all vectors, so nothing is looked for in each."""
    a, b = _fit(a, b)
    with np.errstate(all="ignore"):
        d = np.matmul(a, b.T, out=out)
        np.clip(d, -1.0, 1.0, out=d)
        np.subtract(1.0, d, out=d)
        d *= 0.5
    if plain:
        return d
    if np.isnan(d).any():
        d[np.isnan(d)] = 0.0
    if not (len(np.unique(la)) == len(np.unique(lb)) == 1 and la[0] == lb[0] >= 0):
        d[(la[:, None] != lb[None, :]) | (la[:, None] < 0) | (lb[None, :] < 0)] = 1.0
    return d


def _plain(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> bool:
    """Whether all vectors are of one length and so small that each product is a number."""
    lengths = {int(v) for x in (la, lb) for v in (x.min(initial=la.flat[0]), x.max(initial=la.flat[0]))} if la.size and lb.size else ()
    return len(lengths) == 1 and min(lengths) >= 0 and all(max(x.max(initial=0), -x.min(initial=0)) < 1e100 for x in (a, b))


@cache
def _product_below(threshold: float) -> float:
    """The largest product of vectors whose distance is above a threshold of 0 to 1."""
    low, high = -1.0, 1.0  # a product of low is above, one of high is not
    while low < (middle := low + (high - low) / 2) < high:
        low, high = (middle, high) if 0.5 * (1 - middle) > threshold else (low, middle)
    return low


def _far(a: np.ndarray, b: np.ndarray, threshold: float, out: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """cosine() > threshold of plain vectors; out: room for the products and the result."""
    if threshold < 0.0 or threshold >= 1.0:
        out[1].fill(threshold < 0.0)
        return out[1]
    return np.less_equal(np.matmul(a, b.T, out=out[0]), _product_below(threshold), out=out[1])


def _push(top: list[np.ndarray], x: np.ndarray, k: int) -> None:
    """Puts x among the k largest, the largest first."""
    for i, t in enumerate(top):
        low = np.minimum(t, x) if i < k - 1 else None
        np.maximum(t, x, out=t)
        x = low
    if len(top) < k:
        top.append(x if top else x.copy())


def spread(ds: Iterable[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, maximum and 0.9 quantile of n arrays, which may all lie in the same room."""
    at = (n - 1) * 0.9
    low = int(np.floor(at))
    top: list[np.ndarray] = []
    total = None
    for x in ds:
        total = x.copy() if total is None else np.add(total, x, out=total)
        _push(top, x, n - low)
    a, b = top[n - 1 - low], top[n - 1 - min(low + 1, n - 1)]
    return total / n, top[0], a + (b - a) * (at - low)


def _nan(a: np.ndarray, b: np.ndarray, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    return {x: np.full((len(a), len(b)), np.nan) for x in names}


def hash_stats(a: tuple, b: tuple, o: Options, bits: int = 64, score: bool = True) -> dict[str, np.ndarray]:
    """distance (mean of the differing bits) and, if asked for, score; as hash_distances() and hash_score()."""
    (x, sx, lx), (y, sy, ly) = a, b
    # bitwise_count takes the absolute value of signed numbers
    x, y = (v.astype(np.int64).view(np.uint64) for v in _fit(x, y))
    out = _nan(x, y, ("distance", "score") if score else ("distance",))
    words = x.shape[2]
    # counts of bits stay whole numbers of the least size while hashes have 64 bits
    count, total = (np.min_scalar_type(64 * words), np.min_scalar_type(64 * words * max(x.shape[1], 1))) if bits == 64 else (np.float64, np.float64)
    for at, r, c, n in _by_size(sx, sy):
        if not n:
            continue
        half, trim = n // 2, max(1, int(np.floor(n * o.phash_trim_ratio)))
        shape = (len(x[r]), len(y[c]))
        s, top, squares, bad = np.zeros(shape, total), [], np.zeros(shape), False
        for k in range(n):
            d = np.zeros(shape, count)
            for w in range(words):
                d += np.bitwise_count(x[r, k, w][:, None] ^ y[c, k, w][None, :])
            if bits != 64:
                d = d * 64.0 / bits
            s += d
            if score:
                _push(top, d, max(min(trim, n), n - half))
                if n >= 6:
                    squares += np.square(d, dtype=np.uint32 if bits == 64 and words < 512 else np.float64)
            p, q = lx[r, k][:, None], ly[c, k][None, :]
            if len(np.unique(p)) > 1 or len(np.unique(q)) > 1 or p[0, 0] != q[0, 0] or p[0, 0] < 0:
                bad = bad | (p != q) | (p < 0) | (q < 0)
        s = s.astype(np.float64)
        out["distance"][at] = s / n if bad is False else np.where(bad, np.nan, s / n)
        if not score or n < 2 or n <= trim:
            continue
        add = lambda parts: sum((t.astype(np.float64) for t in parts[1:]), parts[0].astype(np.float64))
        m = (s - add(top[:trim])) / (n - trim)
        over = (m > o.phash_trimmed_mean_cap) | bad
        if n >= 6:
            high = add(top[: n - half])
            over |= high / (n - half) - (s - high) / half > o.phash_bimodal_gap_cap
            m = m / (1 + np.sqrt(np.maximum(0.0, squares - s * s / n) / max(1, n - 1)))
        m[over] = np.nan
        out["score"][at] = m
    return out


def frame_stats(a: tuple, b: tuple, o: Options) -> dict[str, np.ndarray]:
    (x, sx, lx), (y, sy, ly) = a, b
    out = _nan(x, y, ("mean", "max", "p90", "ratio", "mid", "above"))

    def frames(r, c, n: int, above: np.ndarray, over: np.ndarray) -> Iterator[np.ndarray]:
        plain, room = _plain(x[r, :n], y[c, :n], lx[r, :n], ly[c, :n]), np.empty(above.shape)
        for k in range(n):
            d = cosine(x[r, k], y[c, k], lx[r, k], ly[c, k], plain, room)
            above += d > o.t_max
            over += d > o.mid_lower
            yield d

    for at, r, c, n in _by_size(sx, sy):
        if not n:
            continue
        above, over = (np.zeros((len(x[r]), len(y[c])), np.min_scalar_type(n)) for _ in range(2))
        mean, top, p90 = spread(frames(r, c, n, above, over), n)
        out["mean"][at], out["max"][at], out["p90"][at], out["ratio"][at] = mean, top, p90, top / np.maximum(mean, 1e-9)
        out["above"][at], out["mid"][at] = above, over - above if o.mid_lower <= o.t_max else 0
    return out


def center_stats(a: tuple, b: tuple, grid: int, inner: int) -> dict[str, np.ndarray]:
    (x, sx, fx, lx), (y, sy, fy, ly) = a, b
    lo = (grid - inner) // 2
    cells = [r * grid + c for r in range(lo, lo + inner) for c in range(lo, lo + inner)]
    out = _nan(x, y, ("c_mean", "c_max", "c_p90"))
    both = min(x.shape[2], y.shape[2])

    def frames(r, c, n: int, plain: bool) -> Iterator[np.ndarray]:
        shape = (len(x[r]), len(y[c]))
        room, total = np.empty(shape), np.empty(shape)
        for k in range(n):
            total.fill(0.0)
            for p in cells:
                total += cosine(x[r, k, p], y[c, k, p], lx[r, k, p], ly[c, k, p], plain, room) if p < both else 1.0
            total /= len(cells)
            yield total

    for at, r, c, n in _by_size(sx, sy):
        if n:
            plain = _plain(x[r, :n], y[c, :n], lx[r, :n], ly[c, :n])
            out["c_mean"][at], out["c_max"][at], out["c_p90"][at] = spread(frames(r, c, n, plain), n)
    return out


def patch_stats(a: tuple, b: tuple, grid: int, o: Options) -> dict[str, np.ndarray]:
    """All of patch_stats() but the kind, which patch_kind() gives."""
    (x, sx, fx, lx), (y, sy, fy, ly) = a, b
    cells = grid * grid
    names = ("hot", "hot_ratio", "corner", "center", "dom_q", "persistent", "pers_corner", "n_frames")
    out = _nan(x, y, names)
    c_at = (grid - 1) / 2
    ring = [max(abs(p // grid - c_at), abs(p % grid - c_at)) / (c_at or 1.0) for p in range(cells)]
    edge, centre = [q >= o.edge_margin for q in ring], [q <= o.center_margin for q in ring]
    both = min(x.shape[2], y.shape[2])
    for at, r, c, n in _by_size(sx, sy):
        shape = (len(x[r]), len(y[c]))
        # counts are whole numbers of the least size
        zero = lambda: np.zeros(shape, np.min_scalar_type(n * cells))  # noqa: E731, B023
        hot, on_edge, on_centre, pers, pers_edge, quads = zero(), zero(), zero(), zero(), zero(), [zero() for _ in range(4)]
        # the least count that lasts; none: n + 1
        least = int(np.argmax(np.append(np.arange(n + 1) / max(n, 1) >= o.persistent_frac, True)))
        plain = both >= cells and n > 0 and bool((fx[r, :n] >= cells).all() and (fy[c, :n] >= cells).all()) and _plain(x[r, :n, :cells], y[c, :n, :cells], lx[r, :n, :cells], ly[c, :n, :cells])
        room = (np.empty(shape), np.empty(shape, bool))
        for p in range(min(cells, max(x.shape[2], y.shape[2]))):
            count = zero()
            for k in range(n):
                if plain:
                    count += _far(*_fit(x[r, k, p], y[c, k, p]), o.patch_hot_threshold, room)
                    continue
                short = p >= both
                h = np.ones(shape, bool) if short else cosine(x[r, k, p], y[c, k, p], lx[r, k, p], ly[c, k, p]) > o.patch_hot_threshold
                u, v = fx[r, k][:, None], fy[c, k][None, :]
                if short or (u <= p).any() or (v <= p).any():
                    # a null frame is not hot, nor a cell that neither side has; one side's lacking cell is 1.0 apart
                    h = (h | (u <= p) | (v <= p)) & (u >= 0) & (v >= 0) & ((u > p) | (v > p)) if o.patch_hot_threshold < 1.0 else h & (u > p) & (v > p)
                count += h
            lasting = count >= least
            hot += count
            pers += lasting
            if edge[p]:
                on_edge += count
                pers_edge += lasting
            if centre[p]:
                on_centre += count
            quads[2 * (p // grid >= grid / 2) + (p % grid >= grid / 2)] += count
        few, some = hot < o.patch_min_hot, np.maximum(hot, 1)

        def share(s, few=few, some=some):
            found = s / some
            found[few] = 0.0
            return found

        quad = np.maximum(np.maximum(quads[0], quads[1]), np.maximum(quads[2], quads[3]))
        pers_corner = pers_edge / np.maximum(pers, 1)
        pers_corner[few | (pers == 0)] = 0.0
        values = (hot, hot / max(1, n * cells), share(on_edge), share(on_centre), share(quad), np.where(few, 0, pers), pers_corner, n)
        for name, value in zip(names, values, strict=True):
            out[name][at] = value
    return out


#: Kinds of patch distances, by number.
KINDS = np.array(["uncertain", "watermark_strong", "watermark_weak", "watermark_anim", "content_diff_heavy", "content_diff_center_persistent", "content_diff"], dtype=object)


def patch_kind(s: dict[str, np.ndarray], o: Options) -> np.ndarray:
    """The number in KINDS of the first rule that holds."""
    hot, ratio, corner, center, pers, pc = (s[x] for x in ("hot", "hot_ratio", "corner", "center", "persistent", "pers_corner"))
    rules = [
        hot < o.patch_min_hot,
        (pers >= o.persistent_min) & (pers <= o.persistent_max) & (pc >= o.persistent_corner_min) & (corner >= o.corner_merge_frac),
        (corner >= o.corner_merge_frac) & (center < o.weak_center_max) & (ratio < o.weak_hot_ratio_max),
        (pers == 0) & (ratio >= o.anim_hot_ratio_min) & (corner >= o.anim_corner_min) & (center < o.anim_center_max),
        (pers >= o.heavy_persistent_min) & (ratio >= o.heavy_hot_ratio_min) & (pc < o.heavy_pers_corner_max),
        (pers >= o.persistent_min) & (pc <= o.center_persistent_corner_max) & (corner <= o.center_persistent_total_corner_max),
        center >= o.center_split_frac,
    ]
    return np.select(rules, range(7), 0).astype(np.int8)


def colours(a: tuple, b: tuple) -> np.ndarray:
    """As bhattacharyya()."""
    (x, nx), (y, ny) = a, b
    x, y = _fit(x, y)
    with np.errstate(all="ignore"):
        root = np.sqrt(np.maximum(x, 0.0)) @ np.sqrt(np.maximum(y, 0.0)).T
        d = np.sqrt(np.maximum(0.0, 1 - np.where(np.isnan(root), 1.0, np.clip(root, 0.0, 1.0))))
    # a null component counts as 0
    p, q = np.where(nx <= -3, -3 - nx, nx)[:, None], np.where(ny <= -3, -3 - ny, ny)[None, :]
    return np.where((p > 0) & (p == q), d, np.nan)


def sounds(sizes: tuple, starts: tuple, words: tuple, least: int) -> np.ndarray:
    """As fingerprint_distance(), of lists that lie one after the other in words, from starts on; place by place, so a long list costs no padding."""
    order = [np.argsort(-s, kind="stable") for s in sizes]
    (sa, sb), (oa, ob) = ([x[i] for x, i in zip(part, order, strict=True)] for part in (sizes, starts))
    words = tuple(w.astype(np.int64, copy=False).view(np.uint64) for w in words)
    bits = np.zeros((len(sa), len(sb)), np.int64)
    for t in range(int(min(sa.max(initial=0), sb.max(initial=0)))):
        i, j = np.searchsorted(-sa, -t), np.searchsorted(-sb, -t)
        bits[:i, :j] += np.bitwise_count(words[0][oa[:i] + t][:, None] ^ words[1][ob[:j] + t][None, :])
    n = np.minimum(sa[:, None], sb[None, :])
    out = np.empty(bits.shape)
    out[np.ix_(*order)] = np.where(n >= max(1, least), bits / (32.0 * np.maximum(n, 1)), np.nan)
    return out


def cascade(m: dict[str, np.ndarray], o: Options) -> np.ndarray:
    """The number in GATES of each pair's gate; not a number in score rejects, elsewhere abstains. kind: numbers in KINDS, or -1."""
    kind, is_ = m["kind"], lambda *names: np.isin(m["kind"], [int(np.flatnonzero(KINDS == n)[0]) for n in names])
    mean, top = m["mean"], m["max"]
    ratio = top / np.maximum(mean, 1e-9)
    no = np.zeros(kind.shape, bool)
    strict = (m["hot_ratio"] <= o.strict_hot_ratio) & (m["c_mean"] <= o.strict_mean) & (m["c_max"] <= o.strict_max) if o.center_mask else no
    relaxed = no
    if o.center_mask and o.center_mask_relaxed:
        relaxed = (m["hot_ratio"] <= o.relaxed_hot_ratio) & (m["corner"] >= o.relaxed_corner) & (m["center"] <= o.relaxed_center) & (m["dom_q"] <= o.relaxed_dom_q)
        relaxed = relaxed & (m["c_mean"] <= o.relaxed_mean) & (m["c_p90"] <= o.relaxed_p90) & (m["c_max"] <= o.relaxed_max)
    drift = (m["p90"] <= o.t_p90) | ((top > o.t_max) & (m["mid"] <= o.sparse_mid_count) & (m["above"] <= o.sparse_mid_count) & (mean <= o.t_mean))
    rescued = (m["audio_dist"] <= o.audio_merge_threshold) & o.audio_merge_override_color
    wide, over = top <= o.t_max * o.anim_max_override_factor, top > o.t_max
    peak = (ratio > o.t_ratio) & (top > o.t_peakmin)
    corner_of = lambda corner, center, least: is_("uncertain") & (m["corner"] >= corner) & (m["center"] <= center) & (mean <= least)
    rules = [
        ~(m["score"] <= o.phash_distance_threshold), (m["cd"] > o.color_distance_threshold) & ~rescued, np.isnan(mean) | np.isnan(top) | np.isnan(m["p90"]), mean > o.t_mean,
        drift & is_("content_diff_center_persistent") & o.drift_center_persistent_blocks, drift, over & is_("watermark_strong"), over & is_("watermark_anim") & wide,
        over & wide & corner_of(o.max_rescue_corner, o.max_rescue_center, o.max_rescue_mean) & (strict | relaxed), over, peak & is_("watermark_strong", "watermark_weak", "watermark_anim"),
        peak & corner_of(o.ratio_rescue_corner, o.ratio_rescue_center, o.ratio_rescue_mean) & strict, peak, is_("content_diff_heavy") & (ratio < o.heavy_min_ratio),
        is_("content_diff_heavy", "content_diff_center_persistent"),
    ]
    return np.select(rules, range(len(rules)), len(rules)).astype(np.int8)


#: Gates by number, and which of them match.
GATES = np.array(["phash", "color", "abstain", "semantic_mean", "drift_center_persistent", "drift_exempt", "max_strong", "max_anim", "max_corner", "semantic_max", "peak_watermark", "peak_corner", "semantic_peak", "heavy_degraded", "patch_content", "clean"], dtype=object)
MATCHED = np.array([False, False, True, False, False, True, True, True, True, False, True, True, False, True, False, True])


def rounded(x: np.ndarray, places: int = 6) -> np.ndarray:
    """Half away from zero after scaling, as DuckDB rounds doubles."""
    y = np.abs(x)
    y *= 10.0**places
    low = np.floor(y)
    y -= low
    low += y >= 0.5
    low /= 10.0**places
    return np.copysign(low, x, out=low)
