"""Sequential kernels on one series at a time (a code's day), in numpy, run by group."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tickloom.operators.kernels import dtw, information_gain


def by_series(df: DataFrame, by: list[str], order: list[str], keep: list[str], kernel: Callable[[pd.DataFrame], dict], out: dict[str, str]) -> DataFrame:
    """A row for each of the series' rows: by, `keep`, and the kernel's columns (name -> array), NaN as null. A series is one task's."""
    kinds = dict(df.dtypes)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order, kind="stable").reset_index(drop=True)
        return pd.concat([p[[*by, *keep]], pd.DataFrame(kernel(p))[list(out)]], axis=1)

    return df.groupBy(*by).applyInPandas(run, ", ".join([f"`{c}` {kinds[c]}" for c in [*by, *keep]] + [f"`{c}` {t}" for c, t in out.items()]))


def reduce_series(df: DataFrame, by: list[str], order: list[str], kernel: Callable[[pd.DataFrame], list[dict]], out: dict[str, str]) -> DataFrame:
    """The rows (a dict each) that the kernel makes of a series."""
    kinds = dict(df.dtypes)

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        rows = kernel(p.sort_values(order, kind="stable").reset_index(drop=True))
        return pd.DataFrame([(*key, *(r[c] for c in out)) for r in rows], columns=[*by, *out])

    return df.groupBy(*by).applyInPandas(run, ", ".join([f"`{c}` {kinds[c]}" for c in by] + [f"`{c}` {t}" for c, t in out.items()]))


def half_extreme(t, price, seconds: float, direction: str = "ignore") -> np.ndarray:
    """Seconds until the price has moved half as far as it does at most within `seconds`; `seconds` if it doesn't move."""
    t, price = np.asarray(t, float), np.asarray(price, float)
    out, ends = np.full(len(t), float(seconds)), np.searchsorted(t, t + seconds, "right")
    for i, (p, end) in enumerate(zip(price, ends)):
        if not np.isfinite(p):
            out[i] = np.nan
            continue
        move = price[i:end] / p - 1
        up, down = np.fmax.reduce(move, initial=0.0), -np.fmin.reduce(move, initial=0.0)
        if direction == "pos" and up <= 0 or direction == "neg" and down <= 0:
            out[i] = np.nan
            continue
        sign, most = (1, up) if direction == "pos" or direction != "neg" and up > down else (-1, down)
        if most > 0:
            out[i] = t[i + np.argmax(sign * move >= most / 2)] - t[i]
    return out


def half_energy(t, price, seconds: float, direction: str = "ignore") -> np.ndarray:
    """Seconds until |return| reaches half of what it is at the first price `seconds` later or beyond; 0 if that is nil or in the wrong direction, `seconds` if it is not reached in time."""
    t, price = np.asarray(t, float), np.asarray(price, float)
    out, ok = np.full(len(t), float(seconds)), np.isfinite(price)
    begin, ends = np.searchsorted(t, t + seconds, "left"), np.searchsorted(t, t + seconds, "right")
    for i, p in enumerate(price):
        if not ok[i]:
            out[i] = np.nan
            continue
        later = np.flatnonzero(ok[max(begin[i], i + 1) :])
        change = price[max(begin[i], i + 1) + later[0]] - p if len(later) else 0.0
        if change == 0 or direction == "pos" and change < 0 or direction == "neg" and change > 0:
            out[i] = 0.0
            continue
        hit = np.flatnonzero(np.abs(price[i + 1 : ends[i]] - p) / p >= abs(change) / p / 2)
        if len(hit):
            out[i] = t[i + 1 + hit[0]] - t[i]
    return out


def follow_groups(t, keys: list, seconds: float) -> np.ndarray:
    """Group numbers from 1: a row without one opens a group, which takes all rows of its key within `seconds`, those of earlier groups too."""
    t, out, made = np.asarray(t, float), np.zeros(len(t), np.int64), 0
    places: dict = {}
    for i, k in enumerate(keys):
        places.setdefault(k, []).append(i)
    own = {k: np.array(v) for k, v in places.items()}
    for i, k in enumerate(keys):
        if out[i] == 0:
            made += 1
            rows = own[k][own[k] >= i]
            out[rows[t[rows] - t[i] <= seconds]] = made
    return out


def nearby_gap(volume, t, large: float, small: float, near: int, kind: str = "small", only_after: bool = False, apart: bool = False, flags=None, match: str = "ignore", large_to_large: bool = False) -> np.ndarray:
    """Mean of the `near` shortest times from a large row to the `near` target rows before and after it; none for others.

    Large: at least the sorted value at ceil(n * large). Targets: small, at most the one at
    floor(n * small); mid, between; full, all that aren't large; or large ones. `apart` leaves
    out rows of the same time; `match` asks for the same or a different flag.
    """
    volume, t = np.asarray(volume, float), np.asarray(t, float)
    n, out = len(volume), np.full(len(volume), np.nan)
    if not n:
        return out
    s = np.sort(volume)
    high, low = s[min(n - 1, int(np.ceil(n * large)))], s[min(n - 1, int(np.floor(n * small)))]
    big = volume >= high
    target = big if large_to_large else {"mid": (volume > low) & ~big, "full": ~big}.get(kind, volume <= low)
    flags = np.zeros(n) if flags is None else np.asarray(flags)
    for i in np.flatnonzero(big):
        ok = target & (np.arange(n) != i)
        if match in ("same", "diff"):
            ok &= (flags == flags[i]) == (match == "same")
        if apart:
            ok &= t != t[i]
        after, before = np.flatnonzero(ok[i + 1 :])[:near] + i + 1, np.flatnonzero(ok[:i])[::-1][:near]
        gaps = np.sort(np.abs(t[after if only_after else np.concatenate((before, after))] - t[i]))[:near]
        if len(gaps):
            out[i] = gaps.mean()
    return out


def rolling_dtw(x, pattern, t, seconds: float) -> np.ndarray:
    """Distance of each row's last `seconds` of x (z-scored) to the z-scored pattern; none where it is flat or of one row."""
    x, t, pattern = np.asarray(x, float), np.asarray(t, float), np.asarray(pattern, float)
    out, p = np.full(len(x), np.nan), (pattern - pattern.mean()) / pattern.std()
    starts = np.searchsorted(t, t - seconds, "right")
    for i, a in enumerate(starts):
        part = x[a : i + 1]
        if len(part) > 1 and part.std() > 0:
            out[i] = dtw((part - part.mean()) / part.std(), p)
    return out


def _score(guess: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """R squared of each row, between -100 and 1; none beyond, or where the truth is flat and the guess is not it."""
    rss, tss = ((truth - guess) ** 2).sum(1), ((truth - truth.mean(1, keepdims=True)) ** 2).sum(1)
    flat = tss < 1e-15
    r = np.where(flat, np.where(rss < 1e-15, 1.0, np.nan), 1 - rss / np.where(flat, 1.0, tss))
    return np.where((r < -100) | (r > 1.1) | ~np.isfinite(r), np.nan, np.minimum(r, 1.0))


def lagged_regression(x, past: int, future: int, alpha: float = 0.0) -> np.ndarray:
    """For each row that ends a window of past and future rows: R squared of autoregressions of 1 to past - future + 1 lags, in the past, then of their one-step forecasts of the future.

    `alpha` is added to the diagonal of the normal equations (ridge). Singular fits: none. All
    windows are solved together.
    """
    if future > past:
        raise ValueError("future is longer than past")
    x, lags = np.asarray(x, float), past - future + 1
    out = np.full((len(x), 2 * lags), np.nan)
    if len(x) < past + future:
        return out
    w = np.lib.stride_tricks.sliding_window_view(x, past + future)
    for lag in range(1, lags + 1):
        fit = past - lag
        if fit < lag + 1:
            continue
        rows = np.lib.stride_tricks.sliding_window_view(w[:, :-1], lag, axis=1)[..., ::-1]
        design, y = np.concatenate([np.ones((*rows.shape[:2], 1)), rows], 2), w[:, lag:]
        a = design[:, :fit].transpose(0, 2, 1)
        gram = a @ design[:, :fit] + alpha * np.eye(lag + 1)
        ok = np.flatnonzero(np.linalg.matrix_rank(gram) == lag + 1)
        if len(ok):
            guess = (design[ok] @ np.linalg.solve(gram[ok], a[ok] @ y[ok, :fit, None]))[..., 0]
            out[ok + past + future - 1, lag - 1] = _score(guess[:, :fit], y[ok, :fit])
            out[ok + past + future - 1, lags + lag - 1] = _score(guess[:, fit:], y[ok, fit:])
    return out


def _row_corr(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlations of the vector a with each row of b; none where either is flat."""
    da, db = a - a.mean(), b - b.mean(1, keepdims=True)
    den = np.sqrt((da @ da) * (db * db).sum(1))
    return np.divide(db @ da, den, out=np.full(len(b), np.nan), where=den > 1e-15)


def core_feature(x, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """By the window that ends at each row: its value whose place can be left out with the least change in its correlations with all other windows (core), and with the most (minor), by root mean square."""
    x = np.asarray(x, float)
    core, minor = np.full(len(x), np.nan), np.full(len(x), np.nan)
    if len(x) < size:
        return core, minor
    w = np.lib.stride_tricks.sliding_window_view(x, size)
    for i in range(len(w)):
        others = np.delete(w, i, 0)
        others = others[others.std(1) > np.finfo(float).eps]
        if not len(others):
            continue
        base = _row_corr(w[i], others)
        change = np.array([np.sqrt(np.nanmean((base - _row_corr(np.delete(w[i], m), np.delete(others, m, 1))) ** 2)) if np.isfinite(base).any() else np.nan for m in range(size)])
        if np.isfinite(change).any():
            core[i + size - 1], minor[i + size - 1] = w[i][np.nanargmin(change)], w[i][np.nanargmax(change)]
    return core, minor


LOCAL_NAMES = [f"{side}_{what}_{unit}" for side in ("after", "before") for what in ("max", "min", "min_between") for unit in ("rows", "volume")]


def local_correlation(price, volume, size: int) -> np.ndarray:
    """For the window that ends at each row, LOCAL_NAMES: rows and volume to the window after (before) it that correlates most, least, and least of those nearer than the most."""
    price, volume = np.asarray(price, float), np.asarray(volume, float)
    out = np.full((len(price), 12), np.nan)
    if len(price) <= size:
        return out
    w = np.lib.stride_tricks.sliding_window_view(price, size)
    total = np.concatenate(([0.0], np.cumsum(volume)))
    for i in range(size, len(price)):
        c = _row_corr(w[i - size + 1], w)
        for side, at in ((0, np.arange(i + 1, len(price))), (6, np.arange(i - 1, size - 2, -1))):
            own = c[at - size + 1]
            if not np.isfinite(own).any():
                continue
            most, least = np.nanargmax(own), np.nanargmin(own)
            picks = [most, least, np.nanargmin(own[:most]) if most and np.isfinite(own[:most]).any() else None]
            for k, p in enumerate(picks):
                if p is not None:
                    lo, hi = sorted((i, int(at[p])))
                    out[i, side + 2 * k], out[i, side + 2 * k + 1] = hi - lo, total[hi + 1] - total[lo + 1]
    return out


def rolling_gain(x, window: int, max_lag: int, quantile: float = 0.5, step: int = 1) -> np.ndarray:
    """Information gain of each lag over the last window + max_lag values before a row, the whole series cut at one quantile; 0 before that, and between steps."""
    x, out = np.asarray(x, float), np.zeros((len(x), max_lag))
    if len(x) < window + max_lag + 1:
        return out
    s = (x > np.sort(x)[min(int(len(x) * min(max(quantile, 0), 1)), len(x) - 1)]).astype(float)
    for i in range(window + max_lag, len(x), step):
        gains = information_gain(s[i - window - max_lag : i], max_lag, cut=0.5)
        out[i, : len(gains)] = gains
    return out


def rolling_memory(x, window: int, max_lag: int, ratio: float = 0.9, quantile: float = 0.5, step: int = 1) -> np.ndarray:
    """The first lag whose gain reaches `ratio` of the largest; max_lag where nothing is gained."""
    x, out = np.asarray(x, float), np.zeros(len(x))
    gains = rolling_gain(x, window, max_lag, quantile, step)
    for i in range(window + max_lag, len(x), step):
        top = gains[i].max(initial=0)
        out[i] = max_lag if top <= 0 else 1 + np.argmax(gains[i] >= top * ratio)
    return out


def _states(x, c: int) -> np.ndarray:
    """1 to c by rank, n // c values in each but the last."""
    order = np.argsort(x, kind="stable")
    out = np.empty(len(order), np.int64)
    out[order] = np.minimum(np.arange(len(order)) // max(1, len(order) // c), c - 1) + 1
    return out


def transfer_entropy(x, y, k: int, c: int, safe: bool = True) -> float:
    """Sum over states of p(x, y) log2(q / m), x taken k steps before y.

    q adds up n(x, y) / d once for each such pair, where d counts the state x among x's if
    `safe`, and among y's if not; m is the share of y's state if `safe`, its count if not. Safe:
    pairs with a NaN are left out, and too few of them give 0.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    if safe:
        ok = ~(np.isnan(x) | np.isnan(y))
        x, y = x[ok], y[ok]
    if len(x) <= k:
        return 0.0
    a, b = _states(x, c)[: len(x) - k], _states(y, c)[k:]
    n = len(b)
    pairs, count = np.unique(np.stack([a, b]), axis=1, return_counts=True)
    of = lambda s: np.bincount(s, minlength=c + 2)
    d, m = (of(a) if safe else of(b))[pairs[0]], of(b)[pairs[1]]
    q = np.divide(count.astype(float) ** 2, d, out=np.zeros(len(count)), where=d > 0)
    ok = q > 0
    if not safe and not ok.all():
        return -np.inf
    return float((count[ok] / n * np.log2(q[ok] / (m[ok] / n if safe else m[ok]))).sum())


def patterns(x, m: int) -> np.ndarray:
    """Order pattern of each m consecutive values, as digits of a number in base m."""
    w = np.argsort(np.lib.stride_tricks.sliding_window_view(np.asarray(x, float), m), axis=1, kind="stable")
    return w @ (m ** np.arange(m - 1, -1, -1))


def _reversed(p: np.ndarray, m: int) -> np.ndarray:
    digits = p[:, None] // (m ** np.arange(m - 1, -1, -1)) % m
    return digits[:, ::-1] @ (m ** np.arange(m - 1, -1, -1))


def irreversibility(x, m: int = 5) -> dict:
    """Static irreversibility: i_ord over all patterns, the entropy of patterns and its share of ln m!, patterns that don't occur, and the divergence from the reversed ones."""
    from math import factorial

    if len(x) < m:
        return dict.fromkeys(("i_ord", "permutation_entropy", "normalized_entropy", "forbidden_ratio", "kl_divergence"), np.nan)
    p, n = np.unique(patterns(x, m), return_counts=True)
    share, all_ = n / n.sum(), factorial(m)
    back = dict(zip(p.tolist(), share.tolist()))
    q = np.array([back.get(k, 0.0) for k in _reversed(p, m).tolist()])
    h = float(-(share * np.log(share)).sum())
    lone = share[q == 0].sum()  # the reversed pattern of each of these is a pattern of share 0
    return {"i_ord": float(0.5 * (np.abs(share - q).sum() + lone)), "permutation_entropy": h, "normalized_entropy": h / np.log(all_), "forbidden_ratio": 1 - len(p) / all_, "kl_divergence": float((share * np.log(share / q)).sum()) if (q > 0).all() else np.inf}


def transfer_irreversibility(x, m: int = 5) -> dict:
    """Irreversibility of transitions between patterns: half the sum of |flow there - flow back| over patterns that something follows, and the entropy rate."""
    if len(x) < m + 1:
        return {"i_trans": np.nan, "entropy_rate": np.nan}
    p = np.unique(patterns(x, m), return_inverse=True)[1]
    (a, b), n = np.unique(np.stack([p[:-1], p[1:]]), axis=1, return_counts=True)
    flow = {(i, j): k / n.sum() for i, j, k in zip(a.tolist(), b.tolist(), n.tolist())}
    left = set(a.tolist())
    trans = sum(abs(f - flow.get((j, i), 0.0)) + (0 if (j, i) in flow else f) for (i, j), f in flow.items() if j in left)
    row = np.bincount(a, n)[a]
    return {"i_trans": 0.5 * trans, "entropy_rate": float(-(n / n.sum() * np.log(n / row)).sum())}


def peaks(t, volume, flag, tier1: float, tier2: float, seconds: float, other_flag: bool = False, both: bool = True) -> list[dict]:
    """Large volumes that nothing within `seconds` exceeds, with the sizeable ones near them: how many, their sum and mean over the peak's, mean gap, and the correlation of volume with gap."""
    t, volume, flag = np.asarray(t, float), np.asarray(volume, float), np.asarray(flag)
    s, n, out = np.sort(volume)[::-1], len(volume), []
    if not n:
        return out
    high, low = (s[min(n - 1, int(n * x))] for x in (tier1, tier2))
    lo, hi = np.searchsorted(t, t - seconds, "left"), np.searchsorted(t, t + seconds, "right")
    for i in np.flatnonzero(volume >= high):
        near = np.arange(lo[i], hi[i])
        if volume[near].max() > volume[i]:
            continue
        own = near[(near != i) & (volume[near] >= low) & (both | (t[near] > t[i])) & (~np.bool_(other_flag) | (flag[near] != flag[i]))]
        v, gap = volume[own], np.abs(t[own] - t[i])
        flat = len(own) < 2 or v.std() < 1e-12 or gap.std() < 1e-12
        out.append({"row": int(i), "n": len(own), "sum_ratio": v.sum() / volume[i], "mean_ratio": v.mean() / volume[i] if len(own) else 0.0, "mean_gap": gap.mean() if len(own) else 0.0, "corr": 0.0 if flat else float(np.corrcoef(v, gap)[0, 1])})
    return out


def boxes(t, x, levels=(2, 4, 8, 16, 32)) -> float:
    """Box-counting dimension of (t, x) scaled to the unit square; 0 for under five points."""
    t, x = np.asarray(t, float), np.asarray(x, float)
    if len(x) < 5:
        return 0.0
    unit = lambda a: (a - a.min()) / max(a.max() - a.min(), 1e-9)
    t, x = unit(t), unit(x)
    n = [len(np.unique(np.clip(np.floor(t * k), 0, k - 1) * k + np.clip(np.floor(x * k), 0, k - 1))) for k in levels]
    return float(np.polyfit(np.log(levels), np.log(n), 1)[0]) if len(levels) > 1 else 0.0


def hurst_rs(x) -> float:
    """ln(R/S) / ln(n/2) of the log returns, within 0 and 1; 0.5 for under 11 prices or flat ones."""
    x = np.asarray(x, float)
    if len(x) < 11:
        return 0.5
    r = np.diff(np.log(x))
    d = np.cumsum(r - r.mean())
    if r.std() < 1e-12:
        return 0.5
    return float(np.clip(np.log((d.max() - d.min()) / r.std()) / max(np.log(len(r) / 2), 1e-9), 0, 1))


def difference_eigenvalues(x, absolute_below: bool = False) -> np.ndarray:
    """Magnitudes of the eigenvalues of x_i - x_j, largest first; below the diagonal |x_i - x_j| if asked. NaN anywhere: all NaN."""
    x = np.asarray(x, float)
    if not np.isfinite(x).all():
        return np.full(len(x), np.nan)
    d = x[:, None] - x[None, :]
    if absolute_below:
        d = np.where(np.tri(len(x), dtype=bool), np.abs(d), d)
    return np.sort(np.abs(np.linalg.eigvals(d)))[::-1]
