"""Sequential numerical kernels on one array at a time, and their Arrow-batched form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dtw(a, b, radius: int | None = None) -> float:
    """Dynamic time warping distance with absolute cost, diagonals of the table at a time; an optional band."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    n, m = len(a), len(b)
    if not n or not m:
        return float("nan")
    # cell (i, j) of diagonal d = i + j stands at place i + 1
    before, last = np.full(n + 2, np.inf), np.full(n + 2, np.inf)
    for d in range(n + m - 1):
        i = np.arange(max(0, d - m + 1), min(n, d + 1))
        if radius is not None:
            i = i[np.abs(2 * i - d) <= radius]
        now = np.full(n + 2, np.inf)
        best = np.minimum(np.minimum(last[i], last[i + 1]), before[i])
        now[i + 1] = np.abs(a[i] - b[d - i]) + (best if d else 0.0)
        before, last = last, now
    return float(last[n])


def lz_complexity(x, normalize: bool = True, quantiles: tuple | None = None) -> float:
    """Number of phrases of the exhaustive history (Lempel and Ziv 1976) of the symbols of x.

    Symbols are the values, or, with quantiles, how many of the sorted values at int((n - 1) q) a
    value exceeds. Normalized: times log n over n, to the base of the number of symbols; none
    where there are fewer symbols than quantiles + 1 (or than two).
    """
    x = np.asarray(x, float)
    if quantiles is not None and len(x):
        x = np.searchsorted(np.sort(x)[[int((len(x) - 1) * q) for q in quantiles]], x, "left")
    s = "".join(chr(0x100 + int(i)) for i in np.unique(x, return_inverse=True)[1])
    n, at, phrases = len(s), 0, 0
    while at < n:
        size = 1
        while at + size <= n and s.find(s[at : at + size], 0, at + size - 1) >= 0:
            size += 1
        phrases += 1
        at += size
    k = len(set(s))
    if not normalize or n <= 1:
        return 0.0 if normalize else float(phrases)
    return float(phrases * np.log(n) / np.log(k) / n) if k >= (2 if quantiles is None else len(quantiles) + 1) and k > 1 else float("nan")


def max_range(x, equal: bool = True) -> list[int]:
    """For each place, how far back the run reaches in which it is the largest (a monotonic stack)."""
    out, stack = [], []
    for i, v in enumerate(x):
        while stack and (x[stack[-1]] <= v if equal else x[stack[-1]] < v):
            stack.pop()
        out.append(i - stack[-1] if stack else i + 1)
        stack.append(i)
    return out


def irreversibility(x, m: int = 3) -> float:
    """Half the sum of |p(pattern) - p(reversed pattern)| over the order patterns that occur."""
    x = np.asarray(x, float)
    if len(x) < m:
        return float("nan")
    p = [tuple(np.argsort(w, kind="stable").tolist()) for w in np.lib.stride_tricks.sliding_window_view(x, m)]
    n = pd.Series(p).value_counts(normalize=True)
    return float(0.5 * sum(abs(q - n.get(k[::-1], 0.0)) for k, q in n.items()))


def max_eigenvalue(m, rounds: int = 200) -> float:
    """Dominant eigenvalue by power iteration."""
    m = np.asarray(m, float)
    v = np.ones(len(m)) / np.sqrt(len(m))
    for _ in range(rounds):
        w = m @ v
        if not np.linalg.norm(w):
            return 0.0
        v = w / np.linalg.norm(w)
    return float(v @ m @ v)


_KERNELS = {"lz_complexity": lz_complexity, "irreversibility": irreversibility}


def apply(name: str, values: Column) -> Column:
    """A kernel over an array column, in Arrow batches."""
    kernel = _KERNELS[name]

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda a: None if a is None else kernel(a))

    return run(values)


def apply_pair(a: Column, b: Column, radius: int | None = None) -> Column:
    """DTW of two array columns."""

    @F.pandas_udf("double")
    def run(s: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else dtw(x, y, radius) for x, y in zip(s, t)], dtype="float64")

    return run(a, b)


def min_range(x, equal: bool = True) -> list[int]:
    """max_range with the smallest in place of the largest."""
    return max_range([-v for v in x], equal)


def max_range_product(x) -> float:
    """Largest min(x_i, x_j) * (j - i) of non-negative x: the ends move inward, the lower one first."""
    i, j, best = 0, len(x) - 1, 0.0
    while i < j:
        best = max(best, min(x[i], x[j]) * (j - i))
        if x[i] <= x[j]:
            i += 1
        else:
            j -= 1
    return float(best)


def kendall_tau(a, b) -> float:
    """Kendall's tau-b; 0 where either is flat. One row of pairs at a time, so memory stays linear."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    score = in_a = in_b = 0
    for i in range(len(a) - 1):
        x, y = np.sign(a[i + 1 :] - a[i]), np.sign(b[i + 1 :] - b[i])
        score, in_a, in_b = score + (x * y).sum(), in_a + np.count_nonzero(x), in_b + np.count_nonzero(y)
    return float(score / np.sqrt(in_a * in_b)) if in_a and in_b else 0.0


def _bits(p) -> float:
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


def information_gain(x, max_lag: int, quantile: float = 0.5, cut: float | None = None) -> list[float]:
    """H(s) - H(s given its last `lag` symbols), in bits, for each lag up to min(max_lag, 32); s is x above `cut`, or else above its quantile (sorted value at int(n q))."""
    x = np.asarray(x, float)
    if not len(x):
        return []
    s = (x > (np.sort(x)[min(int(len(x) * quantile), len(x) - 1)] if cut is None else cut)).astype(np.int64)
    base, out = _bits(np.bincount(s, minlength=2) / len(s)), []
    for lag in range(1, min(max_lag, 32, len(s) - 1) + 1):
        code = np.lib.stride_tricks.sliding_window_view(s, lag + 1) @ (1 << np.arange(lag, -1, -1, dtype=np.int64))
        both, past = (np.unique(c, return_counts=True)[1] / len(code) for c in (code, code >> 1))
        out.append(base - (_bits(both) - _bits(past)))
    return out


def memory_length(x, max_lag: int = 10, ratio: float = 0.9, quantile: float = 0.5) -> float:
    """The first lag whose information gain reaches `ratio` of the largest; max_lag where nothing is gained."""
    gains = information_gain(x, max_lag, quantile)
    top = max(gains, default=0.0)
    return float(max_lag if top <= 0 else next(i for i, g in enumerate(gains, 1) if g >= top * ratio))


def string_proximity(a: str, b: str, depth: int = 6) -> float:
    """Fewest steps from a to b, each a swap of two places or of two characters throughout; NaN if their letters differ or it takes over `depth`."""
    if sorted(a) != sorted(b):
        return float("nan")
    seen, edge = {a}, {a}
    for steps in range(depth + 1):
        if b in edge:
            return float(steps)
        new = set()
        for s in edge:
            for i in range(len(s)):
                for j in range(i + 1, len(s)):
                    new.add(s[:i] + s[j] + s[i + 1 : j] + s[i] + s[j + 1 :])
                    new.add(s.translate({ord(s[i]): s[j], ord(s[j]): s[i]}))
        edge = new - seen
        seen |= new
    return float("nan")


_KERNELS |= {"max_range_product": max_range_product, "memory_length": memory_length, "max_eigenvalue": lambda m: max_eigenvalue(np.stack([np.asarray(r, float) for r in m]))}


def apply_series(name: str, values: Column) -> Column:
    """A kernel that gives a number for each place of an array column."""
    kernel = {"max_range": max_range, "min_range": min_range}[name]

    @F.pandas_udf("array<int>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda a: None if a is None else kernel(a))

    return run(values)


def apply_two(name: str, a: Column, b: Column) -> Column:
    """A kernel over two columns; none where either is."""
    kernel = {"kendall_tau": kendall_tau, "string_proximity": string_proximity}[name]

    @F.pandas_udf("double")
    def run(s: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else kernel(x, y) for x, y in zip(s, t)], dtype="float64")

    return run(a, b)
