"""Series judged: trends with significance, robust slopes and breaks, and the effect of an intervention with its errors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Lags over which errors may go together, and the level of tests.
LAGS, ALPHA = 4, 0.05


def _pairs_not_above(w: np.ndarray) -> int:
    """Pairs i < j with w[j] <= w[i], by halves."""
    if len(w) < 2:
        return 0
    half = len(w) // 2
    across = np.searchsorted(np.sort(w[half:]), w[:half], "right").sum()
    return int(across) + _pairs_not_above(w[:half]) + _pairs_not_above(w[half:])


def sen_slope(t: np.ndarray, v: np.ndarray) -> float:
    """Median slope of all pairs of different times; pairs are counted at a trial slope and halved, not made."""
    order = np.lexsort((v, t))
    t, v = t[order].astype(float), v[order].astype(float)
    at, values = np.unique(t, return_counts=True)[1], np.unique(np.stack([t, v], 1), axis=0, return_counts=True)[1]
    n = len(t) * (len(t) - 1) // 2 - int((at * (at - 1) // 2).sum())
    if n == 0:
        return math.nan
    same = int((values * (values - 1) // 2).sum())

    def not_above(s: float) -> int:
        w = v - s * t
        # within one time the order is upward, so that only equal values count, and those are taken off
        return _pairs_not_above(w[np.lexsort((w, t))]) - same

    most = (v.max() - v.min()) / np.diff(np.unique(t)).min()

    def kth(k: int) -> float:
        lo, hi = -most - 1, most + 1
        while True:
            mid = lo + (hi - lo) / 2
            if not lo < mid < hi or hi - lo < 1e-13 * max(1.0, most):
                return hi
            lo, hi = (lo, mid) if not_above(mid) >= k else (mid, hi)

    return kth(n // 2 + 1) if n % 2 else (kth(n // 2) + kth(n // 2 + 1)) / 2


def _ties(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_counts=True)[1].astype(float)


def mann_kendall(t: np.ndarray, v: np.ndarray) -> tuple[int, float]:
    """(pairs that rise less pairs that fall, their variance without a trend), both corrected for ties in time and value."""
    order = np.lexsort((v, t))
    t, v = t[order], v[order]
    n, of_t, of_v = float(len(t)), _ties(t), _ties(v)
    both = np.unique(np.stack([t, v], 1), axis=0, return_counts=True)[1] if len(t) else np.zeros(0)
    pairs = lambda c: (c * (c - 1)).sum() / 2
    # within one time values go upward: of those pairs only equal values are not above
    falling_or_level = _pairs_not_above(v) - pairs(both)
    level = pairs(of_v) - pairs(both)
    total = pairs(np.array([n])) - pairs(of_t)
    s = int(round(total - falling_or_level - (falling_or_level - level)))
    whole = lambda c: (c * (c - 1) * (2 * c + 5)).sum()
    variance = (n * (n - 1) * (2 * n + 5) - whole(of_t) - whole(of_v)) / 18
    if n > 2:
        variance += (of_t * (of_t - 1) * (of_t - 2)).sum() * (of_v * (of_v - 1) * (of_v - 2)).sum() / (9 * n * (n - 1) * (n - 2))
    if n > 1:
        variance += (of_t * (of_t - 1)).sum() * (of_v * (of_v - 1)).sum() / (2 * n * (n - 1))
    return s, variance


def trend_test(series: DataFrame, key: str, at: str, value: str, alpha: float = ALPHA) -> DataFrame:
    """(key, n, mann_kendall, variance, z, p_value, sen_slope, trend): rising, falling or stagnant, decided at level alpha, two-sided.

    A series is one group; its pairs are counted in n log n steps and never made. Rows with a null time or value don't count; a series
    without any of others is stagnant, with p_value 1 and no slope.
    """

    def decide(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=["t", "v"])
        t, v = rows["t"].to_numpy(float), rows["v"].to_numpy(float)
        s, variance = mann_kendall(t, v)
        z = (s - np.sign(s)) / math.sqrt(variance) if variance > 0 else 0.0
        p = math.erfc(abs(z) / math.sqrt(2))
        trend = "stagnant" if p > alpha else "rising" if s > 0 else "falling"
        return pd.DataFrame({key: [k[0]], "n": [len(t)], "mann_kendall": [s], "variance": [variance], "z": [z], "p_value": [p], "sen_slope": [sen_slope(t, v)], "trend": [trend]})

    kind = series.schema[key].dataType.simpleString()
    picked = series.select(key, F.col(at).cast("double").alias("t"), F.col(value).cast("double").alias("v"))
    return picked.groupBy(key).applyInPandas(decide, f"{key} {kind}, n long, mann_kendall long, variance double, z double, p_value double, sen_slope double, trend string")


def change_points(series: DataFrame, key: str, at: str, value: str, penalty: float | None = None) -> DataFrame:
    """(key, part, start, n, mean): the parts of each series with the least squares around their means, plus a penalty for each, by dynamic programming.

    By default the penalty is three times the noise, told from differences of neighbours, times the logarithm of the length.
    """

    def cut(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=["t", "v"]).sort_values(["t", "v"])
        v = rows["v"].to_numpy(float)
        n = len(v)
        sums, squares = np.concatenate([[0], np.cumsum(v - v.mean() if n else v)]), np.concatenate([[0], np.cumsum((v - v.mean()) ** 2 if n else v)])
        cost = penalty if penalty is not None else 3 * max(float(np.median(np.diff(v) ** 2)) / 0.9099 if n > 1 else 0.0, 1e-12) * math.log(max(n, 2))
        best, last = np.zeros(n + 1), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            i = np.arange(j)
            total = best[:j] + squares[j] - squares[:j] - (sums[j] - sums[:j]) ** 2 / (j - i) + cost
            last[j] = total.argmin()
            best[j] = total[last[j]]
        starts, j = [], n
        while j:
            j = int(last[j])
            starts.append(j)
        starts = sorted(starts)
        parts = [v[i:j] for i, j in zip(starts, [*starts[1:], n])]
        return pd.DataFrame({key: k[0], "part": range(1, len(parts) + 1), "start": rows["t"].to_numpy()[starts], "n": [len(x) for x in parts], "mean": [x.mean() for x in parts]})

    kind = series.schema[key].dataType.simpleString()
    picked = series.select(key, F.col(at).cast("double").alias("t"), F.col(value).cast("double").alias("v"))
    return picked.groupBy(key).applyInPandas(cut, f"{key} {kind}, part long, start double, n long, mean double")


#: What a segmented line is made of: level and slope before, and their changes at the start.
_TERMS = ("level", "slope", "level_change", "slope_change")


def _upper() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(_TERMS)) for j in range(i, len(_TERMS))]


def intervention_test(series: DataFrame, key: str, at: str, value: str, start: float, lags: int = LAGS, alpha: float = ALPHA) -> DataFrame:
    """(key, n, level, slope, level_change, slope_change, se_ of each, p_ of the changes, effective) of a line that may break at start.

    One aggregation sums the products of the line's terms and the values; level and slopes are solved together, times counted from
    start. A second one sums products of residuals up to lags steps apart, in the order of time, so errors that go together widen the
    errors of the terms (Newey and West). Nothing but a row for each series leaves the plan. Rows with a null time or value don't
    count; a series without enough different times before or after has null terms.
    """
    t = F.col(at).cast("double") - F.lit(float(start))
    after = (t >= 0).cast("double")
    rows = series.where(F.col(at).isNotNull() & F.col(value).isNotNull()).select(key, t.alias("t"), F.lit(1.0).alias("x0"), t.alias("x1"), after.alias("x2"), (after * t).alias("x3"), F.col(value).cast("double").alias("y"))
    products = lambda f: [F.sum(f(i) * f(j)).alias(f"g{i}{j}") for i, j in _upper()]
    x = lambda i: F.col(f"x{i}")
    gram = rows.groupBy(key).agg(F.count("*").alias("n"), *products(x), *[F.sum(x(i) * F.col("y")).alias(f"r{i}") for i in range(4)])
    packed = gram.select(key, "n", F.array(*[f"g{i}{j}" for i, j in _upper()]).alias("g"), F.array(*[f"r{i}" for i in range(4)]).alias("r"))

    def square(g: list[float]) -> np.ndarray:
        out = np.zeros((4, 4))
        for (i, j), v in zip(_upper(), g):
            out[i, j] = out[j, i] = v
        return out

    @F.pandas_udf("array<double>")
    def solved(g: pd.Series, r: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(g, r):
            m = square(a)
            scale = np.sqrt(np.maximum(np.diag(m), 1e-300))
            ok = np.linalg.matrix_rank(m / np.outer(scale, scale), tol=1e-10) == 4
            out.append((np.linalg.solve(m / np.outer(scale, scale), np.asarray(b) / scale) / scale).tolist() if ok else None)
        return pd.Series(out)

    lines = packed.withColumn("line", solved("g", "r"))
    met = rows.join(lines.select(key, "line"), key)
    left = F.col("y") - sum((x(i) * F.col("line")[i] for i in range(1, 4)), x(0) * F.col("line")[0])
    moved = met.select(key, "t", *[(x(i) * left).alias(f"u{i}") for i in range(4)])
    order = Window.partitionBy(key).orderBy("t", "u0")
    lagged = moved.select(key, *[f"u{i}" for i in range(4)], *[F.lag(f"u{i}", k).over(order).alias(f"u{i}_{k}") for k in range(1, lags + 1) for i in range(4)])
    weight = lambda k: 1 - k / (lags + 1)
    u = lambda i, k=0: F.col(f"u{i}" if not k else f"u{i}_{k}")
    together = lambda i, j: sum((weight(k) * F.coalesce(u(i) * u(j, k) + u(j) * u(i, k), F.lit(0.0)) for k in range(1, lags + 1)), u(i) * u(j))
    spread = lagged.groupBy(key).agg(F.array(*[F.sum(together(i, j)) for i, j in _upper()]).alias("s"))

    @F.pandas_udf("array<double>")
    def errors(g: pd.Series, s: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for a, b, k in zip(g, s, n):
            if b is None or any(v is None or v != v for v in b) or k <= 4:
                out.append(None)
                continue
            inverse = np.linalg.inv(square(a))
            out.append(np.sqrt(np.maximum(np.diag(inverse @ square(b) @ inverse) * k / (k - 4), 0)).tolist())
        return pd.Series(out)

    @F.pandas_udf("double")
    def two_sided(z: pd.Series) -> pd.Series:
        return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)), na_action="ignore")

    done = lines.join(spread, key, "left").withColumn("se", errors("g", "s", "n"))
    done = done.select(key, "n", *[F.col("line")[i].alias(c) for i, c in enumerate(_TERMS)], *[F.col("se")[i].alias(f"se_{c}") for i, c in enumerate(_TERMS)])
    done = done.withColumns({f"p_{c}": two_sided(F.try_divide(F.col(c), F.col(f"se_{c}"))) for c in _TERMS[2:]})
    return done.withColumn("effective", F.coalesce(F.least(*[f"p_{c}" for c in _TERMS[2:]]) * 2 <= alpha, F.lit(False)))
