"""Trends, breaks, interventions and reliability against plain computations."""

import hashlib
import math

import numpy as np
import pytest

from tessera.operators import reliability, series


def _pairs(t, v):
    return [((v[j] - v[i]) / (t[j] - t[i])) for i in range(len(t)) for j in range(len(t)) if t[i] < t[j]]


def test_slopes_and_statistics_are_those_of_all_pairs():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 7, 8, 40, 41, 120):
        for _ in range(6):
            t, v = rng.permutation(n * 2)[:n] if rng.random() < 0.5 else rng.integers(0, max(1, n // 2), n), rng.integers(0, 9, n) if rng.random() < 0.5 else rng.normal(size=n)
            t, v = np.asarray(t, float), np.asarray(v, float)
            slopes = _pairs(t, v)
            got = series.sen_slope(t, v) if n else math.nan
            assert (math.isnan(got) and not slopes) or got == pytest.approx(np.median(slopes), abs=1e-9)
            assert series.mann_kendall(t, v)[0] == sum(np.sign(s) for s in slopes)


def test_variance_is_that_of_permutations():
    rng = np.random.default_rng(6)
    t, v = np.array([1, 1, 2, 3, 4, 5, 5, 6, 7, 8.0]), np.array([3, 1, 1, 4, 4, 4, 9, 2, 6, 5.0])
    drawn = [series.mann_kendall(t, rng.permutation(v))[0] for _ in range(6000)]
    assert series.mann_kendall(t, v)[1] == pytest.approx(np.var(drawn), rel=0.06)


def test_trends_are_decided(spark):
    rng = np.random.default_rng(1)
    rows = [(k, i, float(v)) for k, slope in (("up", 0.2), ("down", -0.2), ("flat", 0.0)) for i, v in enumerate(slope * np.arange(40) + rng.normal(size=40))]
    rows += [("one", 1, 2.0), ("none", None, 1.0), ("none", 3, None), ("same", 1, 5.0), ("same", 2, 5.0)]
    got = {r.k: r for r in series.trend_test(spark.createDataFrame(rows, "k string, t int, v double"), "k", "t", "v").collect()}
    assert {k: r.trend for k, r in got.items()} == {"up": "rising", "down": "falling", "flat": "stagnant", "one": "stagnant", "none": "stagnant", "same": "stagnant"}
    assert got["up"].sen_slope == pytest.approx(0.2, abs=0.05) and got["none"].n == 0 and got["none"].p_value == 1
    assert series.trend_test(spark.createDataFrame(rows[:0], "k string, t int, v double"), "k", "t", "v").count() == 0


def test_breaks_are_found(spark):
    rng = np.random.default_rng(2)
    levels = np.repeat([0.0, 5.0, 2.0], [30, 20, 25])
    rows = [("a", i, float(v)) for i, v in enumerate(levels + rng.normal(size=75) * 0.3)] + [("flat", i, 1.0) for i in range(9)] + [("none", 1, None)]
    got = {}
    for r in series.change_points(spark.createDataFrame(rows, "k string, t int, v double"), "k", "t", "v").orderBy("k", "part").collect():
        got.setdefault(r.k, []).append((r.start, r.n, round(r["mean"])))
    assert got == {"a": [(0, 30, 0), (30, 20, 5), (50, 25, 2)], "flat": [(0, 9, 1)]}


def test_intervention_terms_are_least_squares(spark):
    rng = np.random.default_rng(3)
    t = np.arange(60)
    y = 3 + 0.1 * t + np.where(t >= 40, 4 - 0.3 * (t - 40), 0) + rng.normal(size=60)
    rows = [("a", int(i), float(v)) for i, v in zip(t, y)] + [("short", 1, 1.0), ("short", 50, 2.0)] + [("a", None, 1.0), ("a", 3, None)]
    got = {r.k: r for r in series.intervention_test(spark.createDataFrame(rows, "k string, t int, v double"), "k", "t", "v", 40, lags=0).collect()}
    x = np.stack([np.ones(60), t - 40, t >= 40, (t - 40) * (t >= 40)], 1).astype(float)
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    left = y - x @ beta
    inverse = np.linalg.inv(x.T @ x)
    errors = np.sqrt(np.diag(inverse @ (x * left[:, None] ** 2).T @ x @ inverse) * 60 / 56)
    row = got["a"]
    assert [row.level, row.slope, row.level_change, row.slope_change] == pytest.approx(list(beta)) and [row.se_level, row.se_slope, row.se_level_change, row.se_slope_change] == pytest.approx(list(errors))
    assert row.effective and got["short"].level is None and not got["short"].effective


def test_intervention_errors_cover_the_truth(spark):
    """300 series whose errors go together: two errors around the change hold it more than 85 times in 100, and more often by far than errors without lags."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(300):
        noise = np.zeros(240)
        for i in range(1, 240):
            noise[i] = 0.4 * noise[i - 1] + rng.normal()
        rows += [(k, i, float(v)) for i, v in enumerate(1 + 0.05 * np.arange(240) + np.where(np.arange(240) >= 120, 2.0, 0.0) + noise)]
    table = spark.createDataFrame(rows, "k long, t int, v double").cache()
    held = {lags: np.mean([abs(r.level_change - 2) <= 2 * r.se_level_change for r in series.intervention_test(table, "k", "t", "v", 120, lags=lags).collect()]) for lags in (0, 8)}
    assert held[8] > 0.85 and held[8] > held[0] + 0.05


def test_agreement_is_the_one_way_coefficient(spark):
    rng = np.random.default_rng(7)
    rows = [(g, s, float(mean + rng.normal() * noise)) for g, noise in (("good", 0.2), ("bad", 3.0)) for s, mean in enumerate(rng.normal(size=30) * 2) for _ in range(rng.integers(1, 6))]
    rows += [("one", 1, 2.0), ("one", 1, 3.0), ("good", 5, None), ("single", 1, 1.0), ("single", 2, 5.0)]
    got = {r.g: r for r in reliability.agreement(spark.createDataFrame(rows, "g string, s long, v double"), "v", ["g"], ["s"]).collect()}
    for g in ("good", "bad"):
        by = {}
        for h, s, v in rows:
            if h == g and v is not None:
                by.setdefault(s, []).append(v)
        n, k = sum(map(len, by.values())), len(by)
        grand = sum(map(sum, by.values())) / n
        between = sum(len(x) * (np.mean(x) - grand) ** 2 for x in by.values()) / (k - 1)
        within = sum(((np.array(x) - np.mean(x)) ** 2).sum() for x in by.values()) / (n - k)
        each = (n - sum(len(x) ** 2 for x in by.values()) / n) / (k - 1)
        assert got[g].icc == pytest.approx((between - within) / (between + (each - 1) * within)) and got[g].within == pytest.approx(within)
    assert got["good"].icc > 0.9 > 0.5 > got["bad"].icc and got["one"].icc is None and got["single"].icc is None


def test_paired_permutation_is_its_plain_form(spark):
    rng = np.random.default_rng(9)
    rows = [(g, s, f, float(rng.normal() + (shift if f == "after" else 0))) for g, shift in (("moved", 1.5), ("still", 0.0), ("also", 0.0)) for s in range(25) for f in ("before", "after")]
    rows += [("still", 99, "before", 1.0), ("still", 98, "after", None), ("still", 97, "other", 4.0), ("empty", 1, "before", 1.0)]
    table = spark.createDataFrame(rows, "g string, s long, f string, v double")
    got = {r.g: r for r in reliability.paired_permutation(table, "v", ["g"], ["s"], "f", "before", "after", digests=2).collect()}
    assert set(got) == {"moved", "still", "also"} and all(r.draws == 256 and r.pairs == 25 for r in got.values())
    for g, r in got.items():
        d = {s: round((b - a) * 1e6) for s in range(25) for a, b in [[next(v for h, x, f, v in rows if (h, x, f) == (g, s, side)) for side in ("before", "after")]]}
        extreme = 0
        for block in range(2):
            digits = {s: hashlib.md5(f"1|{g}|{s}|{block}".encode()).hexdigest() for s in d}
            for bit in range(128):
                extreme += abs(sum(x * (1 - 2 * (int(digits[s][bit // 4], 16) >> bit % 4 & 1)) for s, x in d.items())) >= abs(sum(d.values()))
        assert r.extreme == extreme and r.p_value == pytest.approx((extreme + 1) / 257)
    assert got["moved"].rank == 1 and got["moved"].p_adjusted < 0.05 < got["still"].p_adjusted <= 1
