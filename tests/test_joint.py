"""Joint outcomes against every pair of residuals, censored fits against the likelihood, correlated totals against sums."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linecraft.operators import joint

COLUMNS = "game long, season long, segment string, h int, a int, ot int, mh double, ma double"


@pytest.fixture(scope="module")
def played():
    rng = np.random.default_rng(12)
    rows = []
    for g in range(240):
        h, a = (int(x) for x in rng.integers(0, 25, 2))
        a = h if g % 9 == 0 else a
        mh, ma = (float(x) / 4 for x in rng.integers(0, 90, 2))
        rows.append((g, 2000 + g // 48, "early" if g % 5 == 0 else "primary", h, a, int(rng.integers(0, 9)) if h == a and g > 60 else None, mh, ma))
    rows += [(900, 2003, "primary", None, None, None, 10.0, 12.25), (901, 2003, "primary", 3, 3, None, None, 2.0), (902, 2004, None, 3, 7, None, 5.0, 2.0)]
    return rows


def plain(rows, season, segment, mh, ma, window, top):
    """pmf, share of home wins and of ties from every pair of residuals and every overtime."""
    done = [r for r in rows if None not in (r[3], r[4], r[6], r[7])]
    last = sorted({r[1] for r in done if r[1] < season})[-window:]
    pool = [(r[3] - r[6], r[4] - r[7]) for r in done if r[1] in last and r[2] == segment]
    with_ot = sorted({r[1] for r in rows if r[5] is not None and r[1] < season})[-window:]
    ots = [r[5] for r in rows if r[5] is not None and r[1] in with_ot] or [0]
    pmf, home, tie = np.zeros(top + 1), 0.0, 0.0
    for eh, ea in pool:
        h, a = max(math.floor(mh + eh + 0.5), 0), max(math.floor(ma + ea + 0.5), 0)
        home += (h > a) + 0.5 * (h == a)
        tie += h == a
        for o in ots if h == a else [0]:
            pmf[min(h + a + o, top)] += 1 / len(pool) / (len(ots) if h == a else 1)
    return (pmf, home / len(pool), tie / len(pool)) if pool else None


@pytest.mark.parametrize("top", [80, 30])
def test_joint_totals(spark, played, top):
    df = spark.createDataFrame(played, COLUMNS)
    pmf, sides = joint.joint_totals(df, "season", "segment", "h", "a", "ot", "mh", "ma", 2, top)
    long, chances = pmf.toPandas(), sides.toPandas().set_index(["season", "segment", "mh", "ma"])
    groups = dict(list(long.groupby(["season", "segment", "mh", "ma"])))
    wanted = {(r[1], r[2], round(r[6] * 4), round(r[7] * 4)) for r in played if r[2] and r[6] is not None and r[7] is not None and r[1] > 2000}
    assert set(groups) == wanted
    for (s, seg, mh, ma), got in groups.items():
        want, home, tie = plain(played, s, seg, mh / 4, ma / 4, 2, top)
        got = got.sort_values("k")
        cdf = np.cumsum(want)
        np.testing.assert_allclose(got["p"], want, atol=1e-12)
        np.testing.assert_allclose(got["crps"], [((cdf - (np.arange(top + 1) >= y)) ** 2).sum() for y in range(top + 1)], atol=1e-9)
        np.testing.assert_allclose(got["pit"], cdf - want / 2, atol=1e-12)
        assert chances.loc[(s, seg, mh, ma), ["home_win", "p_tie", "mean"]].tolist() == pytest.approx([home, tie, want @ np.arange(top + 1)])


def test_joint_totals_of_nothing(spark, played):
    pmf, sides = joint.joint_totals(spark.createDataFrame(played, COLUMNS).limit(0), "season", "segment", "h", "a", "ot", "mh", "ma")
    assert pmf.count() == 0 and sides.count() == 0


def cdf(z):
    return 0.5 * math.erfc(-z / math.sqrt(2))


def test_mills(spark):
    a = [-30.0, -3.0, 0.0, 1.49, 1.51, 4.0, 30.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in a], "a double").select(joint.mills(F.col("a"))).collect()]
    want = [math.exp(-x * x / 2) / math.sqrt(2 * math.pi) / cdf(-x) if x < 20 else x + 1 / (x + 2 / (x + 3 / x)) for x in a]
    assert got == pytest.approx(want, rel=3e-6, abs=1e-12)


def test_censored_fit(spark):
    """The likelihood's slope is zero at the fit, and the errors are those of the scores' outer products."""
    rng = np.random.default_rng(6)
    x = rng.normal(10, 5, 1500)
    y = np.maximum(-4 + 0.9 * x + rng.normal(0, 6, 1500), 2)
    df = pd.DataFrame({"g": np.repeat([1, 2], 750), "x": x, "y": y})
    rows = spark.createDataFrame([*df.itertuples(index=False, name=None), (3, 1.0, 2.0), (3, 4.0, 1.0), (4, None, 3.0), (None, 1.0, 5.0)], "g long, x double, y double")
    got = joint.censored_fit(rows, "x", "y", ["g"], 2.0).toPandas().set_index("g")
    assert sorted(got.index) == [1, 2]
    for g, part in df.groupby("g"):
        x, y, f = part["x"].to_numpy(), part["y"].to_numpy(), got.loc[g]
        mu, cut = f["alpha"] + f["beta"] * x, y <= 2
        z, a = (y - mu) / f["sigma"], (mu - 2) / f["sigma"]
        lam = np.array([math.exp(-v * v / 2) / math.sqrt(2 * math.pi) / cdf(-v) for v in a])
        dmu, dls = np.where(cut, -lam, z) / f["sigma"], np.where(cut, a * lam, z * z - 1)
        scores = np.column_stack([dmu, dmu * x, dls])
        assert np.abs(scores.sum(0)).max() < 0.02 and (f["n"], f["n_censored"]) == (750, cut.sum())
        se = np.sqrt(np.diag(np.linalg.inv(scores.T @ scores)))
        assert [f["se_alpha"], f["se_beta"], f["se_sigma"] / f["sigma"]] == pytest.approx(se, rel=1e-3)
        assert abs(f["beta"] - 0.9) < 4 * f["se_beta"] and abs(f["sigma"] - 6) < 4 * f["se_sigma"]
    assert joint.censored_fit(rows.limit(0), "x", "y", ["g"]).count() == 0


def test_correlated_over(spark):
    """Against a fine grid over both latent scores; without correlation and with nearly full correlation."""
    cases = [(10.0, 14.0, 9.0, 8.0, 0.0, 24.0), (3.0, 5.0, 9.0, 8.0, -0.4, 10.0), (3.0, 5.0, 9.0, 8.0, 0.6, 0.0), (20.0, 2.0, 7.0, 9.0, 0.97, 30.5), (40.0, 40.0, 5.0, 5.0, 0.1, 1.0)]
    names = ["ma", "mb", "sa", "sb", "rho", "line"]
    got = [r[0] for r in spark.createDataFrame(cases, ", ".join(f"{n} double" for n in names)).select(joint.correlated_over(*(F.col(n) for n in names))).collect()]
    z = (np.arange(4000) + 0.5) / 4000 * 18 - 9
    w = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * 18 / 4000
    for value, (ma, mb, sa, sb, rho, line) in zip(got, cases, strict=True):
        need = line - np.maximum(ma + sa * z, 0)
        p = np.where(need < 0, 1.0, [cdf((mb + rho * sb * v - n) / (sb * math.sqrt(1 - rho * rho))) for v, n in zip(z, need, strict=True)])
        assert value == pytest.approx(float(w @ p), abs=2e-4)
    low = spark.range(1).select(joint.correlated_over(*(F.lit(v) for v in (1.0, 1.0, 1.0, 1.0, 0.0, -1.0)))).first()[0]
    assert low is None


def test_error_correlation(spark):
    rows = spark.createDataFrame([(1, 5.0, 7.0), (1, 9.0, 3.0), (1, 0.0, 20.0), (1, 4.0, 9.0), (2, 0.0, 0.0)], "g int, a double, b double")
    got = {r.g: (r.rho, r.n) for r in joint.error_correlation(rows, "a", F.lit(1.0), "b", F.lit(2.0), ["g"]).collect()}
    assert got == {1: (pytest.approx(np.corrcoef([5, 9, 4], [7, 3, 9])[0, 1]), 3)}
