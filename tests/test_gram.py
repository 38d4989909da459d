"""Special functions against closed forms and sums; regressions against dense matrices."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linecraft.functions import special
from linecraft.operators import gram


def column(spark, values, **functions):
    rows = spark.createDataFrame(values)
    return rows.select(*(f.alias(n) for n, f in functions.items())).toPandas()


def test_log_gamma(spark):
    x = [0.5, 1.0, 2.5, 10.0, 171.3, 5e5]
    got = column(spark, [{"x": v} for v in x], y=special.log_gamma(F.col("x")))["y"]
    assert got.tolist() == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-12)


def test_beta(spark):
    """Integer a and b: a binomial tail; both ends; large arguments; symmetry."""
    rows = [{"a": float(a), "b": float(b), "x": x} for a, b, x in [(1, 1, 0.3), (3, 2, 0.5), (20, 5, 0.9), (2, 30, 0.01), (400, 600, 0.41), (1, 1, 0.0), (2, 2, 1.0), (7, 7, 0.5)]]
    got = column(spark, rows, y=special.beta_inc(F.col("a"), F.col("b"), F.col("x")))["y"]
    for r, y in zip(rows, got, strict=True):
        a, n = int(r["a"]), int(r["a"] + r["b"] - 1)
        assert y == pytest.approx(sum(math.comb(n, k) * r["x"] ** k * (1 - r["x"]) ** (n - k) for k in range(a, n + 1)), abs=1e-11)
    half = column(spark, [{"x": x} for x in (0.1, 0.5, 0.99)], y=special.beta_inc(F.lit(0.5), F.lit(0.5), F.col("x")))["y"]
    assert half.tolist() == pytest.approx([2 / math.pi * math.asin(math.sqrt(x)) for x in (0.1, 0.5, 0.99)], abs=1e-11)


def test_tails(spark):
    got = column(spark, [{"x": x} for x in (0.0, 0.7, 5.0, 60.0)], c1=special.chi2_tail(F.col("x"), F.lit(1)), c2=special.chi2_tail(F.col("x"), F.lit(2)), c39=special.chi2_tail(F.col("x"), F.lit(39)), f=special.f_tail(F.col("x"), F.lit(2), F.lit(100)), t1=special.t_tails(F.col("x"), F.lit(1)))
    for k, x in enumerate((0.0, 0.7, 5.0, 60.0)):
        assert got["c1"][k] == pytest.approx(math.erfc(math.sqrt(x / 2)), abs=1e-12)
        assert got["c2"][k] == pytest.approx(math.exp(-x / 2), abs=1e-12)
        assert got["f"][k] == pytest.approx((1 + 2 * x / 100) ** -50, abs=1e-12)
        assert got["t1"][k] == pytest.approx(1 - 2 / math.pi * math.atan(x), abs=1e-11)
    odd = lambda x, k: math.erfc(math.sqrt(x / 2)) + sum(math.exp(-x / 2 + (j - 0.5) * math.log(x / 2) - math.lgamma(j + 0.5)) for j in range(1, (k + 1) // 2))
    assert got["c39"].tolist() == pytest.approx([1.0, *(odd(x, 39) for x in (0.7, 5.0, 60.0))], abs=1e-11)
    big = sum(math.exp(math.lgamma(100_001) - math.lgamma(k + 1) - math.lgamma(100_001 - k) - 100_000 * math.log(2)) for k in range(50_500, 53_000))
    many = column(spark, [{"k": k, "n": n} for k, n in ((0, 5), (5, 5), (6, 5), (60, 100), (50_500, 100_000))], y=special.binomial_upper(F.col("k"), F.col("n"), F.lit(0.5)))["y"]
    assert many.tolist() == pytest.approx([1.0, 1 / 32, 0.0, sum(math.comb(100, k) for k in range(60, 101)) / 2**100, big], abs=1e-10)


def test_sql_forms(spark, duck):
    for x in (0.2, 0.9, 3.0):
        want = column(spark, [{"x": x}], f=special.f_tail(F.col("x"), F.lit(5), F.lit(37)), c=special.chi2_tail(F.col("x") * 9, F.lit(11)))
        got = duck.execute(f"SELECT {special.f_tail_sql(str(x), '5', '37')}, {special.chi2_tail_sql(str(x * 9), '11')}").fetchone()
        assert list(got) == pytest.approx([want["f"][0], want["c"][0]], abs=1e-10)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    n = 600
    x = rng.normal(size=(n, 3)) + np.arange(3)
    y = 2 + x @ [1.0, -0.5, 0.0] + rng.normal(size=n) * 2
    df = pd.DataFrame({"g": rng.integers(0, 3, n), "c": rng.integers(0, 25, n), "a": x[:, 0], "b": x[:, 1], "d": x[:, 2], "y": y})
    df.loc[rng.choice(n, 20, replace=False), "b"] = np.nan
    return df


def frame(spark, df):
    return spark.createDataFrame(df.astype(object).where(df.notna(), None).values.tolist(), ", ".join(f"{c} {'long' if c in 'gc' else 'double'}" for c in df.columns))


def dense(df, columns, intercept=True):
    x = np.column_stack([*([np.ones(len(df))] if intercept else []), df[columns].to_numpy(float)])
    b = np.linalg.lstsq(x, df["y"], rcond=None)[0]
    return x, b, df["y"].to_numpy() - x @ b


@pytest.mark.parametrize("generated", [gram.GENERATED, 0])
@pytest.mark.parametrize("intercept", [True, False])
def test_regress(spark, data, monkeypatch, generated, intercept):
    monkeypatch.setattr(gram, "GENERATED", generated)
    test = {"two": [({"b": 1}, 0), ({"a": 1, "d": 1}, 1)]}
    got = gram.regress(frame(spark, data), "y", ["a", "b", "d"], ["g"], test, ["c"], intercept).toPandas().set_index("g")
    assert sorted(got.index) == [0, 1, 2]
    for g, rows in data.dropna().groupby("g"):
        x, b, e = dense(rows, ["a", "b", "d"], intercept)
        n, k = x.shape
        inverse, s2 = np.linalg.inv(x.T @ x), e @ e / (n - k)
        scores = np.array([x[m].T @ e[m] for m in (rows["c"].to_numpy() == c for c in rows["c"].unique())])
        robust = len(scores) / (len(scores) - 1) * (n - 1) / (n - k) * inverse @ scores.T @ scores @ inverse
        r = np.zeros((2, k))
        r[0, -2], r[1, -3], r[1, -1] = 1, 1, 1
        d = r @ b - [0, 1]
        r_ = got.loc[g]
        assert (r_["n"], r_["clusters"]) == (n, len(scores))
        for i, c in enumerate(["intercept", "a", "b", "d"][not intercept :]):
            assert [r_[f"coef_{c}"], r_[f"se_{c}"], r_[f"cluster_se_{c}"]] == pytest.approx([b[i], math.sqrt(s2 * inverse[i, i]), math.sqrt(robust[i, i])], rel=1e-8)
        f, fc = (d @ np.linalg.inv(r @ v @ r.T) @ d / 2 for v in (s2 * inverse, robust))
        assert [r_["f_two"], r_["cluster_f_two"], r_["sigma"]] == pytest.approx([f, fc, math.sqrt(s2)], rel=1e-7)
        assert [r_["p_two"], r_["cluster_p_two"]] == pytest.approx([(1 + 2 * f / (n - k)) ** (-(n - k) / 2), (1 + 2 * fc / (len(scores) - 1)) ** (-(len(scores) - 1) / 2)], abs=1e-10)


def test_chow(spark, data):
    got = gram.chow(frame(spark, data), ["a", "b"], "y", F.col("c") < 12, ["g"]).toPandas().set_index("g")
    for g, rows in data.dropna().groupby("g"):
        rss = [dense(r, ["a", "b"])[2] for r in (rows, rows[rows["c"] < 12], rows[rows["c"] >= 12])]
        whole, one, two = (e @ e for e in rss)
        f = (whole - one - two) / 3 / ((one + two) / (len(rows) - 6))
        assert got.loc[g, "f"] == pytest.approx(f, rel=1e-8) and 0 < got.loc[g, "p"] < 1


def test_small_and_empty_groups(spark):
    rows = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 3.0), (2, 1.0, 1.0), (None, 1.0, 5.0), (None, 2.0, 4.0), (None, 4.0, 4.5)], "g int, x double, y double")
    got = {r.g: r for r in gram.regress(rows, "y", ["x"], ["g"], {"t": [({"x": 1}, 0)]}, ["g"]).collect()}
    assert got[1].coef_x is None and got[2].n == 1 and got[None].n == 3 and got[None].coef_x is not None
    assert gram.regress(rows.limit(0), "y", ["x"], ["g"]).count() == 0 and gram.chow(rows.limit(0), ["x"], "y", F.col("x") > 1, ["g"]).count() == 0
