"""Searches against enumeration, ensembles and folds against plain fits."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linecraft.operators import search_null as sn
from linecraft.operators import walkforward as wf


def frame(spark, df, kinds):
    return spark.createDataFrame([[None if isinstance(v, float) and np.isnan(v) else v for v in r] for r in df.itertuples(index=False)], kinds)


def test_best_cell_null_is_the_shuffles(spark):
    """Every arrangement of wins inside two strata, against 4,000 draws."""
    picks = [("x", "a", True), ("x", "a", False), ("x", "b", True), ("x", "b", False), ("x", "b", False), ("y", "a", True), ("y", "b", True), ("y", "c", False)]
    df = spark.createDataFrame([*picks, ("x", "a", None)], "era string, cell string, win boolean")
    draws = 4000
    got = sn.best_cell_null(df, ["cell"], "win", ["era"], 2, draws).groupBy("best").count().collect()
    want: dict[float, float] = {}
    xs, ys = [c for e, c, _ in picks if e == "x"], [c for e, c, _ in picks if e == "y"]
    ways = [(w, v) for w in itertools.combinations(range(5), 2) for v in itertools.combinations(range(3), 2)]
    for w, v in ways:
        won = [xs[i] for i in w] + [ys[i] for i in v]
        best = max(won.count(c) / (xs + ys).count(c) for c in "ab")  # c has one pick
        want[best] = want.get(best, 0) + 1 / len(ways)
    assert {round(r.best, 9): r["count"] / draws for r in got} == pytest.approx({round(k, 9): v for k, v in want.items()}, abs=0.03)
    one = sn.permutation_test(df, ["cell"], "win", ["era"], 2, draws).first()
    assert (one.cell, one.n, one.wins, one.draws) == ("a", 3, 2, draws)
    assert one.p == pytest.approx(sum(p for b, p in want.items() if b >= 2 / 3 - 1e-12), abs=0.03)
    assert sn.permutation_test(df, ["cell"], "win", ["era"], 99, 10).count() == 0 and sn.permutation_test(df.limit(0), ["cell"], "win", ["era"], 1, 10).count() == 0


def test_chosen_then_graded(spark):
    rows = [(1, "a", True), (1, "a", True), (1, "b", False), (1, None, True), (2, "a", False), (2, "b", True), (2, "a", True)]
    got = sn.chosen_then_graded(spark.createDataFrame(rows, "s int, cell string, win boolean"), ["cell"], "win", F.col("s") == 1, 1).first()
    assert tuple(got) == ("a", 2, 2, 2, 1)


@pytest.fixture(scope="module")
def seasons():
    rng = np.random.default_rng(8)
    n = 900
    df = pd.DataFrame({"game": range(n), "season": 2000 + np.arange(n) // 150, "mkt": rng.normal(0, 8, n).round(1)})
    df["y"] = 1.1 * df["mkt"] + rng.normal(0, 10, n)
    for j, (noise, have) in enumerate([(2, 0.95), (6, 0.9), (3, 0.7), (1, 0.3)]):
        df[f"m{j}"] = np.where(rng.random(n) < have, 0.5 * df["mkt"] + 0.5 * df["y"] + rng.normal(0, noise, n), np.nan)
    return df


def plain_ensembles(df, models, screen, least_skill, least_fit, ridge):
    """The rules written out over rows, season by season."""
    out = {}
    for s in sorted(df["season"].unique()):
        tr, te = df[df["season"] < s], df[df["season"] == s]
        active = [m for m in models if te[m].notna().mean() >= 0.5]
        skill = {m: ((tr["y"] - tr[m]) ** 2 - (tr["y"] - tr["mkt"]) ** 2).mean() for m in models if tr[m].notna().sum() >= least_skill}
        screened = [m for m in sorted(skill, key=skill.get)[:screen] if m in active] or active[:screen]
        e = pd.DataFrame({"e1": te[active].mean(axis=1), "e2": te[active].median(axis=1), "e3": te[screened].mean(axis=1)})
        cons = tr[screened].mean(axis=1)
        ok = cons.notna()
        e["e4"] = e["r0"] = e["e5"] = np.nan
        if ok.sum() > least_fit:
            x = np.column_stack([np.ones(ok.sum()), tr["mkt"][ok], (cons - tr["mkt"])[ok]])
            b = np.linalg.lstsq(x, tr["y"][ok], rcond=None)[0]
            e["e4"] = b[0] + b[1] * te["mkt"] + b[2] * (e["e3"] - te["mkt"]).fillna(0)
            b = np.linalg.lstsq(x[:, :2], tr["y"][ok], rcond=None)[0]
            e["r0"] = b[0] + b[1] * te["mkt"]
        cols = [m for m in active if tr[m].notna().mean() > 0.8]
        whole = tr[[*cols, "mkt", "y"]].dropna()
        if cols and len(whole) > least_fit:
            x = whole[[*cols, "mkt"]].to_numpy()
            z = x - x.mean(0)
            b = np.linalg.solve(z.T @ z + ridge * np.eye(z.shape[1]), z.T @ (whole["y"] - whole["y"].mean()))
            e["e5"] = te[[*cols, "mkt"]].to_numpy() @ b + whole["y"].mean() - x.mean(0) @ b
        out[s] = e.set_index(te["game"])
    return pd.concat(out.values())


def test_ensembles(spark, seasons):
    models = ["m0", "m1", "m2", "m3"]
    options = {"screen": 2, "least_skill": 60, "least_fit": 100, "ridge": 30.0}
    rows = frame(spark, seasons, "game long, season long, mkt double, y double, m0 double, m1 double, m2 double, m3 double")
    got = wf.ensembles(rows, models, "mkt", "y", **options).toPandas().set_index("game").sort_index()
    want = plain_ensembles(seasons, models, **options).sort_index()
    for e in ("e1", "e2", "e3", "e4", "e5", "r0"):
        assert got[e].notna().sum() > 400
        np.testing.assert_allclose(got[e].astype(float), want[e], rtol=1e-7, atol=1e-7)
    assert wf.ensembles(rows.limit(0), models, "mkt", "y").count() == 0


def test_elastic_net_is_optimal():
    """The conditions of the optimum, and a ridge in closed form."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5)) * [1, 5, 0.2, 1, 1] + 3
    x[:, 4] = x[:, 3] + rng.normal(size=300) * 0.1
    y = x @ [1, 0, 4, 0.5, 0] + rng.normal(size=300)
    m = np.column_stack([np.ones(300), x, y])
    for alpha, share in ((0.3, 0.5), (0.5, 1.0), (2.0, 0.0)):
        b, a, mean, scale = wf.elastic_net_from(m.T @ m, alpha, share)
        z = (x - mean) / scale
        pull = z.T @ (y - a - z @ b) / 300 - alpha * (1 - share) * b
        assert np.abs(pull[b == 0]).max(initial=0) <= alpha * share + 1e-8
        assert pull[b != 0] == pytest.approx(np.sign(b[b != 0]) * alpha * share, abs=1e-7)
    assert b == pytest.approx(np.linalg.solve(z.T @ z / 300 + 2 * np.eye(5), z.T @ (y - y.mean()) / 300), abs=1e-7)


def fold(key, folds, seed):
    import hashlib

    return int(hashlib.md5(f"{key}:{seed}".encode()).hexdigest()[:7], 16) % folds


def test_net_bakeoff(spark, seasons):
    rows = frame(spark, seasons, "game long, season long, mkt double, y double, m0 double, m1 double, m2 double, m3 double")
    specs = {"one": (["m0"], 0.0, 0.0), "all": (["m0", "m1", "mkt"], 0.4, 0.5)}
    got = wf.net_bakeoff(rows, "game", "y", specs, 3, 5).toPandas().set_index(["spec", "fold"])
    at = np.array([fold(g, 3, 5) for g in seasons["game"]])
    for (spec, f), r in got.iterrows():
        names, alpha, share = specs[spec]
        x, y = seasons[names], seasons["y"].to_numpy()
        x = x.fillna(x[at != f].median()).to_numpy()
        m = np.column_stack([np.ones(len(x)), x, y])[at != f]
        b, a, mean, scale = wf.elastic_net_from(m.T @ m, alpha, share)
        e = a + (x[at == f] - mean) / scale @ b - y[at == f]
        assert (r["n"], r["n_train"], r["kept"]) == ((at == f).sum(), (at != f).sum(), (b != 0).sum())
        assert [r["mae"], r["rmse"], r["bias"]] == pytest.approx([np.abs(e).mean(), np.sqrt((e * e).mean()), e.mean()], abs=1e-9)
    assert len(got) == 6 and wf.net_bakeoff(rows.limit(0), "game", "y", specs).count() == 0


def test_probit_bakeoff(spark, seasons):
    """Against scoring steps over plain arrays."""
    rows = frame(spark, seasons, "game long, season long, mkt double, y double, m0 double, m1 double, m2 double, m3 double").withColumn("hit", F.col("y") > 3)
    got = wf.probit_bakeoff(rows, "game", "hit", {"one": ["m0"], "two": ["m0", "mkt"]}, 3, 5, 0.6).toPandas().set_index(["spec", "fold"])
    whole = seasons[["game", "y", "m0", "mkt"]].dropna()
    at, y = np.array([fold(g, 3, 5) for g in whole["game"]]), (whole["y"] > 3).to_numpy(float)
    for spec, names in (("one", ["m0"]), ("two", ["m0", "mkt"])):
        for f in range(3):
            x = whole[names].to_numpy()
            x = np.column_stack([np.ones(len(x)), (x - x[at != f].mean(0)) / x[at != f].std(0)])
            b = np.zeros(x.shape[1])
            for _ in range(30):
                z = x[at != f] @ b
                p, d = np.clip(wf._phi(z), 1e-9, 1 - 1e-9), np.exp(-z * z / 2) / np.sqrt(2 * np.pi)
                w = d * d / (p * (1 - p))
                b = b + np.linalg.solve((x[at != f] * w[:, None]).T @ x[at != f], x[at != f].T @ ((y[at != f] - p) * d / (p * (1 - p))))
            p, t = wf._phi(x[at == f] @ b), y[at == f]
            on, p = p > 0.6, np.clip(p, 1e-6, 1 - 1e-6)  # the loss is taken of clipped forecasts
            r = got.loc[(spec, f)]
            assert (r["n"], r["bets"], r["wins"]) == (len(t), on.sum(), t[on].sum())
            assert r["log_loss"] == pytest.approx(-(t[on] * np.log(p[on]) + (1 - t[on]) * np.log(1 - p[on])).mean(), abs=1e-8)
    assert wf.probit_bakeoff(rows.limit(0), "game", "hit", {"one": ["m0"]}).count() == 0
