"""Joint filters against a dense solution, refitted clusters on planted groups, matches against the greedy assignment."""

import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linecraft.operators import dynamic, matching, refit

LAM, DRIFT = 0.1, 0.03


@pytest.fixture(scope="module")
def played():
    rng = np.random.default_rng(2)
    rows = []
    for season in (2001, 2002):
        for week in (1, 2, 4, 5, 9):
            for _ in range(5):
                a, b = rng.choice(6 if week > 2 else 4, 2, replace=False)  # two teams begin in week 4
                for team, opp, home in ((a, b, 1), (b, a, 0)):
                    rows.append((season, week, int(team) * 10, int(opp) * 10, home, float(rng.normal(25 + 3 * team - 2 * opp, 5)), float(rng.integers(1, 4))))
    return pd.DataFrame(rows, columns=["season", "week", "team", "opponent", "home", "y", "w"])


def dense(df, drift):
    """Means at the last week: every week's effects are unknowns of their own, tied to the week before by the drift."""
    teams, weeks = sorted(set(df["team"]) | set(df["opponent"])), sorted(df["week"].unique())
    k, t = len(teams), len(weeks)
    n = 2 + 2 * k * t
    prec, info = np.zeros((n, n)), np.zeros(n)
    prec[0, 0] = prec[1, 1] = dynamic.FLAT
    at = lambda w, i: 2 + 2 * k * w + i
    for i in range(2 * k):
        prec[at(0, i), at(0, i)] += LAM
        for w in range(1, t):
            p = 1 / (drift * (weeks[w] - weeks[w - 1]))
            for u, v, s in ((w, w, p), (w - 1, w - 1, p), (w, w - 1, -p), (w - 1, w, -p)):
                prec[at(u, i), at(v, i)] += s
    for r in df.itertuples():
        x, w = np.zeros(n), weeks.index(r.week)
        x[0], x[1], x[at(w, teams.index(r.team))], x[at(w, k + teams.index(r.opponent))] = 1, r.home, 1, 1
        prec += r.w * np.outer(x, x)
        info += r.w * r.y * x
    mean, var = np.linalg.solve(prec, info), np.diag(np.linalg.inv(prec))
    return {team: (mean[at(t - 1, i)], mean[at(t - 1, k + i)], np.sqrt(var[at(t - 1, i)])) for i, team in enumerate(teams)}, mean[:2]


def test_joint_filter(spark, played):
    rows = spark.createDataFrame(played)
    got = dynamic.ratings(dynamic.last_state(dynamic.joint_filter(rows, "y", "w", LAM, DRIFT))).toPandas()
    for season, mine in played.groupby("season"):
        want, level = dense(mine, DRIFT)
        for r in got[got["season"] == season].itertuples():
            assert [r.attack, r.defence, r.se_attack, r.level, r.home_edge] == pytest.approx([*want[r.team], *level], rel=1e-5, abs=1e-5)
    assert len(got) == 12


def test_joint_filter_goes_on(spark, played):
    """Two calls give what one gives, teams that begin later included; weeks that are in the state do not count again."""
    rows = spark.createDataFrame(played)
    whole = dynamic.ratings(dynamic.joint_filter(rows, "y", "w", LAM, DRIFT)).toPandas()
    early = dynamic.last_state(dynamic.joint_filter(rows.filter("week <= 2"), "y", "w", LAM, DRIFT))
    state = spark.createDataFrame(early.collect(), early.schema)
    assert {len(r.teams) for r in state.collect()} == {4}
    later = dynamic.ratings(dynamic.joint_filter(rows, "y", "w", LAM, DRIFT, state)).toPandas()
    assert sorted(later["week"].unique()) == [4, 5, 9]
    key = ["season", "week", "team"]
    a, b = whole[whole["week"] > 2].set_index(key).sort_index(), later.set_index(key).sort_index()
    np.testing.assert_allclose(a.to_numpy(), b.to_numpy(), rtol=1e-6, atol=1e-6)


def test_no_drift_is_ridge(spark, played):
    mine = played[played["season"] == 2001]
    got = dynamic.ratings(dynamic.last_state(dynamic.joint_filter(spark.createDataFrame(mine), "y", "w", LAM, 0.0))).toPandas().set_index("team")
    teams = sorted(set(mine["team"]))
    x = np.zeros((len(mine), 14))
    for i, r in enumerate(mine.itertuples()):
        x[i, [0, 1]], x[i, 2 + teams.index(r.team)], x[i, 8 + teams.index(r.opponent)] = (1, r.home), 1, 1
    w, prior = mine["w"].to_numpy(), np.diag([dynamic.FLAT] * 2 + [LAM] * 12)
    b = np.linalg.solve(x.T @ (x * w[:, None]) + prior, x.T @ (w * mine["y"].to_numpy()))
    assert got.loc[teams, "attack"].tolist() == pytest.approx(b[2:8], rel=1e-6) and got.loc[teams, "defence"].tolist() == pytest.approx(b[8:], rel=1e-6)
    empty = spark.createDataFrame(mine).limit(0)
    assert dynamic.ratings(dynamic.joint_filter(empty, "y")).count() == 0


def test_refit_names_stay(spark):
    """Three planted groups whose centres wander; units join and leave; names agree at every cutoff."""
    rng = np.random.default_rng(4)
    rows = []
    for unit in range(60):
        for season in range(2000, 2008):
            if rng.random() < 0.85:
                group = unit % 3
                wander = (season - 2000) * 0.4
                rows.append((unit, season, *(rng.normal(c, 0.5) for c in ([0 + wander, 8], [10, 0 - wander], [20 - wander, 9])[group]), float(rng.integers(1, 9)), "x"))
    df = spark.createDataFrame([*rows, (None, 2001, 1.0, 1.0, 1.0, "x"), (99, 2001, None, 1.0, 1.0, "x")], "unit long, season long, a double, b double, games double, cluster string")
    points = refit.profiles(df, "unit", "season", ["a", "b"], "games", 2)
    got, centres = (x.toPandas() for x in refit.refit_clusters(points, "unit", ["a", "b"], 3))
    assert sorted(got["cutoff"].unique()) == list(range(2002, 2008)) and not got.duplicated(["cutoff", "unit"]).any()
    assert set(zip(got["unit"] % 3, got["cluster"], strict=True)) == {(0, 0), (1, 1), (2, 2)}
    assert centres.groupby("cutoff")["size"].sum().to_dict() == got.groupby("cutoff").size().to_dict()
    one = points.filter("cutoff = 2004 AND unit = 7").first()
    mine = [r for r in rows if r[0] == 7 and r[1] < 2004]
    assert one.a == pytest.approx(np.average([r[2] for r in mine], weights=[r[4] for r in mine]))


def test_refit_of_little(spark):
    """Too few different points at a cutoff, equal points, a feature that does not vary, nothing at all."""
    rows = [(2001, u, float(v), 1.0) for u, v in enumerate([1, 1, 5, 5, 9, 9])] + [(2002, u, 3.0, 1.0) for u in range(6)]
    df = spark.createDataFrame(rows, "cutoff long, unit long, a double, b double")
    got, centres = (x.toPandas() for x in refit.refit_clusters(df, "unit", ["a", "b"], 3))
    assert set(got["cutoff"]) == {2001} and got.sort_values("unit")["cluster"].tolist() == [0, 0, 1, 1, 2, 2] and len(centres) == 3
    assert all(x.count() == 0 for x in refit.refit_clusters(df.limit(0), "unit", ["a", "b"], 3))


def test_matching_is_least():
    rng = np.random.default_rng(0)
    for _ in range(20):
        cost = rng.random((5, 5))
        found = refit.matching(cost)
        assert sum(cost[i, j] for i, j in enumerate(found)) == pytest.approx(min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(5))))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, was = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(was[j] + 1, row[-1] + 1, was[j - 1] + (x != y)))
    return row[-1]


def alike(a, b):
    a, b = ("".join(c for c in (x or "").lower() if c.isascii() and c.isalnum()) for x in (a, b))
    if not a or not b:
        return 0.0
    return 1.0 if a == b else 0.9 if a.startswith(b) or b.startswith(a) else 1 - edits(a, b) / max(len(a), len(b))


def test_matches_are_greedy(spark):
    rng = np.random.default_rng(7)
    names = ["Alabama", "Alabma", "Texas A&M", "Texas", "Miami (FL)", "Miami (OH)", "Oho State", "Ohio State", None, "Ohio"]
    rows = {p: [(100 * p + i, 2020, dt.date(2020, 9, 5) + dt.timedelta(int(rng.integers(0, 4))) if rng.random() < 0.95 else None, names[rng.integers(10)], int(rng.integers(1, 3)), names[rng.integers(10)], int(rng.integers(1, 3))) for i in range(70)] for p in (1, 2)}
    schema = "id long, season int, day date, name1 string, points1 int, name2 string, points2 int"
    found = matching.candidates(*(spark.createDataFrame(rows[p], schema) for p in (1, 2)), 1.3)
    pairs = []
    for a, b in itertools.product(rows[1], rows[2]):
        if None not in (a[2], b[2]) and abs((a[2] - b[2]).days) <= 1 and sorted((a[4], a[6])) == sorted((b[4], b[6])):
            score = max(alike(a[3], b[3]) + alike(a[5], b[5]), alike(a[3], b[5]) + alike(a[5], b[3]))
            if score >= 1.3:
                pairs.append((a[0], b[0], score, abs((a[2] - b[2]).days)))
    assert sorted((r[0], r[1], round(r[2], 9), r[3]) for r in found.collect()) == sorted((l, r, round(s, 9), g) for l, r, s, g in pairs)
    got = matching.one_to_one(found).collect()
    left, right, want = set(), set(), set()
    for l, r, s, g in sorted(pairs, key=lambda p: (-round(p[2], 12), p[3], p[0], p[1])):
        if l not in left and r not in right:
            left.add(l)
            right.add(r)
            want.add((l, r))
    assert {(r.left_id, r.right_id) for r in got} == want and max(r["round"] for r in got) > 1
    assert matching.one_to_one(found.limit(0)).count() == 0


def test_query_finds_the_games(spark, sf_dir):
    """Misspelt, swapped and shifted games find their own row."""
    from linecraft.queries import QUERIES

    got = QUERIES["name_matches"](spark, sf_dir).withColumn("right", F.col("right_id") == F.col("left_id") * 2 + 1).agg(F.avg(F.col("right").cast("int")).alias("share"), F.count(F.lit(1)).alias("n")).first()
    assert got.share > 0.97 and got.n > 1000
