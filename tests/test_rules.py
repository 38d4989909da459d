"""Operators held to their rules by numbers worked out by hand or by plain versions."""

import datetime as dt
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linecraft.functions import names
from linecraft.operators import market, pace, ratings, rollups, testing


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_decision_time_goes_back_a_week_from_a_sunday(spark):
    """2024-09-08 is a Sunday: its games, early and late, decide a week before; Monday and Saturday on the Sunday before."""
    at = lambda *x: F.lit(dt.datetime(2024, 9, *x)).cast("timestamp_ntz")
    got = one(spark, *(names.decision_time(at(*x)).alias(str(i)) for i, x in enumerate([(8, 11), (8, 20), (9, 19), (14, 12)])))
    assert list(got) == [dt.datetime(2024, 9, 1, 12), dt.datetime(2024, 9, 1, 12), dt.datetime(2024, 9, 8, 12), dt.datetime(2024, 9, 8, 12)]


def shop(spark, lines, **options):
    rows = spark.createDataFrame([(1, b, float(x), float(p)) for b, x, p in lines], "game int, book string, line double, price double")
    found = rollups.shop(rows, "game", 2.5, **options).collect()
    return found[0] if found else None


def test_best_number(spark):
    r = shop(spark, [("A", 55.5, -110), ("B", 56.5, -110)])
    assert (r.fair, r.line, r.book, r.range, r.playable) == (56.5, 55.5, "A", 1.0, True)  # the higher middle, a posted number
    r = shop(spark, [("A", 50, -110), ("B", 50.5, -110), ("C", 55, -110)])
    assert (r.books, r.fair, r.line) == (2, 50.5, 50.0)  # C is far from the median of all
    r = shop(spark, [("A", 40, -110), ("B", 50, -110), ("C", 60, -110)])
    assert r.books == 3 and r.fair == 50.0  # one would stay: nobody goes
    r = shop(spark, [("A", 50, -125), ("B", 50.5, -115), ("C", 50.5, -105), ("D", 51, 100)])
    assert (r.line, r.book, r.price) == (50.5, "C", -105.0)  # A's price is below the limit, C pays better than B
    r = shop(spark, [("A", 50, -130), ("B", 50.5, -125)])
    assert (r.line, r.book, r.playable) == (50.0, "A", False)
    assert shop(spark, [("A", 50, -110)]) is None and shop(spark, [("A", 50, -110)], books=1).fair == 50.0


def test_bet_to_over(spark):
    """Against a search over all half points, strictly above the threshold."""
    cdf = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
    lift = lambda m, s: m * cdf(m / s) + s * math.exp(-m * m / s / s / 2) / math.sqrt(2 * math.pi) - m
    for spread, threshold in itertools.product((0.0, -7.5, 21.0), (0.3, 1.75, 20.0)):
        fits = [k / 2 for k in range(800) if lift((k / 2 - abs(spread)) / 2, 12) + lift((k / 2 + abs(spread)) / 2, 11) > threshold]
        got = one(spark, market.bet_to_over(F.lit(spread), F.lit(12.0), F.lit(11.0), threshold))[0]
        assert got == (max(fits) if fits else None)
    with pytest.raises(ValueError):
        market.bet_to_over(F.lit(1.0), F.lit(1.0), F.lit(1.0), 0.0)


PLAY = "game_id int, season int, week int, drive int, number int, play_id int, type string, offense string, defense string, period int, secs int, wall timestamp, margin int, gained int, distance int"


def play(game, drive, number, kind, secs, offense="A", period=1, wall=0, margin=0, gained=2, week=1, season=2024):
    stamp = None if wall is None else dt.datetime(2024, 9, 1) + dt.timedelta(seconds=wall)
    return (game, season, week, drive, number, number, kind, offense, "B" if offense == "A" else "A", period, secs, stamp, margin, gained, 10)


def test_clock_quality(spark):
    """Only a rush with a scrimmage snap of the same side after it, in the drive and period, is a pair; unknown wall clocks are stale."""
    rows = [play(1, 1, 1, "Rush", 900, wall=0), play(1, 1, 2, "Rush", 870, wall=30), play(1, 1, 3, "Punt", 840, wall=60), play(1, 2, 1, "Pass Reception", 800), play(1, 2, 2, "Rush", 760, wall=None), play(1, 2, 3, "Sack", 760, wall=9)]
    rows += [play(1, 3, 1, "Rush", 20), play(1, 3, 2, "Rush", 900, period=2), play(1, 4, 1, "Rush", 500), play(1, 4, 2, "Sack", 480, offense="B"), play(1, 5, 1, "Rush", 100, period=5), play(1, 5, 2, "Rush", 90, period=5)]
    rows += [play(2, 6, k, "Rush", 900 - 25 * k, wall=25 * k) for k in range(12)] + [play(3, 7, 1, "Punt", 1)]
    got = {r.game_id: r for r in pace.clock_quality(spark.createDataFrame(rows, PLAY).repartition(4)).collect()}
    assert sorted(got) == [1, 2]
    assert (got[1].rush_pairs, got[1].clock_stale_share, got[1].wallclock_stale_share, got[1].clock_ok) == (2, 0.5, 0.5, False)
    assert (got[2].rush_pairs, got[2].clock_ok, got[2].wallclock_ok) == (11, True, True)


def test_tempo(spark):
    """Medians, hurries against the season's quartile, the change when trailing; too few pairs give nothing; first downs stop the clock."""
    rng = np.random.default_rng(3)
    rows, drive, want = [], 0, {}
    for team, n, base in (("A", 40, 30), ("C", 10, 25)):
        spent = [int(x) for x in rng.integers(base - 8, base + 8, n)]
        want[team] = spent
        for x in spent:
            drive += 1
            rows += [play(drive % 4, drive, 1, "Rush", 600, team), play(drive % 4, drive, 2, "Sack", 600 - x, team)]
    for x in (40,) * 20:
        drive += 1
        rows += [play(1, drive, 1, "Rush", 600, margin=-20), play(1, drive, 2, "Sack", 600 - x, margin=-20)]
    drive += 1
    rows += [play(1, drive, 1, "Rush", 600, gained=15), play(1, drive, 2, "Sack", 100)]
    got = {r.team: r for r in pace.tempo(pace.running_pairs(spark.createDataFrame(rows, PLAY))).collect()}
    fast = np.quantile(want["A"] + want["C"], 0.25)
    assert (got["A"].tempo_s, got["A"].n_neutral, got["A"].trail_delta_s, got["A"].n_trail) == (np.median(want["A"]), 40, 40 - np.median(want["A"]), 20)
    assert got["A"].hurry_rate == pytest.approx(np.mean(np.array(want["A"]) <= fast)) and got["C"].tempo_s is None and got["C"].n_neutral == 10
    assert got["B"].tempo_faced_s == np.median(want["A"]) and got["A"].n_faced == 10


def test_move_decay(spark):
    kick = dt.datetime(2024, 9, 7)
    ticks = [(1, 1, -3.0, 200), (1, 2, -4.0, 30), (1, 3, -7.0, 2), (1, 4, -9.0, -1), (2, 1, 1.0, 50), (2, 2, 1.5, 1), (3, 1, 4.0, 30), (3, 2, 2.0, 20), (3, 3, 2.0, 0.5), (3, 4, None, 10)]
    rows = spark.createDataFrame([(e, t, x, kick - dt.timedelta(hours=h), kick) for e, t, x, h in ticks], "event int, tick int, line double, at timestamp, kick timestamp")
    got = {(r.event, r.hours): r.done for r in rollups.move_decay(rows, "event", "line", "at", "tick", "kick", (168, 24, 1)).collect()}
    assert got == {(1, 168): 0.0, (1, 24): 0.25, (1, 1): 1.0, (3, 24): 0.0, (3, 1): 1.0}  # event 2 moved half a point; 3 opened late


def test_remaining_points(spark):
    """Minutes from period and clock, overtime at none, junk clocks out, tails from both ends, shares that add up."""
    row = lambda period, minute, second, so_far, final, n: [(period, minute, second, so_far, final, 60.0)] * n
    rows = row(2, 0, 0, 10, 40, 50) + row(2, 0, 0, 10, 30, 49) + row(2, 0, 0, 10, 11, 1) + row(1, 58, 0, 0, 40, 30) + row(0, 3, 0, 0, 40, 30) + row(4, 1, 30, 30, 29, 30) + row(5, 0, 0, 30, 33, 100) + row(4, 1, 30, 30, 37, 99)
    got = rollups.remaining_points(spark.createDataFrame(rows, "period int, clock_min int, clock_sec int, points int, final_total int, pregame_total double"), tail=0.02).toPandas()
    cells = {k: g.set_index("rem")["p"].to_dict() for k, g in got.groupby(["tb", "eb"])}
    # 30 minutes left: the lone start is a tail; none left: overtime and the last minute and a half
    assert cells == {(8, 3): {20: pytest.approx(49 / 99), 30: pytest.approx(50 / 99)}, (0, 0): {3: pytest.approx(100 / 199), 7: pytest.approx(99 / 199)}}
    got = rollups.remaining_points(spark.createDataFrame(rows + row(5, 0, 0, 30, 36, 1) , "period int, clock_min int, clock_sec int, points int, final_total int, pregame_total double"), least=50, tail=0.0).toPandas()
    assert set(zip(got["tb"], got["eb"], strict=True)) == {(8, 3), (0, 0)} and got.groupby(["tb", "eb"])["p"].sum().tolist() == pytest.approx([1, 1])
    assert got[(got["tb"] == 0)]["n"].sum() == 200 and got[got["tb"] == 0]["mean"].iloc[0] == pytest.approx((3 * 100 + 7 * 99 + 6) / 200)


def plain_wild(d, clusters):
    """Mean, t and p with every sign pattern, as residual by residual."""
    names_, idx = np.unique(clusters, return_inverse=True)
    g, n = len(names_), len(d)
    se = lambda x: np.sqrt(g / (g - 1) * (np.bincount(idx, x - x.mean(), g) ** 2).sum()) / n
    t, ts = d.mean() / se(d), []
    for signs in itertools.product((-1.0, 1.0), repeat=g):
        star = (d - d.mean()) * np.array(signs)[idx]
        ts.append(star.mean() / se(star) if se(star) > 1e-12 else 0.0)
    lo, hi = np.quantile(ts, [0.025, 0.975])
    return d.mean(), t, (np.abs(ts) >= abs(t) - 1e-9).mean(), d.mean() - hi * se(d), d.mean() - lo * se(d)


def test_wild_mean(spark):
    rng = np.random.default_rng(9)
    df = pd.DataFrame({"g": np.repeat([1, 2, 3], [60, 80, 20]), "c": np.r_[rng.integers(0, 7, 60), rng.integers(0, 9, 80), rng.integers(0, 3, 20)], "x": rng.normal(0.3, 1, 160)})
    got = testing.wild_mean(spark.createDataFrame(df), "x", ["c"], ["g"]).toPandas().set_index("g")
    for g in (1, 2):
        own = df[df["g"] == g]
        assert got.loc[g, ["mean", "t", "p", "low", "high"]].astype(float).tolist() == pytest.approx(plain_wild(own["x"].to_numpy(), own["c"].to_numpy()), rel=1e-9)
    assert got.loc[3, "mean"] == pytest.approx(df[df["g"] == 3]["x"].mean()) and math.isnan(got.loc[3, "p"]) and math.isnan(got.loc[3, "low"])
    whole = testing.wild_mean(spark.createDataFrame(df), "x", ["c"], [], enumerated=4, draws=3000).first()
    assert whole.clusters == 9 and whole.p == pytest.approx(plain_wild(df["x"].to_numpy(), df["c"].to_numpy())[2], abs=0.05)
    assert testing.wild_mean(spark.createDataFrame(df).limit(0), "x", ["c"], ["g"]).count() == 0


def test_clark_west_is_one_sided(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(0, 1, 240)
    df = pd.DataFrame({"g": 1, "c": np.arange(240) % 8, "y": y, "small": 0.0, "large": 0.8 * y + rng.normal(0, 0.3, 240)})
    good = testing.clark_west(spark.createDataFrame(df), "y", "small", "large", ["c"], ["g"]).first()
    bad = testing.clark_west(spark.createDataFrame(df.assign(large=-df["large"])), "y", "small", "large", ["c"], ["g"]).first()
    assert good.mean > 0 and good.p < 0.01 and bad.mean < 0 and bad.p > 0.99


def test_shrinkage_by_noise_and_signal(spark):
    rng = np.random.default_rng(5)
    n = rng.integers(5, 60, 40)
    df = pd.DataFrame({"s": np.repeat([1, 2], 20), "n": n, "k": rng.binomial(n, np.repeat([0.5, 0.5], 20)) * 1.0})
    df.loc[20:, "k"] = df["n"][20:] * rng.uniform(0.1, 0.9, 20)
    got = rollups.shrink(spark.createDataFrame(df), "k", "n", ["s"]).toPandas()
    assert list(got.columns) == ["s", "n", "k", "shrink_weight", "group_rate", "shrunk"]
    for _, g in got.groupby("s"):
        m, rate = g["n"].to_numpy(float), (g["k"] / g["n"]).to_numpy()
        mu = np.average(rate, weights=m)
        s2 = np.average((rate - mu) ** 2 * m, weights=m)
        signal = max(np.average((rate - mu) ** 2, weights=m) - s2 / m.mean(), 1e-9)
        w = m / (m + s2 / signal)
        np.testing.assert_allclose(g["shrunk"], mu + w * (rate - mu), rtol=1e-9)


def test_carry_over_with_returning_production(spark):
    """Coefficients and errors clustered by unit against dense sums; imputed units; centred priors."""
    rng = np.random.default_rng(7)
    rows = [(u, s, float(rng.normal(0, 5)), None if (u + s) % 7 == 0 else float(rng.uniform(0, 1))) for u in range(12) for s in range(2000, 2006) if (u, s) != (3, 2004)]
    df = pd.DataFrame(rows, columns=["u", "s", "x", "rp"])
    got = ratings.carry_over(spark.createDataFrame(rows, "u long, s long, x double, rp double"), "u", "s", "x", "rp").toPandas()
    df["c"] = df["x"] - df.groupby("s")["x"].transform("mean")
    pairs = df.assign(s=df["s"] + 1).merge(df, on=["u", "s"], suffixes=("_was", "")).dropna(subset=["rp"])
    x = np.column_stack([pairs["c_was"], pairs["rp"] * pairs["c_was"]])
    inv = np.linalg.inv(x.T @ x)
    b = inv @ x.T @ pairs["c"]
    scores = np.array([x[pairs["u"] == u].T @ (pairs["c"].to_numpy() - x @ b)[pairs["u"] == u] for u in pairs["u"].unique()])
    se = np.sqrt(np.diag(inv @ scores.T @ scores @ inv))
    assert got[["b", "c", "se_b", "se_c"]].iloc[0].tolist() == pytest.approx([*b, *se], rel=1e-9)
    season = got[got["s"] == 2003].set_index("u")
    held = df[df["s"] == 2003].set_index("u")["rp"]
    raw = {u: (b[0] + b[1] * (held.mean() if pd.isna(held[u]) else held[u])) * float(df[(df["u"] == u) & (df["s"] == 2002)]["c"].iloc[0]) for u in season.index}
    mean = np.mean(list(raw.values()))
    assert {u: season.loc[u, "prior"] for u in season.index} == {u: pytest.approx(v - mean) for u, v in raw.items()}
    assert (season["source"] == "imputed").sum() == sum((u + 2003) % 7 == 0 for u in season.index)


def test_grades(spark):
    """Five scores and their bands, from records whose parts are worked out one by one."""
    from linecraft.operators import grades
    from linecraft.operators.systems import FeatureFilter, SystemFilter

    def bets(name, seasons):
        return [(name, 2000 + s, r, {"W": 90.9091, "L": -100.0, "P": 0.0}[r]) for s, (w, l, p) in enumerate(seasons) for r in "W" * w + "L" * l + "P" * p]

    rows = [*bets("great", [(90, 10, 0), (80, 20, 3)]), *bets("few", [(20, 0, 0)]), *bets("poor", [(40, 60, 0), (55, 45, 0)]), *bets("pushes", [(0, 0, 4)])]
    df = spark.createDataFrame(rows, "name string, season int, result string, profit double")
    got = {r.name: (r.decided, round(r.average, 6), r.grade) for r in grades.graded_systems(df, ["name"], filters=3).collect()}
    assert got["great"] == (200, 1.0, "A")
    assert got["few"] == (20, 0.8, "B")  # nothing for its size, all else full
    assert got["poor"] == (200, round((0 + 0 + 0.5 + 0 + 1) / 5, 6), "F") and got["pushes"] == (0, round((0 + 0.2 + 0 + 0 + 1) / 5, 6), "F")
    many = {r.name: r.average for r in grades.graded_systems(df, ["name"], filters=8).collect()}
    assert many["great"] == pytest.approx(0.9)
    some = SystemFilter(favorite=True, spread_min=3, seasons=frozenset({2001, 2002}), features=(FeatureFilter("a", "in", (1, 2, 3)), FeatureFilter("b", "gte", 1)))
    assert grades.overfit_count(some) == 1 + 1 + 2 + 3 + 1


def test_line_tiers(spark):
    """Per field and per pair; zeros and sentinels are no lines; a season without lines is an error."""
    from linecraft.sources import lines

    rows = [(1, "teamrankings", -3.0, 50.0), (1, "Zeta", -4.0, None), (1, "Alpha", 0.0, 51.0), (1, "consensus", None, -1.0), (2, "Consensus", -7.0, 44.0), (2, "Alpha", -6.0, 43.0), (3, "numberfire", -1.0, 40.0), (4, "Alpha", None, 41.0)]
    df = spark.createDataFrame(rows, "game_id long, provider string, spread double, total double")
    field = {r.game_id: tuple(r)[1:] for r in lines.by_field(df).collect()}
    assert field == {1: (-4.0, "Zeta", 51.0, "Alpha"), 2: (-7.0, "Consensus", 44.0, "Consensus"), 3: (-1.0, "numberfire", 40.0, "numberfire")}
    pair = {r.game_id: (r.spread, r.total, r.spread_provider) for r in lines.by_pair(df).collect()}
    assert pair == {1: (-3.0, 50.0, "teamrankings"), 2: (-7.0, 44.0, "Consensus"), 3: (-1.0, 40.0, "numberfire")}
    games = spark.createDataFrame([(1, 2013, 20, 10), (2, 2014, 7, 3), (4, 2015, 7, 3), (3, 2016, None, None)], "game_id long, season int, home_points int, away_points int")
    assert {r.game_id for r in lines.modelling_frame(games, lines.by_field(df), [2013, 2014]).collect()} == {1, 2}
    with pytest.raises(ValueError, match="2015, 2016"):
        lines.modelling_frame(games, lines.by_field(df), [2013, 2014, 2015, 2016])


def test_coverage_decides_what_is_searched(spark):
    """Features that few games have are left out; any column of the games may be one."""
    from linecraft.plans import search

    rows = [(i, 2000 + i % 4, float(i % 20), None if i % 10 else 1.0, "x" if i % 2 else "y", 0.5 if i % 3 else None, None) for i in range(400)]
    df = spark.createDataFrame(rows, "game_id long, season int, wind double, rare double, roof string, home_elo double, away_elo double")
    f = search.Features(("wind", "rare"), ("roof",), ("elo",), ())
    share = search.coverage(df, f)
    assert share == pytest.approx({"wind": 1.0, "rare": 0.1, "roof": 1.0, "elo": 266 / 800})
    assert search.covered(df, f) == search.Features(("wind",), ("roof",), (), ()) and search.covered(df, f, 0.3).team_numbers == ("elo",)
    assert search.levels(df, search.covered(df, f)) == {"roof": ["x", "y"]}
    assert search.coverage(df.limit(0), f)["wind"] == 0.0
