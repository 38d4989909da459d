import pytest
from comparing import rows

from linecraft.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[0] == "season"


def test_beam_is_held_out(spark, sf_dir):
    found = QUERIES["beam_search"](spark, sf_dir).toPandas()
    assert found["place"].is_unique and (found["bets_inside"] >= 30).all()


def test_beam_grammar_and_holdout(spark):
    """Quartiles of the in-sample games, away and total bets, records by plain count, p-values and BH."""
    import numpy as np

    from linecraft.plans import search

    rng = np.random.default_rng(1)
    data = [(i, 2000 + i // 400, int(rng.integers(1, 15)), int(i % 10), int(10 + i % 7), int(rng.integers(0, 40)), int(rng.integers(0, 40)), float(rng.integers(-20, 21)) / 2, float(rng.integers(60, 100)) / 2) for i in range(1600)]
    # away sides that get seven points or more cover; low totals go over
    data = [(*g[:5], 10, 22, *g[7:]) if g[7] <= -7 else g for g in data]
    data = [(*g[:5], 60, 60, *g[7:]) if g[7] > -7 and g[8] < 36 else g for g in data]
    made = spark.createDataFrame(data, "game_id long, season long, week long, home_team long, away_team long, home_points long, away_points long, spread double, total double")
    made = made.selectExpr("*", "'regular' AS season_type", "concat('C', home_team % 3) AS home_conference", "concat('C', away_team % 3) AS away_conference", "timestampadd(DAY, CAST(game_id AS INT), TIMESTAMP_NTZ'2000-01-01 00:00:00') AS kickoff")
    inside = [g for g in data if g[1] < 2003]
    spreads = sorted(g[7] for g in inside)
    assert search.thresholds(search.with_features(made).filter("season < 2003"))["line"] == sorted({spreads[round(q * (len(spreads) - 1))] for q in (0.25, 0.5, 0.75)})
    out = search.beam(made, width=10, depth=2).toPandas()
    assert out["place"].is_unique and (out["bets_inside"] >= 100).all() and (out["bets"] > 0).all()
    assert out["candidate"].str.startswith("spread: ").any() and out["candidate"].str.startswith("over: ").any()
    assert out["candidate"].str.contains("away").any() and out["p_value"].between(0, 1).all() and (out["bh"] >= out["p_value"]).all()
    for r in out[out["candidate"].str.fullmatch(r"over: total <= [\d.]+")].itertuples():
        bound = float(r.candidate.split()[-1])
        for year, n in ((lambda y: y < 2003, r.bets_inside), (lambda y: y == 2003, r.bets)):
            assert sum(year(g[1]) and g[8] <= bound for g in data) == n
        assert sum(g[1] == 2003 and g[8] <= bound and g[5] + g[6] > g[8] for g in data) == r.wins


def test_ratings_recover_order(spark):
    import numpy as np

    from linecraft.operators.models import ridge_ratings

    rng = np.random.default_rng(0)
    games = [(1, int(a), int(b), int(20 + 3 * a), int(20 + 3 * b)) for a, b in rng.integers(0, 6, (300, 2)) if a != b]
    out = ridge_ratings(spark.createDataFrame(games, "season long, home_team long, away_team long, home_points long, away_points long")).toPandas()
    assert out.sort_values("attack")["team"].tolist() == list(range(6))


def test_bankroll_repeats(spark, sf_dir):
    a, b = (QUERIES["bankroll_paths"](spark, sf_dir).toPandas() for _ in range(2))
    assert rows(a) == rows(b) and (a["paths"] == 2000).all()
