from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from linecraft.functions.odds import decimal_price, implied_probability, snap_half
from linecraft.functions.stats import adjusted, norm_cdf, wilson
from linecraft.operators.relational import asof_join, merge_sources
from linecraft.operators.systems import FeatureFilter, SystemFilter, feature_predicate, grade


def values(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_prices(spark):
    lit = [F.lit(float(x)) for x in (-110, 150)]
    got = values(spark, *(f(x) for f in (implied_probability, decimal_price) for x in lit))
    assert got == pytest.approx([110 / 210, 0.4, 1 + 100 / 110, 2.5])
    assert list(values(spark, *(snap_half(F.lit(x)) for x in (2.25, -2.25, 2.24)))) == [2.5, -2.5, 2.0]


def test_statistics(spark):
    low, high = wilson(F.lit(55), F.lit(100))
    assert list(values(spark, low, high)) == [0.4524, 0.6439]
    assert list(values(spark, *wilson(F.lit(0), F.lit(0)))) == [0.0, 0.0]
    assert values(spark, norm_cdf(F.lit(1.96)))[0] == pytest.approx(0.9750021, abs=1e-7)
    df = spark.createDataFrame([(0, i, p) for i, p in enumerate((0.01, 0.04, 0.03, 0.5))], "g int, k int, p double")
    got = adjusted(df, "p", "k", ["g"]).orderBy("k").collect()
    assert [r.bh for r in got] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5])
    assert [r.holm for r in got] == pytest.approx([0.04, 0.09, 0.09, 0.5])


@pytest.mark.parametrize("strict", [False, True])
def test_asof(spark, strict):
    left = spark.createDataFrame([(1, 1, dt(2024, 1, 2)), (2, 1, dt(2024, 1, 1)), (3, 2, dt(2024, 1, 5)), (4, None, dt(2024, 1, 5))], "id int, k int, t timestamp_ntz")
    right = spark.createDataFrame([(1, dt(2024, 1, 1), 10.0), (1, dt(2024, 1, 2), 20.0), (1, dt(2024, 1, 3), 30.0)], "k int, t2 timestamp_ntz, v double")
    got = {r.id: r.v for r in asof_join(left, right, ["k"], "t", "t2", ["v"], strict=strict).collect()}
    assert got == ({1: 10.0, 2: None, 3: None, 4: None} if strict else {1: 20.0, 2: 10.0, 3: None, 4: None})


def test_merge(spark):
    a, b = (spark.createDataFrame(x, "k int, v double") for x in ([(1, 1.0), (2, None)], [(2, 5.0), (3, 6.0)]))
    assert sorted(tuple(r) for r in merge_sources(a, b, ["k"], ["v"], ("rest", "gql")).collect()) == [(1, 1.0, "rest"), (2, 5.0, "both"), (3, 6.0, "gql")]


GAMES = "season int, week int, season_type string, home_team string, away_team string, home_conference string, away_conference string, home_points int, away_points int, spread double, total double"


def test_filters_fail_closed(spark):
    rows = [(2020, 1, "regular", "A", "B", "X", None, 20, 17, -3.0, 37.0), (2020, 2, "regular", "C", "D", "Y", "X", 10, 30, -7.0, None), (2020, 3, "regular", "E", "F", None, "Y", None, None, -1.0, 50.0), (2020, 4, "regular", "G", "H", "X", "Y", 7, 3, None, 40.0)]
    games = spark.createDataFrame(rows, GAMES)

    def result(**kw):
        return [(r.home_team, r.result) for r in grade(games, SystemFilter(**kw)).orderBy("week").collect()]

    assert result() == [("A", "P"), ("C", "L")]
    assert result(fade=True) == [("A", "P"), ("C", "W")]
    assert result(side="away", exclude_conferences=frozenset({"Z"})) == [("C", "W")]
    assert result(side="over", market="total", conferences=frozenset({"Y"})) == [("G", "L")]
    test = feature_predicate(FeatureFilter("conference", "not_eq", "X", "either"), "home", games.columns)
    assert [r.home_team for r in games.filter(test).orderBy("week").collect()] == ["C", "E", "G"]
    assert games.filter(feature_predicate(FeatureFilter("absent", "not_eq", 1), "home", games.columns)).count() == 0
    with pytest.raises(KeyError):
        feature_predicate(FeatureFilter("week", "like", 1), "home", games.columns)


def test_files(spark, tmp_path):
    from linecraft.sources.files import child_table, drop_dead, flatten, promote_timestamps, read_bet_history, read_games_csv, read_vendor_json

    (tmp_path / "games.csv").write_text("game_id,season,week,home_team,away_team,home_conference,away_conference,home_points,away_points,provider,spread,total,season_type\n1,2020,1,A,B,,X,,,p,-3.5,,\n")
    game = read_games_csv(spark, str(tmp_path / "games.csv")).first()
    assert (game.home_conference, game.spread, game.total, game.season_type) == (None, -3.5, None, "regular")
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "plays_2023_post_wk1.json").write_text('[{"id": 1}, {"id": 2}]')
    (tmp_path / "j" / "venue_2021.json").write_text('{"id": 3}')
    (tmp_path / "j" / "own_2023_wk1.json").write_text('{"id": 4, "season": 2022, "week": 5, "season_type": "postseason"}')
    got = read_vendor_json(spark, str(tmp_path / "j")).selectExpr("variant_get(payload, '$.id', 'int')", "season", "week", "season_type")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2023, 1, "postseason"), (2, 2023, 1, "postseason"), (3, 2021, None, None), (4, 2022, 5, "postseason")]
    (tmp_path / "bets.csv").write_text("data:text/csv\n1,2.5\nx,y\n")
    bets = read_bet_history(spark, str(tmp_path / "bets.csv"), "id int, line double").collect()
    assert [(r.id, r.line, r._bad is not None) for r in bets] == [(1, 2.5, False), (None, None, True)]
    nested = spark.createDataFrame([(1, (2, ("2024-01-01",)), [(5,), (6,)])], "id int, a struct<b:int,c:struct<start_date:string>>, kids array<struct<n:int>>")
    flat = flatten(nested)
    assert flat.columns == ["id", "a_b", "a_c_start_date", "kids"]
    assert promote_timestamps(flat).schema["a_c_start_date"].dataType.typeName() == "timestamp"
    assert [tuple(r) for r in child_table(nested, "kids", ["id"]).collect()] == [(1, 1, 5), (1, 2, 6)]
    assert drop_dead(spark.createDataFrame([(1, None, 2)], "a int, b int, c int"), ["b", "c", "z"]).columns == ["a", "c"]


def test_stream_gives_the_batch_windows(spark, sf_dir, tmp_path):
    from linecraft.sources.proxy import ticks
    from linecraft.streaming.ticks_stream import tick_stream, windows

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    query = windows(tick_stream(spark, str(tmp_path / "in"), events.schema)).writeStream.format("memory").queryName("tick_windows").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    n = spark.table("tick_windows").groupBy("event", "bucket").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0]
    assert n == ticks(spark, sf_dir).count()
