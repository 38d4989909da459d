"""Sinks and names, child tables of any depth, ordered table functions, streams with state."""

import datetime as dt
import json
import shutil

import pytest

from linecraft.sources import files, offerings
from linecraft.streaming import stateful


def test_games_sinks(spark, tmp_path):
    games = spark.createDataFrame([(1, 2020, "A", None, -3.5, "regular", "2020-09-05", True, "x"), (2, 2021, "B", "C1", None, None, None, None, "y")], "game_id long, season int, home_team string, home_conference string, spread double, season_type string, start_date string, start_time_tbd boolean, extra string")
    files.write_games_csv(games, str(tmp_path / "g"))
    lines = [x for p in sorted((tmp_path / "g").glob("*.csv")) for x in p.read_text().splitlines()]
    assert lines[0] == ",".join(c.split()[0] for c in files.GAMES_CSV.split(", ")) and "1,2020,,A,,,,,,,-3.5,,regular" in lines
    back = {r.game_id: r for r in files.read_games_csv(spark, str(tmp_path / "g")).collect()}
    assert (back[1].spread, back[1].week, back[2].home_conference, back[2].season_type) == (-3.5, None, "C1", "regular")
    files.write_upcoming(games, str(tmp_path / "u"))
    up = {r.game_id: (r.start_date, r.start_time_tbd) for r in files.read_upcoming(spark, str(tmp_path / "u")).collect()}
    assert up == {1: ("2020-09-05", True), 2: (None, False)}


def test_slugs():
    assert files.slug("  My Cool System! ") == "my-cool-system" and files.slug("a--b__c") == "a-b__c"
    for bad in ("", "!!!", "--"):
        with pytest.raises(ValueError):
            files.slug(bad)
    assert files.version_of("week-3-unders") == ("week-3-unders", 1) and files.version_of("x-v12") == ("x", 12)
    assert files.next_version("x-v2", ["x", "x-v10", "xy-v99"]) == "x-v11" and files.next_version("new", []) == "new-v1"


def test_child_tables(spark):
    """Three levels, arrays of arrays, scalars, nulls and empty arrays, names that clash."""
    kind = "id long, a struct<tags:array<string>, b:array<struct<id:long, b_idx:int, c:array<struct<v:int, d:array<array<int>>>>>>>"
    rows = [(1, (["x", None], [(10, 7, [(1, [[1, 2], []]), (2, None)]), (11, 8, [])])), (2, (None, [])), (3, None)]
    got = files.child_tables(spark.createDataFrame(rows, kind), ["id"], "t")
    assert sorted(got) == ["t", "t__a_b", "t__a_b__c", "t__a_b__c__d", "t__a_b__c__d__value", "t__a_tags"]
    found = {k: sorted(tuple(r) for r in v.collect()) for k, v in got.items() if k != "t__a_tags"}
    assert found["t"] == [(1,), (2,), (3,)] and got["t__a_tags"].columns == ["id", "a_tags_idx", "value"]
    assert sorted(map(str, map(tuple, got["t__a_tags"].collect()))) == ["(1, 1, 'x')", "(1, 2, None)"]
    assert got["t__a_b"].columns == ["id", "a_b_idx", "id_", "b_idx"] and found["t__a_b"] == [(1, 1, 10, 7), (1, 2, 11, 8)]
    assert got["t__a_b__c"].columns == ["id", "a_b_idx", "c_idx", "v"] and found["t__a_b__c"] == [(1, 1, 1, 1), (1, 1, 2, 2)]
    assert found["t__a_b__c__d"] == [(1, 1, 1, 1), (1, 1, 1, 2)]
    assert found["t__a_b__c__d__value"] == [(1, 1, 1, 1, 1, 1), (1, 1, 1, 1, 2, 2)]


def test_offerings(spark):
    """Only changes pass, in order of time; null is a value; malformed payloads and other shapes are passed over."""
    book = lambda **sides: json.dumps({"b": {"event": {"total": sides}}})
    rows = [(1, 3, book(over=41.0, under=40.5)), (1, 1, book(over=40.5, under=40.5)), (1, 2, book(over=40.5, under=None)), (1, 4, "{broken"), (1, 5, None), (2, 1, json.dumps({"b": 3, "c": {"event": {"total": {"over": 7, "x": "text"}}}})), (1, 6, book(over=41.0))]
    df = spark.createDataFrame(rows, "game long, side long, raw string").repartition(4)
    out = offerings.changed_offerings(df, ["game"], ["side"], "raw")
    assert out.columns == ["game", "side", "book", "period", "market", "side_", "value", "first"]
    got = sorted((r.game, r.side, r.book, r.side_, -1.0 if r.value is None else r.value, r["first"]) for r in out.collect())
    assert got == [(1, 1, "b", "over", 40.5, True), (1, 1, "b", "under", 40.5, True), (1, 2, "b", "under", -1.0, False), (1, 3, "b", "over", 41.0, False), (1, 3, "b", "under", 40.5, False), (2, 1, "c", "over", 7.0, True)]
    assert offerings.changed_offerings(df.limit(0), ["game"], ["side"], "raw").count() == 0
    with pytest.raises(Exception, match="payload"):
        offerings.changed_offerings(df, ["game"], ["side"], "nothing").count()


def day(n, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=hour)


TICKS = [
    # event 1: a late tick and a repeated file; event 2: the last over is suspended; event 3: other lines; event 4: one side only
    (1, day(10), "over", day(1), 1, 40.0, -110.0, "normal"), (1, day(10), "under", day(2), 2, 41.0, -105.0, "opener"), (1, day(10), "over", day(9, 5), 3, 41.0, -102.0, None),
    (1, day(10), "over", day(10, 1), 9, 44.0, -150.0, "normal"), (2, day(12), "over", day(3), 1, 50.0, -110.0, "normal"), (2, day(12), "under", day(3), 2, 50.0, -110.0, "normal"),
    (2, day(12), "over", day(11), 5, 50.0, -111.0, "suspended"), (3, day(5), "over", day(3), 1, 47.0, -110.0, "normal"), (3, day(5), "under", day(4), 2, 47.5, -110.0, "normal"),
    (4, day(6), "under", day(4), 2, 47.5, -110.0, "normal"), (5, day(7), "over", day(6), 1, 30.0, -110.0, "normal"), (5, day(7), "under", day(6), 2, 30.0, -120.0, "normal"),
    (5, day(7), "under", day(6), 3, 30.0, -125.0, "normal"), (6, day(8), "over", day(7), 1, 33.0, None, "normal"), (6, day(8), "under", day(7), 2, 33.0, -110.0, "normal"),
]


def test_closing_pairs(spark, tmp_path):
    """A stream over late and repeated files gives the rows of the batch, each once, and goes on from its checkpoint."""
    want = stateful.closing_pairs_batch(spark.createDataFrame(TICKS, stateful.TICK))
    rows = sorted(tuple(r) for r in want.collect())
    assert [(r[0], r[2], r[3], r[4]) for r in rows] == [(1, 41.0, -102.0, -105.0), (5, 30.0, -110.0, -125.0)]
    stateful.use_rocksdb(spark)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    late_first = [[TICKS[2], *TICKS[4:9]], [TICKS[0], TICKS[1], TICKS[9], TICKS[10]], TICKS[11:], [TICKS[3]]]
    (tmp_path / "in").mkdir()

    def deliver(name, ticks):
        staged = tmp_path / f"staged-{name}"
        spark.createDataFrame(ticks, stateful.TICK).coalesce(1).write.parquet(str(staged))
        shutil.copy(next(staged.glob("part-*.parquet")), f"{source}/{name}.parquet")

    def run():
        stream = spark.readStream.schema(stateful.TICK).option("maxFilesPerTrigger", 1).parquet(source)
        query = stateful.closing_pairs(stream, "9 days").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None

    try:
        for k, ticks in enumerate(late_first):
            deliver(f"a{k}", ticks)
        run()
        deliver("b0", late_first[1])  # the same ticks again
        deliver("b1", [(99, day(400), "over", day(200), 1, 1.0, -110.0, "normal")])  # time goes on: all timers are due
        deliver("b2", [(99, day(400), "over", day(201), 2, 1.0, -110.0, "normal")])
        run()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == rows


def test_scoreboard(spark):
    """Games, teams, periods, ranks and offers of a file; missing parts, other kinds of values, files without games."""
    from pyspark.sql import functions as F

    from linecraft.sources import scoreboard as sb

    one = {"id": 7, "week": 3, "home_team_id": "12", "boxscore": {"period": 4, "situation": {"down": 2}, "linescore": [{"id": 1, "home_points": 7, "away_points": None}]}, "teams": [{"id": 12, "abbr": "AA", "standings": {"win": 3}}, {"abbr": "BB"}], "ranks": [{"poll": "ap", "rank": 4, "team_id": 12}]}
    one["markets"] = {"15": {"event": {"total": [{"side": "over", "value": 44.5, "odds": -105, "bet_info": {"money": {"percent": 61, "value": 10}}}, {"side": "under", "type": "alt_total"}]}, "firsthalf": {"spread": []}}, "68": {}}
    two = {"core_id": 8, "season": 2022, "status": "complete", "teams": "none", "markets": [], "boxscore": None}
    texts = [json.dumps({"games": [one, two]}), json.dumps({"games": []}), json.dumps({"leagues": 1}), None]
    files_ = spark.createDataFrame([(t, 2021, 1, "regular", f"f{i}") for i, t in enumerate(texts)], "t string, season int, week int, season_type string, source_file string").withColumn("payload", F.try_parse_json("t"))
    games = sb.scoreboard(files_)
    got = {r.event_id: r for r in games.drop("teams", "markets", "ranks", "linescore", "last_play").collect()}
    assert sorted(got) == [7, 8] and (got[7].season, got[7].week, got[7].home_team_id, got[7].period, got[7].down, got[7].core_id) == (2021, 3, 12, 4, 2, None)
    assert (got[8].season, got[8].week, got[8].status, got[8].home_points) == (2022, 1, "complete", None)
    assert sorted((r.event_id, r.abbr, r.team_id, r.wins) for r in sb.teams(games).collect()) == [(7, "AA", 12, 3), (7, "BB", None, None)]
    assert [tuple(r) for r in sb.linescores(games).select("event_id", "period_id", "home_points", "away_points").collect()] == [(7, 1, 7, None)]
    assert [tuple(r) for r in sb.ranks(games).select("event_id", "week", "poll", "rank").collect()] == [(7, 3, "ap", 4)]
    offers = sorted((r.book_id, r.period, r.market, r.side, r.line, r.money_pct) for r in sb.markets(games).collect())
    assert offers == [(15, "event", "alt_total", "under", None, None), (15, "event", "total", "over", 44.5, 61)]
