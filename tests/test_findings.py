"""Cases of a review's findings: ties that two engines decide apart, and steps whose work outgrew their input."""

import datetime as dt
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from linecraft.functions.odds import payout
from linecraft.functions.stats import NORM_CDF_SQL, norm_cdf
from linecraft.operators import joint, matching
from linecraft.operators.relational import pairs_within
from linecraft.operators.rollups import match_ladder
from linecraft.queries import QUERIES
from linecraft.registry import nudged, rounded
from linecraft import session
from linecraft.sources import files


@pytest.mark.parametrize("price", [100.0, -100.0, -110.0])
def test_even_bets_fall_on_the_sqls_side(spark, duck, price):
    z, win = 0.5 / 6.0, f"(CASE WHEN {price} < 0 THEN 100.0::DOUBLE / -({price}) ELSE {price} / 100.0::DOUBLE END)"
    up, down = (NORM_CDF_SQL.replace("{z}", f"({x!r}::DOUBLE)") for x in (z, -z))
    want = duck.execute(f"SELECT (1 - {up}) * {win} - ({up} - ({up} - {down}))").fetchone()[0]
    a, b = norm_cdf(F.lit(z)), norm_cdf(F.lit(-z))
    assert spark.range(1).select((1 - a) * payout(F.lit(price)) - (a - (a - b))).first()[0] == want


@pytest.mark.parametrize("points, games", [(5512894, 217353), (6106301, 242059), (6548331, 257353)])
def test_means_beside_a_tie_round_as_in_the_sql(spark, duck, points, games):
    want = duck.execute("SELECT " + nudged(f"round({points} / {games}::DOUBLE, 6)")).fetchone()[0]
    assert spark.range(1).select(rounded(F.lit(points) / F.lit(games))).first()[0] == want


def _seconds(df):
    started = time.perf_counter()
    rows = df.collect()
    return time.perf_counter() - started, rows


def test_fits_read_equal_scores_once(spark, monkeypatch):
    """The rounds of the fit pass over the distinct pairs of forecast and score, whatever the number of games."""
    base = spark.range(4000).selectExpr("CAST(id % 10 AS DOUBLE) AS x", "CAST((id * 7) % 23 + id % 10 AS DOUBLE) AS y")
    held, real = [], type(base).persist
    monkeypatch.setattr(type(base), "persist", lambda df, *a: held.append(df) or real(df, *a))
    one = joint.censored_fit(base, "x", "y", []).first()
    many = joint.censored_fit(base.crossJoin(spark.range(50).select()), "x", "y", []).first()
    assert [df.count() for df in held] == [230, 230]
    assert many["n"] == 50 * one["n"] and many["n_censored"] == 50 * one["n_censored"]
    for c in ("alpha", "beta", "sigma"):
        assert many[c] == pytest.approx(one[c], rel=1e-9)


def test_equal_moments_do_not_pair_up(spark):
    """20,000 questions and 20,000 games of one team and day: 400 million pairs if each met each."""
    at = dt.datetime(2020, 1, 1)
    rows = spark.range(20000).select("id", F.lit(7).alias("team"), F.lit(at).cast("timestamp_ntz").alias("t"))
    asked, known = rows.select(F.col("id").alias("ask_id"), "team", F.col("t").alias("at")), rows.select(F.col("id").alias("game_id"), "team", F.col("t").alias("kickoff"))
    seconds, got = _seconds(match_ladder(asked, known, ["team"], "at", 30))
    assert len(got) == 20000 and {(r["how"], r["game_id"]) for r in got} == {("exact", 0)}
    assert seconds < 15


def test_equal_questions_do_not_pair_up(spark, tmp_path):
    """The same 2,800 questions from 100 copies of users, and 30,000 games of one day."""
    spark.range(30000).selectExpr("id AS o_orderkey", "id * 3 AS o_custkey", "CAST('1996-01-01' AS TIMESTAMP_NTZ) AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(28000).selectExpr("id AS event_id", "id * 700 AS user_id").write.parquet(f"{tmp_path}/events.parquet")
    seconds, got = _seconds(QUERIES["name_token_match"](spark, str(tmp_path)))
    assert got and max(r["hits"] for r in got) > 100
    assert seconds < 15


def test_child_sizes_count_every_table(spark):
    kind = "id long, a struct<tags:array<string>, b:array<struct<id:long, s:struct<e:array<int>>, c:array<struct<v:int, d:array<array<int>>>>>>>"
    rows = [(1, (["x", None], [(10, ([1, 2],), [(1, [[1, 2], []]), (2, None)]), None, (11, None, [])])), (2, (None, [])), (3, None)]
    df = spark.createDataFrame(rows, kind)
    want = {path: t.count() for path, t in files.child_tables(df, ["id"], "t").items()}
    assert {r["path"]: r["n"] for r in files.child_sizes(df, "t").collect()} == want and len(want) == 7
    assert {r["n"] for r in files.child_sizes(df.limit(0), "t").collect()} == {0}


@pytest.mark.parametrize("name", ["tick_flatten", "offering_unpivot", "entering_stats", "book_pivot", "nearest_game"])
def test_partitions_grow_with_the_rows(spark, sf_dir, name, monkeypatch):
    """With a task's share made small, the same step is dealt over more tasks: its memory does not grow with the input."""
    monkeypatch.setattr(session, "ROWS_A_TASK", 50)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert QUERIES[name](spark, sf_dir).rdd.getNumPartitions() > 40
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("block", [1, 3, 256])
def test_pairs_of_blocks_are_all_pairs(spark, block):
    """Groups of 0 to 9 rows, an id twice, null keys and a null id."""
    data = [(g, i * 7 % 11) for g in range(10) for i in range(g)] + [(9, 5), (9, None), (None, 1), (None, 2)]
    got = pairs_within(spark.createDataFrame(data, "g int, id int"), ["g"], "id", block).collect()
    want = [(g, a, b) for g, a in data for h, b in data if g is not None and g == h and a is not None and b is not None and a < b]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_pairs_of_one_group_are_dealt(spark):
    """One group of 3,000 rows: several tasks make its pairs, none more than half of them."""
    rows = spark.range(3000).select("id", F.lit(1).alias("g"))
    got = pairs_within(rows, ["g"], "id", 256).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in got) == 3000 * 2999 // 2
    assert len(got) > 4 and max(r["count"] for r in got) < 3000 * 2999 // 4


def test_beam_keeps_bit_sets(spark, sf_dir, monkeypatch):
    """The statistics are made once, a row a game; the rounds read a few rows of bits, not a row a bet."""
    from linecraft.plans import search
    from linecraft.sources.proxy import games

    played, held = games(spark, sf_dir), []
    real = type(played).persist
    monkeypatch.setattr(type(played), "persist", lambda df, *a: held.append(df) or real(df, *a))
    assert search.beam(played, width=3, depth=1, least=5).count()
    assert held[0].count() == played.count() and 0 < held[1].count() < played.count() / 10


def test_trees_grow_from_sums(spark, monkeypatch):
    """Four thousand games of 20 kinds: the trees see 20 weighted rows and forecast what those of all rows do."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from linecraft.operators.ratings import boosted_walk

    rows = spark.range(6000).selectExpr("id AS game", "CAST(2000 + id % 3 AS INT) AS season", "CAST(id % 5 AS DOUBLE) AS a", "CAST(id % 4 AS DOUBLE) AS b", "CAST(id % 5 * 3 + id % 4 * (id % 5) + id * 7 % 11 AS DOUBLE) AS y")
    seen, real = [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, df, *a: seen.append(df.count()) or real(self, df, *a))
    got = {r["game"]: r["forecast"] for r in boosted_walk(rows, ["a", "b"], "y", "season", ["game"]).collect()}
    assert seen == [20]
    vector = VectorAssembler(inputCols=["a", "b"], outputCol="x")
    plain = real(GBTRegressor(featuresCol="x", labelCol="y", maxIter=10, maxDepth=3, seed=5), vector.transform(rows.filter("season < 2002"))).transform(vector.transform(rows.filter("season = 2002"))).collect()
    assert len(got) == len(plain) == 2000
    assert all(got[r["game"]] == pytest.approx(r["prediction"], abs=1e-6) for r in plain)


def _plain_rounds(pairs):
    """Mutual best choices round by round, one pair at a time."""
    found, number = {}, 0
    while pairs:
        number += 1
        left, right = {}, {}
        for l, r, s, g in pairs:
            left[l] = max(left.get(l, (-1,)), (s, -g, -r))
            right[r] = max(right.get(r, (-1,)), (s, -g, -l))
        new = {(l, r): (round(s, 9), g, number) for l, r, s, g in pairs if left[l] == (s, -g, -r) and right[r] == (s, -g, -l)}
        found |= new
        pairs = [p for p in pairs if p[0] not in {l for l, _ in new} and p[1] not in {r for _, r in new}]
    return found


def test_matches_of_equal_games(spark):
    """F16: groups of equal rows, with ties between days and names, give the pairs and rounds of single rows."""
    rng = np.random.default_rng(16)
    schema = "id long, season int, day date, name1 string, points1 int, name2 string, points2 int"
    names = ["Ohio", "Ohoi", "Iowa"]
    sides = [[(int(i), 2020, dt.date(2020, 9, 5) + dt.timedelta(int(rng.integers(0, 3))), names[rng.integers(3)], 1, names[rng.integers(3)], 2) for i in rng.permutation(24)] for _ in range(2)]
    left, right = (spark.createDataFrame(rows, schema) for rows in sides)
    found = matching.candidates(left, right, 1.0)
    want = _plain_rounds([tuple(r) for r in found.collect()])
    for got in (matching.matches(left, right, 1.0), matching.one_to_one(found)):
        rows = got.collect()
        assert {(r.left_id, r.right_id): (round(r.score, 9), r.gap, r["round"]) for r in rows} == want and len(rows) == len(want)
    assert max(v[2] for v in want.values()) > 3


def test_matches_of_one_large_group(spark):
    """F16: 3,000 equal games in both feeds (9,000,000 pairs, 3,000 rounds, refused before) match in a few steps."""
    side = spark.range(3000).selectExpr("id", "2020 AS season", "DATE'2020-09-05' AS day", "'Ohio' AS name1", "1 AS points1", "'Iowa' AS name2", "2 AS points2")
    got = matching.matches(side, side, 1.2).agg(F.count("*").alias("n"), F.min(F.expr("left_id = right_id AND round = left_id + 1")).alias("same")).first()
    assert got.n == 3000 and got.same


@pytest.mark.parametrize("held", [500_000, 40])
def test_matches_in_tasks_and_in_steps(spark, monkeypatch, held):
    """blocks settled where they lie, and those too large for it in steps, give the pairs and rounds of single rows."""
    monkeypatch.setattr(matching, "HELD", held)
    steps, real = [], matching._settled
    monkeypatch.setattr(matching, "_settled", lambda *a: steps.append(1) or real(*a))
    rng = np.random.default_rng(22)
    schema = "id long, season int, day date, name1 string, points1 int, name2 string, points2 int"
    names = ["Ohio", "Ohoi", "Iowa", None, "Oh", "Ohio State"]
    sides = [[(int(i), 2020, dt.date(2020, 9, 5) + dt.timedelta(int(rng.integers(0, 4))), names[rng.integers(6)], int(rng.integers(1, 3)), names[rng.integers(3)], 2) for i in rng.permutation(120)] for _ in range(2)]
    left, right = (spark.createDataFrame(rows, schema) for rows in sides)
    want = _plain_rounds([tuple(r) for r in matching.candidates(left, right, 1.0).collect()])
    rows = matching.matches(left, right, 1.0).collect()
    assert {(r.left_id, r.right_id): (round(r.score, 9), r.gap, r["round"]) for r in rows} == want and len(rows) == len(want) > 60
    assert max(v[2] for v in want.values()) > 5 and bool(steps) == (held == 40)
    assert matching.matches(left.limit(0), right, 1.0).count() == 0


@pytest.mark.parametrize("held", [500_000, 40])
def test_steps_leave_only_matches(spark, tmp_path, monkeypatch, held):
    """members, pairs and each step's tables are deleted once nothing reads them; matches stay."""
    monkeypatch.setattr(matching, "HELD", held)
    monkeypatch.setattr(session, "shared_dir", lambda spark: f"file://{tmp_path}")
    side = spark.range(300).selectExpr("id", "2020 AS season", "DATE'2020-09-05' AS day", "concat('Ohio', id % 7) AS name1", "1 AS points1", "'Iowa' AS name2", "2 AS points2")
    assert matching.matches(side, side, 1.2).count() == 300
    kinds = [set(spark.read.parquet(str(x)).columns) for x in tmp_path.iterdir()]
    assert kinds and all("round" in k for k in kinds)


def test_scenarios_share_one_shuffle(spark, sf_dir):
    """ticks and decisions are shuffled once, by game, for all scenarios; only counts and sums are shuffled after that."""
    plan = QUERIES["sensitivity_grid"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert sum("game_id" in k for k in keys) == 1 and not any("decision_id" in k for k in keys)


def test_grid_without_quotes_is_whole(spark):
    """where no decision meets a quote, each scenario and threshold still has its row; without decisions none has."""
    from linecraft.operators import execution as ex
    from linecraft.suites import market

    at = dt.datetime(2020, 1, 1)
    d = spark.createDataFrame([(1, 1, at, at, 44.0, 3, 0.1, 50, "final")], "decision_id long, game_id long, decided_at timestamp, kickoff timestamp, mean double, prior_games int, selective double, final_total int, state string")
    q = spark.createDataFrame([], "game_id long, quote_id long, book string, side string, line double, price double, quoted_at timestamp, live boolean, available boolean")
    got = ex.sensitivity(d, q, market.POLICY, market.BASE, [0.0], market.outcomes).collect()
    assert len(got) == 2 * len(ex.SCENARIOS) and not any(r.bets or r.units or r.actionable for r in got)
    assert ex.sensitivity(d.limit(0), q, market.POLICY, market.BASE, [0.0], market.outcomes).count() == 0
