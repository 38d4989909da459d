"""Parts that SQL does not express: loading, text forms of filters, streams, models and resampling."""

import json
import math
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from linecraft.functions import names
from linecraft.functions.stats import norm_quantile
from linecraft.operators import forecasts, ratings, testing
from linecraft.operators.systems import FeatureFilter, SystemFilter, parse_filter, sentence, without_dimension
from linecraft.queries import QUERIES
from linecraft.registry import nudged
from linecraft.sources import flatten, load
from linecraft.streaming import logs

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_nudged_sql():
    assert nudged("SELECT round(a, 2), f(round(round(x, 1) + g(1, 2), 6)), round(y)").count("1.7e-09") == 3
    assert nudged("SELECT around(a, 2)") == "SELECT around(a, 2)"


def test_stems():
    assert load.parse_stem("plays_2023_post_wk1") == ("plays", 2023, 1, "postseason")
    assert load.parse_stem("plays_2023_wk12") == ("plays", 2023, 12, "regular")
    assert load.parse_stem("games_2023") == ("games", 2023, None, None)
    assert load.parse_stem("1h_lines-x_2024") == ("1h_lines-x", 2024, None, None)
    assert load.parse_stem("odds-2024") == ("odds-2024", None, None, None) and load.parse_stem("games_1066") == ("games_1066", None, None, None)


def test_load(spark, tmp_path):
    """A plan and a report with every file, the failure of one job, one name of two kinds, a sidecar of another version."""
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "plays_2023_wk1.json").write_text(json.dumps([{"id": 1}, {"id": 2}]))
    (raw / "plays_2023_wk2.json").write_text(json.dumps({"id": 3}))
    (raw / "plays_2024_wk1.json").write_text("")
    (raw / "teams_2023.csv").write_text("team,n\nA,1\nB,2\n")
    (raw / "teams.json").write_text(json.dumps([{"id": 9}]))
    (raw / "1h_lines_2024.json").write_text(json.dumps([{"id": 4}]))
    (raw / "odds-2024.json").write_text(json.dumps([{"id": 5}]))
    (raw / "empty_2023.json").write_text("")
    (raw / "user_info.json").write_text("{}")
    (raw / "notes.txt").write_text("x")
    jobs = load.load_plan(load.list_files(spark, str(raw)))
    assert sorted(p for j in jobs for p in j.paths) == sorted(f"file:{raw}/{f.name}" for f in raw.iterdir() if f.name != "plays_2024_wk1.json")

    def broken(spark, paths):
        raise ValueError("no such thing")

    readers = {"json": lambda s, p: s.read.option("multiLine", True).json(p), "csv": broken}
    out = str(tmp_path / "out")
    report = {r.name: (r.kind, r.files, r.rows, r.error) for r in load.load(spark, jobs, out, readers).collect()}
    assert report == {
        "plays": ("json", 2, 3, None), "teams_csv": ("csv", 1, None, "ValueError: no such thing"), "teams_json": ("json", 1, 1, None), "1h_lines": ("json", 1, 1, None), "odds-2024": ("json", 1, 1, None),
        "empty": ("json", 1, None, "no non-empty files"), "user_info.json": ("json", 1, None, "skipped: not a table"), "notes.txt": ("txt", 1, None, "skipped: no reader for this kind"),
    }
    assert sorted(r.id for r in spark.read.parquet(f"{out}/plays").collect()) == [1, 2, 3]
    assert spark.read.parquet(f"{out}/_reports").count() == len(report)
    assert not [f for f in os.listdir(out) if f.startswith(("_building", "_old", "_lock"))]
    only = load.load_plan(load.list_files(spark, str(raw)), {"plays"})
    assert {j.error for j in only if j.name != "plays"} >= {"skipped: not asked for"} and sum(j.error is None for j in only) == 1


def _other_writer(out, code):
    """Another process that loads into ``out``."""
    program = f"""
import sys, tempfile
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
from linecraft.sources import load
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
jobs = [load.Job("t", "x", ())]
readers = {{"x": lambda s, p: s.range(5)}}
{code}
"""
    return subprocess.run([sys.executable, "-c", program, out], capture_output=True, text=True, timeout=240)


def test_second_writer_is_refused_and_harms_nothing(spark, tmp_path):
    out, seen = str(tmp_path / "out"), {}
    attempt = "try:\n    load.load(spark, jobs, sys.argv[1], readers)\nexcept load.LoadInProgress as e:\n    print(e)\n    sys.exit(3)"

    def slow(s, paths):
        """While this table is read, another process tries to load."""
        seen["other"] = _other_writer(out, attempt)
        seen["lock"], seen["files"] = os.path.exists(f"{out}/_lock"), sorted(os.listdir(out))
        return s.range(3)

    (report,) = load.load(spark, [load.Job("t", "x", ())], out, {"x": slow}).collect()
    assert seen["other"].returncode == 3 and "_lock" in seen["other"].stdout, seen["other"].stderr[-500:]
    assert seen["lock"] and "t" not in seen["files"]
    assert report.rows == 3 and spark.read.parquet(f"{out}/t").count() == 3
    assert _other_writer(out, attempt).returncode == 0 and spark.read.parquet(f"{out}/t").count() == 5


def test_locks_of_the_dead(spark, tmp_path):
    """A lock stays until it is removed or, where asked for, has not been renewed; a failed load lets its own go."""
    out, jobs, readers = str(tmp_path / "out"), [load.Job("t", "x", ())], {"x": lambda s, p: s.range(2)}
    dead = load.Lock(spark, out)
    dead.take()
    with pytest.raises(load.LoadInProgress):
        load.load(spark, jobs, out, readers)
    with pytest.raises(load.LoadInProgress):
        load.load(spark, jobs, out, readers, stale_after=3600)
    os.utime(f"{out}/_lock", (0, 0))
    assert load.load(spark, jobs, out, readers, stale_after=3600).first()["rows"] == 2
    dead = load.Lock(spark, out)
    dead.take()
    load.unlock(spark, out)
    with pytest.raises(AttributeError):
        load.load(spark, [None], out, readers)
    assert not os.path.exists(f"{out}/_lock")


def test_crashes_between_renames(spark, tmp_path):
    """A table that was renamed away comes back, one that was already replaced does not; half-written data goes."""
    out, jobs, readers = str(tmp_path / "out"), [load.Job("new", "x", ())], {"x": lambda s, p: s.range(2)}
    for name, rows in (("_old_kept_" + "a" * 32, 7), ("_old_done_" + "b" * 32, 8), ("done", 9), ("_building_z_" + "c" * 32, 1)):
        spark.range(rows).write.parquet(f"{out}/{name}")
    load.load(spark, jobs, out, readers)
    assert {n: spark.read.parquet(f"{out}/{n}").count() for n in ("kept", "done", "new")} == {"kept": 7, "done": 9, "new": 2}
    assert sorted(f for f in os.listdir(out) if f.startswith("_")) == ["_reports"]
    with pytest.raises(OSError):
        load.replace(spark, f"{out}/missing", f"{out}/done")
    assert spark.read.parquet(f"{out}/done").count() == 9


def test_sidecar(spark, tmp_path):
    features = str(tmp_path / "features")
    load.write_sidecar(spark.range(3), features, "v1")
    assert load.read_sidecar(spark, features, "v1").count() == 3
    with pytest.raises(ValueError):
        load.read_sidecar(spark, features, "v2")


def test_bets_split(spark):
    df = spark.createDataFrame([("football", None), ("tennis", None), (None, None), ("football", "a,b,c,d")], "sport string, _bad string")
    assert {k: v.count() for k, v in load.split_bets(df, "football").items()} == {"in_scope": 1, "out_of_scope": 2, "malformed": 1}


def test_snapshot_without_side_raises(spark):
    raw = spark.createDataFrame([(1, "A", "B", [("x", [("C", -110, 3.5)])])], "game_id int, home string, away string, books array<struct<book:string,outcomes:array<struct<name:string,price:int,point:double>>>>")
    with pytest.raises(Exception, match="no side: C"):
        flatten.snapshot_flatten(raw).collect()


def test_filters_as_text():
    s = parse_filter({"side": "away", "underdog": "yes", "spread_min": "3", "teams": "1, 2"})
    assert s == SystemFilter(side="away", underdog=True, spread_min=3.0, teams=frozenset({1, 2}))
    assert sentence(s) == "bet the away as an underdog with a spread of 3 or more with 1, 2"
    for bad in ({"colour": "red"}, {"side": "left"}, {"spread_min": "x"}, {"fade": "maybe"}):
        with pytest.raises(ValueError):
            parse_filter(bad)
        assert parse_filter(bad, strict=False) == SystemFilter()
    assert without_dimension(s, "team") == SystemFilter(side="away", underdog=True, spread_min=3.0)
    one = SystemFilter(features=(FeatureFilter("wind", "gte", 10), FeatureFilter("rest_days", "lt", 6)))
    assert [f.key for f in without_dimension(one, "wind").features] == ["rest_days"]
    assert sentence(one) == "bet the home where wind (single) is at least 10 where rest_days (single) is under 6"


def test_names_and_quantile(spark):
    got = spark.range(1).select(names.school(F.lit("San José St.")), names.school(F.lit("St. John's")), names.without_mascot(F.lit("Ohio Bobcats"), ["Bobcats"]), names.without_mascot(F.lit("Bobcats"), ["Bobcats"]), norm_quantile(F.lit(0.975)), norm_quantile(F.lit(0.01)), norm_quantile(F.lit(0.0))).first()
    assert list(got[:4]) == ["san jose state", "saint johns", "ohio", "bobcats"]
    assert got[4] == pytest.approx(1.959963985, abs=1e-8) and got[5] == pytest.approx(-2.326347874, abs=1e-8) and got[6] is None


def test_upsert_is_idempotent(spark, tmp_path):
    """A batch that is delivered again changes nothing; a later version replaces its row; a stream does the same."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    path, schema = str(tmp_path / "table"), "event int, v int, line double, day int"
    write = logs.upsert(spark, path, ["event"], "v", "day")
    rows = lambda: sorted(map(tuple, spark.read.schema(schema).parquet(path).collect()))
    first = spark.createDataFrame([(1, 1, 3.0, 1), (2, 1, 4.0, 2)], schema)
    write(first, 0)
    write(first, 0)
    assert rows() == [(1, 1, 3.0, 1), (2, 1, 4.0, 2)]
    first_in, second = tmp_path / "in", spark.createDataFrame([(1, 2, 3.5, 1), (1, 1, 3.0, 1), (3, 1, 9.0, 1)], schema)
    second.write.parquet(str(first_in))
    stream = logs.enrich(spark.readStream.schema(schema).parquet(str(first_in)), spark.createDataFrame([(1, "x")], "event int, name string"), "event").drop("name")
    stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert rows() == [(1, 2, 3.5, 1), (2, 1, 4.0, 2), (3, 1, 9.0, 1)]


def test_upsert_goes_on_after_a_crash(spark, tmp_path):
    """A writer that was lost between deleting and writing partitions has left all merged rows aside."""
    path, schema = str(tmp_path / "table"), "event int, v int, line double, day int"
    write = logs.upsert(spark, path, ["event"], "v", "day")
    write(spark.createDataFrame([(1, 1, 3.0, 1), (2, 1, 4.0, 2)], schema), 0)
    spark.createDataFrame([(1, 2, 3.5, 1), (5, 1, 7.0, 1)], schema).write.parquet(f"{path}_merging")
    for part in (tmp_path / "table" / "day=1").iterdir():
        part.unlink()
    write(spark.createDataFrame([(2, 2, 4.5, 2)], schema), 1)
    assert sorted(map(tuple, spark.read.schema(schema).parquet(path).collect())) == [(1, 2, 3.5, 1), (2, 2, 4.5, 2), (5, 1, 7.0, 1)]
    assert not os.path.exists(f"{path}_merging")


def test_long_accounts_and_null_accounts_are_chained(spark):
    """The chain is the plain fold, whatever the partitions and batches."""
    import hashlib

    rows = spark.createDataFrame([(a, i, f"b{i}") for a in (1, 2, None) for i in range(700)], "account int, n int, what string").repartition(5)
    got = logs.chained(rows, "account", "n", ["what"]).collect()
    for account in (1, 2, None):
        sha = ""
        for r in sorted((r for r in got if r.account == account), key=lambda r: r.n):
            sha = hashlib.sha256((sha + r.body).encode()).hexdigest()
            assert r.sha == sha
    assert len(got) == 2100 and logs.chained(rows.limit(0), "account", "n", ["what"]).count() == 0


def test_fits_of_nothing(spark):
    rows = spark.createDataFrame([], "season int, x double, y double, hit boolean, game int")
    assert testing.probit(rows, ["x"], "hit") == {} and testing.tobit(rows, "x", "y") == {}
    assert testing.tobit(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double"), "x", "y") == {}
    out = ratings.boosted_walk(rows, ["x"], "y", "season", ["game"])
    assert out.columns == ["game", "forecast"] and out.count() == 0


def test_pairings_give_what_rows_give(spark):
    """Ridge ratings from added-up pairings against the rows' own dense normal equations."""
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(1, "end", int(a), int(b), int(h), float(rng.normal(2, 0.5)), float(rng.integers(8, 15))) for a, b, h in zip(rng.integers(0, 5, 80), rng.integers(5, 9, 80), rng.integers(0, 2, 80), strict=True)]
    got = ratings.ratings_at(spark.createDataFrame(rows, "season int, cutoff string, team long, opponent long, is_home int, rate double, weight double")).toPandas().set_index("team")
    x, w, r = np.zeros((80, 20)), np.array([v[6] for v in rows]), np.array([v[5] for v in rows])
    for i, (_, _, a, b, h, _, _) in enumerate(rows):
        x[i, a], x[i, 9 + b], x[i, 18], x[i, 19] = 1, 1, 1, h - 0.5
    m = x.T @ (x * w[:, None]) + np.diag([10.0] * 18 + [0, 0])
    fit, pace = np.linalg.solve(m, x.T @ (w * r)), np.linalg.solve(m, x.T @ (w * w))
    assert got.loc[range(9), "attack"].tolist() == pytest.approx(fit[:9]) and got.loc[range(9), "defence"].tolist() == pytest.approx(fit[9:18])
    assert got.loc[range(9), "pace"].tolist() == pytest.approx(pace[:9] + pace[9:18] + pace[18]) and got["n"].sum() == 80


def test_chain_breaks_where_it_is_changed(spark):
    rows = spark.createDataFrame([(1, i, f"b{i}") for i in range(4)], "account int, n int, what string")
    chain = logs.chained(rows, "account", "n", ["what"])
    assert logs.broken_links(chain, "account", "n").count() == 0
    forged = chain.withColumn("body", F.when(F.col("n") == 2, "{}").otherwise(F.col("body")))
    assert [r.n for r in logs.broken_links(forged, "account", "n").collect()] == [2]


def test_convolution_and_normal_pmf(spark):
    half = F.array(F.lit(0.5), F.lit(0.5))
    got = spark.range(1).select(forecasts.convolve(half, half), forecasts.normal_pmf(F.lit(5.0), F.lit(2.0), 10)).first()
    assert got[0] == pytest.approx([0.25, 0.5, 0.25])
    assert sum(got[1]) == pytest.approx(1) and got[1][5] == max(got[1])


def test_binomial_tail(spark):
    got = spark.range(1).select(testing.binomial_tail(F.lit(3).cast("long"), F.lit(5).cast("long"), F.lit(0.5)), testing.binomial_tail(F.lit(0).cast("long"), F.lit(4).cast("long"), F.lit(0.5)), testing.binomial_tail(F.lit(4).cast("long"), F.lit(4).cast("long"), F.lit(0.5))).first()
    assert list(got) == pytest.approx([0.5, 1.0, 0.0625])


def test_bootstrap_covers_the_mean(spark, sf_dir):
    got = QUERIES["bootstrap_interval"](spark, sf_dir).toPandas()
    means = QUERIES["roi_test"](spark, sf_dir).toPandas().set_index("season")
    for r in got.itertuples():
        assert r.draws == 200 and r.low < means.loc[r.season, "roi"] < r.high


def test_samples(spark, sf_dir):
    """A sample and a resample repeat exactly and have the size that they should."""
    games = QUERIES["star_modifiers"](spark, sf_dir).count()
    for name, low, high in (("sampled", 0.07, 0.13), ("resampled", 1, 1)):
        a, b = (QUERIES[name](spark, sf_dir).toPandas().sort_values(["game_id"]).reset_index(drop=True) for _ in range(2))
        assert low * games <= len(a) <= high * games and a["game_id"].tolist() == b["game_id"].tolist()
    assert not a["game_id"].is_unique


def test_approximate_distinct_is_within_its_error(spark, sf_dir):
    exact = QUERIES["distinct_users"](spark, sf_dir).toPandas().set_index("event_type")["users"]
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for r in events.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("n")).collect():
        assert abs(r.n - exact[r.event_type]) <= max(2, 0.1 * exact[r.event_type])


def test_models_recover_what_made_the_data(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    data = [(1, "end", int(a), int(b), int(i % 2), float(2 + 0.3 * a + rng.normal(0, 0.1)), 12.0, float(10 * (2 + 0.3 * a))) for i, (a, b) in enumerate(rng.integers(0, 6, (400, 2))) if a != b]
    rows = spark.createDataFrame(data, "season int, cutoff string, team long, opponent long, is_home int, rate double, weight double, y double")
    assert ratings.ratings_at(rows).toPandas().sort_values("attack")["team"].tolist() == list(range(6))
    mixed = ratings.mixed_model(rows).toPandas().sort_values("effect")
    assert mixed["team"].tolist() == list(range(6)) and (mixed["se"] > 0).all() and (mixed["blended"].abs() <= mixed["effect"].abs() + 1e-9).all()
    line = ratings.huber_line(spark.createDataFrame([(float(i), 2.0 * i + 1 + (1000 if i == 50 else 0)) for i in range(100)], "x double, y double"), ["x"], "y")
    assert line["x"] == pytest.approx(2, abs=0.05)


def test_model_queries(spark, sf_dir):
    clusters = QUERIES["style_clusters"](spark, sf_dir).toPandas()
    assert clusters["cluster"].nunique() == 5 and not clusters.duplicated(["team", "season"]).any()
    axes = QUERIES["style_axes"](spark, sf_dir).toPandas()
    assert axes.groupby("axis")["loading"].apply(lambda x: math.isclose((x**2).sum(), 1)).all()
    for name, columns in (("possession_ratings", ["attack", "defence", "pace"]), ("adjusted_effects", ["effect", "se", "blended"])):
        got = QUERIES[name](spark, sf_dir).toPandas()
        assert len(got) and got[columns].notna().all(axis=None)
    assert len({tuple(x.items()) for x in ratings.random_search({"a": (0, 1)}, 5)}) == 5


def test_boosted_forecasts_are_of_later_seasons(spark, sf_dir):
    got = QUERIES["boosted_totals"](spark, sf_dir).toPandas()
    assert got["game_id"].is_unique and got["forecast"].between(0, 120).all() and got["season"].min() > 1992


def test_fitted_curves_recover_their_parameters(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, 6000)
    y = 1.0 + 2.0 * x + rng.normal(0, 1.5, 6000)
    df = spark.createDataFrame([(float(a), float(max(b, 0)), bool(c)) for a, b, c in zip(x, y, rng.normal(0, 1, 6000) < 0.3 + 0.8 * x, strict=True)], "x double, y double, hit boolean")
    p = testing.probit(df, ["x"], "hit")
    assert p["intercept"] == pytest.approx(0.3, abs=0.08) and p["x"] == pytest.approx(0.8, abs=0.08)
    t = testing.tobit(df, "x", "y")
    assert t["intercept"] == pytest.approx(1, abs=0.15) and t["slope"] == pytest.approx(2, abs=0.15) and t["sigma"] == pytest.approx(1.5, abs=0.15)
