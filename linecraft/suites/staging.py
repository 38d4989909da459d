"""Queries of the staging layer: payloads are built from the tables and taken apart again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..registry import query
from ..session import dealt
from ..sources import flatten as fl
from ..sources.files import child_table, flatten, promote_timestamps
from ..sources.proxy import ctes, made, table

TICKS = "SELECT l_orderkey AS game_id, concat('B', l_suppkey % 3) AS book, CASE WHEN l_partkey % 2 = 0 THEN 'full' ELSE 'half' END AS period, CASE WHEN l_partkey % 3 = 0 THEN 'total' ELSE 'spread' END AS market, CASE WHEN l_linenumber % 2 = 0 THEN 'over' ELSE 'under' END AS side, CAST(l_linenumber * 100 AS BIGINT) AS moment, l_quantity AS line FROM {lineitem}"


def _object(df, key, name, value, to):
    """Rows of one parent as a JSON object text."""
    pair = F.concat(F.lit('"'), F.col(name), F.lit('": '), F.col(value))
    return df.groupBy(*key).agg(F.concat(F.lit("{"), F.array_join(F.collect_list(pair), ", "), F.lit("}")).alias(to))


def _payloads(spark, sf):
    t = dealt(made(spark, sf, TICKS), "game_id")
    tick = F.concat(F.lit('{"moment": '), "moment", F.lit(', "line": '), "line", F.lit("}"))
    offers = t.groupBy("game_id", "book", "period", "market", "side").agg(F.array_join(F.collect_list(tick), ", ").alias("h"))
    offer = F.concat(F.lit('{"side": "'), "side", F.lit('", "history": ['), "h", F.lit("]}"))
    m = offers.groupBy("game_id", "book", "period", "market").agg(F.concat(F.lit("["), F.array_join(F.collect_list(offer), ", "), F.lit("]")).alias("m"))
    p = _object(m, ["game_id", "book", "period"], "market", "m", "p")
    b = _object(p, ["game_id", "book"], "period", "p", "b")
    return _object(b, ["game_id"], "book", "b", "text").select("game_id", F.parse_json("text").alias("payload"))


@query(f"WITH {ctes(t=TICKS)} SELECT DISTINCT game_id, book, period, market, side, moment, line FROM t")
def tick_flatten(spark, sf):
    """Nested tick payloads, every tick once."""
    return fl.tick_flatten(_payloads(spark, sf))


@query(f"WITH {ctes(t=TICKS)}, d AS (SELECT DISTINCT game_id, book, period, market, side, moment, line FROM t) SELECT game_id, book, period, market, max(line) FILTER (side = 'over') AS over, max(line) FILTER (side = 'under') AS under, count(*) AS ticks FROM d GROUP BY ALL")
def offering_unpivot(spark, sf):
    """Both sides of an offer in one row."""
    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("line")))
    return fl.tick_flatten(_payloads(spark, sf)).groupBy("game_id", "book", "period", "market").agg(pick("over").alias("over"), pick("under").alias("under"), F.count(F.lit(1)).alias("ticks"))


@query("SELECT l_orderkey AS game_id, concat('B', l_suppkey % 3) AS book, CASE WHEN l_linenumber % 4 = 0 THEN 'home' WHEN l_linenumber % 4 = 1 THEN 'away' WHEN l_linenumber % 4 = 2 THEN 'over' ELSE 'under' END AS side, l_partkey AS price, l_quantity AS point FROM lineitem")
def snapshot_flatten(spark, sf):
    """Outcomes of odds snapshots with their side."""
    t = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("game_id"), F.concat(F.lit("B"), F.col("l_suppkey") % 3).alias("book"), F.expr("CASE WHEN l_linenumber % 4 = 0 THEN concat('T', l_orderkey) WHEN l_linenumber % 4 = 1 THEN concat('U', l_orderkey) WHEN l_linenumber % 4 = 2 THEN 'Over' ELSE 'UNDER' END").alias("name"), F.col("l_partkey").alias("price"), F.col("l_quantity").alias("point"))
    books = t.groupBy("game_id", "book").agg(F.collect_list(F.struct("name", "price", "point")).alias("outcomes"))
    raw = books.groupBy("game_id").agg(F.collect_list(F.struct("book", "outcomes")).alias("books"))
    return fl.snapshot_flatten(raw.select("game_id", F.concat(F.lit("T"), "game_id").alias("home"), F.concat(F.lit("U"), "game_id").alias("away"), "books"))


@query("SELECT p_partkey AS player, unnest(['left', 'left_deep', NULL]) AS split, unnest(['grade', 'grade', 'snaps']) AS metric, unnest([p_size::DOUBLE, p_retailprice, p_size * 2.0]) AS value FROM part WHERE p_size IS NOT NULL")
def grade_splits(spark, sf):
    """Wide splits to (split, metric, value), the longest split name first."""
    wide = table(spark, sf, "part").select(F.col("p_partkey").alias("player"), F.col("p_size").alias("left_grade"), F.col("p_retailprice").alias("left_deep_grade"), (F.col("p_size") * 2.0).alias("snaps"))
    return fl.split_metrics(wide, ["player"], ["left", "left_deep"])


@query("SELECT o_orderkey AS row_id, 'S' || k AS system, ((o_custkey + k) % 130)::INT AS rank FROM orders, (SELECT unnest([0, 1, 2]) AS k) WHERE (o_orderkey + k) % 7 <> 0")
def system_ranks(spark, sf):
    """Columns of many ranking systems as rows; blanks are left out."""
    raw = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.array(*(F.lit(f"S{k}") for k in range(3))).alias("systems"), F.array(*(F.expr(f"CASE WHEN (o_orderkey + {k}) % 7 <> 0 THEN CAST((o_custkey + {k}) % 130 AS STRING) ELSE '--' END") for k in range(3))).alias("ranks"))
    return fl.system_ranks(raw, ["row_id"], "systems", "ranks")


SNAPSHOTS = "SELECT CAST(l_shipdate AS DATE) AS day, l_orderkey AS game_id, max(l_quantity) AS wind FROM {lineitem} GROUP BY CAST(l_shipdate AS DATE), l_orderkey"


@query(f"WITH {ctes(s=SNAPSHOTS)}, a AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY day DESC) AS r, date_diff('hour', day::TIMESTAMP, TIMESTAMP '1998-06-01 00:00:00') AS age_hours FROM s WHERE day <= DATE '1998-06-01') SELECT game_id, wind, age_hours, age_hours > 5000 AS stale FROM a WHERE r = 1")
def newest_forecast(spark, sf):
    """The newest snapshot of every game, with its age."""
    s = made(spark, sf, SNAPSHOTS).groupBy(F.col("day").cast("timestamp_ntz").alias("taken_at")).agg(F.collect_list(F.struct("game_id", "wind")).alias("games"))
    return fl.newest_forecast(s, "1998-06-01 00:00:00", 5000).select("game_id", "wind", F.col("age_hours").cast("long").alias("age_hours"), "stale")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN p_size::DOUBLE END AS mixed, p_name AS name FROM part")
def nan_retype(spark, sf):
    """A text column of numbers and NaN becomes a number column; one of names stays."""
    raw = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 == 0, "NaN").otherwise(F.col("p_size").cast("string")).alias("mixed"), F.col("p_name").alias("name"))
    return fl.numbers_or_nan(raw, ["mixed", "name"])


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE k::VARCHAR END AS key, CASE WHEN event_id % 3 = 2 THEN '{\"a\":' || user_id || '}' ELSE (user_id + k)::VARCHAR END AS value FROM events, (SELECT unnest([0, 1]) AS k) WHERE event_id % 3 <> 2 OR k = 0")
def json_members(spark, sf):
    """Arrays and objects with numeric keys become rows, other values stay whole."""
    e = table(spark, sf, "events").selectExpr("event_id", "CASE WHEN event_id % 3 = 0 THEN concat('[', user_id, ',', user_id + 1, ']') WHEN event_id % 3 = 1 THEN concat('{\"0\":', user_id, ',\"1\":', user_id + 1, '}') ELSE concat('{\"a\":', user_id, '}') END AS j")
    return fl.explode_json(e, "j", ["event_id"]).select("event_id", "key", F.col("value").cast("string").alias("value"))


@query("SELECT event_id, event_type AS kind, CASE WHEN event_id % 100 = 0 THEN user_id END AS rare, value AS \"deep.x\" FROM events")
def structure_inference(spark, sf):
    """Members that few rows have are found too: the structure is merged from all rows."""
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 100 == 0, F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("rare"), F.struct(F.col("value").alias("x")).alias("deep")))).otherwise(F.to_json(F.struct(F.col("event_type").alias("kind"), F.struct(F.col("value").alias("x")).alias("deep")))).alias("j"))
    out = fl.infer_struct(e, "j")
    return out.select("event_id", "kind", F.col("rare").cast("long").alias("rare"), F.col("deep.x").cast("double").alias("deep.x"))


@query("SELECT o_orderkey AS game_id, o_totalprice AS venue_capacity, o_custkey AS venue_city_id, unnest(['home', 'away']) AS side, unnest([o_custkey % 40, (o_custkey * 7) % 40]) AS sides_team, unnest([1, 2]::INT[]) AS sides_idx FROM orders")
def explode_payloads(spark, sf):
    """Nested objects as underscored columns, a list as a child table with 1-based places."""
    o = table(spark, sf, "orders")
    raw = o.select(F.col("o_orderkey").alias("game_id"), F.struct(F.col("o_totalprice").alias("capacity"), F.struct(F.col("o_custkey").alias("id")).alias("city")).alias("venue"), F.array(F.struct(F.lit("home").alias("side"), F.expr("o_custkey % 40").alias("team")), F.struct(F.lit("away").alias("side"), F.expr("(o_custkey * 7) % 40").alias("team"))).alias("sides"))
    out = child_table(flatten(raw), "sides", ["game_id", "venue_capacity", "venue_city_id"])
    return out.withColumnRenamed("sides_side", "side").select("game_id", "venue_capacity", "venue_city_id", "side", "sides_team", "sides_idx")


BOARD = "SELECT l_orderkey AS game_id, l_linenumber AS n, l_suppkey % 40 AS team, l_quantity AS score, l_partkey AS p FROM {lineitem}"


@query(f"WITH {ctes(b=BOARD)}, q AS (SELECT game_id, n, team, unnest([p % 7, p % 11, p % 13]) AS points, unnest([1, 2, 3]::BIGINT[]) AS period FROM b) SELECT game_id, period, count(*) AS teams, sum(points)::BIGINT AS points FROM q GROUP BY ALL")
def scoreboard_children(spark, sf):
    """Line scores by period, from the nested scoreboard."""
    b = made(spark, sf, BOARD)
    g = b.groupBy("game_id").agg(F.collect_list(F.struct(F.col("n").alias("market"), F.col("score").alias("line"))).alias("markets"), F.collect_list(F.struct("team", "score", F.array(F.col("p") % 7, F.col("p") % 11, F.col("p") % 13).alias("periods"))).alias("teams"))
    lines = fl.scoreboard_children(g)[2]
    return lines.groupBy("game_id", "period").agg(F.count(F.lit(1)).alias("teams"), F.sum("points").alias("points"))


VENDOR = "SELECT l_orderkey AS game_id, concat('B', l_suppkey % 5) AS book, max(CASE WHEN l_partkey % 3 <> 0 THEN l_quantity END) AS spread, max(CASE WHEN l_partkey % 4 <> 0 THEN l_quantity + 30 END) AS total FROM {lineitem} WHERE l_linenumber <= 3 GROUP BY l_orderkey, concat('B', l_suppkey % 5)"
BOARD_LINES = "SELECT l_orderkey AS game_id, concat('B', l_suppkey % 5) AS book, CASE WHEN l_partkey % 2 = 0 THEN 'spread' ELSE 'total' END AS market, l_quantity AS line FROM {lineitem} WHERE l_linenumber = 4"
HISTORY = "SELECT l_orderkey AS game_id, concat('B', l_suppkey % 5) AS book, CASE WHEN l_partkey % 2 = 0 THEN 'spread' ELSE 'total' END AS market, l_quantity AS line, l_partkey % 3 = 0 AS live FROM {lineitem} WHERE l_linenumber >= 5"


@query(f"WITH {ctes(v=VENDOR, s=BOARD_LINES, h=HISTORY)}, t AS (SELECT game_id, book, market, line FROM s UNION ALL SELECT game_id, book, market, line FROM h WHERE NOT live), w AS (SELECT game_id, book, max(line) FILTER (market = 'spread') AS sp, max(line) FILTER (market = 'total') AS tt FROM t GROUP BY ALL) SELECT game_id, book, coalesce(v.spread, w.sp) AS spread, coalesce(v.total, w.tt) AS total, CASE WHEN v.own IS NOT NULL AND w.game_id IS NOT NULL THEN 'both' WHEN v.own IS NOT NULL THEN 'vendor' ELSE 'tape' END AS line_source FROM (SELECT *, 1 AS own FROM v) v FULL JOIN w USING (game_id, book)")
def line_backfill(spark, sf):
    return fl.backfill_lines(*(made(spark, sf, x) for x in (VENDOR, BOARD_LINES, HISTORY)))


@query("SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'ohio state' WHEN 1 THEN 'saint marys' WHEN 2 THEN 'san jose state' ELSE 'texas a m' END AS name, CASE c_custkey % 4 WHEN 0 THEN 'ohio st' WHEN 1 THEN 'st marys' WHEN 2 THEN 'san jose state' ELSE 'texas a m' END AS bare FROM customer")
def name_normalisers(spark, sf):
    """Accents, apostrophes, punctuation, St and mascots of team names."""
    raw = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'Ohio St.' WHEN 1 THEN 'St. Mary''s' WHEN 2 THEN 'San José State' ELSE 'Texas A&M' END")
    full = F.concat(raw, F.when(F.col("c_custkey") % 2 == 0, " Golden Bears").otherwise(" Bears"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), raw.alias("raw"), full.alias("full"))
    return c.select("id", names.school(F.col("raw")).alias("name"), names.without_mascot(F.col("full"), ["Bears", "Golden Bears"]).alias("bare"))


KNOWN = "SELECT concat('N', c_custkey % 300) AS name, c_custkey % 350 AS id, c_custkey % 3 = 0 AS alternate FROM {customer} WHERE c_custkey % 300 < 250"
ASKED = "SELECT o_orderkey AS ask, concat('N', o_orderkey % 300) AS name FROM {orders}"


@query(f"WITH {ctes(k=KNOWN, a=ASKED)}, p AS (SELECT name, count(DISTINCT id) FILTER (NOT alternate) AS ne, min(id) FILTER (NOT alternate) AS e, count(DISTINCT id) FILTER (alternate) AS na, min(id) FILTER (alternate) AS alt FROM k GROUP BY name) SELECT ask, a.name, CASE WHEN ne = 1 THEN 'exact' WHEN ne > 1 THEN 'ambiguous' WHEN na = 1 THEN 'alternate' WHEN na > 1 THEN 'ambiguous' ELSE 'unknown' END AS how, CASE WHEN ne = 1 THEN e WHEN ne = 0 AND na = 1 THEN alt END AS id FROM a LEFT JOIN p ON p.name = a.name")
def name_resolution(spark, sf):
    return fl.resolve_names(made(spark, sf, ASKED), made(spark, sf, KNOWN), "name")


@query("SELECT o_orderkey AS id, o_orderdate AS game_date, CASE WHEN o_orderkey % 50 = 0 THEN 'soon' ELSE o_orderdate::VARCHAR END AS tip_time FROM orders")
def timestamp_promotion(spark, sf):
    """A text column named like a date becomes a timestamp only if all its values parse."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("game_date"), F.when(F.col("o_orderkey") % 50 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("tip_time"))
    return promote_timestamps(o).withColumn("game_date", F.col("game_date").cast("timestamp_ntz"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 2000 + user_id % 20 ELSE 2023 END::INT AS season, CASE WHEN event_id % 3 = 0 THEN user_id % 15 ELSE 7 END::INT AS week FROM events")
def spine_merge(spark, sf):
    """Season and week from the payload, from the file name only where the payload lacks them."""
    e = table(spark, sf, "events").selectExpr("event_id", "parse_json(concat('{', CASE WHEN event_id % 2 = 0 THEN concat('\"season\": ', 2000 + user_id % 20) ELSE '\"x\": 1' END, CASE WHEN event_id % 3 = 0 THEN concat(', \"week\": ', user_id % 15) ELSE '' END, '}')) AS payload")
    return fl.spine(e, F.lit(2023), F.lit(7)).select("event_id", "season", "week")
