"""Queries of deep payloads, ordered table functions and closing pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query, rounded
from ..sources import scoreboard as sb
from ..sources.files import child_sizes, child_tables
from ..sources.offerings import changed_offerings
from ..sources.proxy import table
from ..streaming.stateful import closing_pairs_batch

_DEEP = "STRUCT<lines: ARRAY<STRUCT<n: BIGINT, part: STRUCT<id: BIGINT, name: BIGINT>, tags: ARRAY<STRING>, splits: ARRAY<STRUCT<period: BIGINT, odds: ARRAY<STRUCT<book: STRING, price: DOUBLE>>>>>>, meta: STRUCT<customer: BIGINT>>"


def deep_payloads(spark, sf):
    """A JSON text an order: its lines, each with tags and splits, each split with odds."""
    odds = "transform(sequence(1, 1 + l_partkey % 2), b -> struct(concat('b', b) AS book, CAST(l_quantity + b + s AS DOUBLE) AS price))"
    line = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS game_id", f"struct(l_linenumber AS n, struct(l_partkey AS id, l_suppkey AS name) AS part, CASE WHEN l_linenumber % 3 = 0 THEN array() ELSE array(l_returnflag, l_linestatus) END AS tags, transform(sequence(1, 1 + l_suppkey % 3), s -> struct(s AS period, {odds} AS odds)) AS splits) AS line"
    )
    per = line.groupBy("game_id").agg(F.array_sort(F.collect_list("line")).alias("lines"), F.max("game_id").alias("c"))
    return per.select("game_id", F.to_json(F.struct("lines", F.struct(F.col("c").alias("customer")).alias("meta"))).alias("payload"))


def _deep(spark, sf):
    return deep_payloads(spark, sf).select("game_id", F.from_json("payload", _DEEP).alias("p")).select("game_id", "p.*")


def _children(spark, sf):
    return child_tables(_deep(spark, sf), ["game_id"], "game")


_PLACED = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem"


@query(f"""WITH l AS ({_PLACED}), s AS (SELECT *, unnest(range(1, 2 + l_suppkey % 3)) AS p FROM l) SELECT l_orderkey AS game_id, i AS lines_idx, p AS splits_idx, b AS odds_idx, 'b' || b AS book, (l_quantity + b + p)::DOUBLE AS price FROM (SELECT *, unnest(range(1, 2 + l_partkey % 2)) AS b FROM s)""")
def third_level_children(spark, sf):
    """Odds of splits of lines of payloads: a table three arrays deep, keyed by the places of all its parents."""
    out = _children(spark, sf)["game__lines__splits__odds"]
    return out.select("game_id", *(F.col(c).cast("long").alias(c) for c in ("lines_idx", "splits_idx", "odds_idx")), "book", "price")


@query(f"""WITH l AS ({_PLACED}) SELECT path, n::BIGINT AS n, columns::INT AS columns FROM (SELECT 'game' AS path, count(DISTINCT l_orderkey) AS n, 2 AS columns FROM l UNION ALL SELECT 'game__lines', count(*), 5 FROM l UNION ALL SELECT 'game__lines__tags', count(*) FILTER (l_linenumber % 3 <> 0) * 2, 4 FROM l
 UNION ALL SELECT 'game__lines__splits', sum(1 + l_suppkey % 3), 4 FROM l UNION ALL SELECT 'game__lines__splits__odds', sum((1 + l_suppkey % 3) * (1 + l_partkey % 2)), 6 FROM l)""")
def child_table_sizes(spark, sf):
    """Rows and columns of every table that the walk over the payloads' structure makes."""
    deep = _deep(spark, sf)
    columns = {path: len(t.columns) for path, t in child_tables(deep, ["game_id"], "game").items()}
    sizes = child_sizes(deep, "game")
    return sizes.select("path", "n", F.element_at(F.create_map(*(F.lit(x) for pair in columns.items() for x in pair)), F.col("path")).alias("columns"))


@query("""WITH l AS (SELECT l_orderkey AS game_id, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey AS captured, 'k' || (l_suppkey % 2) AS book, l_quantity AS q, l_partkey AS k FROM lineitem),
 o AS (SELECT game_id, captured, book, 'event' AS period, 'spread' AS market, 'home' AS side, (q::BIGINT // 10)::DOUBLE AS value FROM l UNION ALL SELECT game_id, captured, book, 'event', 'total', 'over', (k % 2)::DOUBLE FROM l),
 w AS (SELECT *, lag(value) OVER s AS was, row_number() OVER s = 1 AS first FROM o WINDOW s AS (PARTITION BY game_id, book, market, side ORDER BY captured)) SELECT game_id, captured, book, period, market, side, value, first FROM w WHERE first OR value <> was""")
def offering_changes(spark, sf):
    """Offerings of nested snapshots where they differ from the snapshot before."""
    payload = "to_json(map(concat('k', l_suppkey % 2), map('event', map('spread', map('home', CAST(CAST(l_quantity AS BIGINT) div 10 AS DOUBLE)), 'total', map('over', CAST(l_partkey % 2 AS DOUBLE))))))"
    rows = table(spark, sf, "lineitem").selectExpr("l_orderkey AS game_id", "CAST(l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey AS BIGINT) AS captured", f"{payload} AS payload")
    return changed_offerings(rows, ["game_id"], ["captured"])


_TICKS = """t AS (SELECT l_orderkey AS event, o_orderdate::TIMESTAMP + INTERVAL 60 DAY AS kickoff, CASE WHEN l_suppkey % 2 = 0 THEN 'over' ELSE 'under' END AS side, l_shipdate::TIMESTAMP AS ts, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey AS tick_id, (40 + l_partkey % 2)::DOUBLE AS line, (-100 - l_quantity)::DOUBLE AS price,
 CASE WHEN l_partkey % 9 = 0 THEN 'suspended' WHEN l_partkey % 5 = 0 THEN NULL ELSE 'normal' END AS status FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def pair_ticks(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey", "CAST(o_orderdate AS TIMESTAMP) + INTERVAL 60 DAY AS kickoff")
    rows = table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.selectExpr(
        "l_orderkey AS event", "kickoff", "CASE WHEN l_suppkey % 2 = 0 THEN 'over' ELSE 'under' END AS side", "CAST(l_shipdate AS TIMESTAMP) AS ts", "CAST(l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey AS BIGINT) AS tick_id", "CAST(40 + l_partkey % 2 AS DOUBLE) AS line",
        "CAST(-100 - l_quantity AS DOUBLE) AS price", "CASE WHEN l_partkey % 9 = 0 THEN 'suspended' WHEN l_partkey % 5 = 0 THEN NULL ELSE 'normal' END AS status",
    )


@query(f"""WITH {_TICKS}, r AS (SELECT * FROM t WHERE ts <= kickoff QUALIFY row_number() OVER (PARTITION BY event, side ORDER BY ts DESC, tick_id DESC) = 1)
 SELECT o.event, o.line, round(o.price, 6) AS over_price, round(u.price, 6) AS under_price FROM r o JOIN r u ON u.event = o.event AND o.side = 'over' AND u.side = 'under' WHERE o.line = u.line AND coalesce(o.status, 'normal') = 'normal' AND coalesce(u.status, 'normal') = 'normal'""")
def closing_pair(spark, sf):
    """Both sides' last quotes as of the kickoff, where both are valid and stand at one line."""
    return closing_pairs_batch(pair_ticks(spark, sf)).select("event", "line", rounded("over_price").alias("over_price"), rounded("under_price").alias("under_price"))


def board_payloads(spark, sf):
    """Scoreboard files of fifty games each, as variants; some games lack their season, some points are text."""
    points = "CASE WHEN o_orderkey % 29 = 0 THEN 'n/a' ELSE CAST(o_orderkey * 31 % 57 AS STRING) END"
    offer = lambda side, value: f"named_struct('side', '{side}', 'value', {value}, 'odds', -110, 'type', CASE WHEN o_orderkey % 5 = 0 THEN 'alt' END)"
    game = f"""to_json(named_struct('id', CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey END, 'core_id', o_orderkey, 'season', CASE WHEN o_orderkey % 3 = 0 THEN year(o_orderdate) END, 'status', o_orderstatus, 'boxscore', named_struct('total_home_points', {points}, 'total_away_points', o_orderkey * 17 % 50, 'linescore', array(named_struct('id', 1, 'home_points', o_orderkey % 9), named_struct('id', 2, 'home_points', o_orderkey % 8))),
 'teams', array(named_struct('id', o_custkey % 40, 'standings', named_struct('win', o_orderkey % 12)), named_struct('id', o_custkey % 40 + 1, 'standings', named_struct('win', 0))), 'markets', map(CAST(o_custkey % 6 AS STRING), map('event', map('total', array({offer('over', 'CAST(40 + o_orderkey % 20 AS DOUBLE)')}, {offer('under', 'CAST(40 + o_orderkey % 20 AS DOUBLE)')})))) ))"""
    rows = table(spark, sf, "orders").selectExpr("o_orderkey div 50 AS f", f"{game} AS g")
    files = rows.groupBy("f").agg(F.concat(F.lit('{"games": ['), F.array_join(F.sort_array(F.collect_list("g")), ", "), F.lit("]}")).alias("t"))
    return files.select(F.parse_json("t").alias("payload"), F.lit(1900).alias("season"), (F.col("f") % 15).cast("int").alias("week"), F.lit("regular").alias("season_type"), F.concat(F.lit("board_"), "f").alias("source_file"))


@query("""SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 3 = 0 THEN year(o_orderdate) ELSE 1900 END::INT AS season, (o_orderkey // 50 % 15)::INT AS week, o_orderstatus AS status, CASE WHEN o_orderkey % 29 <> 0 THEN o_orderkey * 31 % 57 END::INT AS home_points, (o_orderkey * 17 % 50)::INT AS away_points, concat('board_', o_orderkey // 50) AS source_file FROM orders""")
def scoreboard_games(spark, sf):
    """The main table of the scoreboard: a row a game, own season before the file's, text where a number should be as null."""
    return sb.scoreboard(board_payloads(spark, sf)).select("event_id", "season", "week", "status", "home_points", "away_points", "source_file")


@query("""SELECT o_orderkey AS event_id, (o_custkey % 6)::BIGINT AS book_id, 'event' AS period, CASE WHEN o_orderkey % 5 = 0 THEN 'alt' ELSE 'total' END AS market, unnest(['over', 'under']) AS side, (40 + o_orderkey % 20)::DOUBLE AS line, -110 AS odds FROM orders""")
def scoreboard_markets(spark, sf):
    """Offers of the scoreboard, from the maps of books, periods and markets."""
    return sb.markets(sb.scoreboard(board_payloads(spark, sf))).select("event_id", "book_id", "period", "market", "side", "line", "odds")
