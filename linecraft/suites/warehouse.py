"""Queries of the dimensional model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.running import team_games
from ..plans import warehouse as w
from ..registry import query, rounded
from ..sources import lines
from ..sources.proxy import ctes, games, line_tape, made, table
from .joins import TEAM_GAMES_SQL

# raw tables, made alike in both engines
WEEKS = "SELECT season, week, season_type, CASE WHEN game_id % 17 <> 0 THEN kickoff END AS starts, game_id AS ends FROM {games}"
CONFERENCES = "SELECT DISTINCT home_team % 6 AS id, concat('C', home_team % 6) AS conference FROM {games} WHERE home_team % 6 < 5"
DIVISIONS = "SELECT n_nationkey AS id, concat('D', n_regionkey) AS division FROM {nation} WHERE n_nationkey % 2 = 0"
TEAMS = "SELECT DISTINCT home_team AS team, season, concat('C', (home_team + season) % 6) AS conference FROM {games}"
MEMBERS = "SELECT DISTINCT home_team AS team, season FROM {games} WHERE (home_team + season) % 3 <> 0"
VENUES = "SELECT s_suppkey AS venue, s_name AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'unknown' ELSE CAST(s_suppkey * 3 % 2000 AS STRING) END AS elevation, s_suppkey % 7 = 0 AS dome FROM {supplier}"
BOOKS = "SELECT game_id, CASE provider WHEN 1 THEN 'DraftKings' WHEN 2 THEN 'DK' WHEN 3 THEN 'FanDuel' WHEN 4 THEN 'FD' ELSE concat('B', provider) END AS book, pos, CASE WHEN pos = 4 AND game_id % 3 = 0 THEN CAST('NaN' AS DOUBLE) ELSE spread END AS spread, total FROM {line_tape}"
PICKS_A = "SELECT o_orderkey % 7 AS season, o_orderkey % 11 AS round, o_custkey AS pick, max(o_orderkey) AS athlete, min(o_totalprice) AS grade FROM {orders} WHERE o_orderkey % 3 <> 0 GROUP BY o_orderkey % 7, o_orderkey % 11, o_custkey"
PICKS_B = "SELECT o_orderkey % 7 AS season, o_orderkey % 11 AS round, o_custkey AS pick, max(o_orderkey) AS athlete, max(o_orderpriority) AS position FROM {orders} WHERE o_orderkey % 4 <> 0 GROUP BY o_orderkey % 7, o_orderkey % 11, o_custkey"
RECRUITS_A = "SELECT CASE WHEN c_custkey % 50 = 0 THEN 'none' ELSE CAST(c_custkey AS STRING) END AS recruit, c_name AS name, c_acctbal AS rating FROM {customer} WHERE c_custkey % 3 <> 0"
RECRUITS_B = "SELECT c_custkey AS recruit, c_mktsegment AS position, c_acctbal / 2 AS rating FROM {customer} WHERE c_custkey % 4 <> 0"
TALENT_A = "SELECT home_team AS team, season, CAST(home_team * 31 % 100 AS DOUBLE) AS talent FROM {games} WHERE home_team % 5 <> 0"
TALENT_B = "SELECT DISTINCT away_team AS team, season, CAST(away_team * 31 % 90 AS DOUBLE) AS talent FROM {games} WHERE away_team % 4 <> 0"
COACHES = "SELECT DISTINCT concat('Coach ', (home_team * 3 + season) % 55) AS coach, home_team AS team, season FROM {games}"
COACH_A = "SELECT concat('Coach ', (home_team * 3 + season) % 60) AS coach, home_team AS team, season, count(*) AS wins FROM {games} WHERE home_team % 7 <> 0 GROUP BY home_team, season"
COACH_B = "SELECT concat('Coach ', (home_team * 3 + season) % 60) AS coach, home_team AS team, season, count(*) - 1 AS wins FROM {games} WHERE home_team % 5 <> 0 GROUP BY home_team, season"
COACH_NAMES = "SELECT DISTINCT concat('Coach ', home_team) AS coach, CASE WHEN home_team % 8 = 0 THEN season ELSE home_team END AS id FROM {games}"
COACH_TEAMS = "SELECT DISTINCT home_team AS team FROM {games} WHERE home_team % 9 <> 0"
RATING_A = "SELECT home_team AS team, season, CAST(count(*) AS DOUBLE) AS rating, sum(home_points) AS offense FROM {games} WHERE home_team % 3 <> 0 GROUP BY home_team, season"
RATING_B = "SELECT away_team AS team, season, CAST(sum(away_points) AS DOUBLE) AS rating FROM {games} WHERE away_team % 4 <> 0 GROUP BY away_team, season"
RATING_C = "SELECT home_team AS team, season, max(total) AS elo FROM {games} WHERE season > 1993 GROUP BY home_team, season"
RECRUITING = "SELECT home_team AS team, season, sum(home_team * 7 % 30 + week) AS recruiting_points FROM {games} WHERE home_team % 8 <> 0 GROUP BY home_team, season"
RETURNING = "SELECT away_team AS team, season, round(CAST(count(*) AS DOUBLE) / 1024, 6) AS returning_share FROM {games} WHERE away_team % 6 <> 0 GROUP BY away_team, season"
WEATHER_A = "SELECT game_id, CAST(game_id % 60 AS DOUBLE) AS temperature, CASE WHEN game_id % 4 <> 0 THEN CAST(game_id % 25 AS DOUBLE) END AS wind FROM {games} WHERE game_id % 3 <> 0"
WEATHER_B = "SELECT game_id, CAST(game_id % 61 AS DOUBLE) AS temperature, CAST(game_id % 23 AS DOUBLE) AS wind, CAST(game_id % 7 AS DOUBLE) AS rain FROM {games} WHERE game_id % 5 <> 0"
NAMES = "SELECT DISTINCT home_team AS team, concat('School ', home_team) AS name FROM {games} WHERE home_team % 10 <> 0"
POLLS = "SELECT season, week, concat('P', game_id % 2) AS poll, concat('School ', home_team) AS name, home_team % 25 + 1 AS rank FROM {games}"
DRIVES = "SELECT l_orderkey AS game_id, l_linenumber AS drive, concat('School ', l_suppkey % 40) AS offense, concat('School ', l_partkey % 45) AS defense, l_quantity AS yards FROM {lineitem}"
SITES = ["B6", "B7"]


def _books(spark, sf):
    return w.clean_lines(made(spark, sf, BOOKS), ("spread", "total"))


_BOOKS_SQL = f"""{ctes(raw_books=BOOKS)}, named AS (SELECT game_id, CASE book WHEN 'DK' THEN 'DraftKings' WHEN 'draftkings' THEN 'DraftKings' WHEN 'FD' THEN 'FanDuel' ELSE book END AS book, pos, CASE WHEN NOT isnan(spread) THEN spread END AS spread, total FROM raw_books),
 books AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY game_id, book ORDER BY (spread IS NOT NULL)::INT + (total IS NOT NULL)::INT DESC, pos, spread NULLS LAST, total NULLS LAST) AS r FROM named) WHERE r = 1)"""


@query(f"WITH {ctes(weeks=WEEKS)} SELECT season, week, season_type, starts, ends FROM (SELECT *, row_number() OVER (PARTITION BY season, week, season_type ORDER BY starts NULLS LAST, ends NULLS LAST) AS r FROM weeks) WHERE r = 1")
def dim_week(spark, sf):
    return w.dim_week(made(spark, sf, WEEKS))


@query(f"WITH {ctes(rest=CONFERENCES, twin=DIVISIONS)} SELECT rest.*, division FROM rest LEFT JOIN twin USING (id)")
def dim_conference(spark, sf):
    return w.dim_conference(made(spark, sf, CONFERENCES), made(spark, sf, DIVISIONS))


@query(f"""WITH {ctes(teams=TEAMS, members=MEMBERS)} SELECT team, season, conference, team IN (SELECT team FROM members WHERE season = (SELECT max(season) FROM members)) AS is_fbs
 FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY season DESC, conference) AS r FROM teams) WHERE r = 1""")
def dim_team(spark, sf):
    return w.dim_team(made(spark, sf, TEAMS), made(spark, sf, MEMBERS))


@query(f"WITH {ctes(venues=VENUES)} SELECT venue, name, try_cast(elevation AS DOUBLE) AS elevation, dome FROM venues")
def dim_venue(spark, sf):
    return w.dim_venue(made(spark, sf, VENUES))


@query(f"WITH {_BOOKS_SQL} SELECT * FROM books")
def fact_game_line(spark, sf):
    """Lines with aliases collapsed and NaN as null, one row a (game, book)."""
    return _books(spark, sf)


@query(f"""WITH {_BOOKS_SQL}, line AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY (total IS NOT NULL)::INT DESC, pos, book) AS r FROM books WHERE book NOT IN ('B6', 'B7') AND spread IS NOT NULL) WHERE r = 1),
 conf AS (SELECT DISTINCT home_team % 6 AS id, concat('C', home_team % 6) AS conference FROM games WHERE home_team % 6 < 4)
 SELECT g.game_id, g.season, g.home_conference, g.away_conference, book, line.spread AS line_spread, line.total AS line_total, line.spread IS NOT NULL AS has_line,
  coalesce(h.id, g.home_team % 6 + 100) AS home_conference_id, coalesce(a.id, g.away_team % 6 + 100) AS away_conference_id
 FROM games g LEFT JOIN line USING (game_id) LEFT JOIN conf h ON h.conference = g.home_conference LEFT JOIN conf a ON a.conference = g.away_conference""")
def fact_game(spark, sf):
    """Games with selected lines and conference keys."""
    g = games(spark, sf).selectExpr("game_id", "season", "home_conference", "away_conference", "home_team % 6 + 100 AS home_own_id", "away_team % 6 + 100 AS away_own_id")
    conferences = made(spark, sf, CONFERENCES).filter("id < 4").select("conference", F.col("id").alias("conference_id"))
    return w.fact_game(g, _books(spark, sf), conferences, SITES)


@query(f"""WITH {_BOOKS_SQL}, a AS (SELECT * FROM books WHERE pos <= 4), b AS (SELECT game_id, book, spread + CASE WHEN game_id % 5 = 0 THEN 1 ELSE 0 END AS spread, total FROM books WHERE pos >= 2)
 SELECT game_id, book, 'spread' AS field, a.spread AS rest, b.spread AS gql FROM a JOIN b USING (game_id, book) WHERE a.spread <> b.spread
 UNION ALL SELECT game_id, book, 'total', a.total, b.total FROM a JOIN b USING (game_id, book) WHERE a.total <> b.total""")
def line_conflicts(spark, sf):
    """Fields on which two sources of lines disagree."""
    books = _books(spark, sf)
    b = books.filter("pos >= 2").withColumn("spread", F.col("spread") + F.when(F.col("game_id") % 5 == 0, 1).otherwise(0))
    return w.merge_lines(books.filter("pos <= 4"), b, ("spread", "total"))[1]


@query(f"""WITH {_BOOKS_SQL} SELECT game_id, count(*) FILTER (book NOT IN ('B6', 'B7')) AS books, count(*) FILTER (book IN ('B6', 'B7')) AS sites FROM books GROUP BY game_id""")
def game_projections(spark, sf):
    """Books and projection sites, split into two tables and counted."""
    tape, sites = w.split_projections(_books(spark, sf), SITES)
    both = tape.select("game_id", F.lit(1).alias("b"), F.lit(0).alias("s")).unionAll(sites.select("game_id", F.lit(0), F.lit(1)))
    return both.groupBy("game_id").agg(F.sum("b").alias("books"), F.sum("s").alias("sites"))


@query(f"""WITH {_BOOKS_SQL} SELECT book FROM raw_books UNION SELECT book FROM books UNION SELECT concat('B', o_orderkey % 9) FROM orders UNION SELECT c_mktsegment FROM customer""")
def dim_lines_provider(spark, sf):
    others = (table(spark, sf, "orders").select(F.concat(F.lit("B"), F.col("o_orderkey") % 9).alias("book")), table(spark, sf, "customer").select(F.col("c_mktsegment").alias("book")))
    return w.distinct_over("book", made(spark, sf, BOOKS), _books(spark, sf), *others)


_COACH_SQL = f"{ctes(seasons=COACHES)}, per AS (SELECT coach, min(season) AS first_season, count(*) AS seasons, list_sort(list(DISTINCT team)) AS teams FROM seasons GROUP BY coach)"


@query(f"WITH {_COACH_SQL} SELECT coach, first_season, seasons, len(teams) AS n_teams FROM per")
def dim_coach(spark, sf):
    return w.dim_coach(made(spark, sf, COACHES))[0]


@query(f"WITH {_COACH_SQL} SELECT coach, generate_subscripts(teams, 1) AS team_idx, unnest(teams) AS team FROM per WHERE len(teams) > 1")
def coach_name_conflicts(spark, sf):
    return w.dim_coach(made(spark, sf, COACHES))[1]


@query(f"""WITH {ctes(a=PICKS_A, b=PICKS_B)} SELECT season, round, pick, grade, position, coalesce(a.athlete, b.athlete) AS athlete, CASE WHEN a.athlete IS NOT NULL AND b.athlete IS NOT NULL THEN 'both' WHEN a.athlete IS NOT NULL THEN 'rest' ELSE 'gql' END AS _source FROM a FULL JOIN b USING (season, round, pick)""")
def dim_draft_pick(spark, sf):
    return w.twins(made(spark, sf, PICKS_A), made(spark, sf, PICKS_B), ["season", "round", "pick"], ["athlete"])


@query(f"""WITH {ctes(a0=RECRUITS_A, b=RECRUITS_B)}, a AS (SELECT * REPLACE (try_cast(recruit AS BIGINT) AS recruit) FROM a0) SELECT coalesce(a.recruit, b.recruit) AS recruit, name, position, coalesce(a.rating, b.rating) AS rating,
 CASE WHEN a.name IS NOT NULL AND b.position IS NOT NULL THEN 'both' WHEN a.name IS NOT NULL THEN 'rest' ELSE 'gql' END AS _source FROM a FULL JOIN b ON a.recruit = b.recruit""")
def dim_recruit(spark, sf):
    """Recruits of two sources, whose keys have different types; a key that is no number matches nothing."""
    a = made(spark, sf, RECRUITS_A).withColumn("recruit", F.col("recruit").try_cast("bigint"))
    return w.twins(a, made(spark, sf, RECRUITS_B), ["recruit"], ["rating"])


@query(f"""WITH {ctes(a=TALENT_A, b=TALENT_B)}, d AS (SELECT DISTINCT * FROM a) SELECT team, season, coalesce(d.talent, b.talent) AS talent, CASE WHEN d.talent IS NOT NULL AND b.talent IS NOT NULL THEN 'both' WHEN d.talent IS NOT NULL THEN 'rest' ELSE 'gql' END AS _source FROM d FULL JOIN b USING (team, season)""")
def fact_team_talent(spark, sf):
    return w.twins(made(spark, sf, TALENT_A), made(spark, sf, TALENT_B), ["team", "season"], ["talent"], distinct="a")


_CS = f"""{ctes(a=COACH_A, b=COACH_B, names=COACH_NAMES, known=COACH_TEAMS)}, m AS (SELECT coach, team, season, coalesce(a.wins, b.wins) AS wins, CASE WHEN a.wins IS NOT NULL AND b.wins IS NOT NULL THEN 'both' WHEN a.wins IS NOT NULL THEN 'rest' ELSE 'gql' END AS _source FROM a FULL JOIN b USING (coach, team, season)),
 r AS (SELECT m.*, CASE WHEN (SELECT count(*) FROM names n WHERE n.coach = m.coach) = 0 THEN 'no coach' WHEN (SELECT count(*) FROM names n WHERE n.coach = m.coach) > 1 THEN 'ambiguous coach' WHEN NOT EXISTS (SELECT 1 FROM known k WHERE k.team = m.team) THEN 'no team' END AS reason FROM m)"""


def _coach_seasons(spark, sf):
    return w.coach_seasons(*(made(spark, sf, x) for x in (COACH_A, COACH_B, COACH_NAMES, COACH_TEAMS)))


@query(f"WITH {_CS} SELECT * EXCLUDE (reason) FROM r WHERE reason IS NULL")
def fact_coach_season(spark, sf):
    return _coach_seasons(spark, sf)[0]


@query(f"WITH {_CS} SELECT * FROM r WHERE reason IS NOT NULL")
def coach_season_unmatched(spark, sf):
    return _coach_seasons(spark, sf)[1]


@query(f"WITH {ctes(weeks=WEEKS)} SELECT game_id, season FROM games WHERE season < (SELECT min(season) FROM weeks WHERE season > 1995)")
def fact_game_historical(spark, sf):
    return w.historical(games(spark, sf).select("game_id", "season"), made(spark, sf, WEEKS).filter("season > 1995"))


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey AS parent FROM nation")
def lookup_dim(spark, sf):
    """A lookup table as it is, under the model's names; columns that are not there are left out."""
    return w.project(table(spark, sf, "nation"), {"n_nationkey": "id", "n_name": "name", "n_regionkey": "parent", "n_comment": "comment"})


@query("SELECT c_custkey AS athlete, c_name AS name, c_mktsegment AS position, c_acctbal AS weight FROM customer")
def dim_athlete(spark, sf):
    return w.project(table(spark, sf, "customer"), {"c_custkey": "athlete", "c_name": "name", "c_mktsegment": "position", "c_acctbal": "weight"})


@query(f"""WITH {ctes(a=RATING_A, b=RATING_B, c=RATING_C)}, spine AS (SELECT team, season FROM a UNION SELECT team, season FROM b UNION SELECT team, season FROM c)
 SELECT team, season, a.rating AS sp_rating, a.offense::BIGINT AS sp_offense, b.rating AS fpi_rating, c.elo AS elo_elo FROM spine LEFT JOIN a USING (team, season) LEFT JOIN b USING (team, season) LEFT JOIN c USING (team, season)""")
def fact_team_season_rating(spark, sf):
    return w.ratings_wide({"sp": made(spark, sf, RATING_A), "fpi": made(spark, sf, RATING_B), "elo": made(spark, sf, RATING_C)}, ["team", "season"])


@query(f"""WITH {ctes(rec=RECRUITING, ret=RETURNING)}, {TEAM_GAMES_SQL}, own AS (SELECT team, season, count(*) FILTER (points > allowed) AS wins, count(*) FILTER (points < allowed) AS losses, count(*) FILTER (points = allowed) AS ties,
  count(*) FILTER (points - allowed + line > 0) AS ats_wins, count(*) FILTER (points - allowed + line < 0) AS ats_losses, count(*) FILTER (points - allowed + line = 0) AS ats_pushes FROM tg GROUP BY team, season)
 SELECT own.*, recruiting_points::BIGINT AS recruiting_points, returning_share FROM own LEFT JOIN rec USING (team, season) LEFT JOIN ret USING (team, season)""")
def team_season_facts(spark, sf):
    return w.team_season_facts(team_games(games(spark, sf)), made(spark, sf, RECRUITING), made(spark, sf, RETURNING))


@query(f"""WITH {ctes(a=WEATHER_A, b=WEATHER_B)} SELECT game_id, rain, coalesce(a.temperature, b.temperature) AS temperature, coalesce(a.wind, b.wind) AS wind, CASE WHEN a.temperature IS NOT NULL AND b.temperature IS NOT NULL THEN 'both' WHEN a.temperature IS NOT NULL THEN 'rest' ELSE 'gql' END AS _source FROM a FULL JOIN b USING (game_id)""")
def fact_game_weather(spark, sf):
    return w.twins(made(spark, sf, WEATHER_A), made(spark, sf, WEATHER_B), ["game_id"], ["temperature", "wind"])


@query(f"WITH {ctes(polls=POLLS, names=NAMES)} SELECT DISTINCT season, week, poll, team, rank FROM polls JOIN names USING (name)")
def fact_poll_rank(spark, sf):
    return w.poll_ranks(made(spark, sf, POLLS), made(spark, sf, NAMES))


@query(f"WITH {ctes(drives=DRIVES, names=NAMES)} SELECT drives.*, o.team AS offense_team, d.team AS defense_team FROM drives LEFT JOIN names o ON o.name = offense LEFT JOIN names d ON d.name = defense")
def fact_drive(spark, sf):
    return w.drives(made(spark, sf, DRIVES), made(spark, sf, NAMES))


@query(f"""WITH {_BOOKS_SQL} SELECT g.game_id, g.season, s.spread AS book_spread, t.total AS book_total FROM games g LEFT JOIN books s ON s.game_id = g.game_id AND s.book = 'DraftKings' LEFT JOIN books t ON t.game_id = g.game_id AND t.book = 'FanDuel'""")
def v_game(spark, sf):
    return w.v_game(games(spark, sf).select("game_id", "season"), _books(spark, sf), "DraftKings", "FanDuel")


#: Columns of the given tables and their types, as Spark names them.
SCHEMA = {
    "region": "r_regionkey int, r_name string", "nation": "n_nationkey int, n_name string, n_regionkey int", "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double", "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string", "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint", "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string", "benchmark": "item_id bigint, text string", "labels": "doc_id bigint, quality int, toxic int", "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def _described(name: str, columns: str) -> str:
    pairs = [c.split(" ") for c in columns.split(", ")]
    listed = lambda values: "[" + ", ".join(values) + "]"
    return f"""SELECT '{name}' AS "table", n, unnest({listed(f"'{c}'" for c, _ in pairs)}) AS "column", unnest({listed(f"'{t}'" for _, t in pairs)}) AS type, unnest({listed(str(i) for i in range(1, len(pairs) + 1))}) AS place, unnest({listed(f"c{i}" for i in range(len(pairs)))}) AS filled FROM (SELECT count(*) AS n, {", ".join(f"count({c}) AS c{i}" for i, (c, _) in enumerate(pairs))} FROM {name})"""


@query(" UNION ALL ".join(_described(n, c) for n, c in SCHEMA.items()))
def table_dictionary(spark, sf):
    """Every column of every table: its type, place, rows and filled rows."""
    return w.dictionary({t: table(spark, sf, t) for t in SCHEMA})


#: Declared edges: child column and the parent column that it names.
EDGES = (
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id"),
)


@query(" UNION ALL ".join(f"SELECT '{c}' AS child, '{ck}' AS child_key, '{p}' AS parent, '{pk}' AS parent_key, count(*) AS n, count(*) FILTER ({ck} IS NULL) AS null_keys, count(*) FILTER ({ck} IS NOT NULL AND {ck} NOT IN (SELECT {pk} FROM {p} WHERE {pk} IS NOT NULL)) AS orphans, (SELECT count(*) FROM {p} WHERE {pk} NOT IN (SELECT {ck} FROM {c} WHERE {ck} IS NOT NULL)) AS childless FROM {c}" for c, ck, p, pk in EDGES))
def relationship_table(spark, sf):
    """Rows, null keys, orphans and childless parents of every declared edge."""
    return w.relationships({t: table(spark, sf, t) for t in SCHEMA}, EDGES)


_TIERS = f"{ctes()}, lines AS (SELECT game_id, CASE provider WHEN 0 THEN 'Consensus' WHEN 6 THEN 'teamrankings' WHEN 7 THEN 'numberfire' ELSE concat('B', provider) END AS provider, max(spread) AS spread, max(total) AS total FROM line_tape WHERE provider <> 0 OR game_id % 3 = 0 GROUP BY ALL)"
_TIER = "CASE WHEN lower(provider) = 'consensus' THEN 0 WHEN lower(provider) IN ('teamrankings', 'numberfire') THEN 2 ELSE 1 END"


def _provided(spark, sf):
    name = F.when(F.col("provider") == 0, "Consensus").when(F.col("provider") == 6, "teamrankings").when(F.col("provider") == 7, "numberfire").otherwise(F.concat(F.lit("B"), F.col("provider").cast("string")))
    return line_tape(spark, sf).filter("provider <> 0 OR game_id % 3 = 0").groupBy("game_id", name.alias("provider")).agg(F.max("spread").alias("spread"), F.max("total").alias("total"))


@query(f"""WITH {_TIERS}, s AS (SELECT game_id, spread, provider FROM lines WHERE spread IS NOT NULL AND spread <> 0 QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY {_TIER}, lower(provider), provider) = 1), t AS (SELECT game_id, total, provider FROM lines WHERE total > 0 QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY {_TIER}, lower(provider), provider) = 1)
 SELECT game_id, s.spread, s.provider AS spread_provider, t.total, t.provider AS total_provider FROM s JOIN t USING (game_id)""")
def line_tiers(spark, sf):
    """Spread and total of every game, each from the first tier that has it: consensus, books, projection sites."""
    return lines.by_field(_provided(spark, sf))


@query(f"WITH {_TIERS} SELECT game_id, spread, total, provider AS spread_provider, provider AS total_provider FROM lines WHERE spread <> 0 AND total > 0 QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY lower(provider) <> 'consensus', provider) = 1")
def line_pairs(spark, sf):
    """Spread and total of one provider that has both, the consensus first."""
    return lines.by_pair(_provided(spark, sf))
