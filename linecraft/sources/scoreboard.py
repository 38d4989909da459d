"""The weekly scoreboard files as flat tables: one of games, and one for each thing that a game holds several of.

A file's payload holds an array of games; each becomes a row, with columns from the fixed paths below. Values of another
kind than their column's are null, and a season or week that the game does not name is the file's. Books, periods and
markets are names of the payload, so prices are unpivoted from maps, whatever the names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vendor's paths below a game and the columns that they fill.
GAME = {
    "core_id": ("core_id", "bigint"), "start_time": ("start_time", "string"), "status": ("status", "string"), "status_display": ("status_display", "string"), "real_status": ("real_status", "string"),
    "home_team_id": ("home_team_id", "bigint"), "away_team_id": ("away_team_id", "bigint"), "home_rotation_number": ("home_rotation_number", "int"), "away_rotation_number": ("away_rotation_number", "int"),
    "winning_team_id": ("winning_team_id", "bigint"), "attendance": ("attendance", "int"), "num_bets": ("num_bets", "int"), "coverage": ("coverage", "string"), "league_id": ("league_id", "int"), "league_name": ("league_name", "string"),
    "broadcast_network": ("broadcast.network", "string"), "broadcast_network_short": ("broadcast.network_short", "string"), "clock": ("boxscore.clock", "string"), "period": ("boxscore.period", "int"),
    "home_points": ("boxscore.total_home_points", "int"), "away_points": ("boxscore.total_away_points", "int"), "home_firsthalf_points": ("boxscore.total_home_firsthalf_points", "int"), "away_firsthalf_points": ("boxscore.total_away_firsthalf_points", "int"),
    "home_secondhalf_points": ("boxscore.total_home_secondhalf_points", "int"), "away_secondhalf_points": ("boxscore.total_away_secondhalf_points", "int"), "home_timeouts": ("boxscore.home_timeouts", "int"), "away_timeouts": ("boxscore.away_timeouts", "int"),
    "situation": ("boxscore.situation.display", "string"), "down": ("boxscore.situation.down", "int"), "distance": ("boxscore.situation.distance", "int"),
}
TEAM = {
    "team_id": ("id", "bigint"), "core_id": ("core_id", "bigint"), "abbr": ("abbr", "string"), "location": ("location", "string"), "display_name": ("display_name", "string"), "full_name": ("full_name", "string"), "short_name": ("short_name", "string"),
    "url_slug": ("url_slug", "string"), "conference_type": ("conference_type", "string"), "division_type": ("division_type", "string"), "wins": ("standings.win", "int"), "losses": ("standings.loss", "int"), "ties": ("standings.ties", "int"), "draws": ("standings.draw", "int"),
}
LINESCORE = {"period_id": ("id", "int"), "abbr": ("abbr", "string"), "display_name": ("display_name", "string"), "full_name": ("full_name", "string"), "home_points": ("home_points", "int"), "away_points": ("away_points", "int")}
RANK = {"poll": ("poll", "string"), "rank": ("rank", "int"), "team_id": ("team_id", "bigint")}
OFFER = {
    "side": ("side", "string"), "team_id": ("team_id", "bigint"), "line": ("value", "double"), "odds": ("odds", "int"), "is_live": ("is_live", "boolean"), "line_status": ("line_status", "string"),
    "money_pct": ("bet_info.money.percent", "int"), "money": ("bet_info.money.value", "bigint"), "tickets_pct": ("bet_info.tickets.percent", "int"), "tickets": ("bet_info.tickets.value", "bigint"),
}


def _columns(value: str, paths: dict[str, tuple[str, str]]) -> list:
    return [F.try_variant_get(value, f"$.{path}", kind).alias(name) for name, (path, kind) in paths.items()]


def scoreboard(payloads: DataFrame) -> DataFrame:
    """One row a game of ``payloads`` (payload variant, season, week, season_type, source_file); nested parts stay variants."""
    games = payloads.select("season", "week", "season_type", "source_file", F.explode(F.try_variant_get("payload", "$.games", "array<variant>")).alias("g"))
    own = lambda c: F.coalesce(F.try_variant_get("g", f"$.{c}", "int"), F.col(c)).alias(c)
    event = F.coalesce(F.try_variant_get("g", "$.id", "bigint"), F.try_variant_get("g", "$.core_id", "bigint")).alias("event_id")
    nested = [F.try_variant_get("g", f"$.{p}", "variant").alias(n) for n, p in (("teams", "teams"), ("markets", "markets"), ("ranks", "ranks"), ("linescore", "boxscore.linescore"), ("last_play", "last_play"))]
    return games.select(event, own("season"), own("week"), "season_type", *_columns("g", GAME), *nested, "source_file")


_KEY = ["event_id", "season", "week"]


def _items(games: DataFrame, column: str, paths: dict[str, tuple[str, str]]) -> DataFrame:
    rows = games.select(*_KEY, "source_file", F.explode(F.try_variant_get(column, "$", "array<variant>")).alias("x"))
    return rows.select(*_KEY, *_columns("x", paths), "source_file")


def teams(games: DataFrame) -> DataFrame:
    """A row a game and team."""
    return _items(games, "teams", TEAM)


def linescores(games: DataFrame) -> DataFrame:
    """A row a game and period."""
    return _items(games, "linescore", LINESCORE)


def ranks(games: DataFrame) -> DataFrame:
    """A row a game, poll and team."""
    return _items(games, "ranks", RANK)


def markets(games: DataFrame) -> DataFrame:
    """A row an offer: book, period and market are the maps' names, unless the offer names period or market itself."""
    maps = F.try_variant_get("markets", "$", "map<string, map<string, map<string, array<variant>>>>")
    rows = games.select(*_KEY, "source_file", F.explode(maps).alias("book", "periods")).select(*_KEY, "source_file", "book", F.explode("periods").alias("p", "kinds"))
    rows = rows.select(*_KEY, "source_file", "book", "p", F.explode("kinds").alias("m", "offers")).select(*_KEY, "source_file", "book", "p", "m", F.explode("offers").alias("o"))
    named = lambda c, other: F.coalesce(F.try_variant_get("o", f"$.{c}", "string"), F.col(other))
    return rows.select(*_KEY, F.col("book").try_cast("bigint").alias("book_id"), named("period", "p").alias("period"), named("type", "m").alias("market"), *_columns("o", OFFER), "source_file")
