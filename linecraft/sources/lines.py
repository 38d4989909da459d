"""One spread and one total a game from several providers' lines, in three ways, with a check of the seasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed names: the market aggregate, and sites that project lines but take no bets.
CONSENSUS, SITES = "consensus", ("teamrankings", "numberfire")


def tier(provider: str = "provider") -> Column:
    """0 for the consensus, 1 for a book, 2 for a projection site."""
    name = F.lower(provider)
    return F.when(name == CONSENSUS, 0).when(name.isin(*SITES), 2).otherwise(1)


def _first(lines: DataFrame, key: str, value: str, order: list[Column]) -> DataFrame:
    """The provider and value of the first line in ``order`` that can be used, by game: one aggregate."""
    good = lines.filter(F.col(value).isNotNull() & ((F.col(value) != 0) if value == "spread" else (F.col(value) > 0)))
    best = good.groupBy(key).agg(F.min_by(F.struct(value, "provider"), F.struct(*order)).alias("x"))
    return best.select(key, F.col(f"x.{value}").alias(value), F.col("x.provider").alias(f"{value}_provider"))


def by_field(lines: DataFrame) -> DataFrame:
    """Spread and total chosen each by itself: consensus, then books, then sites; then by name.

    A spread of 0 is no spread, a total must be positive; games that lack one of the two are left out.
    """
    order = [tier(), F.lower("provider"), F.col("provider")]
    return _first(lines, "game_id", "spread", order).join(_first(lines, "game_id", "total", order), "game_id")


def by_pair(lines: DataFrame) -> DataFrame:
    """One provider for both: the consensus if it has both, else the first by name that does."""
    both = lines.filter("spread IS NOT NULL AND total IS NOT NULL AND spread <> 0 AND total > 0")
    order = F.struct((F.lower("provider") != CONSENSUS).alias("c"), "provider")
    best = both.groupBy("game_id").agg(F.min_by(F.struct("spread", "total", "provider"), order).alias("x"))
    return best.select("game_id", "x.spread", "x.total", F.col("x.provider").alias("spread_provider"), F.col("x.provider").alias("total_provider"))


def selected(games: DataFrame) -> DataFrame:
    """What the games' own selected columns say."""
    kept = games.filter("selected_spread IS NOT NULL AND selected_total IS NOT NULL AND selected_spread <> 0 AND selected_total > 0")
    return kept.select("game_id", F.col("selected_spread").alias("spread"), F.col("selected_total").alias("total"), F.col("spread_provider"), F.col("total_provider"))


def modelling_frame(games: DataFrame, chosen: DataFrame, seasons: list[int]) -> DataFrame:
    """Finished games of the seasons with a line; a season that is asked for and has none is an error, not fewer rows."""
    rows = games.filter(F.col("season").isin(*seasons) & F.col("home_points").isNotNull() & F.col("away_points").isNotNull()).join(chosen, "game_id")
    had = {r["season"] for r in rows.select("season").distinct().collect()}  # one row a season
    missing = sorted(set(seasons) - had)
    if missing:
        raise ValueError(f"no game with a line in seasons {missing}")
    return rows
