"""Feature assembly: one wide row a game from indexes that are looked up by game, team and season.

An index keeps one row a key; where a file repeats a key, its last row wins (by position in the file).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_row(df: DataFrame, key: list[str], position: str = "pos") -> DataFrame:
    """One row a key: the last in the order of the file; no window, so equal keys combine before the shuffle."""
    values = [c for c in df.columns if c not in key and c != position]
    return df.groupBy(*key).agg(F.max_by(F.struct(*values), position).alias("__x")).select(*key, *(F.col(f"__x.{c}").alias(c) for c in values))


def first_element(df: DataFrame, array: str, fields: list[str]) -> DataFrame:
    """Fields of the first element of an array column, null where it is empty."""
    return df.withColumns({f: F.get(array, F.lit(0))[f] for f in fields}).drop(array)


def head_coach(coaches: DataFrame) -> DataFrame:
    """The coach of each team and season; of several the last in the file.

    ``coaches``: pos, coach and ``seasons`` (JSON text: an array of objects, whose team is a text or an
    object with a name).
    """
    each = coaches.select("pos", "coach", F.posexplode(F.variant_get(F.parse_json("seasons"), "$", "array<variant>")).alias("at", "s"))
    team = F.coalesce(F.try_variant_get("s", "$.team.name", "string"), F.when(~F.schema_of_variant(F.try_variant_get("s", "$.team", "variant")).startswith("OBJECT"), F.try_variant_get("s", "$.team", "string")))
    rows = each.select(team.alias("team"), F.try_variant_get("s", "$.year", "bigint").alias("season"), F.struct("pos", "at").alias("order"), "coach")
    return rows.filter("team IS NOT NULL").groupBy("team", "season").agg(F.max_by("coach", "order").alias("coach"))


def prior_season_sum(players: DataFrame, value: str, name: str) -> DataFrame:
    """Sum of the players' finite values by team, keyed at the season after; a team without players is absent."""
    x = F.col(value).try_cast("double")
    ok = x.isNotNull() & ~F.isnan(x)
    return players.groupBy("team", (F.col("season") + 1).alias("season")).agg(F.sum(F.when(ok, x)).alias(name)).filter(F.col(name).isNotNull())


def prior_season(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Ratings of a season, keyed at the one after."""
    return df.select("team", (F.col("season") + 1).alias("season"), *(F.col(a).alias(b) for a, b in names.items()))


def conference_change(members: DataFrame) -> DataFrame:
    """Whether a team plays in another conference than the season before; null where that season was not loaded."""
    loaded = members.select((F.col("season") + 1).alias("season"), F.lit(True).alias("__loaded")).distinct()
    was = members.select("team", (F.col("season") + 1).alias("season"), F.col("conference").alias("__was"))
    out = members.join(was, ["team", "season"], "left").join(F.broadcast(loaded), "season", "left")
    return out.select("team", "season", F.when(F.col("__loaded"), ~F.col("conference").eqNullSafe(F.col("__was"))).alias("conference_changed"))


def probability_pair(p: Column) -> tuple[Column, Column]:
    """Home and away win probability; a value outside [0, 1] is no probability."""
    ok = F.when((p >= 0) & (p <= 1), p)
    return ok, 1 - ok


def line_moves(lines: DataFrame, spread: str, opened: str) -> DataFrame:
    """Median close less median open over the books; null without an open on the same side."""
    per = lines.groupBy("game_id").agg(F.median(spread).alias("close"), F.median(opened).alias("open"))
    return per.select("game_id", (F.col("close") - F.col("open")).alias("line_move"))


def overlay(base: DataFrame, forecast: DataFrame, fields: list[str], upcoming: Column) -> DataFrame:
    """Forecast fields that are not null win, for upcoming games only."""
    out = base.join(forecast.select("game_id", *(F.col(f).alias(f"__{f}") for f in fields)), "game_id", "left")
    return out.withColumns({f: F.when(upcoming, F.coalesce(f"__{f}", f)).otherwise(F.col(f)) for f in fields}).drop(*(f"__{f}" for f in fields))


def assemble(games: DataFrame, by_game: list[DataFrame], by_team: list[DataFrame]) -> DataFrame:
    """Games with every feature: game indexes as they are, team indexes once for each side.

    Team indexes are keyed by (team, season) or (game_id, team); all are joined into one table first, so
    that each side costs one join however many indexes there are.
    """
    out = reduce(lambda a, b: a.join(b, "game_id", "left"), by_game, games)
    for key in (["team", "season"], ["game_id", "team"]):
        some = [t for t in by_team if set(key) <= set(t.columns) and ("game_id" in t.columns) == ("game_id" in key)]
        if not some:
            continue
        wide = reduce(lambda a, b: a.join(b, key, "full_outer"), some)  # noqa: B023
        values = [c for c in wide.columns if c not in key]
        for side in ("home", "away"):
            one = wide.select(*(F.col(k).alias(f"{side}_team" if k == "team" else k) for k in key), *(F.col(v).alias(f"{side}_{v}") for v in values))
            out = out.join(one, [f"{side}_team" if k == "team" else k for k in key], "left")
    return out


def target_week(games: DataFrame, now: str) -> DataFrame:
    """The week whose calendar window holds ``now``, else that of the game that was completed last."""
    span = games.groupBy("season", "week").agg(F.min("kickoff").alias("a"), F.max("kickoff").alias("b"), F.max(F.when(F.col("home_points").isNotNull(), F.col("kickoff"))).alias("done"))
    at = F.lit(now).cast("timestamp_ntz")
    inside = F.min(F.when((F.col("a") <= at) & (at <= F.col("b")), F.struct("season", "week")))
    past = F.max(F.when(F.col("done") <= at, F.struct("done", "season", "week")))
    out = span.agg(inside.alias("i"), past.alias("p"))
    return out.select(F.coalesce("i.season", "p.season").alias("season"), F.coalesce("i.week", "p.week").alias("week"))


def upcoming_base(games: DataFrame, target: DataFrame) -> DataFrame:
    """Games that running statistics of a target week need: the season's completed ones and the week's own."""
    t = F.broadcast(target.select(F.col("season").alias("__s"), F.col("week").alias("__w")))
    out = games.join(t, F.col("season") == F.col("__s"))
    own = F.col("week") == F.col("__w")
    return out.filter(own | (F.col("home_points").isNotNull() & (F.col("week") < F.col("__w")))).withColumn("is_target", own).drop("__s", "__w")
