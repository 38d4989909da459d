"""Entering-game statistics: what was known about a team before the kickoff."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import rounded
from ..session import dealt


def team_games(games: DataFrame) -> DataFrame:
    """Two rows a game, one per side, from one scan."""
    sides = [
        F.struct(F.lit(i).alias("is_home"), F.col(f"{a}_team").alias("team"), F.col(f"{b}_team").alias("opponent"), F.col(f"{a}_points").alias("points"), F.col(f"{b}_points").alias("allowed"), (F.col("spread") if i else -F.col("spread")).alias("line"))
        for i, a, b in ((1, "home", "away"), (0, "away", "home"))
    ]
    return games.select("game_id", "season", "week", "kickoff", F.explode(F.array(*sides)).alias("s")).select("game_id", "season", "week", "kickoff", "s.*")


def entering(rows: DataFrame, averages: tuple[str, ...] = ()) -> DataFrame:
    """What a team brings into each game of ``team_games`` rows, the game itself excluded.

    Played games, win and cover rates, rest days, last-three scoring, signed streaks of results and of
    covers, and the mean of each of ``averages`` over the games that have it.  A tie or a push resets
    its streak to 0; games without a score leave it as it was.  All windows but the two over streaks
    share one partitioning and order, so one shuffle and one sort serve them; partitions grow in number, not in size.
    """
    rows = dealt(rows, "team", "season").withColumn("diff", F.col("points") - F.col("allowed")).withColumn("cover", F.col("diff") + F.col("line"))
    order = Window.partitionBy("team", "season").orderBy("kickoff", "game_id")
    past, now = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    decided = F.count_if(F.col("diff") != 0).over(past)
    covers = F.count_if(F.col("cover") != 0).over(past)
    runs = {}
    for name, x in (("streak", "diff"), ("ats_streak", "cover")):
        sign = F.signum(x).cast("int")
        # a streak restarts where the sign differs from that of the last played game
        new = sign.isNotNull() & ~sign.eqNullSafe(F.last(sign, ignorenulls=True).over(past))
        rows = rows.withColumns({f"__s_{name}": sign, f"__n_{name}": new.cast("int")})
        runs[f"__r_{name}"] = F.sum(f"__n_{name}").over(now)
    rest = F.datediff(F.col("kickoff"), F.lag("kickoff").over(order))
    rows = rows.withColumns({
        **runs,
        "games_played": F.count("diff").over(past),
        "win_pct": rounded(F.count_if(F.col("diff") > 0).over(past) / F.nullif(decided, F.lit(0)), 4),
        "ats_pct": rounded(F.count_if(F.col("cover") > 0).over(past) / F.nullif(covers, F.lit(0)), 4),
        "rest_days": F.when(rest > 0, rest).cast("long"),
        "last3_points": rounded(F.avg("points").over(order.rowsBetween(-3, -1)), 4),
        **{f"avg_{c}": rounded(F.avg(c).over(past), 4) for c in averages},
    })
    for name in ("streak", "ats_streak"):
        run = Window.partitionBy("team", "season", f"__r_{name}").orderBy("kickoff", "game_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn(f"__a_{name}", F.col(f"__s_{name}") * F.count(f"__s_{name}").over(run))
    for name in ("streak", "ats_streak"):
        rows = rows.withColumn(name, F.coalesce(F.last(f"__a_{name}", ignorenulls=True).over(past), F.lit(0)).cast("long"))
    return rows.select("game_id", "team", "season", "games_played", "win_pct", "ats_pct", "rest_days", "last3_points", "streak", "ats_streak", *(f"avg_{c}" for c in averages))


def prior_mean(games: DataFrame, lag_seconds: int = 86_400) -> DataFrame:
    """Mean points of a team's games that began at least ``lag_seconds`` before this kickoff."""
    at = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', kickoff)")
    w = Window.partitionBy("team").orderBy("__at").rangeBetween(Window.unboundedPreceding, -lag_seconds)
    rows = team_games(games).withColumn("__at", at)
    return rows.select("game_id", "team", F.count("points").over(w).alias("n_prior"), rounded(F.avg("points").over(w)).alias("prior_points"))
