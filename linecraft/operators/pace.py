"""Play clocks: whether a game's can be trusted, and the tempo that trusted ones show.

Both look at pairs: a rush and the next scrimmage snap of the same drive, period and side.  The clock runs
between the two, so a difference of zero or less means that it was not updated.  Drives are short, so the
window over them never gathers much.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Play types that can follow a rush in a drive without a change of sides or units.
SCRIMMAGE = (
    "Rush", "Pass Reception", "Pass Incompletion", "Pass Completion", "Sack", "Rushing Touchdown", "Passing Touchdown", "Interception", "Pass Interception Return",
    "Interception Return Touchdown", "Fumble Recovery (Own)", "Fumble Recovery (Opponent)", "Fumble Return Touchdown", "Fumble",
)
#: A clock is usable below this share of stale pairs; pairs that a team's season needs for its neutral and its trailing tempo.
STALE, NEUTRAL, TRAILING = 0.10, 30, 15


def rush_pairs(plays: DataFrame) -> DataFrame:
    """Rushes of regular time with ``spent`` (seconds of game clock) and ``wall_spent`` until the next scrimmage snap.

    ``plays`` has game_id, season, week, drive, number, play_id, type, offense, defense, period, secs (left in the
    period), wall (timestamp or null), margin, gained and distance.
    """
    w = Window.partitionBy("drive").orderBy("number", "play_id")
    after = {c: F.lead(c).over(w).alias(f"next_{c}") for c in ("type", "offense", "period", "secs", "wall")}
    rows = plays.filter("period <= 4").select("*", *after.values())
    rows = rows.filter((F.col("type") == "Rush") & (F.col("next_offense") == F.col("offense")) & (F.col("next_period") == F.col("period")) & F.col("next_type").isin(*SCRIMMAGE))
    return rows.withColumns({"spent": F.col("secs") - F.col("next_secs"), "wall_spent": (F.unix_micros("next_wall") - F.unix_micros("wall")) / 1e6})


def clock_quality(plays: DataFrame, stale: float = STALE) -> DataFrame:
    """One row a game with pairs: their number, the stale shares of game and wall clock, and whether each is usable."""
    share = lambda x, unknown: F.avg(F.coalesce((x <= 0).cast("int"), F.lit(unknown)))
    out = rush_pairs(plays).groupBy("game_id").agg(F.first("season").alias("season"), F.count(F.lit(1)).alias("rush_pairs"), F.avg((F.col("spent") <= 0).cast("int")).alias("clock_stale_share"), share(F.col("wall_spent"), 1).alias("wallclock_stale_share"))
    return out.withColumns({"clock_ok": F.col("clock_stale_share") < stale, "wallclock_ok": F.col("wallclock_stale_share") < stale})


def running_pairs(plays: DataFrame) -> DataFrame:
    """Pairs of games with a usable clock whose rush gained no first down, so that the clock ran."""
    good = clock_quality(plays).filter("clock_ok").select(F.col("game_id").alias("good"))
    pairs = rush_pairs(plays).join(good, F.col("game_id") == F.col("good"), "left_semi")
    late = F.col("period").isin(2, 4) & (F.col("secs") <= 120)
    return pairs.filter(F.col("gained") < F.col("distance")).withColumns({"neutral": (F.col("period") <= 3) & (F.abs("margin") <= 14) & ~late, "trailing": (F.col("margin") <= -9) & ~late})


def tempo(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """season, team: seconds between neutral snaps (median), how often among the season's fastest quarter, the defence's
    side of it, and the change when trailing; null where a team's season has too few pairs.

    The season's quartile is exact over whole seconds: they are counted first, so a season is some dozens of rows.
    """
    keys = keys or []
    neutral = pairs.filter("neutral")
    fast = neutral.groupBy(F.col("season").alias("of"), *(F.col(k).alias(f"of_{k}") for k in keys)).agg(F.percentile("spent", 0.25).alias("fast"))
    on = (F.col("season") == F.col("of")) if not keys else (F.col("season") == F.col("of")) & (F.col(keys[0]) == F.col(f"of_{keys[0]}"))
    hurried = neutral.join(fast, on).withColumn("hurry", (F.col("spent") <= F.col("fast")).cast("int"))
    own = hurried.groupBy("season", F.col("offense").alias("team"), *keys).agg(F.median("spent").alias("t"), F.avg("hurry").alias("h"), F.count(F.lit(1)).alias("n_neutral"))
    faced = neutral.groupBy("season", F.col("defense").alias("team"), *keys).agg(F.median("spent").alias("f"), F.count(F.lit(1)).alias("n_faced"))
    behind = pairs.filter("trailing").groupBy("season", F.col("offense").alias("team"), *keys).agg(F.median("spent").alias("b"), F.count(F.lit(1)).alias("n_trail"))
    out = own.join(behind, ["season", "team", *keys], "left").join(faced, ["season", "team", *keys], "full")
    enough = lambda n, least, x: F.when(F.col(n) >= least, x)
    return out.select(
        "season", "team", *keys, enough("n_neutral", NEUTRAL, F.col("t")).alias("tempo_s"), enough("n_neutral", NEUTRAL, F.col("h")).alias("hurry_rate"), "n_neutral", enough("n_trail", TRAILING, F.col("b") - F.col("t")).alias("trail_delta_s"),
        "n_trail", enough("n_faced", NEUTRAL, F.col("f")).alias("tempo_faced_s"), "n_faced",
    )


def reliability(pairs: DataFrame, column: str = "tempo_s") -> DataFrame:
    """split_half, full_season (Spearman-Brown) and next_season correlations of a tempo over teams' seasons.

    Halves are the odd and even weeks in which a team has pairs.
    """
    w = Window.partitionBy("season", "offense").orderBy("week")
    halved = pairs.withColumn("half", (F.dense_rank().over(w) % 2).cast("int"))
    halves = tempo(halved, ["half"]).groupBy("season", "team").agg(F.max(F.when(F.col("half") == 0, F.col(column))).alias("a"), F.max(F.when(F.col("half") == 1, F.col(column))).alias("b"))
    r = halves.agg(F.corr("a", "b").alias("r"))
    now = tempo(pairs).select("season", "team", F.col(column).alias("x"))
    later = now.select((F.col("season") - 1).alias("season"), "team", F.col("x").alias("y"))
    both = now.join(later, ["season", "team"]).agg(F.corr("x", "y").alias("next_season"))
    return r.crossJoin(both).select(F.col("r").alias("split_half"), (2 * F.col("r") / (1 + F.col("r"))).alias("full_season"), "next_season")
