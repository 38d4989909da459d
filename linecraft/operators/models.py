"""Rating and simulation models: Spark aggregates or deals the rows, numpy solves small systems in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship


def ridge_ratings(games: DataFrame, penalty: float = 5.0) -> DataFrame:
    """Attack and defence of each team and season by ridge regression of points, with home advantage.

    Spark reduces the games to one row per ordered pair of teams (count and points), so a season's
    task holds teams squared rows at most, whatever the number of games.
    """
    ship(games.sparkSession)
    played = games.filter("home_points IS NOT NULL")
    sides = F.array(*(F.struct(F.col(f"{a}_team").alias("team"), F.col(f"{b}_team").alias("opponent"), F.lit(h).alias("home"), F.col(f"{a}_points").cast("double").alias("points")) for a, b, h in (("home", "away", 0.5), ("away", "home", -0.5))))
    pairs = played.select("season", F.explode(sides).alias("s")).groupBy("season", "s.team", "s.opponent", "s.home").agg(F.count(F.lit(1)).alias("n"), F.sum("s.points").alias("points"))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        teams = np.unique(np.concatenate([rows["team"], rows["opponent"]]))
        k = len(teams)
        x = np.zeros((len(rows), 2 * k + 2))
        at = np.arange(len(rows))
        x[at, np.searchsorted(teams, rows["team"])] = 1
        x[at, k + np.searchsorted(teams, rows["opponent"])] = 1
        x[:, -2], x[:, -1] = 1, rows["home"]
        n = rows["n"].to_numpy(float)
        ridge = np.diag(np.append(np.full(2 * k, penalty), [0, 1e-9]))
        beta = np.linalg.solve(x.T @ (x * n[:, None]) + ridge, x.T @ rows["points"].to_numpy(float))
        return pd.DataFrame({"season": rows["season"].iloc[0], "team": teams, "attack": beta[:k].round(6), "defence": beta[k : 2 * k].round(6), "mean_points": round(beta[-2], 6), "home_edge": round(beta[-1], 6)})

    return pairs.groupBy("season").applyInPandas(solve, "season long, team long, attack double, defence double, mean_points double, home_edge double")


def bankroll(bets: DataFrame, paths: int = 2000, bets_a_path: int = 200, share: float = 0.02, seed: int = 7) -> DataFrame:
    """Final bankroll and drawdown quantiles of each season's record, win rates drawn from Beta posteriors."""
    ship(bets.sparkSession)
    records = bets.groupBy("season").agg(F.count_if(F.col("result") == "W").alias("wins"), F.count_if(F.col("result") == "L").alias("losses"))
    blocks = records.select("season", "wins", "losses", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("block")).repartition("season", "block")

    def simulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                rng = np.random.default_rng([seed, row.season, row.block])
                p = rng.beta(row.wins + 1, row.losses + 1, paths // 8)
                won = rng.random((paths // 8, bets_a_path)) < p[:, None]
                log = np.cumsum(np.where(won, np.log1p(share * 100 / 110), np.log1p(-share)), axis=1)
                fall = 1 - np.exp((log - np.maximum.accumulate(np.maximum(log, 0), axis=1)).min(axis=1))
                yield pd.DataFrame({"season": row.season, "final": np.exp(log[:, -1]), "drawdown": fall})

    drawn = blocks.mapInPandas(simulate, "season long, final double, drawdown double")
    return drawn.groupBy("season").agg(F.count(F.lit(1)).alias("paths"), F.round(F.percentile("final", 0.05), 6).alias("final_p05"), F.round(F.median("final"), 6).alias("final_p50"), F.round(F.percentile("final", 0.95), 6).alias("final_p95"), F.round(F.percentile("drawdown", 0.9), 6).alias("drawdown_p90"))
