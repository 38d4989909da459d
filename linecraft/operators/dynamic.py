"""All teams of a season in one information filter: attack and defence move week by week, jointly.

The state is one precision matrix and one information vector over level, home edge, and every team's attack
and defence.  A week's rows are folded in at once; between weeks the teams' variances grow by a drift.  The
state of the last week is a row of the result, from which a later call goes on, with the same outcome as one
call over all weeks.  Rows are first added up to (week, team, opponent, home), so a season's task holds
pairings, not plays, and a matrix of its teams.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gram import full

#: Prior precision of level and home edge: nearly none.
FLAT = 1e-6
STATE = "season long, began long, week long, teams array<long>, precision array<double>, information array<double>"


def _grown(prec: np.ndarray, info: np.ndarray, drift: np.ndarray, weeks: float) -> tuple[np.ndarray, np.ndarray]:
    cov = np.linalg.inv(prec)
    mean = cov @ info
    prec = np.linalg.inv(cov + np.diag(drift * weeks))
    return prec, prec @ mean


def _filtered(lam: float, drift: float):
    def run(key, rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        season, out = int(key[0]), []
        teams = np.unique(np.concatenate([rows["team"], rows["opponent"], *held["teams"]])).astype(np.int64) if len(rows) or len(held) else np.zeros(0, np.int64)
        k = len(teams)
        n, weeks = 2 + 2 * k, sorted(int(w) for w in rows["week"].unique())
        moves = np.r_[0.0, 0.0, np.full(2 * k, drift)]
        prec, info = np.diag(np.r_[FLAT, FLAT, np.full(2 * k, lam)]), np.zeros(n)
        began = last = None
        if len(held):
            h = held.iloc[0]
            began, last = int(h["began"]), int(h["week"])
            at = np.searchsorted(teams, np.asarray(h["teams"]))
            spot = np.r_[0, 1, 2 + at, 2 + k + at]
            # teams that were not seen have drifted from their prior ever since the first week
            age = 1 / (1 / lam + drift * (last - began))
            prec = np.diag(np.r_[FLAT, FLAT, np.full(2 * k, age)])
            old = full(np.asarray(h["precision"]), 2 + 2 * len(at))
            prec[np.ix_(spot, spot)] = old
            info[spot] = np.asarray(h["information"])
            weeks = [w for w in weeks if w > last]
        for week in weeks:
            if last is not None and drift:
                prec, info = _grown(prec, info, moves, week - last)
            m = rows[rows["week"] == week]
            x = np.zeros((len(m), n))
            a, b = np.searchsorted(teams, m["team"]), np.searchsorted(teams, m["opponent"])
            x[:, 0], x[:, 1] = 1, m["home"]
            x[np.arange(len(m)), 2 + a] = 1
            x[np.arange(len(m)), 2 + k + b] = 1
            prec = prec + x.T @ (x * m["w"].to_numpy()[:, None])
            info = info + x.T @ m["wy"].to_numpy()
            began, last = week if began is None else began, week
            out.append((season, began, week, teams.tolist(), prec[np.triu_indices(n)].tolist(), info.tolist()))
        return pd.DataFrame(out, columns=["season", "began", "week", "teams", "precision", "information"])

    return run


def joint_filter(rows: DataFrame, y: str, weight: str | None = None, lam: float = 0.05, drift: float = 0.002, state: DataFrame | None = None) -> DataFrame:
    """The state after each week of each season.

    ``rows`` has season, week, team, opponent, home (0 or 1) and ``y``, one row a side and game (or play); observations
    have variance 1 / ``weight``, teams a prior precision ``lam`` and ``drift`` more variance a week.  Weeks up to the
    one of ``state`` (a row a season of an earlier result) are not folded in again.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    keys = [F.col(c).cast("long").alias(c) for c in ("season", "week", "team", "opponent")]
    sums = rows.filter(F.col(y).isNotNull()).dropna(subset=["season", "week", "team", "opponent"]).groupBy(*keys, F.col("home").cast("double").alias("home")).agg(F.sum(w).alias("w"), F.sum(w * F.col(y)).alias("wy"))
    held = state if state is not None else rows.sparkSession.createDataFrame([], STATE)
    held = held.select(F.col("season").alias("of"), "began", "week", "teams", "precision", "information")
    return sums.groupBy("season").cogroup(held.groupBy("of")).applyInPandas(_filtered(lam, drift), STATE)


def last_state(states: DataFrame) -> DataFrame:
    """The row of each season's last week, to go on from."""
    rest = ["began", "week", "teams", "precision", "information"]
    return states.groupBy("season").agg(F.max_by(F.struct(*rest), "week").alias("x")).select("season", *(f"x.{c}" for c in rest))


def _rated(batches):
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            k = len(r.teams)
            cov = np.linalg.inv(full(np.asarray(r.precision), 2 + 2 * k))
            mean, var = cov @ np.asarray(r.information), np.diag(cov)
            for i, t in enumerate(r.teams):
                out.append((r.season, r.week, int(t), mean[2 + i], mean[2 + k + i], np.sqrt(var[2 + i]), np.sqrt(var[2 + k + i]), mean[0], mean[1]))
        yield pd.DataFrame(out, columns=["season", "week", "team", "attack", "defence", "se_attack", "se_defence", "level", "home_edge"])


def ratings(states: DataFrame) -> DataFrame:
    """attack, defence (points allowed), their standard errors, level and home edge of every team of each state."""
    return states.mapInPandas(_rated, "season long, week long, team long, attack double, defence double, se_attack double, se_defence double, level double, home_edge double")
