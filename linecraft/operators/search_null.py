"""The best cell of a search against what the search finds when no cell carries a signal.

A shuffle of results inside strata keeps each stratum's wins and each cell's size.  What it does to the cells'
wins is drawing without replacement: given the strata's counts, the wins of a stratum's cells follow the
multivariate hypergeometric distribution.  So a draw needs the counts of (stratum, cell) and no row: one pass
over the rows with map-side combining, then draws that Spark deals out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells times strata whose counts go to every task (two integers each): a grid of rules, not of rows.
GRID = 2_000_000


def cell_records(picks: DataFrame, cell: list[str], win: str, stratum: list[str] | None = None) -> DataFrame:
    """n and wins of each cell (and stratum); undecided picks (null) are left out."""
    return picks.filter(F.col(win).isNotNull()).groupBy(*(stratum or []), *cell).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(win)).alias("wins"))


def best_cell(picks: DataFrame, cell: list[str], win: str, least: int) -> DataFrame:
    """The cell with the highest share of wins among those of ``least`` picks (more picks, then the names, break ties)."""
    found = cell_records(picks, cell, win).filter(F.col("n") >= least).withColumn("rate", F.col("wins") / F.col("n"))
    return found.orderBy(F.desc("rate"), F.desc("n"), *cell).limit(1)


def best_cell_null(picks: DataFrame, cell: list[str], win: str, stratum: list[str], least: int, draws: int, seed: int = 11) -> DataFrame:
    """draw, best: the highest share of wins of a cell of ``least`` picks in each shuffle of results inside strata."""
    counts = cell_records(picks, cell, win, stratum).toPandas()
    if len(counts) > GRID:
        raise ValueError(f"a grid of {len(counts)} cells and strata: make it coarser")
    where = counts.groupby(cell, dropna=False).ngroup().to_numpy() if len(counts) else np.zeros(0, int)
    sizes = np.bincount(where, counts["n"].to_numpy(float)) if len(counts) else np.zeros(0)
    inside = [(where[i], g["n"].to_numpy(np.int64), int(g["wins"].sum())) for _, g in counts.groupby(stratum, dropna=False) for i in [g.index.to_numpy()]] if len(counts) else []
    allowed = sizes >= least

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best = []
            for draw in batch["draw"]:
                rng, wins = np.random.default_rng([seed, int(draw)]), np.zeros(len(sizes))
                for cells, n, k in inside:
                    wins[cells] += rng.multivariate_hypergeometric(n, k, method="marginals")
                best.append(float((wins[allowed] / sizes[allowed]).max()) if allowed.any() else None)
            yield pd.DataFrame({"draw": batch["draw"], "best": pd.Series(best, dtype=float)})

    return picks.sparkSession.range(draws).withColumnRenamed("id", "draw").mapInPandas(run, "draw long, best double")


def permutation_test(picks: DataFrame, cell: list[str], win: str, stratum: list[str], least: int, draws: int = 2000, seed: int = 11) -> DataFrame:
    """One row: observed best cell, its record, median best of the shuffles, and the share of shuffles that do as well."""
    own = best_cell(picks, cell, win, least)
    null = best_cell_null(picks, cell, win, stratum, least, draws, seed)
    # one row against all draws
    both = null.crossJoin(F.broadcast(own))
    keys = [F.first(c).alias(c) for c in [*cell, "n", "wins", "rate"]]
    return both.agg(*keys, F.median("best").alias("null_median"), F.avg((F.col("best") >= F.col("rate") - 1e-12).cast("int")).alias("p"), F.count(F.lit(1)).alias("draws")).filter("draws > 0")


def chosen_then_graded(picks: DataFrame, cell: list[str], win: str, training: Column, least: int) -> DataFrame:
    """The best cell of the picks where ``training`` holds, with its record there and on the others."""
    marked = picks.withColumn("__t", training)
    own = best_cell(marked.filter("__t"), cell, win, least).select(*(F.col(c).alias(f"__{c}") for c in cell), F.col("n").alias("train_n"), F.col("wins").alias("train_wins"))
    held = cell_records(marked.filter("NOT __t"), cell, win)
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in cell]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(f"test_{c}")
    return own.join(held, on, "left").select(*(F.col(f"__{c}").alias(c) for c in cell), "train_n", "train_wins", zero("n"), zero("wins"))
