"""Clusters that are fitted anew at every cutoff, with names that stay.

A unit's profile at a cutoff is its weighted mean over the seasons before; every cutoff standardises its
profiles and runs k-means, all cutoffs in the same rounds: the centres are the driver's state (cutoffs x k
rows), a round is one pass that adds up points by (cutoff, nearest centre).  Names go from one cutoff to the
next by the matching of centres with the least total distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profiles(rows: DataFrame, unit: str, season: str, features: list[str], weight: str | None = None, least: int = 2) -> DataFrame:
    """cutoff, unit, features: weighted means over the seasons before each season, of units with ``least`` of them."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    per = rows.dropna(subset=[unit, season, *features]).groupBy(unit, season).agg(F.sum(w).alias("__w"), *(F.sum(w * F.col(c)).alias(c) for c in features))
    seasons = rows.select(F.col(season).alias("cutoff")).dropna().distinct()
    # a unit's season counts for every later cutoff; there are as many copies as seasons
    later = per.join(F.broadcast(seasons), F.col(season) < F.col("cutoff"))
    out = later.groupBy("cutoff", unit).agg(F.countDistinct(season).alias("__s"), *((F.sum(c) / F.nullif(F.sum("__w"), F.lit(0.0))).alias(c) for c in features))
    return out.filter(F.col("__s") >= least).drop("__s").dropna()


def standardised(points: DataFrame, features: list[str]) -> DataFrame:
    """Mean 0 and deviation 1 within each cutoff; a feature that does not vary is 0."""
    stats = points.groupBy(F.col("cutoff").alias("__cut")).agg(*(f(c).alias(f"__{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    z = [((F.col(c) - F.col(f"__m_{c}")) / F.nullif(F.col(f"__s_{c}"), F.lit(0.0))).alias(c) for c in features]
    keys = [c for c in points.columns if c not in features]
    return points.join(F.broadcast(stats), F.col("cutoff") == F.col("__cut")).select(*keys, *z).fillna(0.0, features)


def matching(cost: np.ndarray) -> list[int]:
    """For each row its column, each column once, at the least total cost; by subsets of columns, so for a dozen at most."""
    k = len(cost)
    best = {0: (0.0, ())}
    for row in range(k):
        new: dict[int, tuple[float, tuple]] = {}
        for used, (total, way) in best.items():
            for j in range(k):
                if not used >> j & 1:
                    found = (total + cost[row, j], (*way, j))
                    key = used | 1 << j
                    if key not in new or found < new[key]:
                        new[key] = found
        best = new
    return list(best[(1 << k) - 1][1])


def refit_clusters(points: DataFrame, unit: str, features: list[str], k: int, rounds: int = 50) -> tuple[DataFrame, DataFrame]:
    """(cutoff, unit, cluster, distance) and (cutoff, cluster, size, centre) of k-means at every cutoff.

    ``points`` has cutoff, unit and features.  Centres start from the point nearest to the mean and then, one after the
    other, from the point farthest from all centres so far (ties by unit), so a run repeats.  Cutoffs with fewer than k
    different points are left out.  Clusters are numbered by the first feature at the first cutoff and keep the number
    of the centre they came from, in the features' own units.
    """
    if not 1 < k <= 12:
        raise ValueError("between 2 and 12 clusters")
    spark = points.sparkSession
    raw = points.select(F.col("cutoff").cast("long").alias("cutoff"), unit, *(F.col(c).cast("double").alias(c) for c in features)).persist()
    z = standardised(raw, features).persist()
    try:
        x = F.array(*features)
        away = lambda centre: F.aggregate(F.zip_with("__x", centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
        start = z.withColumn("__x", x).groupBy("cutoff").agg(F.min_by("__x", F.struct(F.aggregate("__x", F.lit(0.0), lambda s, v: s + v * v), F.col(unit))).alias("c")).collect()
        centres = {r["cutoff"]: [list(r["c"])] for r in start}
        for _ in range(k - 1):
            if not centres:
                break
            held = spark.createDataFrame([(c, v) for c, v in centres.items()], "__cut long, __centres array<array<double>>")
            far = z.withColumn("__x", x).join(F.broadcast(held), F.col("cutoff") == F.col("__cut"))
            far = far.withColumn("__d", F.array_min(F.transform("__centres", away))).groupBy("cutoff").agg(F.max(F.struct("__d", unit, "__x")).alias("m"))
            found = {r["cutoff"]: r["m"] for r in far.collect()}
            centres = {c: [*v, list(found[c]["__x"])] for c, v in centres.items() if c in found and found[c]["__d"] > 1e-12}
        for _ in range(rounds):
            if not centres:
                break
            sent = {c: np.array(v) for c, v in centres.items()}

            def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    for cutoff, g in batch.groupby("cutoff"):
                        if cutoff in sent:
                            v = g[features].to_numpy()
                            own = ((v[:, None] - sent[cutoff][None]) ** 2).sum(2).argmin(1)
                            sums = pd.DataFrame(v, columns=features).groupby(own).sum()
                            yield pd.DataFrame({"cutoff": cutoff, "g": sums.index.astype(np.int64), "n": np.bincount(own)[sums.index], **{c: sums[c].to_numpy() for c in features}})

            sums = z.mapInPandas(nearest, ", ".join(["cutoff long, g long, n long", *(f"`{c}` double" for c in features)])).groupBy("cutoff", "g").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in features)).collect()
            moved = 0.0
            for r in sums:
                new = [r[c] / r["n"] for c in features]
                moved = max(moved, float(np.abs(np.array(new) - centres[r["cutoff"]][r["g"]]).max()))
                centres[r["cutoff"]][r["g"]] = new
            if moved < 1e-9:
                break
        held = spark.createDataFrame([(c, v) for c, v in centres.items()], "__cut long, __centres array<array<double>>")
        own = z.withColumn("__x", x).join(F.broadcast(held), F.col("cutoff") == F.col("__cut")).withColumn("__d", F.transform("__centres", away))
        own = own.select("cutoff", F.col(unit).alias("__unit"), (F.array_position("__d", F.array_min("__d")) - 1).cast("long").alias("g"), F.sqrt(F.array_min("__d")).alias("distance"))
        members = raw.join(own.withColumnRenamed("cutoff", "__at"), (F.col("cutoff") == F.col("__at")) & (F.col(unit) == F.col("__unit")))
        centre = members.groupBy("cutoff", "g").agg(F.count(F.lit(1)).alias("size"), F.array(*(F.avg(c) for c in features)).alias("centre")).collect()
        names, was = {}, None
        spread = np.maximum(np.std([r["centre"] for r in centre], axis=0), 1e-12) if centre else None
        for cutoff in sorted({r["cutoff"] for r in centre}):
            now = {r["g"]: np.array(r["centre"]) / spread for r in centre if r["cutoff"] == cutoff}
            if len(now) < k:
                continue
            groups = sorted(now, key=lambda g: now[g][0])
            if was is None:
                order = list(range(k))
            else:
                order = matching(np.array([[((now[g] - was[j]) ** 2).sum() for j in range(k)] for g in groups]))
            for g, j in zip(groups, order, strict=True):
                names[cutoff, g] = j
            was = {names[cutoff, g]: now[g] for g in groups}
        named = spark.createDataFrame([(c, g, j) for (c, g), j in names.items()], "__c long, __g long, cluster long")
        rows = members.select("cutoff", unit, "g", "distance").join(F.broadcast(named), (F.col("cutoff") == F.col("__c")) & (F.col("g") == F.col("__g"))).select("cutoff", unit, "cluster", "distance")
        table = [(r["cutoff"], names[r["cutoff"], r["g"]], r["size"], list(r["centre"])) for r in centre if (r["cutoff"], r["g"]) in names]
        return rows, spark.createDataFrame(table, "cutoff long, cluster long, size long, centre array<double>")
    finally:
        z.unpersist()
        raw.unpersist()
