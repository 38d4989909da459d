"""Fits on all earlier seasons and on sealed folds, solved from Gram matrices by availability.

``patterned`` adds up, in one pass, a Gram matrix for each group and each set of columns that a row has
(missing values count as zero there).  From those few matrices follow, without another look at the rows:
the fit of any subset of columns on the rows that have them, the fit of a mean over the columns that a row
has, the fit with missing values replaced by a constant, and, by adding or taking away groups, all of these
for the seasons before each one and for all folds but each one.  The number of matrices grows with groups
and with the patterns that occur, not with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gram import _solve, full, gram

#: Models that are screened in, evaluations that a model needs for a skill, rows for a fit, the ridge.
SCREEN_K, LEAST_SKILL, LEAST_FIT, RIDGE = 3, 200, 500, 50.0


def patterned(df: DataFrame, always: list[Column], columns: list[str], by: list[str]) -> DataFrame:
    """``by``, pattern (bit i: the row has columns[i]) and gram of ``always`` and then ``columns`` (0 where missing)."""
    if len(columns) > 62:
        raise ValueError("a pattern has 62 columns at most")
    bits = [F.when(F.col(c).isNotNull(), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, c in enumerate(columns)]
    pattern = F.aggregate(F.array(*bits), F.lit(0).cast("long"), lambda a, b: a + b) if columns else F.lit(0).cast("long")
    return gram(df.withColumn("pattern", pattern), [*always, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns)], [*by, "pattern"])


def _has(pattern: int, k: int) -> np.ndarray:
    return (pattern >> np.arange(k, dtype=np.int64) & 1).astype(bool)


def ridge_from(matrix: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of a ridge fit, the intercept free; columns: 1, regressors, target."""
    n, mean = matrix[0, 0], matrix[0] / matrix[0, 0]
    centred = matrix - n * np.outer(mean, mean)
    k = len(matrix) - 2
    b = _solve(centred[1:-1, 1:-1] + alpha * np.eye(k), centred[1:-1, -1])
    return b, float(mean[-1] - b @ mean[1:-1])


def elastic_net_from(matrix: np.ndarray, alpha: float, share: float, rounds: int = 10_000, close: float = 1e-10) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Elastic net on standardised regressors by coordinate descent; columns: 1, regressors, target.

    Minimises |y - a - Xb|^2 / 2n + alpha * share * |b|_1 + alpha * (1 - share) / 2 * |b|^2 over columns of mean 0
    and standard deviation 1 (a constant column keeps its scale).  Returns b, a, means and scales.
    """
    n, mean = matrix[0, 0], matrix[0] / matrix[0, 0]
    cov = matrix / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov)[1:-1], 0))
    scale[scale < 1e-12] = 1.0
    q, c = cov[1:-1, 1:-1] / np.outer(scale, scale), cov[1:-1, -1] / scale
    b, reach = np.zeros(len(c)), alpha * share
    for _ in range(rounds):
        was = b.copy()
        for j in range(len(c)):
            z = c[j] - q[j] @ b + q[j, j] * b[j]
            b[j] = np.sign(z) * max(abs(z) - reach, 0) / (q[j, j] + alpha * (1 - share)) if q[j, j] + alpha * (1 - share) > 0 else 0.0
        if np.abs(b - was).max(initial=0) < close:
            break
    return b, float(mean[-1]), mean[1:-1], scale


# Screened ensembles, season by season.


def _weights(models: list[str], screen: int, least_skill: int, least_fit: int, ridge: float):
    """Weights of every season from the matrices of all seasons before it; columns: 1, market, y, models."""
    k = len(models)

    def run(grams: pd.DataFrame) -> pd.DataFrame:
        out = []
        held = [(int(s), _has(int(p), k), full(g, k + 3)) for s, p, g in zip(grams["season"], grams["pattern"], grams["gram"], strict=True)]
        for season in sorted({s for s, _, _ in held}):
            past, now = [(h, m) for s, h, m in held if s < season], [(h, m) for s, h, m in held if s == season]
            rows = sum(m[0, 0] for _, m in now)
            share = sum(h * m[0, 0] for h, m in now) / rows
            active = np.flatnonzero(share >= 0.5)
            n, gain = np.zeros(k), np.zeros(k)
            for h, m in past:  # squared error of each model less the market's, on the rows that have it
                own = m[2, 2] + np.diag(m)[3:] - 2 * m[2, 3:]
                market = m[2, 2] + m[1, 1] - 2 * m[1, 2]
                n += h * m[0, 0]
                gain += h * (own - market)
            skill = {int(j): gain[j] / n[j] for j in np.flatnonzero(n >= max(least_skill, 1))}
            best = [j for j in sorted(skill, key=lambda j: (skill[j], j))[:screen] if j in active]
            best = best or active[:screen].tolist()
            row = {"season": season, "active": [models[j] for j in active], "screened": [models[j] for j in best], "n_train": 0, "recal": None, "blend": None, "ridge_columns": None, "ridge": None}
            # market, its recalibration, and the mean of the screened models a row has, less the market
            total = np.zeros((4, 4))
            for h, m in past:
                some = [j for j in best if h[j]]
                if some:
                    to = np.zeros((4, k + 3))
                    to[0, 0] = to[1, 1] = to[3, 2] = 1
                    to[2, [j + 3 for j in some]], to[2, 1] = 1 / len(some), -1
                    total += to @ m @ to.T
            if total[0, 0] > least_fit:
                row["n_train"] = int(round(total[0, 0]))
                row["blend"] = _solve(total[:3, :3], total[:3, 3]).tolist()
                row["recal"] = _solve(total[:2, :2], total[:2, 3]).tolist()
            had, before = sum((h * m[0, 0] for h, m in past), np.zeros(k)), sum(m[0, 0] for _, m in past)
            cols = [int(j) for j in active if before and had[j] / before > 0.8]
            whole = sum((m for h, m in past if h[cols].all()), np.zeros((k + 3, k + 3)))
            if cols and whole[0, 0] > least_fit:
                pick = [0, *(j + 3 for j in cols), 1, 2]
                b, a = ridge_from(whole[np.ix_(pick, pick)], ridge)
                row["ridge_columns"], row["ridge"] = [models[j] for j in cols], [a, *b.tolist()]
            out.append(row)
        return pd.DataFrame(out)

    return run


def ensemble_weights(forecasts: DataFrame, models: list[str], market: str, y: str, season: str = "season", screen: int = SCREEN_K, least_skill: int = LEAST_SKILL, least_fit: int = LEAST_FIT, ridge: float = RIDGE) -> DataFrame:
    """Weights of each season's ensembles, from the seasons before it only.

    ``active``: models that half of the season's games have; ``screened``: of the ``screen`` models with the lowest
    squared error against the market so far, those active (without any, the first active ones); ``recal`` and
    ``blend``: intercept, market and (screened mean - market); ``ridge``: intercept, ``ridge_columns``, market.
    One task solves all seasons from the matrices of season and pattern.
    """
    rows = forecasts.filter(F.col(y).isNotNull() & F.col(market).isNotNull())
    grams = patterned(rows, [F.lit(1.0), F.col(market), F.col(y)], models, [season]).withColumnRenamed(season, "season")
    schema = "season long, active array<string>, screened array<string>, n_train long, recal array<double>, blend array<double>, ridge_columns array<string>, ridge array<double>"
    return grams.groupBy().applyInPandas(_weights(models, screen, least_skill, least_fit, ridge), schema)


def ensembles(forecasts: DataFrame, models: list[str], market: str, y: str, season: str = "season", **options) -> DataFrame:
    """``forecasts`` with e1 to e5 and r0, each season's from the seasons before it.

    e1 mean and e2 median of the active models that a row has, e3 mean of the screened ones, e4 the market moved
    towards e3 by a fitted share, e5 a ridge over the active models, r0 the market recalibrated.
    """
    weights = ensemble_weights(forecasts, models, market, y, season, **options).withColumnRenamed("season", "__season")
    rows = forecasts.join(weights, F.col(season) == F.col("__season"), "left")
    named = F.create_map(*(x for m in models for x in (F.lit(m), F.col(m).cast("double"))))

    def picked(names: str) -> Column:
        return F.transform(F.coalesce(F.col(names), F.array().cast("array<string>")), lambda m: F.element_at("__values", m))

    def mean(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(values), F.lit(0))

    rows = rows.withColumn("__values", named)
    rows = rows.withColumns({"__active": F.sort_array(F.array_compact(picked("active"))), "__screened": F.array_compact(picked("screened")), "__ridge": picked("ridge_columns")})
    size, market_ = F.size("__active"), F.col(market).cast("double")
    middle = (F.get("__active", F.floor((size - 1) / 2).cast("int")) + F.get("__active", F.floor(size / 2).cast("int"))) / 2
    rows = rows.withColumns({"e1": mean(F.col("__active")), "e2": F.when(size > 0, middle), "e3": mean(F.col("__screened"))})
    w = lambda name, i: F.get(name, F.lit(i))
    e4 = w("blend", 0) + w("blend", 1) * market_ + w("blend", 2) * F.coalesce(F.col("e3") - market_, F.lit(0.0))
    whole = F.zip_with("__ridge", F.slice("ridge", 2, F.size("__ridge")), lambda x, b: x * b)
    e5 = F.aggregate(whole, F.lit(0.0), lambda a, x: a + x) + w("ridge", 0) + F.element_at("ridge", -1) * market_
    rows = rows.withColumns({"e4": e4, "e5": F.when(F.col("ridge").isNotNull(), e5), "r0": w("recal", 0) + w("recal", 1) * market_})
    return rows.drop("__values", "__active", "__screened", "__ridge", "__season", "active", "screened", "n_train", "recal", "blend", "ridge_columns", "ridge")


# Sealed folds.


def fold_of(key: Column, folds: int, seed: int) -> Column:
    """The fold of a row, by a hash of its key and the seed: the same at any partitioning and in SQL."""
    return (F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 7), 16, 10).cast("long") % folds).cast("long")


FOLD_SQL = "(('0x' || substr(md5(concat({key}, ':{seed}')), 1, 7))::BIGINT % {folds})"


def _net_fits(specs: dict[str, tuple[list[str], float, float]], columns: list[str], folds: int):
    k = len(columns)

    def run(grams: pd.DataFrame) -> pd.DataFrame:
        held = [(int(f), _has(int(p), k), full(g, k + 2), med) for f, p, g, med in zip(grams["fold"], grams["pattern"], grams["gram"], grams["medians"], strict=True)]
        out = []
        for fold in range(folds):
            # the training medians of a fold fill the missing values of its training rows
            fill = next((np.array([np.nan if m is None else m for m in med], float) for f, _, _, med in held if f == fold), None)
            if fill is None:
                continue
            fill, total = np.nan_to_num(fill), np.zeros((k + 2, k + 2))
            for f, has, m, _ in held:
                if f != fold:
                    to = np.eye(k + 2)
                    to[2:, 0] = np.where(has, 0, fill)
                    total += to @ m @ to.T
            if total[0, 0] < 2:
                continue
            for name, (mine, alpha, share) in specs.items():
                pick = [0, *(columns.index(c) + 2 for c in mine), 1]
                b, a, mean, scale = elastic_net_from(total[np.ix_(pick, pick)], alpha, share)
                out.append((name, fold, a, mine, b.tolist(), mean.tolist(), scale.tolist(), [float(fill[columns.index(c)]) for c in mine], int(round(total[0, 0]))))
        return pd.DataFrame(out, columns=["spec", "fold", "intercept", "names", "coef", "means", "scales", "fill", "n_train"])

    return run


def net_bakeoff(df: DataFrame, key: str, y: str, specs: dict[str, tuple[list[str], float, float]], folds: int = 5, seed: int = 0) -> DataFrame:
    """Fold scores of several column sets and penalties (columns, alpha, share of the absolute penalty).

    Missing values take the training median, columns are standardised on the training rows.  One pass gives the
    matrices of fold and pattern and one the medians of all folds but each; one task solves all fits; a last pass
    scores every row by the fits that did not see it.
    """
    columns = sorted({c for names, _, _ in specs.values() for c in names})
    rows = df.filter(F.col(y).isNotNull()).select(fold_of(F.col(key), folds, seed).alias("fold"), F.col(y).cast("double").alias("__y"), *(F.col(c).cast("double").alias(c) for c in columns))
    grams = patterned(rows, [F.lit(1.0), F.col("__y")], columns, ["fold"])
    without = rows.groupBy().agg(*(F.array(*(F.median(F.when(F.col("fold") != f, F.col(c))) for c in columns)).alias(f"__m{f}") for f in range(folds)))
    medians = without.select(F.posexplode(F.array(*(f"__m{f}" for f in range(folds)))).alias("__f", "medians"))
    grams = grams.join(F.broadcast(medians), F.col("fold") == F.col("__f")).drop("__f")
    schema = "spec string, fold long, intercept double, names array<string>, coef array<double>, means array<double>, scales array<double>, fill array<double>, n_train long"
    fits = grams.groupBy().applyInPandas(_net_fits(specs, columns, folds), schema)
    named = F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c))))
    scored = rows.withColumn("__v", named).select("fold", "__y", "__v").join(F.broadcast(fits), "fold")  # one row a fold and spec
    x = F.zip_with(F.transform("names", lambda c: F.element_at("__v", c)), "fill", lambda v, m: F.coalesce(v, m))
    z = F.zip_with(F.zip_with(x, "means", lambda v, m: v - m), "scales", lambda v, s: v / s)
    forecast = F.aggregate(F.zip_with(z, "coef", lambda v, b: v * b), F.lit(0.0), lambda a, v: a + v) + F.col("intercept")
    e = forecast - F.col("__y")
    return scored.groupBy("spec", "fold").agg(F.first("n_train").alias("n_train"), F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.first(F.size(F.filter("coef", lambda b: b != 0))).cast("long").alias("kept"))


def probit_bakeoff(df: DataFrame, key: str, hit: str, specs: dict[str, list[str]], folds: int = 5, seed: int = 0, hurdle: float = 0.5238, rounds: int = 12) -> DataFrame:
    """Bets of probit models on the folds they were not fitted on, where the forecast exceeds ``hurdle``.

    All models of all folds are scored in one pass a round: a task adds up gradient and information of every
    (spec, fold) from its batch, Spark adds up the tasks, the driver solves the small systems.  Columns are
    standardised on the training rows.  Rows with a missing column or result are left out.
    """
    columns = sorted({c for names in specs.values() for c in names})
    rows = df.select(fold_of(F.col(key), folds, seed).alias("fold"), F.col(hit).cast("double").alias("__y"), *(F.col(c).cast("double").alias(c) for c in columns)).dropna().persist()
    try:
        k = len(columns)
        sums = {r["fold"]: full(r["gram"], k + 1) for r in gram(rows, [F.lit(1.0), *columns], ["fold"]).collect()}
        scale = {}
        for f in range(folds):
            m = sum((s for g, s in sums.items() if g != f), np.zeros((k + 1, k + 1)))
            if m[0, 0] > k + 1 and f in sums:
                mean = m[0, 1:] / m[0, 0]
                sd = np.sqrt(np.maximum(np.diag(m)[1:] / m[0, 0] - mean**2, 0))
                scale[f] = mean, np.where(sd > 1e-12, sd, 1.0)
        at = {s: [columns.index(c) for c in names] for s, names in specs.items()}
        beta = {(s, f): np.zeros(len(at[s]) + 1) for s in specs for f in scale}

        def design(x: np.ndarray, s: str, f: int) -> np.ndarray:
            return np.column_stack([np.ones(len(x)), (x[:, at[s]] - scale[f][0][at[s]]) / scale[f][1][at[s]]])

        for _ in range(rounds):
            sent = {key_: b.copy() for key_, b in beta.items()}

            def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    x, y, fold, out = batch[columns].to_numpy(), batch["__y"].to_numpy(), batch["fold"].to_numpy(), []
                    for (s, f), b in sent.items():
                        d, t = design(x[fold != f], s, f), y[fold != f]
                        z = d @ b
                        p, dens = np.clip(_phi(z), 1e-9, 1 - 1e-9), np.exp(-z * z / 2) * 0.3989422804014327
                        w = dens * dens / (p * (1 - p))
                        out.append((s, f, np.concatenate([d.T @ ((t - p) * dens / (p * (1 - p))), ((d * w[:, None]).T @ d).ravel()]).tolist()))
                    yield pd.DataFrame(out, columns=["spec", "fold", "s"])

            if not beta:
                break
            most = max(len(b) for b in beta.values())
            each = rows.mapInPandas(partial, "spec string, fold long, s array<double>")
            found = each.groupBy("spec", "fold").agg(F.array(*(F.sum(F.get("s", F.lit(i))) for i in range(most * most + most))).alias("s")).collect()
            moved = 0.0
            for r in found:
                b = beta[r["spec"], r["fold"]]
                s = np.array([v for v in r["s"] if v is not None])
                step = _solve(s[len(b) :].reshape(len(b), len(b)), s[: len(b)])
                beta[r["spec"], r["fold"]], moved = b + step, max(moved, np.abs(step).max())
            if moved < 1e-10:
                break

        def bets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x, y, fold, out = batch[columns].to_numpy(), batch["__y"].to_numpy(), batch["fold"].to_numpy(), []
                for (s, f), b in beta.items():
                    p, t = _phi(design(x[fold == f], s, f) @ b), y[fold == f]
                    on = p > hurdle
                    q = np.clip(p[on], 1e-6, 1 - 1e-6)
                    out.append((s, f, int((fold == f).sum()), int(on.sum()), int(t[on].sum()), float(-(t[on] * np.log(q) + (1 - t[on]) * np.log(1 - q)).sum())))
                yield pd.DataFrame(out, columns=["spec", "fold", "n", "bets", "wins", "loss"])

        each = rows.mapInPandas(bets, "spec string, fold long, n long, bets long, wins long, loss double")
        out = each.groupBy("spec", "fold").agg(*(F.sum(c).alias(c) for c in ("n", "bets", "wins", "loss")))
        none = F.nullif(F.col("bets"), F.lit(0))
        unit = (F.col("wins") * 100 - (F.col("bets") - F.col("wins")) * 110) / (none * 110)
        out = out.select("spec", "fold", "n", "bets", "wins", (F.col("wins") / none).alias("win_rate"), F.coalesce(unit, F.lit(0.0)).alias("unit_return"), (F.col("loss") / none).alias("log_loss"))
        return df.sparkSession.createDataFrame(out.collect(), out.schema)  # folds x specs rows; the stored input is released below
    finally:
        rows.unpersist()


def _phi(z: np.ndarray) -> np.ndarray:
    from math import erfc, sqrt

    return np.array([0.5 * erfc(-v / sqrt(2)) for v in z]) if len(z) else np.zeros(0)
