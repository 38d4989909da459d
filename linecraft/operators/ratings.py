"""Rating and forecast models.

Spark prepares sums and small design rows; a model of some hundred parameters is solved inside one
task a group (season, cutoff), groups side by side.  No group holds more than a season's games.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import norm_cdf


def snapshot(games: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Games of a cutoff's season that began strictly before it, once for each cutoff."""
    return games.join(cutoffs, "season").filter("kickoff < cutoff")


def evidence(games: DataFrame) -> DataFrame:
    """Whether a game can teach, and why not: scores that do not add up, or drives that differ by over two."""
    reason = F.when(F.col("points").isNull(), "unplayed").when(F.col("quarters") != F.col("points"), "line score").when(F.abs(F.col("drives_off") - F.col("drives_def")) > 2, "drives")
    return games.withColumn("dropped", reason)


RATING = "season int, cutoff string, team long, attack double, defence double, pace double, n int"


def _ridge(strength: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        teams = np.unique(np.concatenate([pdf["team"], pdf["opponent"]]))
        k, a, b = len(teams), np.searchsorted(teams, pdf["team"]), np.searchsorted(teams, pdf["opponent"])
        x = np.zeros((len(pdf), 2 * k + 2))
        x[np.arange(len(pdf)), a], x[np.arange(len(pdf)), k + b] = 1, 1
        x[:, -2], x[:, -1] = 1, pdf["is_home"] - 0.5
        penalty = np.diag([strength] * (2 * k) + [0.0, 0.0])
        gram = x.T @ (x * pdf["w"].to_numpy(float)[:, None]) + penalty
        fit = np.linalg.solve(gram, x.T @ pdf["wr"].to_numpy(float))
        pace = np.linalg.solve(gram, x.T @ pdf["ww"].to_numpy(float))
        n = np.bincount(a, pdf["n"].to_numpy(), k).astype(np.int64)
        return pd.DataFrame({"season": int(pdf["season"].iloc[0]), "cutoff": str(pdf["cutoff"].iloc[0]), "team": teams, "attack": fit[:k], "defence": fit[k : 2 * k], "pace": pace[:k] + pace[k : 2 * k] + pace[-2], "n": n})

    return run


def ratings_at(rows: DataFrame, strength: float = 10.0) -> DataFrame:
    """Ridge ratings of points per possession and of pace at every cutoff.

    ``rows``: season, cutoff, team, opponent, is_home, rate (points per possession), weight (possessions).
    Team effects are penalised, the level and the home edge are not.  Rows are added up to pairings first, so a
    task holds two rows a pair of teams, whatever the number of games.
    """
    w, r = F.col("weight").cast("double"), F.col("rate").cast("double")
    sums = rows.dropna(subset=["team", "opponent", "is_home", "rate", "weight"]).groupBy("season", "cutoff", "team", "opponent", "is_home").agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), F.sum(w * r).alias("wr"), F.sum(w * w).alias("ww"))
    return sums.groupBy("season", "cutoff").applyInPandas(_ridge(strength), RATING)


def total_forecast(home: DataFrame, possessions: Column, level: Column) -> Column:
    """Points of a game: possessions times both sides' points per possession, and a constant."""
    return possessions * (2 * level + F.col("home_attack") + F.col("away_defence") + F.col("away_attack") + F.col("home_defence"))


def decayed(rows: DataFrame, key: list[str], order: str, x: str, decay: float) -> DataFrame:
    """Mean of the values so far, each weighing ``decay`` to the power of its age, the own row excluded.

    Sums scaled by decay^-order make it two running sums in one window; the scale starts anew in each
    group, so it stays within a double for a season's weeks.
    """
    w = Window.partitionBy(*key).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    base = F.col(order) - F.min(order).over(Window.partitionBy(*key))
    scale = F.pow(F.lit(1 / decay), base)
    ok = F.when(F.col(x).isNotNull(), scale)
    return rows.withColumn("rating", F.sum(F.col(x) * scale).over(w) / F.sum(ok).over(w))


KALMAN = "team long, season int, week int, mean double, variance double"


def _filter(drift: float, noise: float, start: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, m, v, last = [], 0.0, start, None
        for week, part in pdf.sort_values("week").groupby("week"):
            if last is not None:
                v += drift * (week - last)
            out.append((int(pdf["team"].iloc[0]), int(pdf["season"].iloc[0]), int(week), m, v))
            precision = 1 / v + len(part) / noise
            m = (m / v + part["x"].sum() / noise) / precision
            v, last = 1 / precision, week
        return pd.DataFrame(out, columns=["team", "season", "week", "mean", "variance"])

    return run


def kalman(rows: DataFrame, drift: float = 1.0, noise: float = 100.0, start: float = 50.0) -> DataFrame:
    """Local-level filter of every team: its state before each week, from the weeks before."""
    return rows.groupBy("team", "season").applyInPandas(_filter(drift, noise, start), KALMAN)


def carry_over(ratings: DataFrame, unit: str, season: str, x: str, returning: str) -> DataFrame:
    """Priors of each unit from its rating of the season before and its returning production.

    Over all pairs of seasons: rating = (b + c * returning) * rating before, without intercept, ratings centred by
    season; standard errors by units (no small-sample factor).  A unit without ``returning`` takes the season's mean for
    its prior and teaches nothing.  Priors are centred by season.  Returns unit, season, prior, b, c, se_b, se_c, source.
    """
    centred = ratings.withColumn("__c", F.col(x) - F.avg(x).over(Window.partitionBy(season)))
    was = centred.select(unit, (F.col(season) + 1).alias(season), F.col("__c").alias("__u"))
    both = was.join(centred.select(unit, season, F.col("__c").alias("__now"), returning), [unit, season], "left")
    pairs = both.dropna(subset=["__now", "__u", returning]).withColumn("__z", F.col(returning) * F.col("__u"))
    products = {"uu": ("__u", "__u"), "uz": ("__u", "__z"), "zz": ("__z", "__z"), "uy": ("__u", "__now"), "zy": ("__z", "__now")}
    per = pairs.groupBy(unit).agg(*(F.sum(F.col(i) * F.col(j)).alias(k) for k, (i, j) in products.items()))
    total = per.agg(*(F.sum(k).alias(f"t_{k}") for k in products))
    det = F.nullif(F.col("t_uu") * F.col("t_zz") - F.col("t_uz") * F.col("t_uz"), F.lit(0.0))
    fit = total.select("*", ((F.col("t_zz") * F.col("t_uy") - F.col("t_uz") * F.col("t_zy")) / det).alias("b"), ((F.col("t_uu") * F.col("t_zy") - F.col("t_uz") * F.col("t_uy")) / det).alias("c"), det.alias("det"))
    scored = per.crossJoin(F.broadcast(fit)).withColumns({"su": F.col("uy") - F.col("b") * F.col("uu") - F.col("c") * F.col("uz"), "sz": F.col("zy") - F.col("b") * F.col("uz") - F.col("c") * F.col("zz")})
    m = {k: F.sum(F.col(i) * F.col(j)) for k, (i, j) in {"m11": ("su", "su"), "m12": ("su", "sz"), "m22": ("sz", "sz")}.items()}
    fit = scored.groupBy("b", "c", "det", "t_uu", "t_uz", "t_zz").agg(*(v.alias(k) for k, v in m.items()))
    var = lambda p, q: (p * p * F.col("m11") - 2 * p * q * F.col("m12") + q * q * F.col("m22")) / (F.col("det") * F.col("det"))
    fit = fit.select("b", "c", F.sqrt(F.greatest(var(F.col("t_zz"), F.col("t_uz")), F.lit(0.0))).alias("se_b"), F.sqrt(F.greatest(var(F.col("t_uz"), F.col("t_uu")), F.lit(0.0))).alias("se_c"))
    # the season's own returning production, known before its first game
    asked = was.join(ratings.select(unit, season, F.col(returning).alias("__r")), [unit, season], "left")
    held = F.coalesce("__r", F.avg("__r").over(Window.partitionBy(season)), F.avg("__r").over(Window.partitionBy(F.lit(0))))
    out = asked.withColumns({"__h": held, "source": F.when(F.col("__r").isNull(), "imputed").otherwise("carryover")}).crossJoin(F.broadcast(fit))
    raw = (F.col("b") + F.col("c") * F.col("__h")) * F.col("__u")
    return out.withColumn("__p", raw).select(unit, season, (F.col("__p") - F.avg("__p").over(Window.partitionBy(season))).alias("prior"), "b", "c", "se_b", "se_c", "source")


def censored_bias(mean: Column, sd: Column) -> Column:
    """How much scoring below zero that cannot happen lifts the expected points: E[max(X, 0)] - E[X]."""
    z = mean / sd
    density = F.exp(-z * z / 2) * 0.3989422804014327
    return mean * norm_cdf(z) + sd * density - mean


def ceiling_bias(mean: Column, sd: Column, top: Column) -> Column:
    """The mirror image at a ceiling: E[min(X, top)] - E[X]."""
    return -censored_bias(top - mean, sd)


def over_probability(mean_a: Column, mean_b: Column, sd: Column, line: Column) -> Column:
    """P(total > line) with both sides' floors in the mean."""
    lifted = mean_a + mean_b + censored_bias(mean_a, sd) + censored_bias(mean_b, sd)
    return 1 - norm_cdf((line - lifted) / (sd * F.sqrt(F.lit(2.0))))


def holdout_folds(games: DataFrame, season: str, kickoff: str, embargo_days: int) -> DataFrame:
    """Row roles of every season's fold: test, train (earlier seasons), or none (inside the embargo before the test)."""
    starts = games.groupBy(F.col(season).alias("fold")).agg(F.min(kickoff).alias("__start"))
    known = starts.agg(F.sort_array(F.collect_list(F.struct("fold", "__start"))).alias("__folds"))  # one row of seasons
    later = F.filter("__folds", lambda f: f["fold"] >= F.col(season))
    rows = games.filter(F.col(season).isNotNull()).crossJoin(F.broadcast(known)).select(*games.columns, F.explode(later).alias("__f"))
    gap = F.datediff(F.col("__f.__start"), F.col(kickoff))
    role = F.when(F.col(season) == F.col("__f.fold"), "test").when(gap > embargo_days, "train").otherwise("embargo")
    return rows.select(*games.columns, F.col("__f.fold").alias("fold"), role.alias("role"))


def consensus(df: DataFrame, key: list[str], forecasts: list[str]) -> DataFrame:
    """Mean, median and spread of the forecasts that a row has; two at least."""
    values = F.array_compact(F.array(*forecasts))
    n = F.size(values)
    s = F.sort_array(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    middle = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    return df.select(*key, n.cast("long").alias("n"), mean.alias("mean"), middle.alias("median"), (F.array_max(values) - F.array_min(values)).alias("spread")).filter("n >= 2")


def anchored(line: Column, forecast: Column, share: Column) -> Column:
    """The market line moved by a share of the way to the forecast."""
    return line + share * (forecast - line)


def clusters(df: DataFrame, key: list[str], columns: list[str], k: int = 5, seed: int = 3) -> DataFrame:
    """K-means groups of rows, numbered by the mean of the first column, so that labels do not depend on the run."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=columns, outputCol="__x", handleInvalid="skip").transform(df)
    found = KMeans(k=k, seed=seed, featuresCol="__x", predictionCol="__g").fit(ready).transform(ready)
    names = found.groupBy("__g").agg(F.avg(columns[0]).alias("__m")).withColumn("cluster", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__m")))
    return found.join(F.broadcast(names.select("__g", "cluster")), "__g").select(*key, "cluster")


def loadings(df: DataFrame, columns: list[str], k: int = 2) -> DataFrame:
    """Principal axes of standardised columns: (column, axis, loading), the largest loading of an axis positive."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    ready = VectorAssembler(inputCols=columns, outputCol="__x", handleInvalid="skip").transform(df)
    scaled = StandardScaler(withMean=True, withStd=True, inputCol="__x", outputCol="__z").fit(ready).transform(ready)
    axes = PCA(k=k, inputCol="__z", outputCol="__p").fit(scaled).pc.toArray()
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(k)])
    rows = [(c, j + 1, float(axes[i, j])) for i, c in enumerate(columns) for j in range(k)]
    return df.sparkSession.createDataFrame(rows, "column string, axis int, loading double")


def boosted_walk(df: DataFrame, columns: list[str], y: str, season: str, key: list[str], least: int = 2) -> DataFrame:
    """Boosted trees refitted on all seasons before each one; missing features take the training median.

    Rows with equal features get equal forecasts, so a fit by squares needs only their number and mean: the rows are
    summed once by season and features, and the trees are grown from these sums, weighted by the number.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    seasons = sorted(r[0] for r in df.select(season).distinct().collect())
    known = {c: F.nullif(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns}
    per = df.filter(F.col(y).isNotNull()).groupBy(season, *(x.alias(c) for c, x in known.items())).agg(F.count(F.lit(1)).alias("__n"), F.sum(y).alias("__y")).persist()
    vector = VectorAssembler(inputCols=[f"__{c}" for c in columns], outputCol="__x")
    parts = []
    for s in seasons[least:]:
        past, test = per.filter(F.col(season) < s), df.filter(F.col(season) == s)
        middle = past.agg(*(F.percentile(c, 0.5, F.col("__n")).alias(c) for c in columns)).first()
        filled = {c: F.coalesce(x, F.lit(middle[c])).alias(f"__{c}") for c, x in known.items()}
        train = past.groupBy(*filled.values()).agg(F.sum("__n").cast("double").alias("__weight"), (F.sum("__y") / F.sum("__n")).alias("__mean"))
        trees = GBTRegressor(featuresCol="__x", labelCol="__mean", weightCol="__weight", maxIter=10, maxDepth=3, seed=5).fit(vector.transform(train))
        parts.append(trees.transform(vector.transform(test.select("*", *filled.values()))).select(*key, F.col("prediction").alias("forecast")))
    per.unpersist()
    if not parts:
        return df.sparkSession.createDataFrame([], T.StructType([*(df.schema[k] for k in key), T.StructField("forecast", T.DoubleType())]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def huber_line(df: DataFrame, columns: list[str], y: str) -> dict[str, float]:
    """A regression that outliers do not bend; coefficients by column and the intercept."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    ready = VectorAssembler(inputCols=columns, outputCol="__x", handleInvalid="skip").transform(df.filter(F.col(y).isNotNull()))
    fit = LinearRegression(featuresCol="__x", labelCol=y, loss="huber", maxIter=50).fit(ready)
    return dict(zip(columns, fit.coefficients.tolist(), strict=True)) | {"intercept": fit.intercept}


MIXED = "season int, team long, effect double, se double, blended double"


def _mixed(prior_sd: float, rounds: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        teams = np.unique(np.concatenate([pdf["team"], pdf["opponent"]]))
        k = len(teams)
        a, b = np.searchsorted(teams, pdf["team"]), np.searchsorted(teams, pdf["opponent"])
        z = np.zeros((len(pdf), 2 * k))
        z[np.arange(len(pdf)), a], z[np.arange(len(pdf)), k + b] = 1, 1
        n, total = pdf["n"].to_numpy(float), pdf["n"].sum()
        level = pdf["s"].sum() / total
        zy = z.T @ (pdf["s"].to_numpy(float) - level * n)
        gram, yy = z.T @ (z * n[:, None]), pdf["ss"].sum() - level * pdf["s"].sum()
        s_e, s_u = yy / total, np.full(2, yy / total / 4)
        for _ in range(rounds):  # expectation and maximisation of the three variances
            ridge = np.repeat(s_e / np.maximum(s_u, 1e-9), k)
            cov = np.linalg.inv(gram + np.diag(ridge))
            u = cov @ zy
            spread = np.diag(cov) * s_e
            s_u = np.array([(u[:k] ** 2 + spread[:k]).mean(), (u[k:] ** 2 + spread[k:]).mean()])
            s_e = (yy - 2 * u @ zy + u @ gram @ u + s_e * np.trace(gram @ cov)) / total
        se = np.sqrt(spread[:k])
        weight = 1 / se**2 / (1 / se**2 + 1 / prior_sd**2)
        return pd.DataFrame({"season": int(pdf["season"].iloc[0]), "team": teams, "effect": u[:k], "se": se, "blended": weight * u[:k]})

    return run


def mixed_model(rows: DataFrame, prior_sd: float = 5.0, rounds: int = 20) -> DataFrame:
    """Crossed random effects of attack and defence by season, their standard errors, and the blend with a zero prior by precision.

    Rows are added up to pairings first: the fit needs counts, sums and squares of each only.
    """
    y = F.col("y").cast("double")
    sums = rows.dropna(subset=["team", "opponent", "y"]).groupBy("season", "team", "opponent").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("ss"))
    return sums.groupBy("season").applyInPandas(_mixed(prior_sd, rounds), MIXED)


def random_search(spaces: dict[str, tuple[float, float]], trials: int, seed: int = 1) -> Iterator[dict[str, float]]:
    """Seeded draws of parameters, each from its own range."""
    rng = np.random.default_rng(seed)
    for _ in range(trials):
        yield {k: float(rng.uniform(*v)) for k, v in spaces.items()}
