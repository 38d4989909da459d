"""Regressions from Gram matrices: one pass over the rows, whatever the number of regressors and tests.

``gram`` adds up the products of all pairs of columns by group, as the packed upper triangle in one array.
Everything after it works on those arrays: fits, standard errors, joint tests, fits robust to clusters (whose
scores are sums too: X'y - X'Xb of a cluster's own Gram matrix), residual sums of any subset of columns, and
the matrices of other row sets by adding and subtracting.  Rows with a null in any of the columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import f_tail, t_tails

#: Sums up to which a matrix is one generated aggregate; larger ones are added up as arrays in Arrow batches.
GENERATED = 120


def triangle(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def full(packed, k: int) -> np.ndarray:
    """The symmetric matrix of a packed triangle."""
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = packed
    return out + np.triu(out, 1).T


def width(packed: int) -> int:
    return int((np.sqrt(8 * packed + 1) - 1) / 2 + 0.5)


def summed(rows: DataFrame, column: str, by: list[str], size: int) -> DataFrame:
    """Element by element sums of an array column of one size."""
    if size <= GENERATED:
        return rows.groupBy(*by).agg(F.array(*(F.sum(F.get(column, F.lit(i))) for i in range(size))).alias(column))
    each = rows.select(*by, F.posexplode(column).alias("__i", "__v")).groupBy(*by, "__i").agg(F.sum("__v").alias("__v"))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__v"))), lambda s: s["__v"]).alias(column))


def gram(df: DataFrame, columns: list[Column | str], by: list[str]) -> DataFrame:
    """``by`` and ``gram``: sums of products of all pairs of ``columns``, packed row by row."""
    k = len(columns)
    rows = df.select(*by, *((F.col(c) if isinstance(c, str) else c).cast("double").alias(f"__{i}") for i, c in enumerate(columns))).dropna(subset=[f"__{i}" for i in range(k)])
    if len(triangle(k)) <= GENERATED:
        return rows.groupBy(*by).agg(F.array(*(F.sum(F.col(f"__{i}") * F.col(f"__{j}")) for i, j in triangle(k))).alias("gram"))
    upper = np.triu_indices(k)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f"__{i}").to_numpy() for i in range(k)])
            keys = pa.Table.from_batches([batch]).select(by)
            groups = keys.append_column("__row", pa.array(np.arange(batch.num_rows))).group_by(by, use_threads=False).aggregate([("__row", "list")])
            sums = [(x[r].T @ x[r])[upper] for r in groups.column("__row_list").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(groups.column(b).combine_chunks() for b in by), pa.array(sums, pa.list_(pa.float64()))], names=[*by, "gram"])

    kinds = dict(df.dtypes)
    return summed(rows.mapInArrow(partial, ", ".join([*(f"`{b}` {kinds[b]}" for b in by), "gram array<double>"])), "gram", by, len(triangle(k)))


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(a) @ b


_FIT = "coef array<double>, se array<double>, rss double, r2 double, wald array<double>"


def _fitted(restrictions: list[tuple[np.ndarray, np.ndarray]], intercept: bool):
    """Fit of the last column on the others, from a packed matrix; Wald statistics of the restrictions."""

    def run(packed: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for g, rows in zip(packed, n, strict=True):
            m = full(g, width(len(g)))
            k = len(m) - 1
            xx, xy, yy = m[:k, :k], m[:k, k], m[k, k]
            if rows <= k:
                out.append((None, None, None, None, None))
                continue
            b = _solve(xx, xy)
            rss = max(yy - b @ xy, 0.0)
            inverse = _solve(xx, np.eye(k))
            cov = rss / (rows - k) * inverse
            total = yy - xy[0] ** 2 / rows if intercept else yy
            wald = [_wald(b, cov, r, v) for r, v in restrictions]
            out.append((b.tolist(), np.sqrt(np.maximum(np.diag(cov), 0)).tolist(), rss, 1 - rss / total if total > 0 else None, wald))
        return pd.DataFrame(out, columns=["coef", "se", "rss", "r2", "wald"])

    return run


def _wald(b: np.ndarray, cov: np.ndarray, r: np.ndarray, v: np.ndarray) -> float | None:
    d = r @ b - v
    try:
        return float(d @ np.linalg.solve(r @ cov @ r.T, d)) / len(v)
    except np.linalg.LinAlgError:
        return None


def _score(packed: pd.Series, coef: pd.Series) -> pd.Series:
    """Packed outer product of a cluster's score."""
    out = []
    for g, b in zip(packed, coef, strict=True):
        k = len(b)
        m = full(g, k + 1)
        s = m[:k, k] - m[:k, :k] @ np.asarray(b)
        out.append(np.outer(s, s)[np.triu_indices(k)].tolist())
    return pd.Series(out)


def _robust(restrictions: list[tuple[np.ndarray, np.ndarray]]):
    """Standard errors and Wald statistics of a covariance that is robust to clusters."""

    def run(packed: pd.Series, meat: pd.Series, coef: pd.Series, n: pd.Series, clusters: pd.Series) -> pd.DataFrame:
        out = []
        for g, inner, b, rows, c in zip(packed, meat, coef, n, clusters, strict=True):
            if b is None or c < 2:
                out.append((None, None))
                continue
            b, k = np.asarray(b), len(b)
            bread = _solve(full(g, k + 1)[:k, :k], np.eye(k))
            cov = c / (c - 1) * (rows - 1) / (rows - k) * bread @ full(inner, k) @ bread
            out.append((np.sqrt(np.maximum(np.diag(cov), 0)).tolist(), [_wald(b, cov, r, v) for r, v in restrictions]))
        return pd.DataFrame(out, columns=["se", "wald"])

    return run


def regress(df: DataFrame, y: str, columns: list[str], by: list[str], tests: dict[str, list[tuple[dict[str, float], float]]] | None = None, cluster: list[str] | None = None, intercept: bool = True) -> DataFrame:
    """Least squares of ``y`` on ``columns`` in each group, with joint tests of linear restrictions.

    ``tests`` maps a name to restrictions ``({column: weight, ...}, value)``; ``intercept`` is a column's name there.
    Returns n, r2, sigma, coef_<column>, se_<column>, p_<column>, and for each test f_<name> and p_<name> of the exact
    F distribution; with ``cluster``, clusters, cluster_se_<column>, cluster_f_<name> and cluster_p_<name> as well
    (n and clusters corrected, clusters - 1 denominator degrees).  A group with no more rows than columns has nulls.
    """
    tests = tests or {}
    names = [*(["intercept"] if intercept else []), *columns]
    restrictions = []
    for rows in tests.values():
        r = np.zeros((len(rows), len(names)))
        for i, (weights, _) in enumerate(rows):
            for c, w in weights.items():
                r[i, names.index(c)] = w
        restrictions.append((r, np.array([v for _, v in rows], float)))
    k = len(names)
    x = [F.lit(1.0) if c == "intercept" and intercept else F.col(c) for c in names]
    # a column of ones in front counts the rows
    packed = gram(df, [F.lit(1.0), *x[intercept:], F.col(y)], [*by, *(cluster or [])])
    size = len(triangle(k + 1 + (not intercept)))
    total = (summed(packed, "gram", by, size) if cluster else packed).withColumn("n", F.get("gram", F.lit(0)).cast("long"))
    own = F.col("gram") if intercept else F.slice("gram", k + 3, size)
    fitted = F.pandas_udf(_fitted(restrictions, intercept), _FIT)
    out = total.withColumn("own", own).withColumn("fit", fitted("own", "n"))
    df2 = (F.col("n") - k).cast("double")
    picked = [*by, "n", F.col("fit.r2").alias("r2"), F.sqrt(F.col("fit.rss") / F.nullif(df2, F.lit(0.0))).alias("sigma")]
    for i, c in enumerate(names):
        b, se = F.get("fit.coef", F.lit(i)), F.get("fit.se", F.lit(i))
        picked += [b.alias(f"coef_{c}"), se.alias(f"se_{c}"), t_tails(b / F.nullif(se, F.lit(0.0)), df2).alias(f"p_{c}")]
    for i, (name, rows) in enumerate(tests.items()):
        f = F.get("fit.wald", F.lit(i))
        picked += [f.alias(f"f_{name}"), f_tail(f, F.lit(float(len(rows))), df2).alias(f"p_{name}")]
    if not cluster:
        return out.select(*picked)
    slim = out.select(*(F.col(b).alias(f"__by_{b}") for b in by), F.col("fit.coef").alias("coef"))
    same = [F.col(b).eqNullSafe(F.col(f"__by_{b}")) for b in by]
    scores = packed.withColumn("own", own).join(slim, same or F.lit(True), "inner").filter("coef IS NOT NULL")
    scores = scores.select(*by, F.pandas_udf(_score, "array<double>")("own", "coef").alias("meat"))
    meat = summed(scores, "meat", by, len(triangle(k)))
    counted = packed.groupBy(*by).agg(F.count(F.lit(1)).alias("clusters"))
    both = counted.join(meat, by, "left") if by else counted.crossJoin(meat)  # one row each without groups
    both = both.select(*(F.col(b).alias(f"__by_{b}") for b in by), "clusters", "meat")
    out = out.join(both, same or F.lit(True), "left")
    robust = F.pandas_udf(_robust(restrictions), "se array<double>, wald array<double>")
    out = out.withColumn("robust", robust("own", "meat", "fit.coef", "n", "clusters"))
    picked += ["clusters", *(F.get("robust.se", F.lit(i)).alias(f"cluster_se_{c}") for i, c in enumerate(names))]
    for i, (name, rows) in enumerate(tests.items()):
        f = F.get("robust.wald", F.lit(i))
        picked += [f.alias(f"cluster_f_{name}"), f_tail(f, F.lit(float(len(rows))), (F.col("clusters") - 1).cast("double")).alias(f"cluster_p_{name}")]
    return out.select(*picked)


def _residual(packed: pd.Series) -> pd.Series:
    out = []
    for g in packed:
        m = full(g, width(len(g)))
        k = len(m) - 1
        out.append(max(m[k, k] - m[:k, k] @ _solve(m[:k, :k], m[:k, k]), 0.0))
    return pd.Series(out, dtype=float)


def residual_sum(packed: str) -> Column:
    """Residual sum of squares of the last column on the others."""
    return F.pandas_udf(_residual, "double")(packed)


def chow(df: DataFrame, columns: list[str], y: str, split: Column, by: list[str], intercept: bool = True) -> DataFrame:
    """F value and exact p of one set of coefficients for both parts against a set for each.

    ``split`` is a boolean; rows where it is null are left out, groups with one part only too."""
    x = [*([F.lit(1.0)] if intercept else []), *(F.col(c) for c in columns)]
    k, size = len(x), len(triangle(len(x) + 1))
    kept = df.withColumn("__part", split).filter("__part IS NOT NULL")
    ones = kept.dropna(subset=[*columns, y])
    parts = gram(ones, [*x, F.col(y)], [*by, "__part"])
    counted = ones.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__n"))
    apart = parts.withColumn("__s", residual_sum("gram")).join(counted, [*by, "__part"])
    whole = summed(parts, "gram", by, size).withColumn("pooled", residual_sum("gram")).drop("gram")
    halves = apart.groupBy(*by).agg(F.sum("__s").alias("apart"), F.sum("__n").alias("n"), F.count(F.lit(1)).alias("__parts"))
    out = (whole.join(halves, by) if by else whole.crossJoin(halves)).filter("__parts = 2")
    d1, d2 = F.lit(float(k)), (F.col("n") - 2 * k).cast("double")
    f = ((F.col("pooled") - F.col("apart")) / d1) / (F.col("apart") / F.nullif(d2, F.lit(0.0)))
    return out.withColumn("f", F.when(d2 > 0, f)).select(*by, "n", "f", f_tail(F.col("f"), d1, d2).alias("p"))
