"""Mixing sources to target weights by balanced sampling with the cube method.

Every source gets a target of words; ``target / source size`` is the expected number of times that
each of its documents is taken.  The whole part is taken for sure, the rest is an inclusion
probability.  The cube method moves these probabilities along null vectors of the constraints
(number of documents, number of words), which keeps both totals, until each is 0 or 1.  Chunks of
documents fly side by side, large documents first; what each leaves undecided (two documents at
most) flies on in merged chunks.  ``LAND`` documents of the first chunk of a source, whose sizes fall
from the largest by about 40 % each, stay on the ground until the end; together with the last one or two in flight they
are the small landing problem, whose choice nearest to the balance of words (then of documents) is
taken.

Defined cases: a null or empty text has size 0 and takes nothing; null sources form one source, the
last; equal rows are merged before the flight and share what they take; an empty table gives an
empty result; documents may carry any further columns.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship, size_in_words, stored, table

CHUNK = 4096
MERGE = 1024
#: Documents of a source that wait for the landing: 2^(LAND + 2) choices are weighed at most.
LAND = 12
#: Sources up to which the table of sources is broadcast; beyond it the join is shuffled.
BROADCAST_SOURCES = 100_000


def source_targets(sized: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """One row per source: its size, rows and target.

    Sources by code point, null last, weigh ``weights`` in turn.  Targets share the total by weight;
    one that exceeds ``most`` times its source's size stops there and the others share the excess.
    In the order of size per weight the stopped ones come first, so one pass finds them.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    per = per.withColumn("w", weight).withColumn("top", F.lit(float(most)) * F.col("source_size"))
    rising = Window.orderBy(F.col("top") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = lambda c: F.coalesce(F.sum(c).over(rising), F.lit(0.0))
    rate = (F.sum("source_size").over(everything) - before("top")) / (F.sum("w").over(everything) - before("w"))
    per = per.withColumn("rate", rate).withColumn("stopped", F.col("top") / F.col("w") <= F.col("rate"))
    final = F.max(F.when(~F.col("stopped"), F.col("rate"))).over(everything)
    target = F.when(F.col("stopped"), F.col("top")).otherwise(final * F.col("w"))
    return per.withColumn("target", target).select("source", "source_size", "n", "target")


def _null_vector(a: list[float]) -> tuple[float, float, float]:
    """A vector u with sum(u) = 0 and sum(u * a) = 0 for three sizes a."""
    u = (a[2] - a[1], a[0] - a[2], a[1] - a[0])
    return (1.0, -1.0, 0.0) if u == (0.0, 0.0, 0.0) else u


def flight(prob: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight: 0 or 1 but for two at most; both totals are kept."""
    p = prob.astype(float).tolist()
    s = size.astype(float).tolist()
    eps = 1e-9
    todo = [i for i, x in enumerate(p) if eps < x < 1 - eps]
    draws = rng.random(len(todo) + 3).tolist()
    held: list[int] = []
    at = 0
    for i in todo:
        held.append(i)
        if len(held) < 3:
            continue
        u = _null_vector([s[j] for j in held])
        ahead = min(((1 - p[j]) / x if x > 0 else p[j] / -x) for j, x in zip(held, u, strict=True) if x)
        back = min((p[j] / x if x > 0 else (1 - p[j]) / -x) for j, x in zip(held, u, strict=True) if x)
        step = ahead if draws[at] * (ahead + back) < back else -back
        at += 1
        rest = []
        for j, x in zip(held, u, strict=True):
            p[j] += step * x
            if p[j] < eps:
                p[j] = 0.0
            elif p[j] > 1 - eps:
                p[j] = 1.0
            else:
                rest.append(j)
        held = rest
    out = np.array(p)
    out[out <= eps] = 0.0
    out[out >= 1 - eps] = 1.0
    return out


def grounded(prob: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each document waits for the landing: ``LAND`` undecided ones of geometrically falling sizes."""
    out = np.zeros(len(prob), bool)
    todo = np.flatnonzero((prob > 1e-9) & (prob < 1 - 1e-9) & (size > 0))
    for j in range(min(LAND, len(todo))):
        rest = todo[~out[todo]]
        out[rest[np.abs(size[rest] - size[todo].max() * 0.6**j).argmin()]] = True
    return out


def landing(prob: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the last undecided documents: of all choices, the one nearest to the expected words."""
    out = prob.copy()
    left = np.flatnonzero((out > 0) & (out < 1))
    choice = np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1
    off = np.abs(choice @ size[left] - (out[left] * size[left]).sum())
    off_n = np.abs(choice.sum(1) - out[left].sum())
    out[left] = choice[np.lexsort((off_n.round(6), off.round(6)))[0]]
    return out


def _fly(first: bool, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "m"], ascending=[False, True, True], na_position="last", kind="stable").reset_index(drop=True)
        size, prob = pdf["size"].to_numpy(float), pdf["p"].to_numpy(float)
        if first and pdf["chunk"].iloc[0] == 0:
            pdf["waits"] = grounded(prob, size)
        up = ~pdf["waits"].to_numpy(bool)
        prob = prob.copy()
        prob[up] = flight(prob[up], size[up], np.random.default_rng([7, int(pdf["chunk"].iloc[0]), len(pdf)]))
        return pdf.assign(p=landing(prob, size) if last else prob)

    return run


def balanced_mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0, chunk: int = CHUNK) -> DataFrame:
    """doc_id, source, size, source_size, target, times (how often the mix takes it), taken (words).

    ``docs`` needs doc_id, text and source; it may hold an optional ``size`` column of its own, which
    is ignored.
    """
    ship(docs.sparkSession)
    sized = docs.select("doc_id", "source", size_in_words(F.col("text")).alias("size"))
    units = stored(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m")))
    targets = stored(source_targets(units.select("source", (F.col("size") * F.col("m")).alias("size")), weights, most))
    n_sources, largest = targets.agg(F.count(F.lit(1)), F.max("n")).first()
    side = targets.select(F.col("source").alias("src"), "source_size", "n", "target")
    side = F.broadcast(side) if n_sources <= BROADCAST_SOURCES else side
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) * F.col("m")
    whole = F.floor(ratio + 1e-9)
    units = units.join(side, F.col("source").eqNullSafe(F.col("src"))).drop("src")
    units = units.withColumn("whole", whole.cast("long")).withColumn("p", F.greatest(ratio - whole, F.lit(0.0)))
    units = units.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size"), F.ceil(F.col("n") / chunk)).cast("long")).drop("n").withColumn("waits", F.lit(False))
    levels = 1 + max(0, math.ceil(math.log(max(math.ceil((largest or 1) / chunk), 1), MERGE) - 1e-9))
    keys = [F.col("source"), F.col("chunk")]
    done = None
    for level in range(levels):
        last = level == levels - 1
        flown = units.groupBy(*keys).applyInPandas(_fly(level == 0, last), units.schema)
        if last:
            done = flown if done is None else done.unionByName(flown)
            break
        flown = stored(flown)
        decided = flown.filter((F.col("p") == 0) | (F.col("p") == 1))
        done = decided if done is None else done.unionByName(decided)
        units = flown.filter((F.col("p") > 0) & (F.col("p") < 1)).withColumn("chunk", F.floor(F.col("chunk") / MERGE).cast("long"))
    times = F.col("whole") + F.round("p").cast("long")
    each = F.floor(times / F.col("m")) + (F.col("copy") <= times % F.col("m")).cast("long")
    out = done.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m")))).withColumn("times", each.cast("long"))
    return out.select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")
