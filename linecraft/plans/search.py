"""Beam search over filter combinations: one Spark job a round, the driver holds only the beam.

Three searches run side by side, each with its own beam: spread bets, overs and unders.  A candidate
takes one condition of a dimension at most: favourite or underdog, the away side, a bound on the line
(spread bets), a bound on the total, and one condition of each feature.  Bounds are the nearest-rank
quartiles and levels the ``LEVELS`` most frequent values of the in-sample games; features of a team
are read from the candidate's side, their bounds pool both sides.  Without the away condition the
side is the home team's, so a home condition would repeat its parent and is not generated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.running import entering, team_games
from ..operators.systems import SystemFilter, graded, side_line
from ..session import ship

QUARTILES, LEVELS = (0.25, 0.5, 0.75), 8
#: Share of the in-sample games that must have a feature (of a team: of both sides' values) for it to be searched.
COVERAGE = 0.5


@dataclass(frozen=True)
class Features:
    """Columns that conditions may use: of the game, and of both teams as ``home_<name>`` and ``away_<name>``."""

    game_numbers: tuple[str, ...] = ("week",)
    game_levels: tuple[str, ...] = ("season_type",)
    team_numbers: tuple[str, ...] = ("games_played", "win_pct", "ats_pct", "rest_days", "last3_points", "streak")
    team_levels: tuple[str, ...] = ("conference",)


KNOWN = Features()
#: Entering statistics that ``with_features`` adds.
TEAM_NUMBERS = KNOWN.team_numbers
SEARCHES = {"spread": ("home", "away"), "over": ("over", "over"), "under": ("under", "under")}
SIDES = ("home", "away")
BREAK_EVEN, PAYS = 110 / 210, 90.9091
SCHEMA = "candidate string, place int, wilson_low double, roi_inside double, bets_inside long, bets long, wins long, losses long, roi double, p_value double, bh double"


def with_features(games: DataFrame) -> DataFrame:
    """Games with the entering statistics of both teams."""
    known = entering(team_games(games))
    for side in SIDES:
        names = [F.col(n).alias(f"{side}_{n}") for n in TEAM_NUMBERS]
        games = games.join(known.select("game_id", F.col("team").alias(f"{side}_team"), *names), ["game_id", f"{side}_team"], "left")
    return games


def _values(games: DataFrame, columns: dict[str, list[str]], kind: str) -> DataFrame:
    """How often each dimension has each value."""
    cells = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(c).cast(kind).alias("value")) for d, names in columns.items() for c in names))
    return games.select(F.explode(cells).alias("s")).select("s.*").filter("value IS NOT NULL").groupBy("dimension", "value").count()


def coverage(games: DataFrame, features: Features = KNOWN) -> dict[str, float]:
    """Share of the games that have each feature; of a team's, the mean over both sides.  One pass."""
    columns = {n: [n] for n in (*features.game_numbers, *features.game_levels)} | {n: [f"{s}_{n}" for s in SIDES] for n in (*features.team_numbers, *features.team_levels)}
    flat = sorted({c for names in columns.values() for c in names})
    row = games.agg(F.count(F.lit(1)).alias("__n"), *(F.count(c).alias(f"__c_{c}") for c in flat)).first()
    return {n: sum(row[f"__c_{c}"] for c in names) / (len(names) * row["__n"]) if row["__n"] else 0.0 for n, names in columns.items()}


def covered(games: DataFrame, features: Features = KNOWN, least: float = COVERAGE) -> Features:
    """Without the features that too few games have: what is found on such a part is not comparable with the rest."""
    share = coverage(games, features)
    keep = lambda names: tuple(n for n in names if share[n] >= least)
    return Features(keep(features.game_numbers), keep(features.game_levels), keep(features.team_numbers), keep(features.team_levels))


def thresholds(games: DataFrame, features: Features = KNOWN) -> dict[str, list[float]]:
    """Distinct nearest-rank quartiles of each numeric dimension."""
    columns = {"line": ["spread"], "total": ["total"], **{n: [n] for n in features.game_numbers}, **{n: [f"{s}_{n}" for s in SIDES] for n in features.team_numbers}}
    by = Window.partitionBy("dimension")
    upto = _values(games, columns, "double").withColumn("upto", F.sum("count").over(by.orderBy("value"))).withColumn("n", F.sum("count").over(by))
    place = [F.bround(F.lit(q) * (F.col("n") - 1), 0) for q in QUARTILES]
    holds = reduce(lambda a, b: a | b, [(F.col("upto") > p) & (F.col("upto") - F.col("count") <= p) for p in place])
    found: dict[str, list[float]] = {}
    for r in sorted(upto.filter(holds).collect(), key=lambda r: (r["dimension"], r["value"])):
        found.setdefault(r["dimension"], []).append(r["value"])
    return found


def levels(games: DataFrame, features: Features = KNOWN) -> dict[str, list[str]]:
    """The most frequent values of each categorical dimension."""
    columns = {**{n: [n] for n in features.game_levels}, **{n: [f"{s}_{n}" for s in SIDES] for n in features.team_levels}}
    if not columns:
        return {}
    order = Window.partitionBy("dimension").orderBy(F.desc("count"), "value")
    found: dict[str, list[str]] = {}
    for r in _values(games, columns, "string").withColumn("i", F.row_number().over(order)).filter(F.col("i") <= LEVELS).orderBy("dimension", "i").collect():
        found.setdefault(r["dimension"], []).append(r["value"])
    return found


def grammar(games: DataFrame, features: Features = KNOWN) -> list[tuple[str, str, tuple[Column, Column]]]:
    """(dimension, name, test from the home side and from the away side) of all single conditions on ``features``."""
    out = [("favorite", "favorite", tuple(side_line(s) < 0 for s in SIDES)), ("favorite", "underdog", tuple(side_line(s) > 0 for s in SIDES)), ("side", "away", (F.lit(True), F.lit(True)))]
    for d, bounds in sorted(thresholds(games, features).items()):
        read = [side_line(s) if d == "line" else F.col(f"{s}_{d}" if d in features.team_numbers else d) for s in SIDES]
        for v in bounds:
            out += [(d, f"{d} >= {v:g}", tuple(c >= v for c in read)), (d, f"{d} <= {v:g}", tuple(c <= v for c in read))]
    for d, values in sorted(levels(games, features).items()):
        out += [(d, f"{d} = {v}", tuple(F.col(f"{s}_{d}" if d in features.team_levels else d).cast("string") == v for s in SIDES)) for v in values]
    return out


def _packed(games: DataFrame, conditions: list) -> DataFrame:
    """Graded bets as bit sets: a row a batch of games and ``part`` (search and side), with one row of bits a condition, then all bets, wins and losses.

    Both sides' tests are read once for the three searches.
    """
    ship(games.sparkSession)
    flags = [F.coalesce(test[i], F.lit(False)).alias(f"c{i}_{k}") for i, _ in enumerate(SIDES) for k, (_, _, test) in enumerate(conditions)]
    read, n = games, len(conditions)
    for s, (search, bets) in enumerate(SEARCHES.items()):
        for i, _ in enumerate(SIDES):
            of, result = graded(games.columns, SystemFilter(side=bets[i], market="spread" if search == "spread" else "total"))
            read = read.withColumns({f"__{name}{2 * s + i}": F.coalesce(of & test, F.lit(False)) for name, test in (("b", F.lit(True)), ("w", result == "W"), ("l", result == "L"))})
    marks = [f"__{name}{p}" for p in range(2 * len(SEARCHES)) for name in "bwl"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = lambda batch, c: batch.column(c).to_numpy(zero_copy_only=False)
        for batch in batches:
            tests = [np.stack([bits(batch, f"c{i}_{k}") for k in range(n)]) for i, _ in enumerate(SIDES)]
            parts, words = [], []
            for p in range(2 * len(SEARCHES)):
                bet = bits(batch, f"__b{p}")
                if bet.any():
                    mine = np.concatenate([tests[p % 2][:, bet], *(bits(batch, f"__{name}{p}")[None, bet] for name in "bwl")])
                    mine = np.pad(mine, ((0, 0), (0, -mine.shape[1] % 64)))
                    parts.append(p)
                    words.append(np.packbits(mine, axis=1).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(words, pa.binary())], ["part", "words"])

    return read.select(*flags, *marks).mapInArrow(pack, "part int, words binary")


def _records(packed: DataFrame, n_conditions: int, candidates: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Bets, wins and losses of each (part, conditions): bit sets in the tasks, one sum over tasks."""
    longest = max(len(c) for _, c in candidates)
    sets = np.array([[*c, *[n_conditions] * (longest - len(c))] for _, c in candidates]).reshape(len(candidates), -1)
    part_of = np.array([p for p, _ in candidates])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(sets), 3), np.int64)
        for batch in batches:
            for p, held in zip(batch.column("part").to_pylist(), batch.column("words"), strict=True):
                words = np.frombuffer(held.as_buffer(), np.uint64).reshape(n_conditions + 3, -1)
                which = np.flatnonzero(part_of == p)
                for lo in range(0, len(which), 4096):
                    at = which[lo : lo + 4096]
                    met = reduce(np.bitwise_and, [words[c] for c in sets[at].T])
                    for j, of in enumerate((met, met & words[-2], met & words[-1])):
                        total[at, j] += np.bitwise_count(of).sum(axis=1, dtype=np.int64)
        some = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, j]) for j in range(3))], ["i", "bets", "wins", "losses"])

    rows = packed.mapInArrow(count, "i long, bets long, wins long, losses long")
    out = np.zeros((len(sets), 3), np.int64)
    for r in rows.groupBy("i").agg(F.sum("bets"), F.sum("wins"), F.sum("losses")).collect():
        out[r[0]] = r[1:]
    return out


def wilson_low(wins: int, decided: int, z: float = 1.96) -> float:
    if not decided:
        return 0.0
    p = round(wins / decided, 4)
    margin = z * math.sqrt((p * (1 - p) + z * z / (4 * decided)) / decided)
    return round(max(0.0, (p + z * z / (2 * decided) - margin) / (1 + z * z / decided)), 4)


def p_value(wins: int, decided: int) -> float:
    """One-sided test of the hit rate against the break-even rate."""
    if not decided:
        return 1.0
    z = (round(wins / decided, 4) - BREAK_EVEN) / math.sqrt(BREAK_EVEN * (1 - BREAK_EVEN) / decided)
    return round(0.5 * math.erfc(z / math.sqrt(2)), 4)


def benjamini_hochberg(p: list[float]) -> list[float]:
    out, least = [1.0] * len(p), 1.0
    for rank, i in sorted(enumerate(sorted(range(len(p)), key=p.__getitem__), 1), reverse=True):
        least = out[i] = min(least, p[i] * len(p) / rank)
    return out


def _roi(bets: int, wins: int, losses: int) -> float:
    return round((wins * PAYS - losses * 100) / (bets * 100), 4) if bets else 0.0


def beam(games: DataFrame, width: int = 100, depth: int = 4, least: int = 100, top: int = 20, features: Features = KNOWN, cover: float = COVERAGE) -> DataFrame:
    """The best ``top`` combinations of each search, of up to ``depth`` conditions with ``least`` decided bets.

    They are ranked by lower Wilson bound, return and decided bets.  The last season is held out;
    survivors are graded on it once, in one job; those without a bet there are left out, the others'
    p-values are corrected as one batch (Benjamini-Hochberg).  ``features`` may name any columns of ``games``
    besides the entering statistics, which are added here; those that less than ``cover`` of the in-sample
    games have are not searched.
    """
    spark = games.sparkSession
    last = games.filter("home_points IS NOT NULL AND away_points IS NOT NULL").agg(F.max("season")).first()[0]
    sides = [f"{s}_{n}" for n in (*features.team_numbers, *features.team_levels) for s in SIDES]
    needed = dict.fromkeys(["season", "home_points", "away_points", "spread", "total", *features.game_numbers, *features.game_levels, *sides])
    # the entering statistics are made once; the rounds read bit sets
    games = with_features(games).select(*needed).persist()
    known = games.filter(F.col("season") < F.lit(last))
    inside = None
    try:
        conditions = grammar(known, covered(known, features, cover))
        inside = _packed(known, conditions).persist()
        return _found(spark, inside, _packed(games.filter(F.col("season") == F.lit(last)), conditions), conditions, width, depth, least, top)
    finally:
        games.unpersist()
        if inside is not None:
            inside.unpersist()


def _found(spark: SparkSession, inside: DataFrame, held_out: DataFrame, conditions: list, width: int, depth: int, least: int, top: int) -> DataFrame:
    """The search itself, over the bit sets of the games to search and of those held out."""
    dimension, name = [c[0] for c in conditions], [c[1] for c in conditions]
    away, n = name.index("away"), len(conditions)
    key = lambda s, c: (2 * s + (away in c), c)
    called = lambda s, c: f"{list(SEARCHES)[s]}: " + " AND ".join(name[k] for k in c)
    live: list[list[tuple[int, ...]]] = [[()] for _ in SEARCHES]
    seen: set[tuple[int, tuple[int, ...]]] = set()
    best: list[list[tuple]] = [[] for _ in SEARCHES]
    for _ in range(depth):
        tried = []
        for s, search in enumerate(SEARCHES):
            new = {tuple(sorted((*c, k))) for c in live[s] for k in range(n) if dimension[k] not in {dimension[x] for x in c} and (search == "spread" or dimension[k] != "line")}
            tried += sorted({(s, c) for c in new} - seen)
        if not tried:
            break
        seen |= set(tried)
        kept: list[list[tuple]] = [[] for _ in SEARCHES]
        for (s, c), (m, w, l) in zip(tried, _records(inside, n, [key(*t) for t in tried]).tolist(), strict=True):  # noqa: E741
            if w + l >= least and _roi(m, w, l) > 0:
                kept[s].append((-wilson_low(w, w + l), -_roi(m, w, l), -(w + l), called(s, c), s, c, m))
        live = [[r[5] for r in sorted(k)[:width]] for k in kept]
        best = [a + b for a, b in zip(best, kept, strict=True)]
    ranked = sorted(r for b in best for r in sorted(b)[:top])
    graded = _records(held_out, n, [key(*r[4:6]) for r in ranked]).tolist() if ranked else []
    left = [(r, g, p_value(g[1], g[1] + g[2])) for r, g in zip(ranked, graded, strict=True) if g[0]]
    bh = benjamini_hochberg([p for _, _, p in left])
    return spark.createDataFrame([(r[3], i, -r[0], -r[1], r[6], *g, _roi(*g), p, q) for i, ((r, g, p), q) in enumerate(zip(left, bh, strict=True), 1)], SCHEMA)
