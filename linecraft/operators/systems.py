"""Systems: a filter compiled to one predicate, bet grading, records."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.odds import profit
from ..registry import rounded


@dataclass(frozen=True)
class FeatureFilter:
    key: str
    op: str
    value: object
    perspective: str = "single"


@dataclass(frozen=True)
class SystemFilter:
    """What games a system bets on; an empty set is no restriction."""

    side: str = "home"
    market: str = "spread"
    seasons: frozenset = frozenset()
    exclude_seasons: frozenset = frozenset()
    weeks: frozenset = frozenset()
    season_types: frozenset = frozenset()
    teams: frozenset = frozenset()
    exclude_teams: frozenset = frozenset()
    conferences: frozenset = frozenset()
    exclude_conferences: frozenset = frozenset()
    favorite: bool = False
    underdog: bool = False
    spread_min: float | None = None
    spread_max: float | None = None
    total_min: float | None = None
    total_max: float | None = None
    fade: bool = False
    features: tuple[FeatureFilter, ...] = field(default_factory=tuple)


def side_line(side: str) -> Column:
    """The spread from the side's view: the away side's sign flips."""
    return F.col("spread") if side == "home" else -F.col("spread")


_OPS = {
    "eq": lambda c, v: c == v,
    "not_eq": lambda c, v: c != v,
    "in": lambda c, v: c.isin(*v),
    "not_in": lambda c, v: ~c.isin(*v),
    "gte": lambda c, v: c >= v,
    "lte": lambda c, v: c <= v,
    "gt": lambda c, v: c > v,
    "lt": lambda c, v: c < v,
}


def feature_predicate(f: FeatureFilter, side: str, columns: list[str]) -> Column:
    """A missing value fails, for negated tests too; an unknown key fails; an unknown operator raises."""
    other = "away" if side == "home" else "home"
    names = {"single": [f.key], "home": [f"home_{f.key}"], "away": [f"away_{f.key}"], "bet_side": [f"{side}_{f.key}"], "opponent": [f"{other}_{f.key}"], "either": [f"home_{f.key}", f"away_{f.key}"]}[f.perspective]
    test = _OPS[f.op]
    out = F.lit(False)
    for name in names:
        if name in columns:
            out = out | (F.col(name).isNotNull() & F.coalesce(test(F.col(name), f.value), F.lit(False)))
    return out


def predicate(s: SystemFilter, columns: list[str]) -> Column:
    """One boolean column; its null is never seen, every clause answers true or false."""
    clauses: list[Column] = [F.col("home_points").isNotNull() & F.col("away_points").isNotNull()]
    own, other = ("home", "away") if s.side == "home" else ("away", "home")
    involved = s.market == "total"

    def member(column: str, values: frozenset) -> Column:
        return F.coalesce(F.col(column).isin(*values), F.lit(False))

    for column, chosen, out in (("season", s.seasons, s.exclude_seasons), ("week", s.weeks, frozenset()), ("season_type", s.season_types, frozenset())):
        if chosen:
            clauses.append(member(column, chosen))
        if out:
            clauses.append(F.coalesce(~F.col(column).isin(*out), F.lit(False)))
    for kind, chosen, out in (("team", s.teams, s.exclude_teams), ("conference", s.conferences, s.exclude_conferences)):
        names = [f"{own}_{kind}", f"{other}_{kind}"] if involved else [f"{own}_{kind}"]
        if chosen:
            test = member(names[0], chosen)
            clauses.append(test | member(names[1], chosen) if involved else test)
        if out:
            clauses += [F.coalesce(~F.col(n).isin(*out), F.lit(False)) for n in names]
    line = side_line(s.side)
    clauses.append((F.col("total") if involved else F.col("spread")).isNotNull())
    for on, test in ((s.favorite, line < 0), (s.underdog, line > 0), (s.spread_min is not None, line >= F.lit(s.spread_min)), (s.spread_max is not None, line <= F.lit(s.spread_max)), (s.total_min is not None, F.col("total") >= F.lit(s.total_min)), (s.total_max is not None, F.col("total") <= F.lit(s.total_max))):
        if on:
            clauses.append(F.coalesce(test, F.lit(False)))
    clauses += [feature_predicate(f, s.side, columns) for f in s.features]
    out = clauses[0]
    for c in clauses[1:]:
        out = out & c
    return out


def _margin(s: SystemFilter) -> Column:
    """The bet's margin.  Fading flips the side at grading only."""
    side = ("away" if s.side == "home" else "home") if s.fade and s.market == "spread" else s.side
    if s.market == "spread":
        diff = F.col("home_points") - F.col("away_points")
        return ((diff if side == "home" else -diff) + side_line(side)).cast("double")
    over = (s.side == "over") != s.fade
    margin = F.col("home_points") + F.col("away_points") - F.col("total")
    return (margin if over else -margin).cast("double")


def _result(margin: Column) -> Column:
    return F.when(margin > 0, "W").when(margin < 0, "L").otherwise("P")


def graded(columns: list[str], s: SystemFilter) -> tuple[Column, Column]:
    """Whether the system bets on a game of these columns, and the result of that bet."""
    return predicate(s, columns), _result(_margin(s))


def grade(games: DataFrame, s: SystemFilter, stake: float = 100.0, price: float = -110.0) -> DataFrame:
    """The system's bets with margin, result and profit.  Fading flips the side at grading only."""
    bets = games.filter(predicate(s, games.columns)).withColumn("margin", _margin(s))
    bets = bets.withColumn("result", _result(F.col("margin")))
    return bets.withColumn("profit", profit(F.col("result"), F.lit(stake), F.lit(price)).cast("decimal(18,4)"))


def record(stake: float = 100.0) -> list[Column]:
    """Aggregates: pushes count as bets in the return but not in the hit rate."""
    won, lost = F.count_if(F.col("result") == "W"), F.count_if(F.col("result") == "L")
    bets = F.count(F.lit(1))
    return [
        bets.alias("bets"), won.alias("wins"), lost.alias("losses"), F.count_if(F.col("result") == "P").alias("pushes"),
        rounded(won / F.nullif(won + lost, F.lit(0)), 4).cast("double").alias("hit_rate"),
        F.sum("profit").cast("double").alias("profit"),
        rounded(F.sum("profit").cast("double") / (bets * stake), 4).cast("double").alias("roi"),
    ]


def evaluate(games: DataFrame, candidates: list[tuple[str, Column]], stake: float = 100.0) -> DataFrame:
    """Records of many candidate filters over graded ``games`` in one pass.

    Each game names the candidates that it meets in one array; exploding it pre-aggregates before
    the shuffle, which carries one row per candidate and task.
    """
    met = F.filter(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in candidates)), lambda x: x.isNotNull())
    return games.select("result", "profit", F.explode(met).alias("candidate")).groupBy("candidate").agg(*record(stake))


#: The dimensions of a filter, and the fields that each one clears.
DIMENSIONS = {"side": ("favorite", "underdog"), "spread": ("spread_min", "spread_max"), "total": ("total_min", "total_max"), "season": ("seasons", "exclude_seasons"), "week": ("weeks",), "season_type": ("season_types",), "team": ("teams", "exclude_teams"), "conference": ("conferences", "exclude_conferences")}


def without_dimension(s: SystemFilter, dimension: str) -> SystemFilter:
    """The filter with one dimension cleared, all others kept; a feature's name clears its tests."""
    plain = SystemFilter()
    if dimension in DIMENSIONS:
        return replace(s, **{f: getattr(plain, f) for f in DIMENSIONS[dimension]})
    return replace(s, features=tuple(f for f in s.features if f.key != dimension))


def parse_filter(query: dict[str, str], strict: bool = True) -> SystemFilter:
    """A filter from texts such as those of a web form; strict parsing refuses what it does not know."""
    kinds = {f.name: f.type for f in fields(SystemFilter)}
    found: dict[str, object] = {}
    for name, text in query.items():
        try:
            if name not in kinds or name == "features":
                raise ValueError(f"unknown field {name}")
            if "frozenset" in kinds[name]:
                found[name] = frozenset(int(x) if x.strip().lstrip("-").isdigit() else x.strip() for x in text.split(",") if x.strip())
            elif "float" in kinds[name]:
                found[name] = float(text)
            elif kinds[name] == "bool":
                if text.lower() not in ("1", "true", "yes", "0", "false", "no"):
                    raise ValueError(f"{name} is yes or no, not {text}")
                found[name] = text.lower() in ("1", "true", "yes")
            else:
                allowed = {"side": ("home", "away", "over", "under"), "market": ("spread", "total")}[name]
                if text not in allowed:
                    raise ValueError(f"{name} is one of {', '.join(allowed)}, not {text}")
                found[name] = text
        except ValueError:
            if strict:
                raise
    return SystemFilter(**found)


def sentence(s: SystemFilter) -> str:
    """The filter in words."""
    listed = lambda x: ", ".join(str(v) for v in sorted(x, key=str))
    parts = [("fade " if s.fade else "bet ") + ("the " + s.side if s.market == "spread" else s.side)]
    if s.favorite or s.underdog:
        parts.append("as a favourite" if s.favorite else "as an underdog")
    for name, low, high in (("spread", s.spread_min, s.spread_max), ("total", s.total_min, s.total_max)):
        if low is not None and high is not None:
            parts.append(f"with a {name} from {low:g} to {high:g}")
        elif low is not None or high is not None:
            parts.append(f"with a {name} of {low:g} or more" if low is not None else f"with a {name} of {high:g} or less")
    for text, values in (("in", s.seasons), ("not in", s.exclude_seasons), ("in week", s.weeks), ("in the", s.season_types), ("with", s.teams), ("without", s.exclude_teams), ("in conference", s.conferences), ("outside conference", s.exclude_conferences)):
        if values:
            parts.append(f"{text} {listed(values)}")
    words = {"eq": "is", "not_eq": "is not", "in": "is one of", "not_in": "is none of", "gte": "is at least", "lte": "is at most", "gt": "is over", "lt": "is under"}
    parts += [f"where {f.key} ({f.perspective}) {words[f.op]} {listed(f.value) if isinstance(f.value, (tuple, list, set, frozenset)) else f.value}" for f in s.features]
    return " ".join(parts)
