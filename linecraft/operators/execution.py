"""How a forecast meets two-sided quotes: candidates, decisions, settlement, closing-line value, sensitivity.

Decisions have decision_id, game_id, decided_at, kickoff, mean, prior_games, selective, final_total and state,
and whatever columns their outcome probabilities need; quotes have game_id, quote_id, book, side (over or
under), line, price, quoted_at, live and available.  Every book's last tick of either side as of any moment
comes from one window over the game's ticks and the moments that are asked for; a book whose last tick is not
available has no quote then, even if an earlier one was.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import session
from ..functions.odds import decimal_price, fair_pair, implied_probability, payout
from ..session import tasks
from .market import american, cents, settle

#: Outcome probabilities of a line: (over, push, under) columns of a decision's row.
Outcomes = Callable[[Column], tuple[Column, Column, Column]]


@dataclass(frozen=True)
class Execution:
    """How a decision is carried out: which book's quote, how old at most, how late, and what is taken from it."""

    rule: str = "best"
    book: str | None = None
    max_age: int = 24 * 3600
    delay: int = 0
    points: float = 0.0
    cents: int = 0
    missed: float = 0.0
    seed: int = 0

    def __post_init__(self):
        if self.rule not in ("best", "median", "named") or (self.rule == "named") != (self.book is not None):
            raise ValueError("the rule is best, median or named, and only the last one has a book")


@dataclass(frozen=True)
class Policy:
    """When to bet: the score (point_edge, min_ev, prob_edge or no_bet), its threshold, and when to keep out."""

    kind: str = "min_ev"
    threshold: float = 0.0
    least_games: int = 0
    most_selective: float | None = None

    def __post_init__(self):
        if self.kind not in ("point_edge", "min_ev", "prob_edge", "no_bet"):
            raise ValueError(f"unknown policy {self.kind}")


#: Fixed scenarios: what modest trouble takes from a bettor, and the middle book instead of the chosen one.
MODEST = {"line_half_point": {"points": 0.5}, "price_10_cents": {"cents": 10}, "missed_fill_10pct": {"missed": 0.1}, "delay_60m": {"delay": 3600}}
SCENARIOS = {"base": {}, **MODEST, "median_book": {"rule": "median", "book": None}}


#: Tasks for so many rows as one task of ``dealt`` has: a decision grows to a row a book, moment, side and choice.
SPREAD = 4


def _states(decisions: DataFrame, quotes: DataFrame, delays: list[int]) -> DataFrame:
    """``book_states`` of several delays: game_id, decision_id, book, delay, the last ticks, and the decision itself.

    One shuffle by game, of ticks and decisions as they are; all that follows has the game among its keys and stays where it
    lies.  Moments are made of decisions, and sent to the books of their game, after it.
    """
    ticks = quotes.filter(~F.col("live")).select("game_id", "book", "side", F.struct("line", "price", "available", "quoted_at", "quote_id").alias("tick"))
    rows = ticks.unionByName(decisions.select("game_id", F.struct(*decisions.columns).alias("decision")), allowMissingColumns=True)
    parts = max(tasks(decisions), -(-SPREAD * (quotes.count() + decisions.count()) // session.ROWS_A_TASK))
    books = F.collect_set(F.when(F.col("tick").isNotNull(), F.struct("book"))).over(Window.partitionBy("game_id"))
    rows = rows.repartition(parts, "game_id").withColumn("books", books)
    moment = lambda mark, at: F.struct(F.lit(mark).cast("string").alias("mark"), at.alias("at"))
    late = lambda d: F.col("decision.decided_at") + F.expr(f"INTERVAL {int(d)} SECOND")
    moments = F.array(moment("close", F.col("decision.kickoff")), *(moment(f"now{d}", late(d)) for d in delays))
    none = F.array(moment(None, F.col("tick.quoted_at")))
    both = rows.withColumn("b", F.explode(F.when(F.col("tick").isNull(), F.col("books")).otherwise(F.array(F.struct("book"))))).withColumn("book", F.col("b.book")).drop("books", "b")
    both = both.withColumn("m", F.explode(F.when(F.col("tick").isNull(), moments).otherwise(none))).select("game_id", "book", "side", "tick", "decision", "m.*")
    w = Window.partitionBy("game_id", "book").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    order = F.struct("tick.quoted_at", "tick.quote_id")
    last = lambda side, x: F.max_by(F.when(F.col("side") == side, x), F.when(F.col("side") == side, order)).over(w)
    both = both.withColumns({"o": last("over", F.col("tick")), "u": last("under", F.col("tick"))})
    full = F.when(F.col("side") == "over", F.col("tick").withField("other", F.col("u"))).when(F.col("side") == "under", F.col("tick").withField("other", F.col("o")))
    both = both.withColumn("full", full).drop("o", "u")
    states = both.withColumns({"over": last("over", F.col("full")), "under": last("under", F.col("full"))}).filter("mark IS NOT NULL")
    states = states.withColumn("decision_id", F.col("decision.decision_id"))
    pick = lambda mark, side: F.first(F.when(F.col("mark") == mark, F.col(side)), ignorenulls=True)
    marks = [(d, f"now{d}") for d in delays]
    found = states.groupBy("game_id", "decision_id", "book").agg(F.first("decision").alias("decision"), *(pick("close", x).alias(f"{x}_close") for x in ("over", "under")), *(pick(m, x).alias(f"{x}_{m}") for _, m in marks for x in ("over", "under")))
    at = F.explode(F.array(*(F.struct(F.lit(d).alias("delay"), F.col(f"over_{m}").alias("over"), F.col(f"under_{m}").alias("under")) for d, m in marks)))
    return found.withColumn("n", at).select("game_id", "decision_id", "book", "n.*", "over_close", "under_close", "decision")


def book_states(decisions: DataFrame, quotes: DataFrame, delay: int = 0) -> DataFrame:
    """game_id, decision_id, book, over, under, over_close, under_close, decision: each book's last ticks at the decision and at the kickoff.

    A tick is a struct (line, price, available, quoted_at, quote_id, other), ``other`` being the other side's last tick
    of the same book when it was made.  Live ticks do not count.  ``decision`` has the columns of ``decisions``.
    """
    return _states(decisions, quotes, [delay]).drop("delay")


def _sides(states: DataFrame, *also: str) -> DataFrame:
    """A row a side of ``states`` with its quote and the ticks beside it."""
    sides = [F.struct(F.lit(s).alias("side"), F.col(s).alias("quote"), F.col(t).alias("pair"), F.col(f"{s}_close").alias("close"), F.col(f"{t}_close").alias("close_pair")) for s, t in (("over", "under"), ("under", "over"))]
    return states.select("game_id", "decision_id", "book", "decision", *also, F.explode(F.array(*sides)).alias("x")).select("game_id", "decision_id", "book", "decision", *also, "x.*")


def _fresh(rows: DataFrame, delay: Column, max_age: Column) -> DataFrame:
    """The quotes that are available and ``max_age`` microseconds old at most, ``delay`` microseconds after the decision."""
    at = F.timestamp_micros(F.unix_micros(F.col("decision.decided_at")) + delay)
    age = F.unix_micros(at) - F.unix_micros(F.col("quote.quoted_at"))
    return rows.filter(F.col("quote.available") & (age <= max_age)).withColumns({"at": at, "age": age / 1e6})


def fresh_quotes(decisions: DataFrame, states: DataFrame, ex: Execution) -> DataFrame:
    """decision_id, side, book, quote and the ticks beside it, of the books that have a quote that is fresh at the decision."""
    rows = _fresh(_sides(states), F.lit(int(ex.delay) * 1_000_000), F.lit(ex.max_age * 1_000_000))
    return rows.filter(F.col("book") == ex.book) if ex.rule == "named" else rows


def _ranked(fresh: DataFrame, *by: str) -> DataFrame:
    """``fresh`` with the place ``r`` of each quote in the ranking of its decision, side and ``by``, and ``of``, their number."""
    key = Window.partitionBy("game_id", "decision_id", "side", *by)
    line = F.when(F.col("side") == "over", F.col("quote.line")).otherwise(-F.col("quote.line"))
    return fresh.withColumns({"r": F.row_number().over(key.orderBy(line, F.desc(decimal_price(F.col("quote.price"))), "book")), "of": F.count(F.lit(1)).over(key)})


def chosen_quotes(fresh: DataFrame, rule: str) -> DataFrame:
    """One quote a decision and side: the most favourable line, then the higher payout; or, by ``median``, the middle of that ranking (the worse of two)."""
    return _ranked(fresh).filter(F.col("r") == (F.floor(F.col("of") / 2) + 1 if rule == "median" else 1)).drop("r", "of")


def _usable(tick: str) -> Column:
    return F.coalesce(F.col(f"{tick}.available"), F.lit(False))


def fair(price: Column, other: Column) -> Column:
    return fair_pair(implied_probability(price), implied_probability(other))


def _priced(c: DataFrame, policy: Policy, points: Column, cents_: Column, outcomes: Outcomes, by: list[str]) -> DataFrame:
    """``by`` and ``x``, the better-scored of the two sides that ``c`` has of them (over first in a tie), with the first ``decision``."""
    c = c.select("*", *(F.col("decision")[x].alias(x) for x in c.schema["decision"].dataType.names if x not in c.columns))
    over = F.col("side") == "over"
    line, price = F.col("quote.line") + F.when(over, points).otherwise(-points), american(cents(F.col("quote.price").cast("double")) - cents_)
    c = c.withColumns({"line": line, "price": price})
    p_over, p_push, p_under = outcomes(F.col("line"))
    c = c.withColumns({"p_win": F.when(over, p_over).otherwise(p_under), "p_push": p_push, "p_loss": F.when(over, p_under).otherwise(p_over)})
    c = c.withColumn("ev", F.col("p_win") * payout(F.col("price")) - F.col("p_loss"))
    c = c.withColumn("point_edge", F.when(over, F.col("mean") - F.col("line")).otherwise(F.col("line") - F.col("mean")))
    comparable = _usable("pair") & (F.col("pair.line") == F.col("quote.line"))
    share = F.col("p_win") / F.greatest(1 - F.col("p_push"), F.lit(1e-12))
    c = c.withColumn("prob_edge", F.when(comparable, share - fair(F.col("quote.price"), F.col("pair.price"))))
    score = {"point_edge": F.col("point_edge"), "min_ev": F.col("ev"), "prob_edge": F.col("prob_edge")}.get(policy.kind, F.lit(None).cast("double"))
    c = c.withColumn("score", score)
    # closing-line value against what was taken; in probability only at one number and an undegraded price
    moved = F.when(_usable("close"), F.col("close.line") - F.col("line"))
    c = c.withColumn("clv_line", F.when(over, moved).otherwise(0.0 - moved))
    same = (points == 0) & (cents_ == 0) & _usable("close") & _usable("close_pair") & F.coalesce(F.col("quote.other.available"), F.lit(False))
    for tick in ("close", "close_pair", "quote.other"):
        same = same & (F.col(f"{tick}.line") == F.col("quote.line"))
    c = c.withColumn("clv_prob", F.when(same, fair(F.col("close.price"), F.col("close_pair.price")) - fair(F.col("quote.price"), F.col("quote.other.price"))))
    kept = ["side", "book", "line", "price", "age", "p_win", "p_push", "p_loss", "ev", "point_edge", "prob_edge", "score", "clv_line", "clv_prob"]
    return c.groupBy(*by).agg(F.max_by(F.struct(F.col("quote.quote_id").alias("quote_id"), *kept), F.struct(F.col("score").isNotNull(), "score", over)).alias("x"), F.first("decision").alias("decision"))


def scored(decisions: DataFrame, states: DataFrame, policy: Policy, ex: Execution, outcomes: Outcomes) -> DataFrame:
    """Each decision with the better-scored of its two sides (over first in a tie), if a side has a quote."""
    chosen = chosen_quotes(fresh_quotes(decisions, states, ex), ex.rule)
    best = _priced(chosen, policy, F.lit(float(ex.points)), F.lit(ex.cents), outcomes, ["game_id", "decision_id"])
    return decisions.join(best.select(F.col("decision_id").alias("of"), "x"), F.col("decision_id") == F.col("of"), "left").drop("of").select("*", "x.*", F.col("x").isNotNull().alias("quoted")).drop("x")


def fill_draw(decision_id: Column, seed: int) -> Column:
    """A number in [0, 1) by hash of seed and decision: the same decisions miss under every threshold and scenario."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), decision_id.cast("string")).cast("binary")), 1, 7), 16, 10).cast("long") / float(1 << 28)


def acted(rows: DataFrame, policy: Policy, ex: Execution, threshold: Column | None = None, missed: Column | None = None) -> DataFrame:
    """``rows`` of ``scored`` with action (pass, abstain, no_quote, missed or bet), result and units of one-unit bets."""
    limit = F.lit(policy.threshold) if threshold is None else threshold
    out = F.col("prior_games") < policy.least_games
    if policy.most_selective is not None:
        out = out | (F.col("selective") > policy.most_selective)
    action = F.when(F.lit(policy.kind == "no_bet"), "pass").when(out, "abstain").when(~F.col("quoted"), "no_quote").when(F.col("score").isNull() | (F.col("score") < limit), "pass")
    action = action.when(fill_draw(F.col("decision_id"), ex.seed) < (F.lit(ex.missed) if missed is None else missed), "missed").otherwise("bet")
    margin = F.when(F.col("side") == "over", F.col("final_total") - F.col("line")).otherwise(F.col("line") - F.col("final_total"))
    units = settle(F.col("state"), margin, F.lit(1.0), F.col("price"))
    rows = rows.withColumn("action", action)
    bet = F.col("action") == "bet"
    result = F.when(F.col("state").isin("void", "cancelled", "postponed"), "no_action").when(margin == 0, "push").when(margin > 0, "win").otherwise("loss")
    looked = F.col("action").isin("pass", "missed", "bet") & F.lit(policy.kind != "no_bet") & F.col("score").isNotNull()
    shown = {c: F.when(looked, F.col(c)) for c in ("side", "book", "quote_id", "line", "price", "age", "p_win", "p_push", "p_loss", "ev", "point_edge", "prob_edge", "score")}
    return rows.withColumns({"result": F.when(bet, result), "units": F.when(bet, units), "clv_line": F.when(bet, F.col("clv_line")), "clv_prob": F.when(bet, F.col("clv_prob")), **shown})


def ledger(decisions: DataFrame, quotes: DataFrame, policy: Policy, ex: Execution, outcomes: Outcomes) -> DataFrame:
    """One row a decision: what was done and what came of it."""
    return acted(scored(decisions, book_states(decisions, quotes, ex.delay), policy, ex, outcomes), policy, ex)


def summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Edge, closing-line value, realised units and availability, side by side and never as one score."""
    bet = F.col("action") == "bet"
    of_bets = lambda c: F.when(bet, F.col(c))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("games"), F.count("book").alias("with_quote"), *(F.count_if(F.col("action") == a).alias(a) for a in ("bet", "pass", "missed", "no_quote", "abstain")),
        F.avg(of_bets("ev")).alias("mean_ev"), F.avg(of_bets("point_edge")).alias("mean_point_edge"), F.count("clv_line").alias("clv_n"), F.avg("clv_line").alias("mean_clv_line"),
        F.avg((F.col("clv_line") > 0).cast("int")).alias("clv_positive"), F.avg("clv_prob").alias("mean_clv_prob"), F.coalesce(F.sum("units"), F.lit(0.0)).alias("units"),
        F.count_if(F.col("result") == "win").alias("wins"), F.count_if(F.col("result") == "push").alias("pushes"), F.median("age").alias("median_age"),
    )


def sensitivity(decisions: DataFrame, quotes: DataFrame, policy: Policy, base: Execution, thresholds: list[float], outcomes: Outcomes) -> DataFrame:
    """scenario, threshold, bets, units, mean_ev, mean_clv_line, and whether the policy is ``actionable``.

    It is if, at its own threshold (which is always in the grid), the base makes units and so does every modest scenario.
    Every scenario is scored once, in one pass over the games; thresholds only decide over scores.
    """
    grid = sorted({*map(float, thresholds), float(policy.threshold)})
    runs = {name: replace(base, **change) for name, change in SCENARIOS.items()}
    choice = lambda ex: (int(ex.delay), ex.max_age, ex.rule, ex.book)
    choices = list(dict.fromkeys(map(choice, runs.values())))
    kind = "struct<k:int,delay:bigint,max_age:double,rule:string,named:string>"
    ways = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(d).alias("delay"), F.lit(float(age)).alias("max_age"), F.lit(rule).alias("rule"), F.lit(book).cast("string").alias("named")).cast(kind) for k, (d, age, rule, book) in enumerate(choices)))
    rows = _sides(_states(decisions, quotes, list(dict.fromkeys(c[0] for c in choices))).withColumn("way", F.explode(ways)).filter("way.delay = delay AND (way.rule <> 'named' OR book = way.named)"), "way")
    ranked = _ranked(_fresh(rows, F.col("way.delay") * 1_000_000, F.col("way.max_age") * 1_000_000), "way")
    chosen = ranked.filter(F.col("r") == F.when(F.col("way.rule") == "median", F.floor(F.col("of") / 2) + 1).otherwise(1)).drop("r", "of")
    kind = "struct<scenario:string,k:int,points:double,cents:double,missed:double>"
    trouble = F.array(*(F.struct(F.lit(name), F.lit(choices.index(choice(ex))), F.lit(float(ex.points)), F.lit(float(ex.cents)), F.lit(float(ex.missed))).cast(kind) for name, ex in runs.items()))
    scenes = chosen.withColumn("scene", F.explode(trouble)).filter("scene.k = way.k")
    best = _priced(scenes, policy, F.col("scene.points"), F.col("scene.cents"), outcomes, ["game_id", "decision_id", "scene"])
    best = best.select("game_id", "decision_id", "scene", *(F.col("decision")[c].alias(c) for c in decisions.columns if c not in ("game_id", "decision_id")), "x.*", F.lit(True).alias("quoted")).withColumn("threshold", F.explode(F.array(*map(F.lit, grid))))
    out = acted(best, policy, base, F.col("threshold"), F.col("scene.missed")).select("scene.scenario", "threshold", "action", "units", "ev", "clv_line")
    # every scenario and threshold has its row, even if no decision meets a quote
    out = out.unionByName(decisions.limit(1).select(F.explode(F.array(*map(F.lit, runs))).alias("scenario")).withColumn("threshold", F.explode(F.array(*map(F.lit, grid)))), allowMissingColumns=True)
    bet = F.col("action") == "bet"
    table = out.groupBy("scenario", "threshold").agg(F.count_if(bet).alias("bets"), F.coalesce(F.sum("units"), F.lit(0.0)).alias("units"), F.avg(F.when(bet, F.col("ev"))).alias("mean_ev"), F.avg("clv_line").alias("mean_clv_line"))
    own = F.col("threshold") == policy.threshold
    # a few rows: a window over all of them, for which the games are not gone through again
    least = F.min(F.when(own & F.col("scenario").isin("base", *MODEST), F.col("units"))).over(Window.partitionBy(F.lit(1)))
    return table.withColumn("actionable", F.coalesce(least > 0, F.lit(False)))


def market_scores(decisions: DataFrame, quotes: DataFrame, max_age: int, outcomes: Outcomes) -> DataFrame:
    """decision_id, line, books, p_model, p_market, over: model and de-vigged market at the modal number of fresh pairs.

    A pair is both sides of one book at one number; among numbers with equally many pairs the lowest counts.  Games that
    land on it are left out.
    """
    rows = fresh_quotes(decisions, book_states(decisions, quotes), Execution(max_age=max_age)).select("game_id", "decision_id", "book", "side", "quote")
    own = ["game_id", "decision_id"]
    sides = rows.groupBy(*own, "book").agg(*(F.first(F.when(F.col("side") == s, F.col("quote")), ignorenulls=True).alias(s) for s in ("over", "under")))
    pairs = sides.filter("over.line = under.line").select(*own, F.col("over.line").alias("line"), fair(F.col("over.price"), F.col("under.price")).alias("p"))
    lines = pairs.groupBy(*own, "line").agg(F.count(F.lit(1)).alias("books"), F.avg("p").alias("p_market"))
    modal = lines.groupBy(*own).agg(F.max_by(F.struct("line", "books", "p_market"), F.struct("books", -F.col("line"))).alias("x")).select("decision_id", "x.*")
    rows = modal.join(decisions, "decision_id").filter("final_total <> line")
    over, push, _ = outcomes(F.col("line"))
    share = over / F.greatest(1 - push, F.lit(1e-12))
    return rows.select("decision_id", "line", "books", F.least(F.greatest(share, F.lit(1e-12)), F.lit(1 - 1e-12)).alias("p_model"), "p_market", (F.col("final_total") > F.col("line")).cast("int").alias("over"))
