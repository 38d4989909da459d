"""Quotes, decisions, settlement and closing-line value on numbers worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from linecraft.operators import execution as ex
from linecraft.operators.market import degrade, pmf_outcomes, settle

T = dt.datetime(2026, 9, 26, 16)
KICK = T + dt.timedelta(hours=3)
QUOTE = "game_id long, quote_id string, book string, side string, line double, price double, quoted_at timestamp, live boolean, available boolean"
DECISION = "decision_id long, game_id long, decided_at timestamp, kickoff timestamp, mean double, prior_games int, selective double, final_total int, state string, pmf array<double>"
PMF = [0.0] * 46 + [0.25, 0.25, 0.5] + [0.0] * 20


def quote(book, side, line, price, at, live=False, available=True, game=1):
    return (game, f"{book}:{side}:{at.isoformat()}", book, side, float(line), float(price), at, live, available)


def book(game=1):
    h = lambda **k: T - dt.timedelta(**k)
    return [
        quote("A", "over", 47.5, -110, h(hours=3), game=game),
        quote("A", "over", 48.0, -110, h(hours=1), game=game),  # A's last one before T
        quote("A", "over", 46.0, -110, T + dt.timedelta(minutes=5), game=game),  # after T
        quote("B", "over", 47.0, -115, h(minutes=30), game=game),  # the best line
        quote("C", "over", 46.5, -110, h(hours=30), game=game),  # old
        quote("D", "over", 45.0, -110, h(minutes=10), live=True, game=game),
        quote("E", "over", 46.0, -110, h(hours=2), game=game),
        quote("E", "over", 46.0, -110, h(minutes=20), available=False, game=game),
    ]


def forecast(final=49, mean=47.75, game=1, prior=10, selective=0.0, pmf=PMF, state="final"):
    return (game, game, T, KICK, mean, prior, selective, final, state, pmf)


def outcomes(line):
    return pmf_outcomes(F.col("pmf"), line)


@pytest.fixture
def run(spark):
    def go(forecasts, quotes, policy, how=None):
        d, q = spark.createDataFrame(forecasts, DECISION), spark.createDataFrame(quotes, QUOTE).repartition(3)
        return ex.ledger(d, q, policy, how or ex.Execution(), outcomes)

    return go


@pytest.mark.parametrize(
    ("side", "line", "total", "state", "units"),
    [("over", 47.5, 48, "final", 100 / 110), ("over", 47.5, 47, "final", -1.0), ("over", 47.0, 47, "final", 0.0), ("under", 47.0, 46, "final", 100 / 110), ("under", 47.5, 55, "final", -1.0), ("over", 47.5, 60, "cancelled", 0.0)],
)
def test_settlement(spark, side, line, total, state, units):
    margin = F.lit(total - line if side == "over" else line - total)
    assert spark.range(1).select(settle(F.lit(state), margin, F.lit(1.0), F.lit(-110.0))).first()[0] == pytest.approx(units)


@pytest.mark.parametrize(("line", "want"), [(47.0, (0.5, 0.25, 0.25)), (47.5, (0.5, 0.0, 0.5)), (46.5, (0.75, 0.0, 0.25))])
def test_outcomes_at_the_exact_number(spark, line, want):
    row = spark.createDataFrame([(PMF,)], "pmf array<double>").select(*pmf_outcomes(F.col("pmf"), F.lit(line))).first()
    assert tuple(row) == pytest.approx(want)


def test_degradation(spark):
    lit = lambda *x: [F.lit(float(v)) for v in x]
    over, under = degrade(*lit(47.5, -110), 0.5, 10, under=False), degrade(*lit(47.5, 105), 0.5, 10, under=True)
    assert list(spark.range(1).select(*over, *under).first()) == [48.0, -120.0, 47.0, -105.0]


def test_fair_share(spark):
    got = spark.range(1).select(ex.fair(F.lit(-120.0), F.lit(100.0))).first()[0]
    assert got == pytest.approx((120 / 220) / (120 / 220 + 100 / 200))


def test_selection_is_as_of_the_decision(spark):
    d, q = spark.createDataFrame([forecast()], DECISION), spark.createDataFrame(book(), QUOTE)

    def chosen(**how):
        e = ex.Execution(**how)
        rows = ex.chosen_quotes(ex.fresh_quotes(d, ex.book_states(d, q, e.delay), e), e.rule).filter("side = 'over'").collect()
        return [(r.book, r.quote.line) for r in rows]

    assert chosen(max_age=600 * 60) == [("B", 47.0)]
    assert chosen(rule="named", book="A") == [("A", 48.0)]
    assert chosen(rule="median") == [("A", 48.0)]  # of two the worse one
    assert chosen(delay=600) == [("A", 46.0)]  # A's tick after T is seen
    assert chosen(max_age=31 * 3600) == [("C", 46.5)]  # the old one only where it is let in
    assert chosen(rule="named", book="E") == []  # its last tick is not available, though an earlier one was
    for bad in ({"rule": "named"}, {"book": "A"}, {"rule": "worst"}):
        with pytest.raises(ValueError):
            ex.Execution(**bad)


def test_a_bet_its_result_and_its_closing_line(run):
    late = KICK - dt.timedelta(minutes=5)
    quotes = [*book(), quote("B", "under", 47.0, -105, T - dt.timedelta(minutes=30)), quote("B", "over", 48.5, -110, late), quote("B", "under", 48.5, -110, late)]
    (r,) = run([forecast()], quotes, ex.Policy("min_ev", 0.01)).collect()
    assert (r.action, r.side, r.book, r.line, r.result) == ("bet", "over", "B", 47.0, "win")
    assert (r.ev, r.units, r.clv_line, r.age) == pytest.approx((0.5 * 100 / 115 - 0.25, 100 / 115, 1.5, 1800.0))
    # both sides stood at 47, the close does not: nothing to compare in probability
    assert r.clv_prob is None and r.prob_edge == pytest.approx(0.5 / 0.75 - (115 / 215) / (115 / 215 + 105 / 205))
    same = [*book(), quote("B", "under", 47.0, -105, T - dt.timedelta(minutes=30)), quote("B", "over", 47.0, -130, late), quote("B", "under", 47.0, 110, late)]
    (r,) = run([forecast()], same, ex.Policy("min_ev", 0.01)).collect()
    fair = lambda a, b: a / (a + b)
    assert r.clv_prob == pytest.approx(fair(130 / 230, 100 / 210) - fair(115 / 215, 105 / 205)) and r.clv_line == 0.0


def test_closing_line_is_measured_from_what_was_taken(run):
    quotes = [*book(), quote("B", "over", 48.5, -110, KICK - dt.timedelta(minutes=5))]
    (r,) = run([forecast()], quotes, ex.Policy("point_edge", 0.0), ex.Execution(points=0.5)).collect()
    assert (r.action, r.line, r.clv_line, r.clv_prob) == ("bet", 47.5, 1.0, None)


def test_policies_abstain_and_pass(run):
    actions = lambda forecasts, policy: [r.action for r in run(forecasts, book(), policy).collect()]
    assert actions([forecast()], ex.Policy("no_bet")) == ["pass"]
    assert actions([forecast(prior=1)], ex.Policy("point_edge", 0.5, 3)) == ["abstain"]
    assert actions([forecast(selective=0.9)], ex.Policy("point_edge", 0.5, most_selective=0.5)) == ["abstain"]
    assert actions([forecast()], ex.Policy("point_edge", 5.0)) == ["pass"]
    assert actions([forecast(game=2)], ex.Policy("point_edge", 5.0)) == ["no_quote"]
    assert actions([forecast()], ex.Policy("point_edge", 0.75)) == ["bet"]  # the threshold itself is enough
    assert actions([forecast()], ex.Policy("prob_edge", -1.0)) == ["pass"]  # without the other side there is no score


def test_misses_are_the_same_under_every_threshold(run):
    forecasts = [forecast(game=g, pmf=PMF if g % 2 else [0.0] * 46 + [0.45, 0.0, 0.55] + [0.0] * 9) for g in range(1, 61)]
    quotes = [q for g in range(1, 61) for q in book(g)]
    missed = []
    for limit in (0.0, 0.1):  # the second passes the even games
        rows = run(forecasts, quotes, ex.Policy("min_ev", limit), ex.Execution(missed=0.5, seed=3)).collect()
        missed.append({r.game_id for r in rows if r.action == "missed" and r.game_id % 2})
    assert missed[0] == missed[1] and 5 < len(missed[0]) < 25


def test_sensitivity_and_summary(spark, run):
    forecasts = [forecast(game=g, final=49 if g % 2 else 46) for g in range(1, 21)]
    quotes = [q for g in range(1, 21) for q in book(g)]
    s = ex.summary(run(forecasts, quotes, ex.Policy()), []).first()
    assert (s.games, s.with_quote, s.bet, s.wins, s.no_quote) == (20, 20, 20, 10, 0) and s.units == pytest.approx(10 * 100 / 115 - 10)
    d, q = spark.createDataFrame(forecasts, DECISION), spark.createDataFrame(quotes, QUOTE)
    table = ex.sensitivity(d, q, ex.Policy("min_ev", 0.02), ex.Execution("named", "B"), [0.0], outcomes).collect()
    assert {r.scenario for r in table} == set(ex.SCENARIOS) and {r.threshold for r in table} == {0.0, 0.02}
    assert not any(r.actionable for r in table)  # the base loses units
    won = spark.createDataFrame([forecast(game=g) for g in range(1, 21)], DECISION)
    assert all(r.actionable for r in ex.sensitivity(won, q, ex.Policy("min_ev", -1.0), ex.Execution(), [], outcomes).collect())
    # half a point leaves no bet at 0, and no units are not positive ones
    assert not any(r.actionable for r in ex.sensitivity(won, q, ex.Policy("min_ev", 0.0), ex.Execution(), [], outcomes).collect())


def test_market_scores(spark):
    """The number with most pairs, the lowest of several; old and unavailable sides do not count, a push leaves the game out."""
    h = T - dt.timedelta(hours=1)
    pair = lambda b, line, o, u, game=1, **k: [quote(b, "over", line, o, h, game=game, **k), quote(b, "under", line, u, h, game=game)]
    quotes = [*pair("A", 47.0, -110, -110), *pair("B", 47.0, -120, 100), *pair("C", 46.5, -105, -115), *pair("D", 46.5, -110, -110, available=False), *pair("A", 44.0, -110, -110, game=2), *pair("A", 50.0, -110, -110, game=3), *pair("B", 45.5, -110, -110, game=3)]
    d = spark.createDataFrame([forecast(), forecast(game=2, final=44), forecast(game=3, final=40)], DECISION)
    got = {r.decision_id: r for r in ex.market_scores(d, spark.createDataFrame(quotes, QUOTE), 86_400, outcomes).collect()}
    assert sorted(got) == [1, 3] and (got[1].line, got[1].books, got[1].over) == (47.0, 2, 1) and (got[3].line, got[3].books, got[3].over) == (45.5, 1, 0)
    assert got[1].p_market == pytest.approx((0.5 + (120 / 220) / (120 / 220 + 0.5)) / 2) and got[1].p_model == pytest.approx(0.5 / 0.75)


def test_empty(run, spark):
    d, q = spark.createDataFrame([], DECISION), spark.createDataFrame([], QUOTE)
    assert run([], [], ex.Policy()).count() == 0 and ex.market_scores(d, q, 1, outcomes).count() == 0
