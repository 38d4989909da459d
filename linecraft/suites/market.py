"""Queries of quotes, execution, closing-line value and bankroll."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.odds import decimal_price, fair_pair, implied_probability, kelly
from ..functions.stats import NORM_CDF_SQL, norm_cdf, norm_quantile_sql
from ..operators import execution as ex
from ..operators import market as m
from ..registry import query, rounded
from ..sources.proxy import ctes, made

# quotes come from the line tape of an order's day, decisions from orders
QUOTES = "SELECT l_orderkey AS game_id, l_partkey * 10 + l_linenumber AS quote_id, concat('B', l_suppkey % 5) AS book, 40 + l_quantity / 2 AS line, CASE WHEN l_partkey % 3 = 0 THEN 100 + l_partkey % 40 ELSE -100 - l_partkey % 40 END AS price, l_shipdate AS quoted_at FROM {lineitem}"
TICKS = "SELECT l_orderkey AS game_id, CASE WHEN l_partkey % 13 <> 0 THEN l_partkey % 5 <> 0 END AS main, CASE WHEN l_suppkey % 11 <> 0 THEN l_suppkey % 7 = 0 END AS live, CASE WHEN l_partkey % 17 <> 0 THEN l_quantity END AS line, CASE WHEN l_partkey % 19 = 0 THEN 50 WHEN l_partkey % 23 <> 0 THEN -110 END AS price FROM {lineitem}"
_PRICE_P = "CASE WHEN {p} < 0 THEN -{p} / (-{p} + 100.0::DOUBLE) WHEN {p} > 0 THEN 100.0::DOUBLE / ({p} + 100) END"
_WIN = "CASE WHEN {p} < 0 THEN 100.0::DOUBLE / -{p} ELSE {p} / 100.0::DOUBLE END"


def price_p(x: str) -> str:
    return _PRICE_P.replace("{p}", x)


def win(x: str) -> str:
    return _WIN.replace("{p}", x)


# two-sided ticks of five books and one decision a game
TWO_SIDED = """SELECT l_orderkey AS game_id, l_partkey * 1000 + l_linenumber * 100 + l_suppkey AS quote_id, concat('B', l_suppkey % 5) AS book, CASE WHEN l_partkey % 2 = 0 THEN 'over' ELSE 'under' END AS side, 44 + CAST(l_orderkey % 9 AS DOUBLE) + CAST(l_partkey % 3 AS DOUBLE) / 2 AS line,
 CAST(CASE WHEN l_partkey % 3 = 0 THEN 100 + l_partkey % 40 ELSE -100 - l_partkey % 40 END AS DOUBLE) AS price, CAST(l_shipdate AS TIMESTAMP) AS quoted_at, l_partkey % 17 = 0 AS live, l_partkey % 9 <> 0 AS available FROM {lineitem}"""
FORECASTS = """SELECT o_orderkey AS decision_id, o_orderkey AS game_id, CAST(o_orderdate AS TIMESTAMP) + INTERVAL '70' DAY AS decided_at, CAST(o_orderdate AS TIMESTAMP) + INTERVAL '130' DAY AS kickoff, 44 + CAST(o_orderkey % 9 AS DOUBLE) + CAST(o_custkey % 13 - 6 AS DOUBLE) / 2 AS mean, o_orderkey % 6 AS prior_games,
 CAST(o_custkey % 10 AS DOUBLE) / 10 AS selective, 30 + o_orderkey * 7 % 40 AS final_total, CASE WHEN o_orderkey % 31 = 0 THEN 'void' ELSE 'final' END AS state FROM {orders}"""
SIGMA = 6.0
OLD = 60 * 86400
POLICY, BASE = ex.Policy("min_ev", 0.02, 1, 0.85), ex.Execution(max_age=OLD)


def outcomes(line):
    """Over, push and under of a normal total that is rounded to whole points."""
    z = lambda x: norm_cdf((x - F.col("mean")) / SIGMA)
    up, at = z(F.floor(line) + 0.5), F.when(line == F.floor(line), z(line + 0.5) - z(line - 0.5)).otherwise(0.0)
    return 1 - up, at, up - at


def _phi(x: str) -> str:
    return NORM_CDF_SQL.replace("{z}", f"(({x} - mean) / {SIGMA}::DOUBLE)")


def _fair(a: str, b: str) -> str:
    return f"(({price_p(a)}) / (({price_p(a)}) + ({price_p(b)})))"


def _states(delay: int = 0) -> str:
    """Last ticks of every decision, book and side at the decision and at the kickoff, and the other side's when the quote was made."""
    asof = lambda at: f"SELECT d.decision_id, q.* EXCLUDE (game_id, live) FROM decisions d JOIN quotes q USING (game_id) WHERE NOT live AND quoted_at <= {at} QUALIFY row_number() OVER (PARTITION BY d.decision_id, book, side ORDER BY quoted_at DESC, quote_id DESC) = 1"
    late = f"decided_at + INTERVAL {delay} SECOND"
    return f"""now AS ({asof(late)}), closing AS ({asof("kickoff")}),
 other AS (SELECT n.decision_id, n.book, n.side, q.line, q.price, q.available FROM now n JOIN decisions d USING (decision_id) JOIN quotes q ON q.game_id = d.game_id AND q.book = n.book AND q.side <> n.side AND NOT q.live AND q.quoted_at <= n.quoted_at QUALIFY row_number() OVER (PARTITION BY n.decision_id, n.book, n.side ORDER BY q.quoted_at DESC, q.quote_id DESC) = 1),
 fresh AS (SELECT n.*, epoch({late}) - epoch(quoted_at) AS age FROM now n JOIN decisions d USING (decision_id) WHERE available AND epoch({late}) - epoch(quoted_at) <= {OLD}),
 ranked AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY decision_id, side) AS n_books FROM fresh WINDOW w AS (PARTITION BY decision_id, side ORDER BY CASE WHEN side = 'over' THEN line ELSE -line END, CASE WHEN price < 0 THEN 1 + 100.0::DOUBLE / -price ELSE 1 + price / 100.0::DOUBLE END DESC, book))"""


_MADE = ctes(quotes=TWO_SIDED, decisions=FORECASTS)


def _choice(rule: str = "best") -> str:
    return "r = n_books // 2 + 1" if rule == "median" else "r = 1"


def _scored(rule: str = "best", points: float = 0.0, cents: int = 0) -> str:
    """Candidates of both sides and the better one, after ``_states``."""
    c = f"(CASE WHEN price >= 100 THEN price - 100 ELSE price + 100 END - {cents})"
    return f"""c0 AS (SELECT q.*, d.mean, q.line + CASE WHEN q.side = 'over' THEN {points}::DOUBLE ELSE -{points}::DOUBLE END AS taken, CASE WHEN {c} >= 0 THEN 100 + {c} ELSE -100 + {c} END AS paid FROM ranked q JOIN decisions d USING (decision_id) WHERE {_choice(rule)}),
 c1 AS (SELECT *, {_phi("(floor(taken) + 0.5)")} AS below, CASE WHEN taken = floor(taken) THEN {_phi("(taken + 0.5)")} - {_phi("(taken - 0.5)")} ELSE 0.0 END AS push FROM c0),
 c2 AS (SELECT *, CASE WHEN side = 'over' THEN 1 - below ELSE below - push END AS p_win, CASE WHEN side = 'over' THEN below - push ELSE 1 - below END AS p_loss FROM c1),
 c3 AS (SELECT *, p_win * ({win("paid")}) - p_loss AS ev FROM c2), best AS (SELECT * FROM c3 QUALIFY row_number() OVER (PARTITION BY decision_id ORDER BY ev DESC, side = 'over' DESC) = 1)"""


_DRAW = "(('0x' || substr(md5(concat('0:', decision_id)), 1, 7))::BIGINT / 268435456.0::DOUBLE)"


def _acted(threshold: str, missed: float = 0.0) -> str:
    return f"""CASE WHEN prior_games < {POLICY.least_games} OR selective > {POLICY.most_selective}::DOUBLE THEN 'abstain' WHEN ev IS NULL THEN 'no_quote' WHEN ev < {threshold} THEN 'pass' WHEN {_DRAW} < {missed} THEN 'missed' ELSE 'bet' END"""


_UNITS = f"CASE WHEN state IN ('void', 'cancelled', 'postponed') OR final_total = taken THEN 0.0 WHEN (final_total > taken) = (side = 'over') THEN {win('paid')} ELSE -1.0 END"
_LEDGER = f"""{_MADE}, {_states()}, {_scored()}, l0 AS (SELECT d.*, b.side, b.book, b.line, b.price, b.taken, b.paid, b.ev, b.quote_id, {_acted(f"{POLICY.threshold}::DOUBLE")} AS action FROM decisions d LEFT JOIN best b USING (decision_id)),
 ledger AS (SELECT *, CASE WHEN action = 'bet' THEN {_UNITS} END AS units FROM l0)"""


def _decisions(spark, sf):
    return made(spark, sf, FORECASTS)


def _quotes(spark, sf):
    return made(spark, sf, TWO_SIDED)


def _ledger(spark, sf):
    return ex.ledger(_decisions(spark, sf), _quotes(spark, sf), POLICY, BASE, outcomes)


@query(f"WITH {ctes(ticks=TICKS)} SELECT coalesce(CASE WHEN main IS NULL OR live IS NULL THEN 'unknown flag' WHEN NOT main THEN 'alternative' WHEN live THEN 'live' WHEN line IS NULL THEN 'no line' WHEN price IS NULL OR abs(price) < 100 THEN 'no price' END, 'quote') AS reason, count(*) AS n FROM ticks GROUP BY 1")
def tick_drop_counts(spark, sf):
    """Ticks that are quotes, and why the others are not."""
    return m.drop_reason(made(spark, sf, TICKS)).groupBy(F.coalesce("reason", F.lit("quote")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def _chosen(spark, sf, how):
    d = _decisions(spark, sf)
    fresh = ex.fresh_quotes(d, ex.book_states(d, _quotes(spark, sf)), how)
    return ex.chosen_quotes(fresh, how.rule).select("decision_id", "side", "book", F.col("quote.line").alias("line"), F.col("quote.price").alias("price"), F.col("quote.quote_id").alias("quote_id"))


@query(f"WITH {_MADE}, {_states()} SELECT decision_id, side, book, line, price, quote_id FROM ranked WHERE r = 1")
def best_quote(spark, sf):
    """The most favourable of the books' last ticks before each decision, of those available and not too old."""
    return _chosen(spark, sf, BASE)


@query(f"WITH {_MADE}, {_states()} SELECT decision_id, side, book, line, price, quote_id FROM ranked WHERE {_choice('median')}")
def median_quote(spark, sf):
    """The middle of the books' quotes ranked by favour; of an even number the worse middle."""
    return _chosen(spark, sf, ex.Execution("median", max_age=OLD))


@query(f"WITH {_MADE}, {_states()} SELECT decision_id, side, book, line, price, quote_id FROM fresh WHERE book = 'B2'")
def named_quote(spark, sf):
    return _chosen(spark, sf, ex.Execution("named", "B2", OLD))


@query(f"""WITH {ctes(quotes=QUOTES)}, c AS (SELECT quote_id, game_id, line - 0.5 AS line, CASE WHEN price >= 100 THEN price - 100 ELSE price + 100 END - 10 AS c FROM quotes) SELECT quote_id, game_id, line, CASE WHEN c >= 0 THEN c + 100 ELSE c - 100 END AS price FROM c""")
def degraded_quotes(spark, sf):
    """Half a point and ten cents worse."""
    q = made(spark, sf, QUOTES)
    line, price = m.degrade(F.col("line"), F.col("price"), 0.5, 10, under=True)
    return q.select("quote_id", "game_id", line.alias("line"), price.alias("price"))


@query(f"""WITH {ctes()}, p AS (SELECT season, (home_points + away_points)::BIGINT AS k, count(*) AS n FROM games WHERE home_points IS NOT NULL GROUP BY ALL), t AS (SELECT season, sum(n) AS n FROM p GROUP BY season), l AS (SELECT unnest([40.0, 52.0, 60.5]::DOUBLE[]) AS line)
 SELECT season, line, round(sum(p.n) FILTER (k > line) / any_value(t.n)::DOUBLE, 6) AS over, round(coalesce(sum(p.n) FILTER (k = line), 0) / any_value(t.n)::DOUBLE, 6) AS push, round(sum(p.n) FILTER (k < line) / any_value(t.n)::DOUBLE, 6) AS under FROM p JOIN t USING (season), l GROUP BY season, line""")
def pmf_outcomes(spark, sf):
    """Over, push and under of some lines, from each season's distribution of points."""
    from ..operators.forecasts import empirical_pmf
    from ..sources.proxy import games

    points = games(spark, sf).filter("home_points IS NOT NULL").select("season", (F.col("home_points") + F.col("away_points")).alias("k"))
    pmf = empirical_pmf(points, "k", ["season"]).select("season", "pmf", F.explode(F.array(*map(F.lit, (40.0, 52.0, 60.5)))).alias("line"))
    over, push, under = m.pmf_outcomes(F.col("pmf"), F.col("line"))
    return pmf.select("season", "line", rounded(over).alias("over"), rounded(push).alias("push"), rounded(under).alias("under"))


@query(f"WITH {_LEDGER} SELECT decision_id, action, CASE WHEN action IN ('pass', 'bet') THEN side END AS side, CASE WHEN action IN ('pass', 'bet') THEN book END AS book, CASE WHEN action IN ('pass', 'bet') THEN taken END AS line, round(CASE WHEN action IN ('pass', 'bet') THEN ev END, 6) AS ev, round(units, 6) AS units FROM ledger")
def execution_ledger(spark, sf):
    """What became of every decision: the better side, bet from the threshold on, and its units."""
    return _ledger(spark, sf).select("decision_id", "action", "side", "book", "line", rounded("ev").alias("ev"), rounded("units").alias("units"))


_GRID = [0.0, 0.02, 0.05]


def _scenario(name: str, change: dict) -> str:
    parts = f"{_MADE}, {_states(change.get('delay', 0))}, {_scored(change.get('rule', 'best'), change.get('points', 0.0), change.get('cents', 0))}, closing_side AS (SELECT decision_id, book, side, line AS close_line FROM closing WHERE available)"
    rows = f"""SELECT '{name}' AS scenario, threshold, {_acted("threshold", change.get("missed", 0.0))} AS action, {_UNITS} AS units, ev, CASE WHEN side = 'over' THEN close_line - taken ELSE taken - close_line END AS clv FROM (SELECT *, unnest({_GRID}::DOUBLE[]) AS threshold FROM decisions) d LEFT JOIN best b USING (decision_id) LEFT JOIN closing_side USING (decision_id, book, side)"""
    return f"(WITH {parts} {rows.replace('d LEFT JOIN best b', 'd LEFT JOIN (SELECT * EXCLUDE (mean) FROM best) b')})"


@query(f"""WITH rows AS ({" UNION ALL ".join(_scenario(n, c) for n, c in ex.SCENARIOS.items())}), t AS (SELECT scenario, threshold, count(*) FILTER (action = 'bet') AS bets, coalesce(sum(units) FILTER (action = 'bet'), 0) AS units, avg(ev) FILTER (action = 'bet') AS mean_ev, avg(clv) FILTER (action = 'bet') AS mean_clv FROM rows GROUP BY ALL)
 SELECT scenario, threshold, bets, round(units, 4) AS units, round(mean_ev, 6) AS mean_ev, round(mean_clv, 6) AS mean_clv_line, (SELECT min(units) > 0 FROM t WHERE threshold = {POLICY.threshold}::DOUBLE AND scenario <> 'median_book') AS actionable FROM t""")
def sensitivity_grid(spark, sf):
    """Units under modest trouble and several thresholds, and whether the policy stands it."""
    out = ex.sensitivity(_decisions(spark, sf), _quotes(spark, sf), POLICY, BASE, _GRID, outcomes)
    return out.select("scenario", "threshold", "bets", rounded("units", 4).alias("units"), rounded("mean_ev").alias("mean_ev"), rounded("mean_clv_line").alias("mean_clv_line"), "actionable")


@query(f"""WITH {_LEDGER} SELECT l.decision_id, CASE WHEN l.side = 'over' THEN c.line - taken ELSE taken - c.line END AS clv_line, round(CASE WHEN c.line = l.line AND cp.line = l.line AND o.line = l.line THEN {_fair("c.price", "cp.price")} - {_fair("l.price", "o.price")} END, 6) AS clv_prob FROM ledger l
 LEFT JOIN closing c ON c.decision_id = l.decision_id AND c.book = l.book AND c.side = l.side AND c.available LEFT JOIN closing cp ON cp.decision_id = l.decision_id AND cp.book = l.book AND cp.side <> l.side AND cp.available LEFT JOIN other o ON o.decision_id = l.decision_id AND o.book = l.book AND o.side = l.side AND o.available WHERE action = 'bet'""")
def comparable_clv(spark, sf):
    """Closing-line value of the bets at their own book; in fair probability only where all four prices stand at one number."""
    return _ledger(spark, sf).filter("action = 'bet'").select("decision_id", "clv_line", rounded("clv_prob").alias("clv_prob"))


@query(f"""WITH {_LEDGER} SELECT decision_id, round(exp(sum(ln(1 + 0.01 * units)) OVER (PARTITION BY game_id % 20 ORDER BY decision_id ROWS UNBOUNDED PRECEDING)), 6) AS bank FROM ledger WHERE action = 'bet'""")
def compounded_bankroll(spark, sf):
    bets = _ledger(spark, sf).filter("action = 'bet'").withColumn("account", F.col("game_id") % 20).withColumn("return", F.col("units"))
    return m.compounded(bets, ["account"], ["decision_id"], F.lit(0.01)).select("decision_id", rounded("bank").alias("bank"))


@query(f"""WITH {_LEDGER}, c AS (SELECT game_id % 20 AS account, decision_id, sum(units) OVER (PARTITION BY game_id % 20 ORDER BY decision_id ROWS UNBOUNDED PRECEDING) AS total, row_number() OVER (PARTITION BY game_id % 20 ORDER BY decision_id) AS n FROM ledger WHERE action = 'bet')
 SELECT account, decision_id, n, round(total, 4) AS total, round(total - 1.96 * sqrt(n), 4) AS low, round(total + 1.96 * sqrt(n), 4) AS high FROM c""")
def equity_bands(spark, sf):
    """Profit so far with the band that results of unit variance would stay in."""
    from pyspark.sql import Window

    w = Window.partitionBy("account").orderBy("decision_id")
    c = _ledger(spark, sf).filter("action = 'bet'").withColumn("account", F.col("game_id") % 20).select("account", "decision_id", F.sum("units").over(w).alias("total"), F.row_number().over(w).cast("long").alias("n"))
    return c.select("account", "decision_id", "n", rounded("total", 4).alias("total"), rounded(F.col("total") - 1.96 * F.sqrt("n"), 4).alias("low"), rounded(F.col("total") + 1.96 * F.sqrt("n"), 4).alias("high"))


@query(f"""WITH {ctes(quotes=QUOTES)}, p AS (SELECT quote_id, game_id, line, price, -115 AS other, {price_p("price")} AS a FROM quotes) SELECT quote_id, game_id, round(a / (a + 115.0::DOUBLE / 215), 6) AS p_over, round(a, 6) AS implied, round(CASE WHEN price < 0 THEN 1 + 100.0::DOUBLE / -price ELSE 1 + price / 100.0::DOUBLE END, 6) AS decimal_price,
 round(greatest(0.0, (0.55 * ({win("price")}) - 0.45) / ({win("price")})), 6) AS kelly, round(0.55 * ({win("price")}) - 0.45, 6) AS ev FROM p""")
def price_math(spark, sf):
    """Implied and fair probability, decimal price, Kelly share and expected value of every quote."""
    q = made(spark, sf, QUOTES)
    a, price = implied_probability(F.col("price")), F.col("price")
    return q.select("quote_id", "game_id", rounded(fair_pair(a, implied_probability(F.lit(-115)))).alias("p_over"), rounded(a).alias("implied"), rounded(decimal_price(price)).alias("decimal_price"), rounded(kelly(F.lit(0.55), price)).alias("kelly"), rounded(m.expected_value(F.lit(0.55), F.lit(0.0), price)).alias("ev"))


@query(f"""WITH {ctes(quotes=QUOTES)}, p AS (SELECT quote_id, game_id, line, price, 45 + game_id % 12 AS projection, 8 + 0.1::DOUBLE * line AS sigma FROM quotes), z AS (SELECT *, (line - projection) / sigma AS z, ({price_p("price")}) + 0.02::DOUBLE AS need FROM p)
 SELECT quote_id, game_id, round({NORM_CDF_SQL.replace("{z}", "z")}, 6) AS p_under, round({NORM_CDF_SQL.replace("{z}", "z")} - ({price_p("price")}), 6) AS edge, ceil((projection + ({norm_quantile_sql("need")}) * sigma) * 2) / 2 AS bet_to FROM z""")
def repriced_edge(spark, sf):
    """Probability and edge of an under by a spread that grows with the line, and the lowest half point that still has the edge."""
    p = made(spark, sf, QUOTES).withColumns({"projection": 45 + F.col("game_id") % 12, "sigma": 8 + 0.1 * F.col("line")})
    under = norm_cdf((F.col("line") - F.col("projection")) / F.col("sigma"))
    to = m.bet_to(F.col("projection"), F.col("sigma"), F.col("price"), 0.02)
    return p.select("quote_id", "game_id", rounded(under).alias("p_under"), rounded(under - implied_probability(F.col("price"))).alias("edge"), to.alias("bet_to"))


def _lift(mean: str, sd: float) -> str:
    z = f"(({mean}) / {sd}::DOUBLE)"
    return f"(({mean}) * {NORM_CDF_SQL.replace('{z}', z)} + {sd}::DOUBLE * exp(-{z} * {z} / 2) * 0.3989422804014327 - ({mean}))"


_BIAS = f"({_lift('(i / 2.0::DOUBLE - abs(spread)) / 2', 12.0)} + {_lift('(i / 2.0::DOUBLE + abs(spread)) / 2', 11.0)})"


@query(f"""WITH {ctes()}, f AS (SELECT DISTINCT spread FROM games WHERE spread IS NOT NULL) SELECT spread, list_max(list_filter(range(0, 400), lambda i: {_BIAS} > 0.75)) / 2.0::DOUBLE AS bet_to FROM f""")
def bet_to_total(spark, sf):
    """The highest half-point total at which the floor under both scores still lifts the expected total by more than the threshold."""
    from ..sources.proxy import games

    f = games(spark, sf).filter("spread IS NOT NULL").select("spread").distinct()
    return f.select("spread", m.bet_to_over(F.col("spread"), F.lit(12.0), F.lit(11.0), 0.75).alias("bet_to"))


@query(f"""WITH {_MADE}, {_states()}, pairs AS (SELECT o.decision_id, o.line, {_fair("o.price", "u.price")} AS p FROM fresh o JOIN fresh u ON u.decision_id = o.decision_id AND u.book = o.book AND o.side = 'over' AND u.side = 'under' AND o.line = u.line),
 counted AS (SELECT decision_id, line, count(*) AS books, avg(p) AS p_market FROM pairs GROUP BY ALL), lines AS (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY decision_id ORDER BY books DESC, line) = 1),
 m AS (SELECT l.*, mean, line AS taken, (final_total > line)::INT AS y FROM lines l JOIN decisions USING (decision_id) WHERE final_total <> line),
 s AS (SELECT *, least(greatest((1 - {_phi("(floor(taken) + 0.5)")}) / (1 - CASE WHEN taken = floor(taken) THEN {_phi("(taken + 0.5)")} - {_phi("(taken - 0.5)")} ELSE 0.0 END), 1e-12), 1 - 1e-12) AS p_model FROM m)
 SELECT books, count(*) AS n, round(avg(y), 6) AS over_rate, round(avg(pow(p_model - y, 2)), 6) AS brier_model, round(avg(pow(p_market - y, 2)), 6) AS brier_market, round(avg(pow(p_model - y, 2) - pow(p_market - y, 2)), 6) AS brier_difference,
  round(avg(-(y * ln(p_model) + (1 - y) * ln(1 - p_model)) + y * ln(p_market) + (1 - y) * ln(1 - p_market)), 6) AS log_loss_difference FROM s GROUP BY books""")
def priced_replay(spark, sf):
    """Model and de-vigged market at the modal number of fresh pairs, by how many books stand there."""
    s = ex.market_scores(_decisions(spark, sf), _quotes(spark, sf), OLD, outcomes)
    y = F.col("over")
    brier = lambda c: (F.col(c) - y) * (F.col(c) - y)
    loss = lambda c: -(y * F.log(c) + (1 - y) * F.log(1 - F.col(c)))
    found = {"over_rate": y, "brier_model": brier("p_model"), "brier_market": brier("p_market"), "brier_difference": brier("p_model") - brier("p_market"), "log_loss_difference": loss("p_model") - loss("p_market")}
    return s.groupBy("books").agg(F.count(F.lit(1)).alias("n"), *(rounded(F.avg(c)).alias(n) for n, c in found.items()))


BETS = "SELECT o_orderkey AS bet_id, o_orderkey + o_orderkey % 2 * 0 AS game_id, CAST(o_orderdate AS DATE) AS day, concat('T', o_custkey % 40) AS home, concat('T', (o_custkey * 7 + o_orderkey) % 40) AS away, o_orderkey % 5 AS line FROM {orders} WHERE o_orderkey % 4 = 0"
SAVED = "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, concat('T', o_custkey % 40) AS home, concat('T', (o_custkey * 7 + o_orderkey) % 40) AS away FROM {orders} WHERE o_orderkey % 8 = 0"


@query(f"""WITH {ctes(bets=BETS, saved=SAVED)}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day, home, away ORDER BY bet_id) AS r FROM bets) WHERE r = 1), g AS (SELECT game_id, kickoff::DATE AS day, concat('T', home_team) AS home, concat('T', away_team) AS away FROM games)
 SELECT one.bet_id, min(g.game_id) AS game_id, count(g.game_id) AS hits FROM one LEFT JOIN g USING (day, home, away) WHERE NOT EXISTS (SELECT 1 FROM saved s WHERE s.day = one.day AND s.home = one.home AND s.away = one.away) GROUP BY one.bet_id""")
def bet_import(spark, sf):
    """Bets matched to games by date and both teams; what is saved already, or repeated but for the line, is left out."""
    from ..operators.relational import latest
    from ..sources.proxy import games

    key = ["day", "home", "away"]
    new = latest(made(spark, sf, BETS).drop("game_id"), key, [F.asc("bet_id")]).join(made(spark, sf, SAVED), key, "left_anti")
    g = games(spark, sf).select("game_id", F.to_date("kickoff").alias("day"), F.concat(F.lit("T"), "home_team").alias("home"), F.concat(F.lit("T"), "away_team").alias("away"))
    return new.join(g, key, "left").groupBy("bet_id").agg(F.min("game_id").alias("game_id"), F.count("game_id").alias("hits"))


@query(f"""WITH {ctes(quotes=QUOTES)}, own AS (SELECT game_id, arg_max(line, (quoted_at, quote_id, line)) AS line FROM quotes WHERE book = 'B1' GROUP BY game_id), med AS (SELECT game_id, median(line) AS line FROM quotes GROUP BY game_id)
 SELECT med.game_id, coalesce(own.line, med.line) AS close, CASE WHEN own.line IS NOT NULL THEN 'own' ELSE 'median' END AS source, 50 - coalesce(own.line, med.line) AS clv FROM med LEFT JOIN own USING (game_id)""")
def sheet_clv(spark, sf):
    """Closing-line value of a sheet's bets: the own book's last line, else the median of all."""
    q = made(spark, sf, QUOTES)
    out = q.groupBy("game_id").agg(F.max_by(F.when(F.col("book") == "B1", F.col("line")), F.when(F.col("book") == "B1", F.struct("quoted_at", "quote_id", "line"))).alias("own"), F.median("line").alias("med"))
    close = F.coalesce("own", "med")
    return out.select("game_id", close.alias("close"), F.when(F.col("own").isNotNull(), "own").otherwise("median").alias("source"), (50 - close).alias("clv"))


@query(f"""WITH {ctes(quotes=QUOTES)}, c AS (SELECT game_id, line - 50 AS clv, quoted_at, quote_id FROM quotes WHERE book = 'B3') SELECT game_id % 50 AS account, quote_id, game_id, sum(clv) OVER (PARTITION BY game_id % 50 ORDER BY quoted_at, quote_id, game_id ROWS UNBOUNDED PRECEDING) AS total_clv FROM c""")
def cumulative_clv(spark, sf):
    from pyspark.sql import Window

    c = made(spark, sf, QUOTES).filter("book = 'B3'").withColumn("account", F.col("game_id") % 50)
    w = Window.partitionBy("account").orderBy("quoted_at", "quote_id", "game_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return c.select("account", "quote_id", "game_id", F.sum(F.col("line") - 50).over(w).alias("total_clv"))
