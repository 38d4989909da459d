"""Grouped rollups, matching rules and small-sample estimators of the research reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pooled(rate: str, weight: str) -> Column:
    """Weighted mean over the rows that have the rate: pooled over games, not a mean of means."""
    ok = F.col(rate).isNotNull()
    return F.sum(F.col(rate) * F.col(weight)) / F.nullif(F.sum(F.when(ok, F.col(weight))), F.lit(0))


def shop(quotes: DataFrame, game: str, k: float, keys: tuple[float, ...] = (), least_price: float = -120.0, books: int = 2) -> DataFrame:
    """Fair total and best playable over of every game that ``books`` books quote.

    ``quotes`` has one row a game and book.  Where three or more quote, lines further than ``k`` from the median of all
    are left out, if two or more stay.  The fair number is a posted one, the higher of two middles.  The best one is the
    lowest total at ``least_price`` or better, then the better price, then the book; if no book has that price, the
    lowest total of all, not playable.  ``crosses`` tells whether a key number lies between best and fair.
    """
    w = Window.partitionBy(game)
    near = (F.count("line").over(w) < 3) | (F.abs(F.col("line") - F.median("line").over(w)) <= k)
    marked = quotes.filter(F.col("line").isNotNull()).withColumn("__all", F.count("line").over(w)).filter(F.col("__all") >= books).withColumn("__near", near)
    kept = marked.withColumn("__few", F.count_if(F.col("__near")).over(w) < 2).filter("__few OR __near")
    row = F.struct("line", (-F.col("price")).alias("p"), "book")
    lowest = F.min(F.struct("line", "book", (-F.col("price")).alias("p")))
    out = kept.groupBy(game).agg(conservative_median("line", False).alias("fair"), F.count(F.lit(1)).alias("books"), (F.max("line") - F.min("line")).alias("range"), F.min(F.when(F.col("price") >= least_price, row)).alias("b"), lowest.alias("a"))
    best = F.coalesce("b.line", "a.line")
    crosses = F.exists(F.array(*map(F.lit, keys)), lambda x: (best < x) & (x < F.col("fair"))) if keys else F.lit(False)
    return out.select(game, "fair", "books", "range", best.alias("line"), (-F.coalesce("b.p", "a.p")).alias("price"), F.coalesce("b.book", "a.book").alias("book"), F.col("b").isNotNull().alias("playable"), crosses.alias("crosses"))


def conservative_median(x: str, low: bool) -> Column:
    """The lower or higher of the two middle values where the number of values is even."""
    s = F.sort_array(F.collect_list(x))
    n = F.size(s)
    return F.get(s, F.when(F.lit(low), F.floor((n - 1) / 2)).otherwise(F.floor(n / 2)).cast("int"))


def quartile_buckets(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """``bucket`` 1 to 4 by the group's own quartiles; equal values share a bucket."""
    cuts = df.groupBy(*by).agg(F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("__c"))
    bucket = 1 + F.size(F.filter("__c", lambda c: F.col(x) > c))
    return df.join(cuts, by).withColumn("bucket", bucket.cast("long")).drop("__c")


def fixed_bins(x: Column, edges: tuple[float, ...]) -> Column:
    """Number of the half-open bin [edge, next edge) of ``x``; null outside."""
    return F.when((x >= edges[0]) & (x < edges[-1]), F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= x)).cast("long"))


def shrink(df: DataFrame, total: str, n: str, by: list[str]) -> DataFrame:
    """Rates (``total`` over ``n``) pulled to the weighted mean of their group, as far as noise explains their spread.

    Noise and signal are told apart by group: the variance of one trial from the n-weighted spread, the rates' own
    variance less that noise at the mean n; a rate keeps n / (n + variance / signal) of its distance.
    """
    w = Window.partitionBy(*by)
    size = F.greatest(F.col(n), F.lit(1)).cast("double")
    rows = df.withColumn("__n", size).withColumn("__r", F.col(total) / F.col("__n")).withColumn("__m", F.sum(F.col("__n") * F.col("__r")).over(w) / F.sum("__n").over(w))
    d2 = (F.col("__r") - F.col("__m")) * (F.col("__r") - F.col("__m"))
    trial = F.sum(F.col("__n") * F.col("__n") * d2).over(w) / F.sum("__n").over(w)
    spread = F.sum(F.col("__n") * d2).over(w) / F.sum("__n").over(w)
    rows = rows.withColumns({"__s2": trial, "__noise": trial / F.avg("__n").over(w), "__spread": spread})
    rows = rows.withColumn("shrink_weight", F.col("__n") / (F.col("__n") + F.col("__s2") / F.greatest(F.col("__spread") - F.col("__noise"), F.lit(1e-9))))
    out = rows.withColumns({"group_rate": F.col("__m"), "shrunk": F.col("__m") + F.col("shrink_weight") * (F.col("__r") - F.col("__m"))})
    return out.drop("__n", "__r", "__m", "__s2", "__noise", "__spread")


def overdispersion(df: DataFrame, hits: str, n: str, unit: list[str], by: list[str]) -> DataFrame:
    """Summed squared Pearson residuals of the units' games against their own rate, by degree of freedom.

    The rate is clipped to [0.02, 0.98], so that a spotless record does not divide by nothing.
    """
    rate = df.groupBy(*by, *unit).agg(F.least(F.lit(0.98), F.greatest(F.lit(0.02), F.sum(hits) / F.sum(n))).alias("p"), F.count(F.lit(1)).alias("games"))
    d = F.col(hits) - F.col(n) * F.col("p")
    each = df.join(rate, [*by, *unit]).withColumn("x", d * d / (F.col(n) * F.col("p") * (1 - F.col("p"))))
    per = each.groupBy(*by, *unit).agg(F.sum("x").alias("x"), F.max("games").alias("games")).filter("games > 1")
    return per.groupBy(*by).agg((F.sum("x") / F.sum(F.col("games") - 1)).alias("phi"))


def z_by(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Population z-scores within the group; a constant column gives null."""
    w = Window.partitionBy(*by)
    return df.withColumns({f"z_{c}": (F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_pop(c).over(w), F.lit(0.0)) for c in columns})


def residual(df: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    """``y`` less its regression on ``x`` within the group."""
    line = df.groupBy(*by).agg(F.regr_slope(y, x).alias("__s"), F.regr_intercept(y, x).alias("__i"))
    return df.join(line, by).withColumn("residual", F.col(y) - F.col("__i") - F.col("__s") * F.col(x)).drop("__s", "__i")


def leave_one_out_slopes(df: DataFrame, x: str, y: str, season: str) -> DataFrame:
    """Slope over all seasons but each one, by subtracting the season's own sums."""
    ok = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    s = ok.groupBy(season).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(F.col(x) * F.col(x)).alias("xx"), F.sum(F.col(x) * F.col(y)).alias("xy"))
    total = s.agg(*(F.sum(c).alias(f"t_{c}") for c in ("n", "x", "y", "xx", "xy")))
    s = s.crossJoin(F.broadcast(total))
    n, sx, sy, xx, xy = (F.col(f"t_{c}") - F.col(c) for c in ("n", "x", "y", "xx", "xy"))
    return s.select(season, n.alias("n"), ((n * xy - sx * sy) / F.nullif(n * xx - sx * sx, F.lit(0.0))).alias("slope"))


def match_ladder(asked: DataFrame, known: DataFrame, key: list[str], at: str, hours: float) -> DataFrame:
    """Rows of ``asked`` with the game they mean and how it was found.

    First a game of exactly that kickoff; else the only one within ``hours``; two or more are ambiguous,
    none is missed.  Buckets of the window's width make both steps joins by equality; equal moments ask once and
    games of one kickoff answer as one row, so pairs grow with distinct moments, not with rows.
    """
    width = int(hours * 3600)
    bucket = lambda c: F.floor(F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})") / width)
    moments = asked.select(*key, at).distinct().withColumn("__b", F.explode(F.sequence(bucket(at) - 1, bucket(at) + 1)))
    starts = known.groupBy(*key, "kickoff").agg(F.count(F.lit(1)).alias("__n"), F.min("game_id").alias("game_id")).withColumn("__b", bucket("kickoff"))
    near = moments.join(starts, [*key, "__b"]).withColumn("__gap", F.abs(F.expr(f"timestampdiff(SECOND, {at}, kickoff)"))).filter(F.col("__gap") <= width)
    found = near.groupBy(*key, at).agg(F.sum("__n").alias("n"), F.min("game_id").alias("one"), F.min(F.when(F.col("__gap") == 0, F.col("game_id"))).alias("exact"))
    hits = asked.join(found, [*key, at]).groupBy("ask_id").agg(F.sum("n").alias("n"), F.min("one").alias("one"), F.min("exact").alias("exact"))
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("n") == 1, "window").when(F.col("n") > 1, "ambiguous").otherwise("missed")
    out = asked.select("ask_id").join(hits, "ask_id", "left").withColumn("how", how)
    return out.select("ask_id", "how", F.when(F.col("how") == "exact", F.col("exact")).when(F.col("how") == "window", F.col("one")).alias("game_id"))


#: Fixed moments before kickoff, in hours: coarse far out, then fine.
MARKS = (2880, 1440, 720, 336, 168, 120, 72, 48, 24, 12, 6, 1)


def move_decay(ticks: DataFrame, event: str, line: str, at: str, tie: str, kickoff: str, marks: tuple[int, ...] = MARKS, least: float = 1.0) -> DataFrame:
    """event, hours, done: the share of the move from open to close that was done so many hours before kickoff.

    Ticks before the kickoff count; moves of less than ``least`` points are left out; a mark before an event's first
    tick has no row.  One aggregate an event: each mark keeps the last tick that is that far out.
    """
    out = (F.unix_micros(F.col(kickoff).cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / 3.6e9
    rows = ticks.filter(F.col(line).isNotNull()).withColumn("__h", out).filter("__h > 0")
    order = F.struct(at, tie)
    last = [F.max_by(F.when(F.col("__h") >= h, F.col(line)), F.when(F.col("__h") >= h, order)).alias(f"__{h}") for h in marks]
    per = rows.groupBy(event).agg(F.min_by(line, order).alias("__open"), F.max_by(line, order).alias("__close"), *last)
    per = per.withColumn("__move", F.col("__close") - F.col("__open")).filter(F.abs("__move") >= least)
    each = per.select(event, "__open", "__move", F.explode(F.array(*(F.struct(F.lit(h).alias("hours"), F.col(f"__{h}").alias("line")) for h in marks))).alias("x")).filter("x.line IS NOT NULL")
    return each.select(event, F.col("x.hours").cast("long").alias("hours"), ((F.col("x.line") - F.col("__open")) / F.col("__move")).alias("done"))


#: Fixed edges of minutes left (finer near the end), points a bin of expected rest, rows a cell needs, share below which tails end.
MINUTES, EXPECTED, CELL, TAIL = (0, 2.5, 5, 7.5, 10, 15, 20, 25, 30, 37.5, 45, 52.5, 60.1), 10.0, 100, 0.0005


def remaining_points(starts: DataFrame, least: int = CELL, tail: float = TAIL) -> DataFrame:
    """Distribution of the points still to come by minutes left and expected rest: tb, eb, rem, n, p, mean.

    ``starts`` has period, clock_min, clock_sec, points (so far), final_total and pregame_total, a row a drive.  Clocks
    that cannot be and starts beyond the final total are left out; overtime has no minutes left.  Cells of fewer than
    ``least`` starts go, tails end at the first share of ``tail``, and what is left adds up to one.
    """
    regular = F.col("period").between(1, 4) & F.col("clock_min").between(0, 15) & F.col("clock_sec").between(0, 59)
    left = F.when(F.col("period") >= 5, 0.0).when(regular, (4 - F.col("period")) * 15.0 + F.col("clock_min") + F.col("clock_sec") / 60.0)
    rows = starts.withColumns({"left": left, "rem": F.col("final_total") - F.col("points")}).filter("left BETWEEN 0 AND 60 AND rem BETWEEN 0 AND 120")
    time = fixed_bins(F.col("left"), MINUTES) - 1
    counts = rows.groupBy(time.alias("tb"), F.floor(F.col("pregame_total") * F.col("left") / 60.0 / EXPECTED).alias("eb"), F.col("rem").cast("long").alias("rem")).agg(F.count(F.lit(1)).alias("n")).filter("tb IS NOT NULL AND eb IS NOT NULL")
    cell = Window.partitionBy("tb", "eb")
    full = counts.withColumns({"of": F.sum("n").over(cell), "mean": F.sum(F.col("rem") * F.col("n")).over(cell) / F.sum("n").over(cell)}).filter(F.col("of") >= least)
    heavy = F.when(F.col("n") / F.col("of") >= tail, F.col("rem"))
    kept = full.withColumns({"lo": F.min(heavy).over(cell), "hi": F.max(heavy).over(cell)}).filter("rem BETWEEN lo AND hi")
    return kept.select("tb", "eb", "rem", "n", (F.col("n") / F.sum("n").over(cell)).alias("p"), "mean")
