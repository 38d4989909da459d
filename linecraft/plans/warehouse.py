"""Builders of the dimensional model: each takes raw tables and returns one table of the model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relational import latest

#: Books under several names, and the one they are kept under (fixed values of the vendor feeds).
ALIASES = {"DK": "DraftKings", "draftkings": "DraftKings", "FD": "FanDuel"}


def dim_week(weeks: DataFrame) -> DataFrame:
    """One row a (season, week, season_type): the one that starts first, rows without a start last."""
    return latest(weeks, ["season", "week", "season_type"], [F.asc_nulls_last("starts"), F.asc_nulls_last("ends")])


def dim_conference(rest: DataFrame, twin: DataFrame) -> DataFrame:
    """Conferences with the division that their twin table has by id."""
    return rest.join(twin.select("id", "division"), "id", "left")


def dim_team(teams: DataFrame, members: DataFrame) -> DataFrame:
    """Each team as of its latest season; ``is_fbs`` if it is a member in the latest season of memberships."""
    newest = latest(teams, ["team"], [F.desc("season"), F.asc_nulls_last("conference")])
    top = members.agg(F.max("season").alias("top"))
    now = members.join(F.broadcast(top), F.col("season") == F.col("top"), "left_semi").select("team").distinct().withColumn("is_fbs", F.lit(True))
    return newest.join(now, "team", "left").withColumn("is_fbs", F.coalesce("is_fbs", F.lit(False)))


def dim_venue(raw: DataFrame) -> DataFrame:
    """Typed venues; an elevation that is no number is null."""
    return raw.select("venue", "name", F.col("elevation").try_cast("double").alias("elevation"), F.col("dome").cast("boolean").alias("dome"))


def project(raw: DataFrame | None, names: dict[str, str]) -> DataFrame | None:
    """A lookup table: the columns that exist under their model names, none for an absent table."""
    return None if raw is None else raw.select(*(F.col(old).alias(new) for old, new in names.items() if old in raw.columns))


def _fullest(lines: DataFrame, key: list[str], order: list[Column], values: tuple[str, ...]) -> DataFrame:
    filled = reduce(Column.__add__, [F.col(v).isNotNull().cast("int") for v in values])
    return latest(lines.withColumn("__n", filled), key, [F.desc("__n"), *order]).drop("__n")


def clean_lines(lines: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """Books under one name, NaN as null, one row a (game, book): the fullest, the first of equals."""
    known = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    named = lines.withColumn("book", F.coalesce(F.try_element_at(known, F.col("book")), "book"))
    named = named.withColumns({v: F.when(~F.isnan(v), F.col(v)) for v in values})
    return _fullest(named, ["game_id", "book"], [F.asc("pos"), *(F.asc_nulls_last(v) for v in values)], values)


def merge_lines(a: DataFrame, b: DataFrame, values: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Lines of two sources, the first one's values win; and the fields on which they disagree."""
    left = a.select("game_id", "book", F.struct(*values).alias("a"))
    right = b.select("game_id", "book", F.struct(*values).alias("b"))
    both = left.join(right, ["game_id", "book"], "full_outer")
    source = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "both").when(F.col("a").isNotNull(), "rest").otherwise("gql")
    merged = both.select("game_id", "book", *(F.coalesce(f"a.{v}", f"b.{v}").alias(v) for v in values), source.alias("_source"))
    fields = F.array(*(F.struct(F.lit(v).alias("field"), F.col(f"a.{v}").alias("rest"), F.col(f"b.{v}").alias("gql")) for v in values))
    conflicts = both.select("game_id", "book", F.explode(fields).alias("x")).select("game_id", "book", "x.*").filter("rest <> gql")
    return merged, conflicts


def fact_game(games: DataFrame, lines: DataFrame, conferences: DataFrame, projections: list[str]) -> DataFrame:
    """Games with their line (the fullest of the books, no projection site) and their conference keys.

    A conference key comes from the conference's own table, else from the game's row.
    """
    book = lines.filter(~F.col("book").isin(projections) & F.col("spread").isNotNull())
    line = _fullest(book, ["game_id"], [F.asc("pos"), F.asc("book")], ("spread", "total")).select("game_id", "book", F.col("spread").alias("line_spread"), F.col("total").alias("line_total"))
    out = games.join(line, "game_id", "left").withColumn("has_line", F.col("line_spread").isNotNull())
    for side in ("home", "away"):
        known = F.broadcast(conferences.select(F.col("conference").alias(f"{side}_conference"), F.col("conference_id").alias("__id")))
        out = out.join(known, f"{side}_conference", "left").withColumn(f"{side}_conference_id", F.coalesce("__id", f"{side}_own_id")).drop("__id", f"{side}_own_id")
    return out


def split_projections(lines: DataFrame, projections: list[str]) -> tuple[DataFrame, DataFrame]:
    """The books' tape and the projection sites' numbers."""
    site = F.col("book").isin(projections)
    return lines.filter(~site), lines.filter(site)


def distinct_over(column: str, *tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, [t.select(column) for t in tables]).filter(F.col(column).isNotNull()).distinct()


def dim_coach(seasons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Coaches with all their teams, and the names that stand for several coaches, team by team (1-based)."""
    per = seasons.groupBy("coach").agg(F.min("season").alias("first_season"), F.count(F.lit(1)).alias("seasons"), F.sort_array(F.collect_set("team")).alias("teams"))
    conflicts = per.filter(F.size("teams") > 1).select("coach", F.posexplode("teams").alias("i", "team"))
    return per.withColumn("n_teams", F.size("teams").cast("long")).drop("teams"), conflicts.select("coach", (F.col("i") + 1).cast("long").alias("team_idx"), "team")


def twins(a: DataFrame, b: DataFrame, key: list[str], values: list[str], names: tuple[str, str] = ("rest", "gql"), distinct: str = "") -> DataFrame:
    """Full outer join of a table with its twin: ``values`` of the first win, others come from either side.

    ``distinct`` ("a" or "b") drops repeated rows of that side first.
    """
    a, b = (a.distinct() if distinct == "a" else a), (b.distinct() if distinct == "b" else b)
    only_a, only_b = [c for c in a.columns if c not in key + values], [c for c in b.columns if c not in key + values]
    left = a.select(*key, *only_a, *(F.col(v).alias(f"__a_{v}") for v in values), F.lit(True).alias("__a"))
    right = b.select(*key, *only_b, *(F.col(v).alias(f"__b_{v}") for v in values), F.lit(True).alias("__b"))
    source = F.when(F.col("__a") & F.col("__b"), "both").when(F.col("__a"), names[0]).otherwise(names[1])
    return left.join(right, key, "full_outer").select(*key, *only_a, *only_b, *(F.coalesce(f"__a_{v}", f"__b_{v}").alias(v) for v in values), source.alias("_source"))


def coach_seasons(rest: DataFrame, twin: DataFrame, coaches: DataFrame, teams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Coach seasons of both sources, and those that cannot be tied to one coach and one team, with the reason."""
    out = twins(rest, twin, ["coach", "team", "season"], ["wins"])
    named = coaches.groupBy("coach").agg(F.count(F.lit(1)).alias("coaches"))
    known = teams.select("team", F.lit(1).alias("teams")).distinct()
    checked = out.join(named, "coach", "left").join(known, "team", "left").fillna(0, ["coaches", "teams"])
    reason = F.when(F.col("coaches") == 0, "no coach").when(F.col("coaches") > 1, "ambiguous coach").when(F.col("teams") == 0, "no team")
    checked = checked.withColumn("reason", reason).drop("coaches", "teams")
    return checked.filter("reason IS NULL").drop("reason"), checked.filter("reason IS NOT NULL")


def historical(games: DataFrame, weeks: DataFrame) -> DataFrame:
    """Games of seasons before the first one that has weeks."""
    return games.crossJoin(F.broadcast(weeks.agg(F.min("season").alias("__first")))).filter("season < __first").drop("__first")


def ratings_wide(sources: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """One row a key over all sources, each source's columns under its prefix."""
    spine = reduce(DataFrame.union, [s.select(*key) for s in sources.values()]).distinct()
    for prefix, s in sources.items():
        one = s.select(*key, *(F.col(c).alias(f"{prefix}_{c}") for c in s.columns if c not in key))
        spine = spine.join(one, key, "left")
    return spine


def team_season_facts(games: DataFrame, recruiting: DataFrame, returning: DataFrame) -> DataFrame:
    """Record, record against the line, recruiting and returning production of each team and season."""
    diff, cover = F.col("points") - F.col("allowed"), F.col("points") - F.col("allowed") + F.col("line")
    own = games.groupBy("team", "season").agg(
        *(F.count_if(x).alias(n) for n, x in (("wins", diff > 0), ("losses", diff < 0), ("ties", diff == 0), ("ats_wins", cover > 0), ("ats_losses", cover < 0), ("ats_pushes", cover == 0))),
    )
    return own.join(recruiting, ["team", "season"], "left").join(returning, ["team", "season"], "left")


def poll_ranks(polls: DataFrame, teams: DataFrame) -> DataFrame:
    """Poll ranks by team key; a name in several polls' pages counts once."""
    return polls.join(F.broadcast(teams.select("team", "name")), "name").select("season", "week", "poll", "team", "rank").distinct()


def drives(raw: DataFrame, teams: DataFrame) -> DataFrame:
    """Drives with the keys of both sides, looked up by name; unknown names stay with a null key."""
    out = raw
    for side in ("offense", "defense"):
        known = F.broadcast(teams.select(F.col("name").alias(side), F.col("team").alias(f"{side}_team")))
        out = out.join(known, side, "left")
    return out


def v_game(games: DataFrame, lines: DataFrame, spread_book: str, total_book: str) -> DataFrame:
    """Games with one book's spread and another one's total: a left join for each market."""
    pick = lambda book, c: lines.filter(F.col("book") == book).select("game_id", F.col(c).alias(f"book_{c}"))
    return games.join(pick(spread_book, "spread"), "game_id", "left").join(pick(total_book, "total"), "game_id", "left")


def relationships(tables: dict[str, DataFrame], edges: tuple[tuple[str, str, str, str], ...]) -> DataFrame:
    """Rows, null keys, orphans and childless parents of each edge (child, its key, parent, its key).

    Both sides are reduced to their distinct keys with counts before they meet.
    """
    out = []
    for child, child_key, parent, parent_key in edges:
        c = tables[child].groupBy(F.col(child_key).alias("k")).agg(F.count(F.lit(1)).alias("c"))
        p = tables[parent].filter(F.col(parent_key).isNotNull()).groupBy(F.col(parent_key).alias("pk")).agg(F.count(F.lit(1)).alias("p"))
        both = c.join(p, F.col("k") == F.col("pk"), "full")
        zero = lambda x: F.coalesce(F.sum(x), F.lit(0))
        sums = both.agg(zero("c").alias("n"), zero(F.when(F.col("k").isNull(), F.col("c"))).alias("null_keys"), zero(F.when(F.col("k").isNotNull() & F.col("pk").isNull(), F.col("c"))).alias("orphans"), zero(F.when(F.col("c").isNull(), F.col("p"))).alias("childless"))
        out.append(sums.select(F.lit(child).alias("child"), F.lit(child_key).alias("child_key"), F.lit(parent).alias("parent"), F.lit(parent_key).alias("parent_key"), "*"))
    return reduce(DataFrame.unionByName, out)


def dictionary(tables: dict[str, DataFrame]) -> DataFrame:
    """Every column of the tables with its type, rows and share of nulls."""
    out = []
    for name, df in tables.items():
        counts = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(c).alias(f"c_{c}") for c in df.columns))
        each = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.lit(i).alias("place"), F.col(f"c_{c}").alias("filled")) for i, (c, t) in enumerate(df.dtypes, 1)))
        out.append(counts.select(F.lit(name).alias("table"), "n", F.explode(each).alias("x")).select("table", "n", "x.*"))
    return reduce(DataFrame.unionByName, out)
