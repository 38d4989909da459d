"""Line dedup: repeated runs of lines by distributed prefix doubling, later copies deleted.

Each document is a sequence of lines (those without a word stand outside it).  Lines that occur once
in the corpus end a repeated run, so only the others are suffixes of the array:

1. Lines are ranked over all documents: their distinct names are sorted by range and numbered in that
   order, so ranks keep the order of names across partitions.
2. Round k ranks the suffixes by their first 2^(k+1) lines, from the pairs (rank, rank 2^k lines
   further): pairs are counted with map-side combining, those that occur once end there, the others
   are sorted by range and numbered, and each suffix looks its new rank up.  The order of ranks is the
   suffix order to that depth.
3. The suffixes that share their first L lines are an interval of the array whose common prefixes are
   L lines or longer.  It is named by the ranks of the two runs of 2^k <= L lines that cover L lines.
   Within an interval the first suffix in the order (doc_id, text, place) stays and the runs of all
   later ones are deleted; overlapping runs make up the maximal ones.

A run counts if it has ``min_words`` words or more.  Any longer run is a union of shortest ones, which
begin or end at one of its lines and have at most ``min_words`` lines; so doubling stops at that depth
and only the intervals of shortest runs are formed.  Names of lines are 128-bit hashes.

Ranks of frequent runs are broadcast (``FREQUENT`` places or more, so there are few of them), all
others are joined by shuffle: no task receives all places of one line.

Defined cases: null and empty texts have no lines to delete and stay; null ids sort first; rows that
repeat both doc_id and text are one document and share its result; rows that share an id with other
texts are documents of their own; very long texts are rows of lines like all others; ties cannot occur
(places differ); further columns are kept as they are; an empty table gives an empty result.  Only
DataFrame operations are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, free, fresh, size_in_words, stored, table

MIN_WORDS = 10
#: Places from which on a run's rank is broadcast, and how many such ranks are (40 bytes each) at most.
FREQUENT, MOST_FREQUENT = 5000, 200_000
#: Column names of this operator inside a plan; a document table does not use them.
_P = "__line_"


def _hashed(*parts: Column) -> Column:
    """A 128-bit name: two differently seeded 64-bit hashes."""
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(7919), *parts).alias("b"))


def _sequence(text: Column) -> Column:
    """Lines with a word: name, words and place among all lines of the text."""
    pieces = F.split(text, "\n", -1)
    lines = F.transform(pieces, lambda x, i: F.struct(_hashed(x).alias("name"), size_in_words(x).alias("words"), i.alias("at")))
    return F.filter(lines, lambda x: x["words"] > 0)


def _looked_up(rows: DataFrame, names: DataFrame, on: list[str], new: list[str]) -> DataFrame:
    """``rows`` with the columns ``new`` of ``names`` (key ``on``, copies), null where there is none.

    ``rows`` and ``names`` are stored tables.  Frequent names are broadcast if there are at most
    ``MOST_FREQUENT``, the rest is joined by shuffle without the rows that need no look-up.
    """
    often = names.filter(F.col("copies") >= FREQUENT).drop("copies")
    if often.count() > MOST_FREQUENT:
        return rows.join(names.drop("copies"), on, "left")
    seen = rows.join(F.broadcast(often), on, "left")
    missing = F.col(new[0]).isNull() & reduce(Column.__and__, [F.col(c).isNotNull() for c in on])
    rest = seen.filter(missing).drop(*new).join(names.filter(F.col("copies") < FREQUENT).drop("copies"), on, "left")
    return seen.filter(~missing).unionByName(rest.select(*seen.columns))


def _ranked(names: DataFrame, key: list[str], rank: str) -> DataFrame:
    """Stored ``names`` with a number each that keeps the order of ``key`` over all partitions."""
    return stored(names.repartitionByRange(*key).sortWithinPartitions(*key).withColumn(rank, F.monotonically_increasing_id()))


def ranked_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, int]:
    """Lines that occur twice or more (doc_id, key, i, at, words) with their ranks r0, r1, ..., and the last level.

    ``i`` is the place among the lines with a word, r<k> the rank of the 2^k lines from there; it is null
    where those do not occur twice.
    """
    levels = max(min_words, 1).bit_length() - 1
    lines = docs.select("doc_id", F.xxhash64("text").alias("key"), F.posexplode(_sequence(F.col("text"))).alias("i", "line"))
    lines = stored(lines.select("doc_id", "key", "i", "line.at", "line.words", "line.name.a", "line.name.b"))
    names = lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    names = _ranked(names, ["a", "b"], "r0")
    rows = stored(_looked_up(lines, names, ["a", "b"], ["r0"]).filter("r0 IS NOT NULL").drop("a", "b").dropDuplicates(["doc_id", "key", "i"]))
    free(lines, names)
    sequence = Window.partitionBy("doc_id", "key").orderBy("i")
    for k in range(levels):
        ahead = F.max(f"r{k}").over(sequence.rangeBetween(1 << k, 1 << k))
        pairs = stored(rows.withColumn("p", F.when(ahead.isNotNull(), F.col(f"r{k}"))).withColumn("q", F.when(F.col(f"r{k}").isNotNull(), ahead)))
        names = pairs.filter("p IS NOT NULL AND q IS NOT NULL").groupBy("p", "q").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
        names = _ranked(names, ["p", "q"], f"r{k + 1}")
        new = stored(_looked_up(pairs, names, ["p", "q"], [f"r{k + 1}"]).drop("p", "q"))
        free(rows, pairs, names)
        rows = new
    return rows, levels


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, key, i and lines of each shortest run of ``min_words`` words whose lines are all repeated; n, p, q name its interval."""
    rows, levels = ranked_lines(docs, min_words)
    sequence = Window.partitionBy("doc_id", "key").orderBy("i")
    most = max(min_words, 1)
    columns = {"ats": F.collect_list("at").over(sequence.rangeBetween(0, most - 1))}
    runs = []
    for n in range(1, most + 1):
        k = min(n.bit_length() - 1, levels)
        # words of n lines, and of all but the last one
        columns[f"w{n}"] = F.sum("words").over(sequence.rangeBetween(0, n - 1))
        columns[f"q{n}"] = F.max(f"r{k}").over(sequence.rangeBetween(n - (1 << k), n - (1 << k)))
        enough, shorter = F.col(f"w{n}"), (F.col(f"w{n - 1}") if n > 1 else F.lit(0))
        shortest = (enough >= min_words) & ((shorter < min_words) | (enough - F.col("words") < min_words))
        runs.append(F.when(shortest & F.col(f"r{k}").isNotNull() & F.col(f"q{n}").isNotNull(), F.struct(F.lit(n).alias("n"), F.col(f"r{k}").alias("p"), F.col(f"q{n}").alias("q"))))
    wide = rows.select("*", *(c.alias(x) for x, c in columns.items()))
    each = wide.select("doc_id", "key", "i", "ats", F.explode(F.array_compact(F.array(*runs))).alias("run"))
    return each.select("doc_id", "key", "i", F.slice("ats", F.lit(1), F.col("run.n")).alias("lines"), "run.n", "run.p", "run.q")


def deleted_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, key and the places of the lines to delete, one row per document that has any."""
    runs = stored(repeated_runs(docs, min_words))
    place = F.struct("doc_id", "key", "i")
    first = stored(runs.groupBy("n", "p", "q").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("first")).filter("copies > 1"))
    later = _looked_up(runs, first, ["n", "p", "q"], ["first"]).filter(place > F.col("first"))
    return later.groupBy("doc_id", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("gone"))


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with its text rid of later copies of repeated runs, and three further columns.

    n_lines and n_removed count the text's lines; n_spans counts the maximal deleted runs.  A column of
    ``docs`` that has one of these names stays, and the operator's own gets an underscore.
    """
    names = [fresh(c, docs.columns) for c in ("n_lines", "n_removed", "n_spans")]
    gone = deleted_lines(docs, min_words).select(F.col("doc_id").alias(f"{_P}id"), F.col("key").alias(f"{_P}key"), F.col("gone").alias(f"{_P}gone"))
    match = F.col(f"{_P}id").eqNullSafe(F.col("doc_id")) & (F.col(f"{_P}key") == F.xxhash64("text"))
    out = docs.join(gone, match, "left").withColumn(f"{_P}all", F.split("text", "\n", -1))
    cut, pieces = F.col(f"{_P}gone"), F.col(f"{_P}all")
    stay = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), cut)
    text = F.when(cut.isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(pieces, i)), "\n"))
    begins = F.size(F.filter(cut, lambda x, i: (i == 0) | (F.get(cut, i - 1) != x - 1)))
    count = lambda c: F.coalesce(F.when(c.isNotNull(), F.size(c)), F.lit(0)).cast("long")
    counts = (count(pieces), count(cut), F.coalesce(F.when(cut.isNotNull(), begins), F.lit(0)).cast("long"))
    out = out.withColumns({**dict(zip(names, counts, strict=True)), f"{_P}text": text})
    return out.select(*[F.col(f"{_P}text").alias("text") if c == "text" else F.col(c) for c in docs.columns], *names)


def without_repeated_lines(docs: DataFrame, share: int = 20, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` (same columns) without later copies of runs, and without what such copies leave over.

    A document that keeps less than ``share`` percent of its words, all others being copies of runs of
    earlier ones, is a near copy: its remnant goes too, as it would stand for no document of its own.
    """
    before, text = fresh(f"{_P}before", docs.columns), fresh("n_removed", docs.columns)
    counted = docs.withColumn(before, size_in_words(F.col("text")))
    out = drop_repeated_lines(counted, min_words)
    left = F.when(F.col(text) > 0, 100 * size_in_words(F.col("text")) >= share * F.col(before)).otherwise(True)
    out = out.filter(left & ((F.col(text) == 0) | F.col("text").rlike(WORD)))
    chars = {"n_chars": F.when(F.col(text) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {}
    return out.withColumns(chars).select(*docs.columns)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", size_in_words(F.col("text")).alias("n_words_kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = rf"""
WITH docs AS (SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS ls FROM documents),
one AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM docs),
worded AS (
  SELECT doc_id, pos, line, len(regexp_extract_all(line, '{WORD}')) AS w,
         row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i
  FROM one WHERE regexp_matches(line, '{WORD}')),
ends AS (
  SELECT x.doc_id, x.i AS a, y.i AS b, sum(y.w) OVER (PARTITION BY x.doc_id, x.i ORDER BY y.i) AS n, y.w AS last_w, x.w AS first_w
  FROM worded x JOIN worded y ON x.doc_id = y.doc_id AND y.i >= x.i AND y.i < x.i + {MIN_WORDS}),
runs AS (
  SELECT DISTINCT doc_id, a, b FROM ends
  WHERE n >= {MIN_WORDS} AND (n - last_w < {MIN_WORDS} OR n - first_w < {MIN_WORDS})),
texts AS (
  SELECT r.doc_id, r.a, r.b, string_agg(l.line, chr(10) ORDER BY l.i) AS body
  FROM runs r JOIN worded l ON l.doc_id = r.doc_id AND l.i BETWEEN r.a AND r.b GROUP BY ALL),
later AS (SELECT doc_id, a, b, row_number() OVER (PARTITION BY body ORDER BY doc_id, a) AS place FROM texts),
gone AS (
  SELECT DISTINCT l.doc_id, l.pos FROM later r JOIN worded l ON l.doc_id = r.doc_id AND l.i BETWEEN r.a AND r.b WHERE r.place > 1),
kept AS (
  SELECT o.doc_id, count(g.pos) AS n_removed, count(*) AS n_lines,
         coalesce(string_agg(o.line, chr(10) ORDER BY o.pos) FILTER (WHERE g.pos IS NULL), '') AS body
  FROM one o LEFT JOIN gone g ON g.doc_id = o.doc_id AND g.pos = o.pos GROUP BY o.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       len(regexp_extract_all(coalesce(body, ''), '{WORD}')) AS n_words_kept, sha256(coalesce(body, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)
"""
