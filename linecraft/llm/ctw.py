"""LM scoring by context-tree weighting over bytes.

The next byte is decomposed into eight binary decisions along its bits, most significant first: 255
nodes.  Each node has a context tree over the preceding bytes (none at a text's start count as byte
0) down to ``DEPTH``.  A context s counts its zeros and ones, estimates them by Krichevsky-Trofimov,
and weights its own estimate against that of its longer contexts,

    P_w(s) = 1/2 KT(s) + 1/2 prod P_w(children),   P_w = KT at the full depth,

so a bit's probability mixes the KT predictions of all depths with the posterior weights that the
training counts give.  A text's score is the sum over its bytes and one end byte (0), its code
length per byte follows.

The model is the table of all (DEPTH + 1)-byte strings of the texts with their training counts, in
which strings of texts outside training count 0.  It grows with the corpus and stays distributed:
strings go to tasks by their nearest ``TOP`` context bytes, and each task weights the subtrees of its
contexts, whole.  Contexts above them are few whatever the corpus (at most 256 ** (TOP - 1) of them
times 255 nodes); their sums reach the driver and go back as a broadcast, with which a second pass
writes each string's log-probability.  Scoring reads the ``HOT_STRINGS`` most frequent strings from
a broadcast of that fixed size and joins all others to the table; words of the base likewise.

Tokens for the base are words in lower case (A-Z) and one end per text, add-half smoothed unigrams
of the same training texts.

Defined cases: null and empty texts are one end token and one end byte; without training texts every
bit has probability 1/2 and every word an equal share; equal rows score alike; ids may be null;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, ship, stored, table
from .textops import Hasher, slices, words

#: Context bytes, and those by which strings are dealt out.
DEPTH, TOP = 5, 3
#: Distinct strings in a task (of the tree), and strings and words whose values are broadcast.
STRINGS_A_TASK, HOT_STRINGS, HOT_WORDS = 400_000, 1 << 21, 1 << 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = np.arange(97, 123)


def strings(data: np.ndarray, off: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Each byte and the end of each text with its ``depth`` bytes before, packed, and its document."""
    n_docs = len(off) - 1
    length = np.diff(off) + 1
    first = np.concatenate([[0], np.cumsum(length + depth)])
    padded = np.zeros(first[-1], np.int64)
    doc = np.repeat(np.arange(n_docs), np.diff(off))
    padded[np.arange(len(data)) + (first[:-1] - off[:-1])[doc] + depth] = _LOWER[data]
    packed = padded[depth:].copy()
    for d in range(1, depth + 1):
        packed |= padded[depth - d : len(padded) - d] << (8 * d)
    owner = np.repeat(np.arange(n_docs), length + depth)
    real = np.ones(len(padded), bool)
    real[(first[:-1, None] + np.arange(depth)).ravel()] = False
    return packed[real[depth:]], owner[depth:][real[depth:]]


def _tally(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            learn = batch.column("learn").to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, data, off in slices(batch.column("text")):
                s, doc = strings(data, off, depth)
                s = np.sort(s << 1 | learn[lo:hi][doc])
                new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                found, size = s[new], np.diff(np.append(new, len(s)))
                both, back = np.unique(np.concatenate([keys, found >> 1]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, size * (found & 1)]), len(both)).astype(np.int64)
                keys = both
                if len(keys) > 2_000_000:
                    yield _columns(s=keys, n=counts)
                    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(keys):
            yield _columns(s=keys, n=counts)

    return run


def _columns(**arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays.values()], list(arrays))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x >= 0.5, by Stirling's series after a shift by 8."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) - shift


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log probability of a sequence with these counts."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - 1.1447298858494002


def _weigh(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior weight of the own estimate, and the weighted log probability."""
    return 1 / (1 + np.exp(np.clip(below - own, -60, 60))), np.logaddexp(own, below) - np.log(2)


def _nodes(keys: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of bit ``k`` over sorted (context, byte) keys: each key's node, the first key, zeros and ones of each node."""
    group = keys >> (8 - k)
    new = np.concatenate([[True], group[1:] != group[:-1]])
    node = np.cumsum(new) - 1
    bit = (keys >> (7 - k)) & 1
    one = np.bincount(node, counts * bit)
    return node, np.flatnonzero(new), np.bincount(node, counts) - one, one


class Top:
    """Weights and predictions of the contexts of fewer than ``TOP`` bytes."""

    def __init__(self, key: np.ndarray, zero: np.ndarray, one: np.ndarray, below: np.ndarray):
        self.levels = []
        for d in range(TOP - 1, -1, -1):
            own, weighted = _weigh(_kt(zero, one), below)
            self.levels.append((key, (one + 0.5) / (zero + one + 1), own))
            if d:
                context = (key >> 8) & ((1 << (8 * (d - 1))) - 1)
                key, back = np.unique(context << 8 | key & 255, return_inverse=True)
                zero, one, below = (np.bincount(back, x, len(key)) for x in (zero, one, weighted))

    def mix(self, p: np.ndarray, packed: np.ndarray, k: int) -> np.ndarray:
        node = (1 << k) | (packed & 255) >> (8 - k)
        for d, (key, kt, own) in zip(range(TOP - 1, -1, -1), self.levels, strict=True):
            at = np.searchsorted(key, ((packed >> 8) & ((1 << (8 * d)) - 1)) << 8 | node)
            p = p + own[at] * (kt[at] - p)
        return p


def _subtrees(depth: int, sent=None):
    """Sums for the contexts above the subtrees of a task, or (with those sent) each string's log2 probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        s, n = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("s", "n"))
        order = np.argsort(s)
        keys, counts, up = [s[order]], [n[order].astype(float)], []
        for d in range(depth - 1, TOP - 1, -1):
            u, back = np.unique(keys[-1] & ((1 << (8 * (d + 1))) - 1), return_inverse=True)
            up.append(back)
            keys.append(u)
            counts.append(np.bincount(back, counts[-1], len(u)))
        total = np.zeros(len(s))
        sums: list[tuple[np.ndarray, ...]] = []
        for k in range(8):
            p = below = None
            at = np.arange(len(s))  # each string's key of this depth
            for level in range(len(keys)):
                node, first, zero, one = _nodes(keys[level], counts[level], k)
                kt, estimate = (one + 0.5) / (zero + one + 1), _kt(zero, one)
                own, weighted = _weigh(estimate, below) if level else (np.ones(len(kt)), estimate)
                if sent is not None:
                    mine = node[at]
                    p = kt[mine] if p is None else p + own[mine] * (kt[mine] - p)
                if level + 1 < len(keys):
                    above = _nodes(keys[level + 1], counts[level + 1], k)[0]
                    below = np.bincount(above[up[level][first]], weighted, above[-1] + 1)
                    at = up[level][at]
            if sent is None:
                context = (keys[-1][first] >> 8) & ((1 << (8 * (TOP - 1))) - 1)
                u, back = np.unique(context << 8 | (1 << k) | (keys[-1][first] & 255) >> (8 - k), return_inverse=True)
                sums.append((u, *(np.bincount(back, x, len(u)) for x in (zero, one, weighted))))
            else:
                p = sent.value.mix(p, keys[0], k)
                total += np.log2(np.where((keys[0] >> (7 - k)) & 1 == 1, p, 1 - p))
        if sent is None:
            yield _columns(**dict(zip(("key", "zero", "one", "below"), (np.concatenate(x) for x in zip(*sums, strict=True)), strict=True)))
        else:
            yield _columns(s=keys[0], n=counts[0].astype(np.int64), l=total)

    return run


def model(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """s, n, l: all strings of ``docs`` (text, learn), training counts and log2 probabilities, stored."""
    spark = docs.sparkSession
    counts = stored(docs.select("text", "learn").mapInArrow(_tally(depth), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")))
    parts = max(spark.sparkContext.defaultParallelism, -(-counts.count() // STRINGS_A_TASK))
    dealt = counts.repartition(parts, F.shiftright("s", 8).bitwiseAND(F.lit((1 << (8 * TOP)) - 1)))
    above = dealt.mapInArrow(_subtrees(depth), "key long, zero double, one double, below double")
    above = above.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("zero", "one", "below"))).toArrow().sort_by("key")
    top = Top(*(above.column(c).to_numpy() for c in ("key", "zero", "one", "below")))
    return stored(dealt.mapInArrow(_subtrees(depth, spark.sparkContext.broadcast(top)), "s long, n long, l double"))


def _most_frequent(rows: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of the highest counts, at most ``most`` of them, without a sort of all."""
    level = F.floor(F.log2(F.col(count) + 1) * 16).alias("level")
    kept, lowest = 0, None
    for found, size in sorted(rows.groupBy(level).count().collect(), reverse=True):
        if kept + size > most:
            break
        kept, lowest = kept + size, found
    return rows.filter(level >= lowest) if lowest is not None else rows.limit(0)


def _word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = words(data, off)
    return Hasher(data, lower=True)(w.start, w.end).view(np.int64), w.first


def _word_tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [np.unique(_word_hashes(data, off)[0], return_counts=True) for _, _, data, off in slices(batch.column("text"))]
        if parts:
            keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["h", "c"])


def _look(keys: np.ndarray, values: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value of each key that is there (0 else), and whether it is."""
    if not len(keys):
        return np.zeros(len(what)), np.zeros(len(what), bool)
    at = np.minimum(np.searchsorted(keys, what), len(keys) - 1)
    there = keys[at] == what
    return np.where(there, values[at], 0.0), there


def _rest(what: np.ndarray, of: np.ndarray, n: int) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(what))


def _score(sent, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, bits, frequent, logs = sent.value
        for batch in batches:
            for lo, hi, data, off in slices(batch.column("text")):
                n = hi - lo
                s, doc = strings(data, off, depth)
                order = np.argsort(s)
                new = np.concatenate([[True], s[order][1:] != s[order][:-1]])
                value, there = _look(hot, bits, s[order][new])
                back = np.empty(len(s), np.int64)
                back[order] = np.cumsum(new) - 1
                value, there = value[back], there[back]
                h, ends = _word_hashes(data, off)
                of = np.repeat(np.arange(n), np.diff(ends))
                log, known = _look(frequent, logs, h)
                ids, held = (batch.column(c).slice(lo, n) for c in ("doc_id", "held_out"))
                yield pa.RecordBatch.from_arrays(
                    [ids, held, pa.array(np.diff(ends).astype(np.int64) + 1), pa.array(np.diff(off).astype(np.int64)), pa.array(np.bincount(doc, value, n).astype(float)), _rest(s[~there], doc[~there], n), pa.array(np.bincount(of, log, n).astype(float)), pa.array(np.bincount(of, known, n).astype(np.int64)), _rest(h[~known], of[~known], n)],
                    ["doc_id", "held_out", "n_tokens", "n_bytes", "bits", "strings", "logs", "n_known", "words"],
                )

    return run


def score(docs: DataFrame, train_docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Base and tree scores of ``docs`` (doc_id, held_out, text) after learning ``train_docs`` (text)."""
    ship(docs.sparkSession)
    empty = F.coalesce("text", F.lit("")).alias("text")
    both = train_docs.select(empty, F.lit(True).alias("learn")).unionByName(docs.select(empty, F.lit(False).alias("learn")))
    return _scored(docs.select("doc_id", "held_out", empty), train_docs.select(empty), both, depth)


def score_by_flag(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Scores of ``docs`` (doc_id, held_out, text) after learning those not held out; one scan fewer."""
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "held_out", F.coalesce("text", F.lit("")).alias("text"))
    return _scored(docs, docs.filter(~F.col("held_out")).select("text"), docs.select("text", (~F.col("held_out")).alias("learn")), depth)


def _scored(docs: DataFrame, train_docs: DataFrame, both: DataFrame, depth: int) -> DataFrame:
    table_ = model(both, depth)
    counts = stored(train_docs.mapInArrow(_word_tally, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
    ends = train_docs.count()
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = n + ends, v + (ends > 0)
    hot = _most_frequent(table_, "n", HOT_STRINGS).select("s", F.col("l").cast("float").alias("l")).toArrow()
    top = _most_frequent(counts, "c", HOT_WORDS).toArrow()
    hot_s, hot_l, word, c = (t.column(x).to_numpy() for t, x in ((hot, "s"), (hot, "l"), (top, "h"), (top, "c")))
    by, by_word = np.argsort(hot_s), np.argsort(word)
    sent = docs.sparkSession.sparkContext.broadcast((hot_s[by], hot_l[by], word[by_word], np.log10(c[by_word] + 0.5)))
    schema = "doc_id long, held_out boolean, n_tokens long, n_bytes long, bits double, strings array<long>, logs double, n_known long, words array<long>"
    rows = stored(docs.mapInArrow(_score(sent, depth), schema).withColumn("row", F.monotonically_increasing_id()))

    def joined(column: str, other: DataFrame, key: str, value: Column, name: str) -> DataFrame:
        each = rows.select(F.col("row").alias(name + "_row"), F.explode(column).alias("what"))
        found = each.join(other.withColumnRenamed(key, "what"), "what").groupBy(name + "_row")
        return found.agg(F.sum(value).alias(name), F.count(F.lit(1)).alias("n_" + name))

    out = rows.drop("strings", "words")
    out = out.join(joined("strings", table_, "s", F.col("l"), "more_bits"), F.col("row") == F.col("more_bits_row"), "left")
    out = out.join(joined("words", counts, "h", F.log10(F.col("c") + 0.5), "more_logs"), F.col("row") == F.col("more_logs_row"), "left")
    n_known = F.col("n_known") + F.coalesce("n_more_logs", F.lit(0))
    unknown = F.col("n_tokens") - 1 - n_known
    sums = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + unknown * F.lit(float(np.log10(0.5))) + F.lit(float(np.log10(ends + 0.5)))
    base = sums - F.col("n_tokens") * F.lit(float(np.log10(n + 0.5 * (v + 1))))
    bits = F.col("bits") + F.coalesce("more_bits", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (n_known + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (bits * F.lit(float(np.log10(2)))).alias("score"),
        (-bits / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id"), 5) == 1)
    return score_by_flag(docs)
