"""Benchmark decontamination: size-partitioned MinHash containment search, exactly verified.

Items and documents are sets of 5-word shingles (letters A-Z in lower case; an item of fewer words
is one shingle of all its words).  A document contains an item if at least 80 % of the item's
shingles occur in it.  Shingles that no item has cannot be shared with an item, so a document's domain is its shingles
anywhere in the text that some item has; domains are partitioned by size.  Within a partition the
containment bound becomes a Jaccard bound, and the number of one-row bands is the smallest whose
probability to miss a pair at that bound is under 1e-6, wherever in the text the shared shingles
lie.  Where ``BANDS`` bands do not reach that (a domain of about six times an item's shingles or
more), retrieval is exact instead: an item of n shingles that may lack m of them shares at least one
of its m + 1 rarest ones, which are looked up.  Retrieved pairs are verified by exact containment.

The items are the stated query set: they are taken in blocks of at most ``BLOCK`` shingles, each
block is broadcast and searched over all documents in one pass without a shuffle.

Defined cases: items and documents without words (null or empty) match nothing; repeated rows give
repeated pairs; an empty table on either side gives no pairs; ids may be null; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, stored, table
from .textops import Hasher, distinct, mix, shingles, slices, words

K, CONTAINED = 5, 0.8
#: Shingles of one broadcast block of items: 8 bytes each in three arrays, and 768 bytes of band values an item.
BLOCK = 1_000_000
BANDS = 96
MISS = 1e-6
_SEEDS = np.random.default_rng(11).integers(1, 1 << 63, BANDS, dtype=np.int64).astype(np.uint64)
SCHEMA = "doc_id long, item_id long, n_item_shingles int, n_shared int, containment double"


def _item_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in slices(batch.column("text")):
                w = words(data, off)
                h, doc = shingles(Hasher(data, lower=True)(w.start, w.end), w, k)
                h, first = distinct(h, doc, hi - lo)
                sets = [h[a:b].view(np.int64) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(lo, hi - lo), pa.array(w.counts.astype(np.int64)), pa.array(sets, pa.list_(pa.int64()))], ["item_id", "n_words", "shingles"])

    return run


def minhash(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Band values (one row each) of consecutive non-empty groups of shingles."""
    return np.stack([np.minimum.reduceat(mix(h ^ s), starts) for s in _SEEDS], axis=1)


def bands_for(size: np.ndarray, domain: int, contained: float) -> np.ndarray:
    """One-row bands needed for items of ``size`` in domains of at most ``domain`` shingles."""
    jaccard = np.minimum(contained * size / (size + domain - contained * size), 1)
    return np.ceil(np.log(MISS) / np.log(np.maximum(1 - jaccard, 1e-12))).astype(int)


class _Block:
    """One broadcast block of items: sets, sorted shingles, band values and rarest shingles."""

    def __init__(self, found: pa.Table, k: int, contained: float):
        rows = found.drop_columns("item_id").to_pandas()
        full = rows["shingles"].map(len) > 0
        rows, self.ids = rows[full], found.column("item_id").filter(pa.array(full.to_numpy(bool))).to_pylist()
        self.sets = [np.asarray(x, np.int64).view(np.uint64) for x in rows["shingles"]]
        self.size = np.array([len(x) for x in self.sets])
        self.short = np.minimum(rows["n_words"].to_numpy(np.int64), k)  # words of this item's shingles
        if self.ids:
            flat = np.concatenate(self.sets)
            self.all, seen = np.unique(flat, return_counts=True)
            some = self.size - np.ceil(contained * self.size - 1e-9).astype(int) + 1
            rare = [x[np.argsort(seen[np.searchsorted(self.all, x)], kind="stable")[:n]] for x, n in zip(self.sets, some, strict=True)]
            rare, item = np.concatenate(rare), np.repeat(np.arange(len(some)), some)
            order = np.argsort(rare, kind="stable")
            self.rare, self.rare_item = rare[order], item[order]
            self.bands = minhash(flat, np.concatenate([[0], np.cumsum(self.size)[:-1]]))


def _search(sent, k: int, contained: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: _Block = sent.value
        lookup = [(np.sort(c), np.argsort(c, kind="stable")) for c in block.bands.T]
        for batch in batches:
            for lo, _, data, off in slices(batch.column("text")):
                w = words(data, off)
                word = Hasher(data, lower=True)(w.start, w.end)
                out: list[tuple[int, int, int]] = []
                for s in sorted(set(block.short.tolist())):
                    out += _pairs(block, s, k, contained, lookup, w, word)
                if out:
                    doc, item, shared = (np.array(x) for x in zip(*out, strict=True))
                    ids = batch.column("doc_id").take(pa.array(doc + lo))
                    size = block.size[item]
                    yield pa.RecordBatch.from_arrays([ids, pa.array([block.ids[i] for i in item], pa.int64()), pa.array(size.astype(np.int32)), pa.array(shared.astype(np.int32)), pa.array(shared / size)], ["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"])

    return run


def _pairs(block: _Block, s: int, k: int, contained: float, lookup, w, word) -> list[tuple[int, int, int]]:
    """Verified (document, item, shared shingles) for the items whose shingles have ``s`` words."""
    h, doc = shingles(word, w, s)
    if s < k and len(h):  # such an item's shingle carries its length; a run of s words does too here
        h = _short(word, w, s)
        doc = w.doc[: len(h)] if len(h) else doc
        doc, h = _inside(doc, h, w, s)
    if not len(h):
        return []
    at = np.minimum(np.searchsorted(block.all, h), len(block.all) - 1)
    hit = np.flatnonzero(block.all[at] == h)
    if not len(hit):
        return []
    h, first = distinct(h[hit], doc[hit], len(w.counts))
    mine = block.short == s
    found: set[tuple[int, int]] = set()
    with_hits = np.flatnonzero(np.diff(first))
    domain = np.diff(first)[with_hits]
    values = minhash(h, first[with_hits])
    part = 1 << np.ceil(np.log2(domain)).astype(int)
    for p in np.unique(part):
        rows = np.flatnonzero(part == p)
        need = np.where(mine & (contained * block.size - 1e-9 <= p), bands_for(block.size, int(p), contained), 0)
        if need.max() > BANDS:  # more bands than there are: look up the rarest shingles
            at = np.concatenate([np.arange(first[d], first[d + 1]) for d in with_hits[rows]])
            left, right = np.searchsorted(block.rare, h[at], "left"), np.searchsorted(block.rare, h[at], "right")
            n = right - left
            item = block.rare_item[np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())]
            owner = np.repeat(np.repeat(with_hits[rows], domain[rows]), n)
            found.update(zip(owner[need[item] > BANDS].tolist(), item[need[item] > BANDS].tolist(), strict=True))
        need[need > BANDS] = 0
        for b in range(int(need.max())):
            keys, back = lookup[b]
            left, right = np.searchsorted(keys, values[rows, b], "left"), np.searchsorted(keys, values[rows, b], "right")
            for r in np.flatnonzero(right > left):
                for item in back[left[r] : right[r]]:
                    if need[item] > b:
                        found.add((int(with_hits[rows[r]]), int(item)))
    out = []
    for d, item in sorted(found):
        shared = int(np.isin(block.sets[item], h[first[d] : first[d + 1]], assume_unique=True).sum())
        if shared >= contained * block.size[item] - 1e-9:
            out.append((d, item, shared))
    return out


def _short(word: np.ndarray, w, s: int) -> np.ndarray:
    from .textops import _STEP

    n = len(word)
    if n < s:
        return np.zeros(0, np.uint64)
    total = word[: n - s + 1] * _STEP[0]
    for j in range(1, s):
        total = total + word[j : n - s + 1 + j] * _STEP[j]
    return mix(total + np.uint64(s) * _STEP[63])


def _inside(doc: np.ndarray, h: np.ndarray, w, s: int) -> tuple[np.ndarray, np.ndarray]:
    ok = w.doc[: len(h)] == w.doc[s - 1 : s - 1 + len(h)]
    return doc[ok], h[ok]


def containment_search(docs: DataFrame, items: DataFrame, k: int = K, contained: float = CONTAINED, block: int = BLOCK) -> DataFrame:
    """One row per document (doc_id, text) and item (item_id, text) that it contains."""
    spark, found = docs.sparkSession, []
    for sent, last in _blocks(items, spark, k, contained, block):
        hits = docs.select("doc_id", "text").mapInArrow(_search(sent, k, contained), SCHEMA)
        if not last or found:  # of several blocks only one is held by the executors at a time
            hits = stored(hits)
            sent.unpersist()
        found.append(hits)
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], SCHEMA)


def _blocks(items: DataFrame, spark: SparkSession, k: int, contained: float, block: int) -> Iterator[tuple]:
    """The items in broadcast blocks, made one after the other, and whether a block is the last; items without words are left out."""
    ship(spark)
    sets = items.select("item_id", "text").mapInArrow(_item_sets(k), "item_id long, n_words long, shingles array<long>")
    total = sets.agg(F.sum(F.size("shingles"))).first()[0] or 0
    n_blocks = max(1, -(-int(total) * 5 // (block * 4)))
    for b in range(n_blocks):
        rows = (sets if n_blocks == 1 else sets.filter(F.pmod(F.xxhash64("item_id", "shingles"), F.lit(n_blocks)) == b)).toArrow()
        one = _Block(rows, k, contained)
        if one.ids:
            yield spark.sparkContext.broadcast(one), b == n_blocks - 1


def _clean(sent, k: int, contained: float):
    search = _search(sent, k, contained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column("text")], ["doc_id", "text"])
            keep = np.ones(batch.num_rows, bool)
            for hits in search(iter([places])):
                keep[hits.column("doc_id").to_numpy()] = False
            yield batch.filter(pa.array(keep))

    return run


def keep_clean(docs: DataFrame, items: DataFrame, k: int = K, contained: float = CONTAINED, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns; decided row by row, whatever the ids."""
    for sent, last in _blocks(items, docs.sparkSession, k, contained, block):
        docs = docs.mapInArrow(_clean(sent, k, contained), docs.schema)
        if not last:
            docs = stored(docs)
            sent.unpersist()
    return docs


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
ORACLE = rf"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, {_WORDS} AS ws FROM documents),
items AS (SELECT row_number() OVER () AS i, item_id, {_WORDS} AS ws FROM benchmark),
of_item AS (
  SELECT DISTINCT i, s, array_to_string(ws[a:a + s - 1], ' ') AS shingle
  FROM (SELECT i, ws, s, unnest(range(1, len(ws) - s + 2)) AS a FROM (SELECT *, least(len(ws), {K}) AS s FROM items) WHERE s > 0)),
of_doc AS (
  SELECT DISTINCT d, s, array_to_string(ws[a:a + s - 1], ' ') AS shingle
  FROM (SELECT d, ws, s, unnest(range(1, len(ws) - s + 2)) AS a FROM docs, (SELECT DISTINCT s FROM of_item) WHERE len(ws) >= s)),
sizes AS (SELECT i, count(*) AS n FROM of_item GROUP BY i),
shared AS (SELECT d, i, count(*) AS m FROM of_doc JOIN of_item USING (s, shingle) GROUP BY ALL)
SELECT doc_id, item_id, n::INT AS n_item_shingles, m::INT AS n_shared, m / n AS containment
FROM shared JOIN sizes USING (i) JOIN docs USING (d) JOIN items USING (i)
WHERE 100 * m >= {round(100 * CONTAINED)} * n
"""
