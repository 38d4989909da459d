"""Exact Jaccard join of documents as word-shingle sets, in the Jaccard metric space.

With the distance d = 1 - |x & y| / |x | y|, two documents link if d <= r (r = 0.1).

1. Equal sets are one point, known by a 64-bit name of the set (equal sets are told apart from others
   by 128 bits).  A document that links with another has at most 10 % of its shingles to itself;
   those with more are left out (see ``_candidates``).
2. First level: the pivots are the one-shingle sets.  A document is at distance 1 - 1/|x| from each
   of its own shingles and at 1 from all others, so it is nearest to its own; the tie goes to the
   first in one global order, rarest first.  A document that links with x keeps 90 % of x, hence the
   first shingle that both have is among the first |x| - ceil(0.9 |x|) + 1 of x: x is replicated to
   these cells and meets there every document that it can link with.  A cell is cut by size, as
   linked sets differ in size by 10 % at most.  Cells of one document end here.
3. Documents that are joined by cells form regions; no link leaves a region.  Inside a region,
   documents are the pivots: each document belongs to the Voronoi cell of its nearest pivot p and is
   replicated to that of q if d(x, q) <= d(x, p) + 2r, the bound that the triangle inequality gives
   for a linked document of q's cell.  In the cell of q, documents linked with q form one group, and
   those of them nearer to q than any other document's distance minus r can have no further link:
   they leave.  Cells are joined recursively.
4. A region beyond ``LIMIT`` shingles is mostly a chain of strangers that have a shingle in common.
   It is dealt anew by whole parts first (``_parted``): two linked sets differ in fewer shingles than
   hash space has parts, so one part of both is the same.  What is still beyond the limit is cut in
   Spark rounds (``_cut``): distances to the pivots chunk by chunk, cells as the regions of the next
   round.  Regions within the limit are finished in one task each.  Cells that keep nearly all of their
   region (no pivot tells its documents apart) are compared as one, chunk against chunk, in many tasks,
   without what is linked already.

Only links that join two groups are kept, so the result is a spanning set of each component.

Defined cases: null or empty texts and texts without words have an empty set and link with nothing;
a text of one or two words has its whole sequence as one shingle; equal rows are one point; rows that
share an id are one document for the component, whatever their texts, and keep their own sizes; a null
id gets a null component and links nothing; very long texts enter whole; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, free, ship, stored, table
from .components import components
from .textops import Hasher, distinct, mix, release, shingles, slices, words

K, PERCENT = 3, 90
#: Cells of the sketch that orders shingles by frequency, and how they are split for its sum.
SKETCH, PART = 1 << 21, 1 << 16
#: Shingles of a region that one task joins (8 bytes each).
LIMIT = 1_500_000
#: A cell with more than this share of its region is not cut any further.
STUCK = 0.8
#: Shingles that one task counts, and the share (one in PART_OF) of hash space of the first count.
BUCKET, PART_OF = 3_000_000, 4
#: Shingles of sets that a task works on at once.
HELD = 1 << 18
LEAF, PIVOTS = 24, 8
#: Rows up to which a list of documents is broadcast (16 bytes each); beyond, the join is shuffled.
BROADCAST_ROWS = 1_000_000


def _sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    w = words(data, off)
    h, doc = shingles(Hasher(data, lower=True)(w.start, w.end), w, k)
    return distinct(h, doc, len(off) - 1)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SKETCH, np.int64)
    for batch in batches:
        for h in _flat(batch.column("set"), HELD):
            total += np.bincount((h & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
    parts = np.minimum(total, 65535).astype("<u2").reshape(-1, PART)
    yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "counts"])


def _flat(column: pa.Array, most: int) -> Iterator[np.ndarray]:
    """The hashes of a column of sets, about ``most`` at a time."""
    held, n = [], 0
    for x in column:
        held.append(np.frombuffer(x.as_buffer(), np.uint64))
        n += len(held[-1])
        if n >= most:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, raw in zip(batch.column("part").to_pylist(), batch.column("counts"), strict=True):
            total.setdefault(part, np.zeros(PART, np.int64))
            total[part] += np.frombuffer(raw.as_buffer(), "<u2")
    for part, counts in total.items():
        level = np.minimum(np.log2(counts + 1.0) * 4, 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["part", "counts"])


def frequency_levels(sets: DataFrame) -> np.ndarray:
    """A quarter-octave level of frequency for each sketch cell, over all sets.

    It only fixes the order of the shingles: any order gives the same links, a good one small cells.
    """
    schema = "part int, counts binary"
    rows = sets.select("set").mapInArrow(_sketch, schema).repartition(SKETCH // PART, "part").mapInArrow(_add, schema).collect()
    out = np.zeros((SKETCH // PART, PART), np.uint8)
    for part, level in rows:
        out[part] = np.frombuffer(bytes(level), np.uint8)
    return out.ravel()


def _names(h: np.ndarray, first: np.ndarray, seeds: tuple[int, ...] = (1, 2)) -> list[np.ndarray]:
    """64-bit names of consecutive sets, one for each seed."""
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(c)))]) for c in seeds]
    return [(x[first[1:]] - x[first[:-1]]).view(np.int64) for x in sums]


def _points(k: int):
    """Size and 128-bit name of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in slices(batch.column("text")):
                h, first = _sets(data, off, k)
                a, b = _names(h, first)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(first).astype(np.int64)), pa.array(a), pa.array(b)], ["doc_id", "n_shingles", "a", "b"])

    return run


#: Stands for two or more documents of one slice that have a shingle.
SEVERAL = np.iinfo(np.int64).min


def _pack(ids: np.ndarray, h: np.ndarray, first: np.ndarray, buckets: int, part: int) -> Iterator[tuple]:
    """(bucket, ids, sizes, 32-bit hashes) of the shingles of one of ``part`` parts of hash space.

    Each shingle is sent once a slice, by its document, or by ``SEVERAL`` where more have it: a shingle
    of a third of all documents weighs as much as there are slices.
    """
    mine = (h % np.uint64(part)) == 0
    own, h = np.repeat(ids, np.diff(first))[mine], h[mine]
    order = np.lexsort((own, h))
    own, h = own[order], h[order]
    begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    last = np.append(begin[1:], len(h)) - 1
    own, h = np.where(own[begin] == own[last], own[begin], SEVERAL), h[begin]
    bucket = ((h // np.uint64(part)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((own, bucket))
    h, own, bucket = (h[order] >> np.uint64(32)).astype("<u4"), own[order], bucket[order]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (bucket[1:] != bucket[:-1])])) if len(h) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(new, len(h))).astype("<u4")
    ends = np.searchsorted(bucket[new], np.arange(buckets + 1))
    cuts = np.append(new, len(h))
    for b in np.flatnonzero(np.diff(ends)):
        lo, hi = ends[b], ends[b + 1]
        yield int(b), own[new[lo:hi]].astype("<i8").tobytes(), sizes[lo:hi].tobytes(), h[cuts[lo] : cuts[hi]].tobytes()


PACKED = "bucket int, ids binary, sizes binary, hashes binary"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(4)], ["bucket", "ids", "sizes", "hashes"])


def _pack_texts(k: int, buckets: int, part: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in slices(batch.column("text")):
                h, first = _sets(data, off, k)
                yield _packed(list(_pack(_names(h, first, (1,))[0], h, first, buckets, part)))

    return run


def _pack_sets(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets = batch.column("doc_id").to_numpy(zero_copy_only=False), _unpack(x.as_buffer() for x in batch.column("set"))
            ends, lo = np.cumsum([len(s) for s in sets]), 0
            while lo < len(sets):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + HELD, "right")))
                some = sets[lo:hi]
                yield _packed(list(_pack(ids[lo:hi], np.concatenate(some), np.concatenate([[0], np.cumsum([len(s) for s in some])]), buckets, 1)))
                lo = hi

    return run


def _lonely(pdf: pd.DataFrame) -> pd.DataFrame:
    """How many of a document's shingles in this bucket no other document has."""
    release()
    ids = np.concatenate([np.frombuffer(x, "<i8") for x in pdf["ids"]])
    sizes = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["sizes"]])
    h = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["hashes"]])
    ids = np.repeat(ids, sizes)
    order = np.lexsort((ids, h))
    ids, h = ids[order], h[order]
    begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    last = np.append(begin[1:], len(h)) - 1
    alone = begin[(ids[begin] == ids[last]) & (ids[begin] != SEVERAL)]
    found, lonely = np.unique(ids[alone], return_counts=True)
    return pd.DataFrame({"doc_id": found, "lonely": lonely})


def _lonely_counts(packed: DataFrame) -> DataFrame:
    counts = packed.groupBy("bucket").applyInPandas(_lonely, "doc_id long, lonely long")
    return counts.groupBy("doc_id").agg(F.sum("lonely").alias("lonely"))


def _cells(sent, percent: int):
    """The first-level cells of each set: first shingles in the order, each with two size bands.

    Linked sets differ in size by the factor ``percent`` / 100 at most, so they share a band.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = sent.value
        for batch in batches:
            out = []
            for h in _unpack(x.as_buffer() for x in batch.column("set")):
                n = len(h)
                reach = n - -(-percent * n // 100) + 1
                first = h[np.lexsort((h, level[(h & np.uint64(SKETCH - 1)).astype(np.int64)]))[:reach]]
                band = int(np.log(n) / -np.log(percent / 100) + 1e-9) if percent < 100 else n
                out.append(np.concatenate([mix(first + np.uint64(band)), mix(first + np.uint64(band + 1))]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "cells"])

    return run


def _parts(percent: int):
    """The cells of the sets of one region that agree in a whole part of hash space, with two size bands.

    Of x + y shingles of two linked sets at most (100 - percent) / (100 + percent) are in one of them only.
    With more parts than that, one holds the same shingles of both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for region, h in zip(batch.column("region").to_numpy().view(np.uint64), _unpack(x.as_buffer() for x in batch.column("set")), strict=True):
                band = int(np.log(len(h)) / -np.log(percent / 100) + 1e-9) if percent < 100 else len(h)
                cells = []
                for b in (band, band + 1):
                    most = int((100 / percent) ** (b + 1)) + 1 if percent < 100 else b  # no set of the band is larger
                    n = 2 * most * (100 - percent) // (100 + percent) + 1
                    part = (mix(h + np.uint64(3)) % np.uint64(n)).astype(np.int64)
                    sums = np.zeros(n, np.uint64)
                    np.add.at(sums, part, mix(h + np.uint64(4)))
                    cells.append(mix(sums + mix(mix(np.arange(n, dtype=np.uint64) + (np.uint64(b) << np.uint64(32))) + region)))
                out.append(np.concatenate(cells).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "cells"])

    return run


def _joined(posts: DataFrame) -> DataFrame:
    """id, region of the documents that cells of ``posts`` (doc_id, cell) join."""
    cells = posts.groupBy("cell").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("last")).filter("centre < last")
    stars = posts.join(cells, "cell").filter("doc_id != centre").select(F.col("doc_id").alias("a"), F.col("centre").alias("b")).distinct()
    return components(stars).select(F.col("node").alias("id"), F.col("root").alias("region"))


def _parted(members: DataFrame, percent: int) -> DataFrame:
    """doc_id, region, set of ``members`` (doc_id, region, set) that share a whole part with another one of their region."""
    posts = stored(members.select("doc_id", "region", "set").mapInArrow(_parts(percent), "doc_id long, cells array<long>").select("doc_id", F.explode("cells").alias("cell")))
    regions = _joined(posts)
    out = stored(members.select("doc_id", "set").join(regions, F.col("doc_id") == F.col("id")).select("doc_id", "region", "set"))
    free(posts)
    return out


def _weights(sets: DataFrame, limit: int) -> DataFrame:
    """Regions beyond ``limit`` shingles, with these."""
    return stored(sets.groupBy("region").agg(F.sum(F.octet_length("set") / 8).cast("long").alias("weight")).filter(F.col("weight") > limit))


def _with_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in slices(batch.column("text")):
                h, first = _sets(data, off, k)
                raw = [h[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(_names(h, first, (1,))[0]), pa.array(raw, pa.binary())], ["doc_id", "set"])

    return run


class Groups:
    """Union-find over positions, with the links that joined two groups."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((x, y))


def shared(sets: list[np.ndarray], pivot: np.ndarray) -> np.ndarray:
    """Sizes of the intersections with ``pivot`` (all sets are sorted and not empty)."""
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
    return np.add.reduceat((pivot[at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]))


class Region:
    """The recursive join of the documents of one region."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT, leaf: int = LEAF):
        self.sets, self.percent, self.leaf = sets, percent, leaf
        self.size = np.array([len(s) for s in sets])
        self.groups = Groups(len(sets))

    def compare(self, idx: np.ndarray, p: int) -> np.ndarray:
        """Distances of ``idx`` to document ``p``; links are recorded."""
        common = shared([self.sets[i] for i in idx], self.sets[p])
        union = self.size[idx] + self.size[p] - common
        for i in idx[100 * common >= self.percent * union]:
            self.groups.join(int(i), p)
        return 1 - common / union

    def pairs(self, idx: np.ndarray) -> None:
        """All comparisons that can still join two groups, one document against the later ones."""
        for k, p in enumerate(idx):
            mine = self.groups.find(int(p))
            rest = [i for i in idx[k + 1 :] if self.groups.find(int(i)) != mine]
            rest = np.array([i for i in rest if 100 * min(self.size[i], self.size[p]) >= self.percent * max(self.size[i], self.size[p])], np.int64)
            if len(rest):
                self.compare(rest, int(p))

    def join(self, idx: np.ndarray | None = None) -> None:
        idx = np.arange(len(self.sets)) if idx is None else idx
        todo = [idx]
        reach = 2 * (100 - self.percent) / 100 + 1e-9
        while todo:
            idx = todo.pop()
            if len({self.groups.find(int(i)) for i in idx}) <= 1:
                continue
            if len(idx) <= self.leaf:
                self.pairs(idx)
                continue
            far = np.full(len(idx), np.inf)
            rows = []
            for _ in range(PIVOTS):  # each next pivot is the document farthest from those before
                p = int(np.argmax(far))
                rows.append(self.compare(idx, int(idx[p])))
                far = np.minimum(far, rows[-1])
                if far.max() <= 0:
                    break
            d = np.array(rows)
            cells = [idx[row <= far + reach] for row in d]
            if max(len(c) for c in cells) > 0.8 * len(idx):
                self.thin(idx, d)
            else:
                todo += [c for c in cells if len(c) > 1]

    def thin(self, idx: np.ndarray, d: np.ndarray) -> None:
        """Where the windows hold nearly all: the largest group is settled, the others are compared.

        A document outside it meets only documents whose distance to each pivot differs by r at most.
        """
        roots = np.array([self.groups.find(int(i)) for i in idx])
        names, counts = np.unique(roots, return_counts=True)
        r = (100 - self.percent) / 100 + 1e-9
        for k in np.flatnonzero(roots != names[counts.argmax()]):
            p = int(idx[k])
            near = (np.abs(d - d[:, k : k + 1]) <= r).all(0)
            near &= 100 * np.minimum(self.size[idx], self.size[p]) >= self.percent * np.maximum(self.size[idx], self.size[p])
            mine = self.groups.find(p)
            rest = np.array([i for i in idx[near] if self.groups.find(int(i)) != mine], np.int64)
            if len(rest):
                self.compare(rest, p)


LINKS = "a long, b long"


def _unpack(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column]


def _join_bucket(percent: int):
    """All regions of one bucket."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        release()
        pdf = pdf.drop_duplicates(["region", "doc_id"]).sort_values(["region", "doc_id"], kind="stable")
        ids, region, sets = pdf["doc_id"].to_numpy(), pdf["region"].to_numpy(), _unpack(pdf["set"])
        starts = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]]))
        out = []
        for a, b in zip(starts, np.append(starts[1:], len(ids)), strict=True):
            one = Region(sets[a:b], percent)
            one.join()
            out += [(ids[a + x], ids[a + y]) for x, y in one.groups.links]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


_NEAR = "doc_id long, region long, p long, d double, linked boolean, inside boolean"


def _against_pivots(percent: int):
    """One chunk of a large region against its pivots: the cells that each document enters, and its links."""
    reach = 2 * (100 - percent) / 100 + 1e-9

    def run(pdf: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in _NEAR.split(", ")]
        if not len(pdf) or not len(pivots):
            return pd.DataFrame({n: [] for n in names}).astype({"doc_id": "int64", "region": "int64", "p": "int64", "linked": "bool", "inside": "bool"})
        sets = _unpack(pdf["set"])
        size = np.array([len(x) for x in sets])
        wide, linked = [], []
        for x in _unpack(pivots["pset"]):
            common = shared(sets, x)
            union = size + len(x) - common
            wide.append(1 - common / union)
            linked.append(100 * common >= percent * union)
        wide, linked = np.array(wide), np.array(linked)
        inside = wide <= wide.min(0) + reach
        p, x = np.nonzero(inside | linked)
        ids = pdf["doc_id"].to_numpy()
        return pd.DataFrame({"doc_id": ids[x], "region": pdf["region"].iloc[0], "p": pivots["p"].to_numpy()[p], "d": wide[p, x], "linked": linked[p, x], "inside": inside[p, x]})[names]

    return run


def _chunk_pairs(percent: int):
    """Unsettled documents of one chunk against a chunk of the region."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = pd.concat([left.assign(new=True), right.assign(new=False)]).drop_duplicates("doc_id")
        if not len(left) or not len(rows):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        rows = rows.sort_values(["new", "doc_id"], ascending=[False, True], kind="stable")
        ids, one = rows["doc_id"].to_numpy(), Region(_unpack(rows["set"]), percent)
        for k in range(int(rows["new"].sum())):
            rest = np.arange(k + 1, len(ids))
            rest = rest[100 * np.minimum(one.size[rest], one.size[k]) >= percent * np.maximum(one.size[rest], one.size[k])]
            if len(rest):
                one.compare(rest, k)
        return pd.DataFrame([(ids[x], ids[y]) for x, y in one.groups.links], columns=["a", "b"]).astype("int64")

    return run


def _cut(members: DataFrame, percent: int, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round over the regions of ``members`` (doc_id, region, set, weight), all beyond ``limit`` shingles.

    Links with the pivots, the cells (as members of the next round), and the members of cells that
    hold more than ``STUCK`` of their region: those of one region once, settled if each of its cells' pivots is
    linked with them.
    """
    chunks = F.ceil(F.col("weight") / limit).cast("int")
    members = stored(members.withColumn("n", chunks).withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("n")).cast("int")))
    row = F.struct(F.col("doc_id").alias("p"), F.col("set").alias("pset"))
    draws = [F.min_by(row, F.xxhash64("doc_id", F.lit(j))).alias(f"p{j}") for j in range(PIVOTS)]
    pivots = members.groupBy("region", "n").agg(*draws).select("region", "n", F.explode(F.array_distinct(F.array(*[f"p{j}" for j in range(PIVOTS)]))).alias("x"))
    pivots = pivots.select("region", "x.p", "x.pset", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk"))
    near = stored(members.groupBy("region", "chunk").cogroup(pivots.groupBy("region", "chunk")).applyInPandas(_against_pivots(percent), _NEAR))
    links = near.filter("linked AND doc_id != p").select(F.col("doc_id").alias("a"), F.col("p").alias("b"))
    # what is linked with the pivot and deeper inside than any other document reaches has no further link
    edge = near.filter("inside").groupBy("region", "p").agg(F.min(F.when(~F.col("linked"), F.col("d"))).alias("first_out"))
    r = (100 - percent) / 100 + 1e-9
    kept = near.filter("inside").join(edge.filter("first_out IS NOT NULL"), ["region", "p"]).filter(~F.col("linked") | (F.col("d") >= F.col("first_out") - r))
    cells = kept.join(members.select("doc_id", "region", "set", "weight"), ["doc_id", "region"])
    cells = stored(cells.select("doc_id", F.col("region").alias("of"), F.xxhash64("region", "p").alias("region"), "set", F.col("weight").alias("was"), "linked"))
    sizes = stored(cells.groupBy("region").agg(F.sum(F.octet_length("set") / 8).cast("long").alias("weight"), F.max("was").alias("before")))
    cells = cells.join(sizes, "region")
    stuck = (F.col("weight") > limit) & (F.col("weight") > STUCK * F.col("before"))
    whole = cells.filter(stuck).groupBy(F.col("of").alias("region"), "doc_id").agg(F.any_value("set").alias("set"), F.any_value("was").alias("weight"), F.min("linked").alias("settled"))
    return links, cells.filter(~stuck).select("doc_id", "region", "set", "weight"), whole


def _compared(members: DataFrame, percent: int, limit: int) -> DataFrame:
    """Links of documents that are not settled with all of their region, chunk against chunk."""
    chunks = F.ceil(F.col("weight") / limit).cast("int")
    named = stored(members.withColumn("n", chunks).withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("n")).cast("int")))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    left = named.filter(~F.col("settled")).select("region", "doc_id", "set", F.col("chunk").alias("l"), other.alias("r"))
    used = left.select("region", "l").distinct()
    right = named.join(used, "region").select("region", "doc_id", "set", "l", F.col("chunk").alias("r"))
    left, right = left.toDF("region", "doc_id", "set", "l", "r"), right.toDF("region", "doc_id", "set", "l", "r")
    return left.groupBy("region", "l", "r").cogroup(right.groupBy("region", "l", "r")).applyInPandas(_chunk_pairs(percent), LINKS)


def _large(members: DataFrame, percent: int, limit: int) -> DataFrame:
    """Links of regions beyond ``limit`` shingles: cells in rounds until each fits one task or is compared."""
    links, found = [], True
    while found:
        more, cells, stuck = _cut(members, percent, limit)
        links += [more, _compared(stuck, percent, limit), _regions(cells.filter(F.col("weight") <= limit), percent, limit)]
        members = stored(cells.filter(F.col("weight") > limit))
        found = not members.isEmpty()
    return reduce(DataFrame.unionByName, links)


def _regions(members: DataFrame, percent: int, limit: int) -> DataFrame:
    """Links of regions that fit one task each; tasks take several of them."""
    total = members.agg(F.coalesce(F.sum(F.octet_length("set") / 8), F.lit(0))).first()[0]
    buckets = max(1, -(-2 * int(total) // limit), members.sparkSession.sparkContext.defaultParallelism)
    return members.groupBy(F.pmod(F.xxhash64("region"), F.lit(buckets)).alias("bucket")).applyInPandas(_join_bucket(percent), LINKS)


def _candidates(docs: DataFrame, points: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id and set of the documents that may link with another one, one for each distinct set.

    A document that links keeps ``percent`` of its shingles in the other, so it has at most the rest
    to itself.  The count goes over a part of hash space for all documents first (what is alone there
    is alone), then over all shingles of those that are left: shared with a document that cannot link
    counts as alone.
    """
    bound = F.col("n") - F.ceil(F.col("n") * percent / 100)
    sizes = classes.select(F.col("a").alias("id"), "rep", F.col("n_shingles").alias("n"))
    # copies are counted under the name of their set, so none has to be looked for and no text is shuffled
    total = int(points.filter("doc_id IS NOT NULL").agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0])
    buckets = max(8, -(-total // (PART_OF * BUCKET)))
    counts = _lonely_counts(docs.filter("doc_id IS NOT NULL").mapInArrow(_pack_texts(k, buckets, PART_OF), PACKED))
    first = stored(sizes.join(counts, F.col("id") == F.col("doc_id"), "left").filter(F.coalesce("lonely", F.lit(0)) <= bound).select("id", "rep", "n"))
    n, total = first.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    reps = first.select("rep").distinct()
    some = docs.join(F.broadcast(reps) if n <= BROADCAST_ROWS else reps, F.col("doc_id") == F.col("rep"), "left_semi")
    sets = some.mapInArrow(_with_sets(k), "doc_id long, set binary").filter(F.octet_length("set") > 0).dropDuplicates(["doc_id"])
    sets = stored(sets.join(F.broadcast(first) if n <= BROADCAST_ROWS else first, F.col("doc_id") == F.col("id"), "left_semi"))
    counts = _lonely_counts(sets.mapInArrow(_pack_sets(max(8, -(-int(total) // BUCKET))), PACKED))
    second = first.join(counts, F.col("id") == F.col("doc_id"), "left").filter(F.coalesce("lonely", F.lit(0)) <= bound).select("id")
    out = stored(sets.join(second, F.col("doc_id") == F.col("id"), "left_semi"))
    free(first, sets)
    return out


def jaccard_components(docs: DataFrame, k: int = K, percent: int = PERCENT, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text")
    points = stored(docs.mapInArrow(_points(k), "doc_id long, n_shingles long, a long, b long"))
    known = points.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = stored(known.groupBy("a", "b", "n_shingles").agg(F.min("doc_id").alias("rep")))
    unfiltered = _candidates(docs, points, classes, k, percent)
    order = spark.sparkContext.broadcast(frequency_levels(unfiltered))
    posts = stored(unfiltered.mapInArrow(_cells(order, percent), "doc_id long, cells array<long>").select("doc_id", F.explode("cells").alias("cell")))
    regions = _joined(posts)
    sets = stored(unfiltered.join(regions, F.col("doc_id") == F.col("id")).select("doc_id", "region", "set"))
    free(posts, unfiltered)
    order.unpersist()
    weights = _weights(sets, limit)
    if weights.isEmpty():
        links = _regions(sets, percent, limit)
    else:
        links = _regions(sets.join(weights, "region", "left_anti"), percent, limit)
        parted = _parted(sets.join(weights, "region"), percent)
        weights = _weights(parted, limit)
        links = links.unionByName(_regions(parted.join(weights, "region", "left_anti"), percent, limit))
        if not weights.isEmpty():
            links = links.unionByName(_large(parted.join(weights, "region"), percent, limit))
    links = stored(links)
    # from names of sets to documents; a document with several texts joins their components
    one = classes.select(F.col("a").alias("name"), "rep")
    ends = links.join(one, F.col("a") == F.col("name")).select("b", F.col("rep").alias("x"))
    ends = ends.join(one, F.col("b") == F.col("name")).select(F.col("x").alias("a"), F.col("rep").alias("b"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in ("a", "b", "n_shingles")]
    rows = stored(points.join(classes.toDF("a_", "b_", "n_shingles_", "rep"), reduce(Column.__and__, same), "left").select("doc_id", "n_shingles", "rep"))
    several = rows.filter("doc_id IS NOT NULL AND rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high").select("doc_id")
    more = rows.join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    roots = components(ends.unionByName(more.filter("b IS NOT NULL")))
    free(points, sets)
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep")))
    return rows.join(roots, F.col("rep") == F.col("node"), "left").select("doc_id", "n_shingles", own.alias("component_id"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {K} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {K} + 2), lambda i: array_to_string(ws[i:i + {K} - 1], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS seen FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.low, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(seen) AS low FROM r GROUP BY doc_id) c USING (doc_id)
"""
