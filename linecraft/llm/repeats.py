"""Suffix-array dedup: removal of bytes that repeated strings of ``LENGTH`` bytes cover.

Every window of ``LENGTH`` bytes has an anchor, the ``GRAM``-byte string of smallest hash inside it,
so equal windows have equal anchors.  Neighbouring windows of one anchor are a segment of a document.
Segments are told apart by anchor and content before any text moves:

1. contents that occur twice or more are repeated whole, which counting decides;
2. of the other anchors' contents, one representative each goes to the shard of its anchor, where
   induced sorting gives a suffix array and permuted common prefixes; a window is repeated when a
   neighbour in suffix order shares ``LENGTH`` bytes with it;
3. anchors with more than ``SHARD_SEGMENTS`` contents would make one shard too large: their
   segments go as parts of ``PART`` windows to shards by (anchor, offset, the bytes that all windows
   of the part have in common), steps 1 and 2 again; of parts whose common bytes still have too many
   contents, each window's own hash is counted.

Nothing is capped: every window is decided by one of the three.  Text is compared as UTF-8 bytes and
matches stay inside documents.

Defined cases: null and empty texts have 0 bytes and keep the hash of the empty string; texts below
``LENGTH`` bytes are never touched; equal rows remove each other's bytes; null and repeated ids stay
rows of their own; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, stored, table
from .suffixarray import common_prefixes, suffix_array
from .textops import Hasher, slices

LENGTH, GRAM = 400, 64
SHARD_SEGMENTS, PART = 2000, 16
#: Bytes of text that one suffix array covers (an anchor's segments stay together), and that a task holds.
ARRAY_BYTES, SHARD_BYTES = 1 << 20, 4 << 20
#: Contents that are told to all tasks when they are so frequent that a join on them would be lopsided.
FREQUENT, MOST_FREQUENT = 2000, 200_000


def segments(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """document, first window, number of windows, anchor hash, anchor position and content hash."""
    none = np.zeros(0, np.int64)
    w = length - gram + 1
    if len(data) < length:
        return none, none, none, none, none, none
    hasher = Hasher(data, lower=False)
    h = hasher.every(gram)
    bits = np.uint64(max(1, int(len(data)).bit_length()))
    packed = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
    rows = -(-len(packed) // w) + 1
    grid = np.full(rows * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    grid[: len(packed)] = packed
    grid = grid.reshape(rows, w)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(grid, axis=1).ravel()
    m = len(data) - length + 1
    anchor = (np.minimum(ahead[:m], behind[w - 1 : w - 1 + m]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    # a run of windows ends where the anchor changes and where no window of its document begins
    begins, ends = off[:-1], np.maximum(off[1:] - length + 1, off[:-1])
    begins, ends = begins[begins < ends], ends[begins < ends]
    if not len(begins):
        return none, none, none, none, none, none
    new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    new[begins] = True
    new[ends[ends < m]] = True
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, m))
    doc = np.searchsorted(begins, first, "right") - 1
    inside = (doc >= 0) & (first < ends[doc])
    start, count, doc = first[inside], count[inside], doc[inside]
    anchor, doc = anchor[start], np.searchsorted(off, start, "right") - 1
    content = hasher(start, start + count - 1 + length)
    return doc, start, count, h[anchor].view(np.int64), anchor, content.view(np.int64)


_SEEN = "rid long, start int, n int, key long, content long"


def _find(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column("rid").to_numpy()
            for lo, _, data, off in slices(batch.column("text")):
                doc, start, n, key, _, content = segments(data, off, length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(rid[lo + doc]), pa.array((start - off[doc]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(key), pa.array(content)], ["rid", "start", "n", "key", "content"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted segments of each document."""
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        held = 0
        for rid, text, wanted in zip(batch.column("rid").to_pylist(), batch.column("text"), batch.column("wanted"), strict=True):
            data = text.cast(pa.large_binary()).as_buffer() if text.is_valid else b""
            for want in wanted.values.to_pylist():
                piece = data[want["start"] : want["start"] + want["n"] - 1 + want["length"]]
                for column, value in zip(out, (rid, want["start"], want["n"], want["key"], want["copies"], bytes(piece)), strict=True):
                    column.append(value)
                held += len(piece)
                if held > 8 << 20:
                    yield _pieces(out)
                    out, held = [[], [], [], [], [], []], 0
        yield _pieces(out)


_PIECE = "rid long, start int, n int, key long, copies long, piece binary"


def _pieces(out: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64()), pa.array(out[5], pa.binary())], ["rid", "start", "n", "key", "copies", "piece"])


def _runs(hit: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last index of the maximal runs of True that do not cross an ``edge`` (first indices)."""
    cut = np.zeros(len(hit), bool)
    cut[edge] = True
    begins = np.flatnonzero(hit & (cut | ~np.concatenate([[False], hit[:-1]])))
    over = ~np.concatenate([hit[1:], [False]]) | np.concatenate([cut[1:], [True]])
    return begins, np.flatnonzero(hit & over) + 1


_SPAN = "rid long, lo int, hi int"


def _spans(rid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["rid", "lo", "hi"])


def shard_repeats(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece, first and past-the-last start of the runs of windows that occur twice in the pieces."""
    size = np.array([len(p) for p in pieces])
    first = np.concatenate([[0], np.cumsum(size + 1)])
    raw = np.frombuffer(b"\0".join([*pieces, b""]), np.uint8)
    symbol = raw.astype(np.int64) + 2
    symbol[first[1:] - 1] = 1
    symbol = np.append(symbol, 0)
    sa = suffix_array(symbol)
    end = np.append(np.repeat(first[:-1] + size, size + 1), len(symbol))
    phi, plcp = common_prefixes(np.append(raw, np.uint8(0)), end, sa)
    hit = plcp >= length
    hit[phi[hit]] = True
    begin, past = _runs(hit, first[:-1])
    of = np.searchsorted(first, begin, "right") - 1
    return of, begin - first[of], past - first[of]


def _sort_shard(length: int):
    """Suffix arrays over the pieces of a partition, which come sorted by key."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        of, begin, past = shard_repeats([r[4] for r in rows], length)
        alone = np.array([r[3] == 1 for r in rows])[of]
        of, begin, past = of[alone], begin[alone], past[alone]
        start = np.array([r[1] for r in rows], np.int64)[of]
        return _spans(np.array([r[0] for r in rows], np.int64)[of], start + begin, start + past - 1 + length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("rid", "start", "key", "copies", "piece")), strict=True):
                if row[2] != last and size > ARRAY_BYTES:
                    yield flush(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
                last = row[2]
        if rows:
            yield flush(rows)

    return run


def _split(length: int, gram: int, part: int):
    """Parts of segments: the key is the offset to the anchor with the bytes that all windows of the part share.

    With ``part`` 1 the common bytes are the window itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("rid", "start", "n", "key", "content", "copies", "piece")
        for batch in batches:
            piece = batch.column("piece")
            off = np.frombuffer(piece.buffers()[1], np.int32)[piece.offset : piece.offset + len(piece) + 1].astype(np.int64)
            if not len(piece) or off[-1] == off[0]:
                continue
            data = np.frombuffer(piece.buffers()[2], np.uint8)[off[0] : off[-1]]
            off = off - off[0]
            hasher = Hasher(data, lower=False)
            n = batch.column("n").to_numpy()
            doc = np.repeat(np.arange(len(n)), n)
            start = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            # the anchor is the same string in every piece of a key: find its place by its hash
            place = np.arange(max(len(data) - gram + 1, 0))
            h = hasher(place, place + gram).view(np.int64)
            owner = np.searchsorted(off, place, "right") - 1
            fits = (place + gram <= off[owner + 1]) & (h == batch.column("key").to_numpy()[owner])
            place, owner = place[fits], owner[fits]
            at = np.full(len(n), 0)
            ok = place - off[owner] >= n[owner] - 1
            leftmost = np.unique(owner[ok], return_index=True)
            at[leftmost[0]] = place[ok][leftmost[1]] - off[leftmost[0]]
            ahead = at[doc] - start  # of the window's start, 0 .. length - gram
            group = ahead // part
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (group[1:] != group[:-1])]))
            count = np.diff(np.append(new, len(doc)))
            doc, start, group = doc[new], start[new], group[new]
            low = off[doc] + at[doc] - group * part
            high = off[doc] + at[doc] - np.minimum(group * part + part - 1, length - gram) + length
            high = np.maximum(np.minimum(high, off[doc + 1]), off[doc])
            low = np.maximum(low, off[doc])
            key = hasher(low, np.maximum(high, low)) ^ (group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            lo, hi = off[doc] + start, off[doc] + start + count - 1 + length
            content = hasher(lo, hi)
            raw = data.tobytes()
            cut = [raw[a:b] for a, b in zip(lo, hi, strict=True)] if part > 1 else [b""] * len(lo)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("rid").to_numpy()[doc]), pa.array((batch.column("start").to_numpy()[doc] + start).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array(batch.column("copies").to_numpy()[doc]), pa.array(cut, pa.binary())], list(names))

    return run


def _whole(seen: DataFrame, counted: DataFrame, length: int) -> DataFrame:
    """Spans of the segments whose content occurs twice or more."""
    twice = counted.filter("copies > 1").select(F.col("key").alias("k"), F.col("content").alias("c"), "copies")
    often = stored(twice.filter(F.col("copies") > FREQUENT))
    same = (F.col("key") == F.col("k")) & (F.col("content") == F.col("c"))
    if often.count() <= MOST_FREQUENT:
        hot = seen.join(F.broadcast(often), same, "left_semi")
        cold = seen.join(F.broadcast(often), same, "left_anti").join(twice.filter(F.col("copies") <= FREQUENT), same, "left_semi")
        found = hot.unionByName(cold)
    else:
        found = seen.join(twice, same, "left_semi")
    return found.select("rid", F.col("start").alias("lo"), (F.col("start") + F.col("n") - 1 + length).cast("int").alias("hi"))


def _shards(pieces: DataFrame, length: int) -> DataFrame:
    """Spans that the suffix arrays of the shards find in stored ``pieces``."""
    total = pieces.agg(F.coalesce(F.sum(F.length("piece")), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // SHARD_BYTES), min(pieces.sparkSession.sparkContext.defaultParallelism, -(-int(total) // ARRAY_BYTES)))
    return pieces.select("rid", "start", "key", "copies", "piece").repartition(n, "key").sortWithinPartitions("key").mapInArrow(_sort_shard(length), _SPAN)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """rid, lo, hi: byte ranges of ``docs`` (rid, text) that repeated strings of ``length`` bytes cover."""
    seen = stored(docs.select("rid", "text").mapInArrow(_find(length, gram), _SEEN))
    counted = stored(seen.groupBy("key", "content").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("rid", "start", "n")).alias("one")))
    kinds = stored(counted.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"))
    wanted = counted.join(kinds, "key").select("one.*", "key", "copies", F.lit(length).alias("length"), "kinds")
    wanted = wanted.groupBy("rid").agg(F.collect_list(F.struct("start", "n", "key", "copies", "length")).alias("wanted"))
    pieces = stored(docs.select("rid", "text").join(wanted, "rid").mapInArrow(_cut, _PIECE))
    big = kinds.filter(F.col("kinds") > SHARD_SEGMENTS).select("key")
    big_count = big.count()
    spans = [_whole(seen, counted, length)]
    if not big_count:
        spans.append(_shards(pieces, length))
    else:
        side = F.broadcast(big) if big_count <= MOST_FREQUENT else big
        spans.append(_shards(pieces.join(side, "key", "left_anti"), length))
        large = pieces.join(side, "key", "left_semi")
        names = "rid long, start int, n int, key long, content long, copies long, piece binary"
        for part in (PART, 1):
            seen = stored(large.mapInArrow(_split(length, gram, part) if part > 1 else _windows(length), names))
            counted = seen.groupBy("key", "content").agg(F.sum("copies").alias("copies"), F.min(F.struct("rid", "start", "n")).alias("one"))
            counted = stored(counted)
            spans.append(_whole(seen.filter("copies = 1"), counted, length))
            if part == 1:
                break
            kinds = stored(counted.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"))
            ones = counted.select("one.rid", "one.start", "one.n", "key", F.col("copies").alias("total"))
            few = kinds.filter(F.col("kinds") <= SHARD_SEGMENTS).select("key")
            many = kinds.filter(F.col("kinds") > SHARD_SEGMENTS).select("key")
            reps = stored(seen.drop("copies", "content").join(ones, ["rid", "start", "n", "key"]).withColumnRenamed("total", "copies"))
            spans.append(_shards(reps.join(few, "key", "left_semi"), length))
            if many.isEmpty():
                break
            large = reps.join(many, "key", "left_semi")
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out


def _windows(length: int):
    """Every window of the pieces by its own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, first, n, copies = (batch.column(c).to_numpy() for c in ("rid", "start", "n", "copies"))
            piece = batch.column("piece")
            if not len(piece):
                continue
            off = np.frombuffer(piece.buffers()[1], np.int32)[piece.offset : piece.offset + len(piece) + 1].astype(np.int64)
            data = np.frombuffer(piece.buffers()[2], np.uint8)[off[0] : off[-1]]
            off = off - off[0]
            doc = np.repeat(np.arange(len(n)), n)
            start = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            lo = off[doc] + start
            h = Hasher(data, lower=False)(lo, lo + length).view(np.int64)
            one = pa.array(np.ones(len(doc), np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(rid[doc]), pa.array((first[doc] + start).astype(np.int32)), one, pa.array(h), pa.array(h), pa.array(copies[doc]), pa.array([b""] * len(doc), pa.binary())], ["rid", "start", "n", "key", "content", "copies", "piece"])

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each document after the removal of its spans."""
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("spans"), strict=True):
            data = bytes(text.cast(pa.large_binary()).as_buffer()) if text.is_valid else b""
            runs: list[list[int]] = []
            if spans.is_valid:
                fields = spans.values
                for lo, hi in sorted(zip(fields.field("lo").to_pylist(), fields.field("hi").to_pylist(), strict=True)):
                    if runs and lo <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], hi)
                    else:
                        runs.append([lo, hi])
            left, at = hashlib.sha256(), 0
            for lo, hi in runs:
                left.update(data[at:lo])
                at = hi
            left.update(data[at:])
            rows.append((doc_id, len(data), sum(hi - lo for lo, hi in runs), len(runs), left.hexdigest(), [{"lo": lo, "hi": hi} for lo, hi in runs]))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.int64()) for c in columns[1:4]), pa.array(columns[4], pa.string()), pa.array(columns[5], pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte ranges of every document."""
    ship(docs.sparkSession)
    held = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("rid", F.monotonically_increasing_id()))
    spans = repeated_spans(held, length, gram).groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<lo:int,hi:int>>"
    return held.join(spans, "rid", "left").select("doc_id", "text", "spans").mapInArrow(_digest, schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents")).drop("removed")
