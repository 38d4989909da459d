"""Alignment of two tokenisers' outputs, segment by segment.

A text is split before its runs of white space, but only where neither vocabulary has a token that reaches
across such a border (``Splitter`` reads that off the vocabularies), so that tokens of a segment do not
depend on its neighbours.  Segments repeat a lot.  The steps, each a Spark job:

1. chunks of documents: each chunk's distinct segments and, for each document, their numbers in order;
2. equal segments of all chunks meet; each is tokenised and aligned once, and keeps the places it came from;
3. counts of linked id pairs, from the segments and their occurrences;
4. alignments go back to their places, and each chunk's documents are composed from them.

Byte offsets at which tokens of both sides end cut the tokens into groups; the tokens of the two sides that
end there are linked.  A segment's end is such an offset.

Bounds: a chunk holds ``CHUNK`` bytes of text or one document.  A frequent segment has one place a chunk;
places meet by segment and by ranges of ``RANGE`` input partitions, so that no segment, however frequent,
has more than a range's chunks to one task (it is then tokenised once a range).  The counts of id pairs are
broadcast: tokens that end together are suffixes of one another, so their number is at most the number of
such pairs in the two vocabularies (some hundred thousand), whatever the corpus.

Defined cases: texts that are null or empty, and texts that a tokeniser does not give back byte by byte
(U+2581, which the piece model writes for spaces), have no tokens and count nowhere; texts of any length are
taken whole; rows are kept apart by their place, so null and shared ids do no harm; further columns are
left out, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _byte_letters, gather, row_slices
from .common import free, ship, stored, table
from .textops import release

#: Bytes of text of a chunk of documents (a longer document is a chunk of its own).
CHUNK = 6 << 20
#: Input partitions whose equal segments meet in one task.
RANGE = 1 << 12
#: Texts that are tokenised and aligned at a time.
BATCH = 50_000
#: Of op12: byte-level side and piece side.
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: ASCII white space.
WHITE = b" \t\n\x0b\x0c\r"
#: White space by its bytes: one byte, and the wider characters.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_WIDE = [c.encode() for c in map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))]
#: A pair of ids as one number.
_PAIR = 1 << 24
#: A chunk's number and a segment's number in it as one: 23 bits for the partition, 12 for the chunk, 28 for the segment.
_CHUNKS, _PLACE = 1 << 12, 1 << 28


class Tokenisers:
    """Both tokenisers with their tokens' bytes.  A encodes space + text, B the text, before which it puts a space itself."""

    def __init__(self, raw_a: bytes, raw_b: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b, spec = Tokenizer.from_buffer(raw_a), SentencePieceProcessor(model_proto=raw_b), json.loads(raw_a)
        self.a.encode_special_tokens = True
        first = spec.get("pre_tokenizer") or {}
        if first.get("type") != "ByteLevel" or first.get("add_prefix_space") or not first.get("use_regex") or spec.get("normalizer"):
            raise ValueError("side A must be a plain byte-level vocabulary")
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        a_bytes = [b""] * (max(vocab.values()) + 1)
        for name, i in vocab.items():
            a_bytes[i] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
        b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.bytes = [pa.array(x, pa.large_binary()) for x in (a_bytes, b_bytes)]
        self.space = self.b.piece_to_id("▁")
        self.ends = [[s + e for s in map(str, range(len(x))) for e in (",", "|", ";", "")] for x in (a_bytes, b_bytes)]
        self.ends = [pa.array(x, pa.large_string()) for x in self.ends]

    def borders(self) -> set[tuple[int, int]]:
        """(byte, white space after it) inside tokens of B, from its vocabulary."""
        return {(token[k - 1], token[k]) for token in self.bytes[1].to_pylist() for k in range(1, len(token)) if token[k] in WHITE}

    def pieces(self, segments: list[str]) -> list[list[int]]:
        """Ids of B.  The space that B puts before a text is the segment's own or, before other white space, a token to drop."""
        own = [s.startswith(" ") for s in segments]
        found = self.b.encode([s[1:] if o else s for s, o in zip(segments, own, strict=True)], num_threads=1)
        # a space alone is an empty text, to which B adds none
        return [[self.space] if s == " " else x if o else x[1:] if x[:1] == [self.space] else [] for s, x, o in zip(segments, found, own, strict=True)]


class Splitter:
    """Cuts space + text before runs of white space where no token of either side reaches across.

    A run counts if it begins with one of ``starts``: white space before which no token of B holds any
    byte that is not white space, nor the space that B would put there.  Side A merges inside matches of
    its pattern only, and a match that holds white space holds it at its beginning, so none crosses the
    place between a character that is not white space and one that is.
    """

    def __init__(self, tokenisers: Tokenisers):
        inside = tokenisers.borders()
        crossed = {after for before, after in inside if before not in WHITE or (before == 32 and after != 32)}
        self.starts = "".join(chr(w) for w in WHITE if w not in crossed)
        if " " not in self.starts:
            raise ValueError("tokens reach across spaces")
        self.start = np.zeros(256, bool)
        self.start[list(self.starts.encode())] = True

    def cut(self, texts: pa.Array) -> pa.ListArray:
        """The segments of each text; none of null and empty texts."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        full = np.flatnonzero(np.diff(offsets))
        data = np.insert(raw, offsets[full], 32)  # a space before every text that is not empty
        begins = offsets[full] + np.arange(len(full))
        border = self.start[data]
        border[1:] &= ~_SPACE[data[:-1]]
        border[begins] = True
        at = np.flatnonzero(border)
        at = at[~self._after_wide(data, at) | np.isin(at, begins)]
        values = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int64)), pa.py_buffer(data)])
        bounds = np.searchsorted(at, np.append(begins, len(data)))
        counts = np.zeros(len(texts), np.int64)
        counts[full] = np.diff(bounds)
        return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)])), values)

    @staticmethod
    def _after_wide(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the character before each place is white space of two or three bytes."""
        out = np.zeros(len(at), bool)
        for wide in _WIDE:
            hit = at >= len(wide)
            for k, byte in enumerate(wide):
                hit[hit] = data[at[hit] - len(wide) + k] == byte
            out |= hit
        return out

    def __call__(self, text: str) -> list[str]:
        return self.cut(pa.array([text]))[0].as_py()


_held: dict[int, tuple[Tokenisers, Splitter]] = {}


def _tools(shared) -> tuple[Tokenisers, Splitter]:
    """Both tokenisers of the broadcast files, built once a Python worker."""
    key = hash(shared.value)
    if key not in _held:
        _held.clear()
        both = Tokenisers(*shared.value)
        _held[key] = both, Splitter(both)
    return _held[key]


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of seven bits, low ones first, all but a number's last byte marked; and where each begins (and the total)."""
    size = 1 + sum((values >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    out = np.zeros(first[-1], np.uint8)
    for k in range(5):
        on = size > k
        out[first[:-1][on] + k] = (values[on] >> 7 * k & 127) | np.where(size[on] > k + 1, 128, 0)
    return out, first


def unpack(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ``pack``, and the place behind each one's last byte."""
    stop = np.flatnonzero(raw < 128) + 1
    start = np.concatenate([[0], stop[:-1]]).astype(np.int64)
    size, out = stop - start, np.zeros(len(stop), np.int64)
    for k in range(int(size.max(initial=0))):
        on = size > k
        out[on] |= (raw[start[on] + k].astype(np.int64) & 127) << 7 * k
    return out, stop


def _split(shared, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, part, made = _tools(shared)[1].cut, TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in row_slices(whole, "text", chunk):
                release()  # workers of one executor share its memory with other stages' left-overs
                lists = cut(batch.column("text"))
                bounds, coded = lists.offsets.to_numpy(), pc.dictionary_encode(lists.flatten())
                del lists
                local, n = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
                count = np.bincount(local, minlength=n)
                order = np.argsort(-count, kind="stable")  # frequent segments get small numbers
                rank = np.empty(n, np.int64)
                rank[order] = np.arange(n)
                raw, first = pack(rank[local])
                m, number, made = batch.num_rows, part * _CHUNKS + made, made + 1
                if made > _CHUNKS or n > _PLACE:
                    raise ValueError("too many chunks or segments: read the documents in smaller partitions")
                segs = pa.Array.from_buffers(pa.large_binary(), m, [None, pa.py_buffer(first[bounds].astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
                # rows of documents, then rows of segments
                rows = {
                    "chunk": pa.array(np.full(m + n, number)),
                    "doc_id": pa.concat_arrays([batch.column("doc_id"), pa.nulls(n, batch.column("doc_id").type)]),
                    "segs": pa.concat_arrays([segs, pa.nulls(n, segs.type)]),
                    "segment": pa.concat_arrays([pa.nulls(m, pa.string()), coded.dictionary.take(pa.array(order)).cast(pa.string())]),
                    "place": pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(number * _PLACE + np.arange(n))]),
                    "n": pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(count[order].astype(np.int64))]),
                }
                yield pa.RecordBatch.from_arrays(list(rows.values()), names=list(rows))

    return run


def _aligned(tools: Tokenisers, segments: list[str]) -> dict[str, pa.Array]:
    """What ``align_segments`` returns, for some segments at once."""
    ids = [[e.ids for e in tools.a.encode_batch_fast(segments, add_special_tokens=False)], tools.pieces(segments)]
    raw = [s.encode() for s in segments]
    size, ok = np.array([len(r) for r in raw], np.int64), np.ones(len(raw), bool)
    flat, first = [], []
    for side, found in enumerate(ids):
        flat.append(np.fromiter((i for x in found for i in x), np.int64))
        first.append(np.cumsum([0, *map(len, found)]))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(first[side].astype(np.int32)), tools.bytes[side].take(pa.array(flat[side]))), pa.scalar(b"", pa.large_binary()))
        ok &= pc.equal(joined, pa.array(raw, pa.large_binary())).to_numpy(zero_copy_only=False)
    counts = [np.where(ok, np.diff(f), 0) for f in first]
    base = np.cumsum([0, *np.where(ok, size, 0)])
    token, end, owner = [], [], []
    for side in (0, 1):
        t, _ = gather(flat[side], first[side][:-1], counts[side])
        token.append(t)
        owner.append(np.repeat(np.arange(len(raw)), counts[side]))
        end.append(np.cumsum(pc.binary_length(tools.bytes[side].take(pa.array(t))).to_numpy(zero_copy_only=False)))
    common, at_a, at_b = np.intersect1d(*end, assume_unique=True, return_indices=True)
    group = [np.searchsorted(common, e) for e in end]
    n_groups = np.diff(np.searchsorted(common, base, "right"))
    # each token's place among the tokens of both sides in order of groups, A before B
    before = [np.searchsorted(group[1], group[0], "left"), np.searchsorted(group[0], group[1], "right")]
    texts = np.empty(len(token[0]) + len(token[1]), np.int64)
    last_of_segment = np.searchsorted(base, common) - 1
    closes = np.ones(len(common), bool)
    closes[:-1] = last_of_segment[1:] != last_of_segment[:-1]
    for side in (0, 1):
        closing = np.zeros(len(token[side]), np.int64)  # a comma
        closing[(at_a, at_b)[side]] = 1 if side == 0 else np.where(closes, 3, 2)
        texts[np.arange(len(token[side])) + before[side]] = token[side] * 4 + closing + (len(tools.ends[0]) if side else 0)
    written = pa.concat_arrays(tools.ends).take(pa.array(texts))
    both = np.cumsum([0, *(counts[0] + counts[1])]).astype(np.int32)
    links = token[0][at_a] * _PAIR + token[1][at_b]
    return {
        "ok": pa.array(ok),
        "n_a": pa.array(counts[0]),
        "n_b": pa.array(counts[1]),
        "links": pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n_groups]).astype(np.int32)), pa.array(links)),
        "groups": pc.binary_join(pa.ListArray.from_arrays(pa.array(both), written), pa.scalar("", pa.large_string())).cast(pa.string()),
    }


def align_segments(segments: DataFrame, shared) -> DataFrame:
    """n, places, ok, n_a, n_b, links (A id * 2**24 + B id) and groups (``a1,a2|b1;a3|b2``) of runs of equal segments.

    ``segments`` (segment, place, n) has equal segments next to one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _tools(shared)[0]
        for whole in batches:
            release()
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                coded = pc.dictionary_encode(batch.column("segment"))
                which = coded.indices.to_numpy(zero_copy_only=False)
                order = np.argsort(which, kind="stable")
                bounds = np.searchsorted(which[order], np.arange(len(coded.dictionary) + 1))
                n = np.add.reduceat(batch.column("n").to_numpy()[order], bounds[:-1])
                places = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), batch.column("place").take(pa.array(order)))
                out = {"n": pa.array(n), "places": places, **_aligned(tools, coded.dictionary.to_pylist())}
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return segments.mapInArrow(run, "n long, places array<long>, ok boolean, n_a long, n_b long, links array<long>, groups string")


def _rated(shared_counts):
    """For each place of a segment: groups (null if the segment is not given back), n_a, links of the highest count and counts' sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = shared_counts.value
        for batch in batches:
            links = batch.column("links")
            flat = links.flatten().to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(pair, flat), max(0, len(pair) - 1))
            known = pair[at] == flat if len(pair) else np.zeros(len(flat), bool)  # others occur in no valid document
            bounds = links.offsets.to_numpy(zero_copy_only=False) - links.offsets[0].as_py()
            total, top = (np.concatenate([[0], np.cumsum(np.where(known, x[at], 0) if len(pair) else flat * 0)]).astype(np.int64) for x in (count, best))
            places = batch.column("places")
            size = np.diff(places.offsets.to_numpy(zero_copy_only=False))
            owner = np.repeat(np.arange(batch.num_rows), size)
            place = places.flatten().to_numpy(zero_copy_only=False)
            groups = pc.if_else(batch.column("ok"), batch.column("groups"), pa.scalar(None, pa.string()))
            rows = {
                "of": pa.array(place // _PLACE),
                "local": pa.array((place % _PLACE).astype(np.int32)),
                "groups": groups.take(pa.array(owner)),
                "n_a": batch.column("n_a").take(pa.array(owner)).cast(pa.int32()),
                "n_best": pa.array((top[bounds[1:]] - top[bounds[:-1]])[owner].astype(np.int32)),
                "count_sum": pa.array((total[bounds[1:]] - total[bounds[:-1]])[owner]),
            }
            yield pa.RecordBatch.from_arrays(list(rows.values()), names=list(rows))

    return run


_SUMS = ["n_a", "n_b", "n_groups", "n_best", "count_sum"]


def _composed(docs: pa.Table, found: pa.Table) -> pa.Table:
    """A chunk's documents from the alignments of its segments."""
    release()
    found = found.sort_by("local").combine_chunks()
    lists = docs.column("segs").combine_chunks().cast(pa.large_binary())
    offsets = np.frombuffer(lists.buffers()[1], np.int64)[lists.offset : lists.offset + len(lists) + 1]
    raw = np.frombuffer(lists.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    flat, stop = unpack(raw)
    bounds = np.searchsorted(stop, offsets - offsets[0], "right")
    out = {"doc_id": docs.column("doc_id")}
    texts = found.column("groups").combine_chunks().cast(pa.large_string()) if len(flat) else pa.array([], pa.large_string())
    bad = np.concatenate([[0], np.cumsum(texts.is_null().to_numpy(zero_copy_only=False)[flat])])
    ok = bad[bounds[1:]] == bad[bounds[:-1]]
    if len(flat):
        tokens, groups = (pc.fill_null(pc.add(pc.count_substring_regex(texts, p), 1), 0).to_numpy() for p in ("[,|;]", ";"))
        values = {"n_groups": groups, **{c: found.column(c).to_numpy() for c in ("n_a", "n_best", "count_sum")}}
        values["n_b"] = tokens - values["n_a"]
    for name in _SUMS:
        sums = np.concatenate([[0], np.cumsum(values[name][flat], dtype=np.int64)]) if len(flat) else np.zeros(1, np.int64)
        out[name] = pa.array(np.where(ok, sums[bounds[1:]] - sums[bounds[:-1]], 0))
    kept, ends = gather(flat, bounds[:-1].astype(np.int64), np.where(ok, np.diff(bounds), 0))
    out["groups"] = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), texts.take(pa.array(kept))), pa.scalar(";", pa.large_string())).cast(pa.string())
    return pa.table(out)


def _marked(docs: pa.Table, places: pa.Table) -> pa.Table:
    """Segments of a chunk's documents that hold a bad segment (``places`` with ok false), with their links, as often as they occur there."""
    flat = [unpack(np.frombuffer(x, np.uint8))[0] for x in docs.column("segs").to_pylist()]
    bad = places.column("local").to_numpy()[~places.column("ok").to_numpy(zero_copy_only=False)]
    lost = np.concatenate([np.zeros(0, np.int64), *(x for x in flat if np.isin(x, bad).any())])
    local, count = np.unique(lost, return_counts=True)
    return pa.table({"of": pa.array(np.full(len(local), docs.column("chunk")[0].as_py())), "at": pa.array(local.astype(np.int32)), "less": pa.array(-count)})


def _lost(texts: DataFrame, aligned: DataFrame) -> DataFrame:
    """pair, n: what documents with a segment that is not given back would add to the counts, negative."""
    placed = aligned.select("ok", "links", F.explode("places").alias("place")).select((F.col("place") / _PLACE).cast("long").alias("c"), (F.col("place") % _PLACE).cast("int").alias("local"), "ok", "links")
    bad = placed.filter("NOT ok").select("c", "local", "ok")
    marks = texts.join(bad.select("c").distinct(), F.col("chunk") == F.col("c"), "left_semi").groupBy("chunk").cogroup(bad.groupBy("c")).applyInArrow(_marked, "of long, at int, less long")
    return placed.filter("ok").join(marks, (F.col("c") == F.col("of")) & (F.col("local") == F.col("at"))).select(F.explode("links").alias("pair"), F.col("less").alias("n"))


def align(docs: DataFrame, a_path: str, b_path: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_best, count_sum and groups for each row of ``docs`` (doc_id, text).

    The paths are vocabulary files on the driver.  The result reads stored tables, which ``free(*result._held)``
    deletes when it has been used.
    """
    spark = docs.sparkSession
    ship(spark)
    raw = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            raw.append(f.read())
    shared = spark.sparkContext.broadcast(tuple(raw))
    kind = dict(docs.dtypes)["doc_id"]
    parts = stored(docs.select("doc_id", "text").mapInArrow(_split(shared, chunk), f"chunk long, doc_id {kind}, segs binary, segment string, place long, n long"), "zstd")
    texts = parts.filter("segs IS NOT NULL").select("chunk", "doc_id", "segs")
    rows = parts.filter("segment IS NOT NULL").select("segment", "place", "n", F.floor(F.col("chunk") / (RANGE * _CHUNKS)).alias("range"))
    aligned = stored(align_segments(rows.repartition("segment", "range").sortWithinPartitions("segment"), shared), "zstd")
    pairs = aligned.filter("ok").select(F.explode("links").alias("pair"), "n")
    if not aligned.filter("NOT ok").isEmpty():
        pairs = pairs.unionByName(_lost(texts, aligned))
    pairs = pairs.groupBy("pair").agg(F.sum("n").alias("count")).filter("count > 0")
    counts = pairs.toPandas().sort_values("pair")  # one row a pair of ids that can end together: bounded by the vocabularies
    pair, count = (counts[c].to_numpy(np.int64) for c in ("pair", "count"))
    top = np.zeros(int((pair % _PAIR).max(initial=0)) + 1, np.int64)
    np.maximum.at(top, pair % _PAIR, count)
    sent = spark.sparkContext.broadcast((pair, count, (count == top[pair % _PAIR]).astype(np.int64)))
    back = aligned.select("places", "ok", "n_a", "links", "groups").mapInArrow(_rated(sent), "of long, local int, groups string, n_a int, n_best int, count_sum long")
    out = texts.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(_composed, f"doc_id {kind}, {', '.join(f'{c} long' for c in _SUMS)}, groups string")
    out._held = (parts, aligned)
    return out


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of a byte-level and a piece vocabulary on every document."""
    import public_tokenizers as files

    found = align(table(spark, sf_dir, "documents"), files.path(A_FILE), files.path(B_FILE))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    out = stored(found.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", digest.alias("groups_sha256")))
    free(*found._held)
    return out
