"""Byte-pair encoding by speculation: longest matches are proposed, checked by pairs, and merged only where they fail.

A word's units are its bytes; its last byte carries the end-of-word mark.  Three steps, each over the
distinct words of a slice of documents at once:

1. *Speculate*: from the left, the longest token that fits.
2. *Verify*: a sequence of tokens is the one that merging gives if merging leaves each token alone as it is
   and, for each two neighbours, merging their units gives just those two.  Undoing the later merge of the
   two tokens step by step shows every pair of pieces that ever meets at their border; a merge of such a
   pair that comes before both pieces grow on breaks the border.
3. *Merge*: words with a broken border (or a token that merging never makes) are merged by rank.

Step 2 needs a vocabulary whose merges make each token once, from tokens of earlier merges; ``Vocabulary``
refuses others.  Texts are cut into chunks at ASCII white space, which no token of these vocabularies crosses
and which neither normalisation nor the pattern for words sees across; normalisation and pattern of a chunk
are the vocabulary file's own, as the library runs them.  Strings of special tokens inside a text are those
tokens.

Defined cases: null and empty texts, and texts of white space, have no tokens and decode to an empty text;
texts of any length are encoded whole; equal rows give equal results; further columns are kept, and result
columns that clash with them are renamed by ``fresh``; empty tables give empty results.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, ship, table

#: Bytes of text that one slice of documents holds (a longer document is a slice of its own).
SLICE = 4 << 20
#: Bytes of chunks whose tokens a Python worker remembers; beyond, it begins anew.
MEMORY = 4 << 20
#: Of op13.
FILE = "word_bpe_49k.json"
_NEVER = np.int64(1) << 40


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones as themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and the trie of one vocabulary file with end-of-word marks."""

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer

        spec, self.library = json.loads(raw), Tokenizer.from_buffer(raw)
        model, letters, end = spec["model"], _byte_letters(), spec["model"]["end_of_word_suffix"]
        if not end or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("a byte-level vocabulary with an end-of-word suffix and plain merges is needed")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile(f"({'|'.join(re.escape(s) for s in self.special) or '(?!)'})")
        ids = model["vocab"]
        size = max([*ids.values(), *self.special.values()]) + 1
        named = {i: t for t, i in [*ids.items(), *self.special.items()]}
        self.names = pa.array([named.get(k, "") for k in range(size)], pa.large_string())
        self.byte = np.zeros(512, np.int64)
        self.byte[[ord(c) for c in letters]] = list(letters.values())
        self._ascii(spec)
        self.unit = np.full(512, -1, np.int64)
        for name, i in ids.items():
            body = name.removesuffix(end)
            if len(body) == 1 and body in letters:
                self.unit[letters[body] + (256 if name != body else 0)] = i
        if (self.unit < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([ids[m[k]] for m in merges], np.int64) for k in (0, 1))
        made = np.array([ids["".join(m)] for m in merges], np.int64)
        self.size, self.rank = size, np.full(size, -1, np.int64)
        self.rank[made] = np.arange(len(made))
        if len(np.unique(made)) < len(made) or (np.maximum(self.rank[left], self.rank[right]) >= np.arange(len(made))).any() or np.isin(made, self.unit).any():
            raise ValueError("the merges do not make each token once from earlier ones")
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.left[made], self.right[made] = left, right
        key = left * size + right
        order = np.argsort(key)
        self.pairs, self.pair_rank, self.made = key[order], order.astype(np.int64), made
        self._trie([(i, name) for name, i in ids.items()], end)
        self._forget()
        whole = self.meet(left, right, np.arange(len(made)))
        self.sound = np.ones(size, bool)
        for m, (a, b, c) in enumerate(zip(left.tolist(), right.tolist(), made.tolist(), strict=True)):
            self.sound[c] = whole[m] and self.sound[a] and self.sound[b]

    def _ascii(self, spec: dict) -> None:
        """The file's own pattern for printable ASCII, if its normaliser only lowers those letters."""
        printable = "".join(map(chr, range(0x21, 0x7F)))
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        lowers = self.library.normalizer is not None and self.library.normalizer.normalize_str(printable) == printable.lower()
        fits = [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1]["use_regex"]
        self.ascii_pattern = regex.compile(steps[0]["pattern"]["Regex"] + r"|\n") if lowers and fits else None

    def _trie(self, tokens: list[tuple[int, str]], end: str) -> None:
        edges: dict[int, int] = {}
        ends: dict[int, int] = {}
        for i, name in tokens:
            marked = name.endswith(end) and name != end
            units, at = self.units([name.removesuffix(end)] if marked else [name], marked)[0], 0
            for u in units.tolist():
                at = edges.setdefault(at * 512 + u, len(edges) + 1)
            ends[at] = i
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(keys)
        self.edges, self.child = keys[order], np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.token_at = np.full(len(edges) + 1, -1, np.int64)
        self.token_at[list(ends)] = list(ends.values())

    def units(self, words: list[str], marked: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The units of byte-level words, flat, and where each word's begin (and the total at the end)."""
        first = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)]).astype(np.int64)
        out = self.byte[np.frombuffer("".join(words).encode("utf-16-le"), np.uint16)]
        if marked:
            out[first[1:][np.diff(first) > 0] - 1] += 256
        return out, first

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of tokens; beyond all ranks where there is none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_rank[at], _NEVER)

    def meet(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether merging the units of a and b keeps the border between them (up to the merge ``before``).

        A piece at the border exists until the merge that makes the next larger piece.  The left token's own
        merges of equal rank come before one across the border, the right token's come after it.
        """
        n = len(a)
        ok = np.ones(n, bool)
        until_a = np.full(n, _NEVER) if before is None else before.copy()
        until_b = until_a - 1 if before is not None else until_a.copy()
        a, b, left = a.copy(), b.copy(), np.arange(n)
        while len(left):
            x, y = a[left], b[left]
            r = self.ranks(x, y)
            broken = (r < until_a[left]) & (r <= until_b[left])
            ok[left[broken]] = False
            go = ~broken & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            left, x, y = left[go], x[go], y[go]
            undo_a = self.rank[x] > self.rank[y]
            i, j = left[undo_a], left[~undo_a]
            until_a[i], a[i] = self.rank[x[undo_a]], self.right[x[undo_a]]
            until_b[j], b[j] = self.rank[y[~undo_a]], self.left[y[~undo_a]]
        return ok

    def longest(self, units: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches from the left of every word: tokens in order of words, and the word of each."""
        at, stop, word = first[:-1].copy(), first[1:], np.arange(len(first) - 1)
        word = word[at < stop]
        at = at[at < stop]
        found, owner, place = [], [], []
        while len(word):
            token, length = np.full(len(word), -1, np.int64), np.zeros(len(word), np.int64)
            live, node, depth = np.arange(len(word)), np.zeros(len(word), np.int64), 0
            while len(live):
                key = node * 512 + units[at[live] + depth]
                k = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
                hit = self.edges[k] == key
                live, node, depth = live[hit], self.child[k[hit]], depth + 1
                named = self.token_at[node] >= 0
                token[live[named]], length[live[named]] = self.token_at[node[named]], depth
                more = at[live] + depth < stop[word[live]]
                live, node = live[more], node[more]
            found.append(token)
            owner.append(word)
            place.append(at)
            at = at + length
            go = at < stop[word]
            at, word = at[go], word[go]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = np.argsort(np.concatenate(place), kind="stable")
        return np.concatenate(found)[order], np.concatenate(owner)[order]

    def merge(self, tokens: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge by rank: in each round every word merges all places of its earliest pair, from the left."""
        done_t, done_w = [], []
        while len(tokens):
            same = np.zeros(len(tokens), bool)
            same[:-1] = word[1:] == word[:-1]
            r = np.full(len(tokens), _NEVER)
            at = np.flatnonzero(same)
            r[at] = self.ranks(tokens[at], tokens[at + 1])
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.repeat(np.minimum.reduceat(r, heads), np.diff(np.r_[heads, len(tokens)]))
            over = least == _NEVER
            done_t.append(tokens[over])
            done_w.append(word[over])
            tokens, word, r, least = tokens[~over], word[~over], r[~over], least[~over]
            hit = r == least
            spot = np.flatnonzero(hit)
            if not len(spot):
                break
            run = np.maximum.accumulate(np.where(np.r_[True, np.diff(spot) != 1], np.arange(len(spot)), 0))
            spot = spot[(np.arange(len(spot)) - run) % 2 == 0]  # of three equal tokens the first two merge
            tokens[spot] = self.made[r[spot]]
            keep = np.ones(len(tokens), bool)
            keep[spot + 1] = False
            tokens, word = tokens[keep], word[keep]
        tokens, word = np.concatenate([*done_t, tokens]), np.concatenate([*done_w, word])
        order = np.argsort(word, kind="stable")
        return tokens[order], word[order]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of byte-level words, flat, and where each word's begin (and the total at the end)."""
        flat, first = self.units(words)
        tokens, word = self.longest(flat, first)
        wrong = np.zeros(len(words), bool)
        wrong[word[~self.sound[tokens]]] = True
        inner = np.flatnonzero(word[1:] == word[:-1])
        pair, back = np.unique(tokens[inner] * self.size + tokens[inner + 1], return_inverse=True)
        fits = self.meet(pair // self.size, pair % self.size)
        wrong[word[inner[~fits[back]]]] = True
        if wrong.any():
            of_unit = np.repeat(np.arange(len(words)), np.diff(first))
            failing = wrong[of_unit]
            t, w = self.merge(self.unit[flat[failing]], of_unit[failing])
            keep = ~wrong[word]
            tokens, word = np.concatenate([tokens[keep], t]), np.concatenate([word[keep], w])
            order = np.argsort(word, kind="stable")
            tokens, word = tokens[order], word[order]
        return tokens, np.searchsorted(word, np.arange(len(words) + 1))

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of chunks without ASCII white space, flat, and where each chunk's begin (and the total at the end)."""
        known: dict[str, int] = {}
        start, length = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        simple = np.fromiter((c.isascii() and c.isprintable() and "<" not in c for c in chunks), bool, len(chunks)) & (self.ascii_pattern is not None)
        # printable ASCII, all at once; the ends of chunks come out as words of their own and have no tokens
        line = known.setdefault("\n", 0)
        found = self.ascii_pattern.findall("".join([chunks[k].lower() + "\n" for k in np.flatnonzero(simple)])) if simple.any() else []
        pieces = [known.setdefault(w, len(known)) for w in found]
        stops = np.flatnonzero(np.array(pieces, np.int64) == line)
        start[simple] = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else 0
        length[simple] = stops - start[simple]
        normal, split = self.library.normalizer, self.library.pre_tokenizer
        for k in np.flatnonzero(~simple).tolist():
            start[k] = len(pieces)
            for part in self.special_pattern.split(chunks[k]):
                if part in self.special:
                    pieces.append(-1 - self.special[part])
                elif part:
                    pieces += [known.setdefault(w, len(known)) for w, _ in split.pre_tokenize_str(normal.normalize_str(part) if normal else part)]
            length[k] = len(pieces) - start[k]
        tokens, first = self.encode_words(["", *list(known)[1:]])
        base, tokens = len(tokens), np.concatenate([tokens, np.arange(self.size)])  # special tokens come from the second part
        piece = np.array(pieces, np.int64)
        word = np.maximum(piece, 0)
        flat, offsets = gather(tokens, np.where(piece < 0, base - 1 - piece, first[word]), np.where(piece < 0, 1, np.diff(first)[word]))
        return gather(flat, offsets[start], offsets[start + length] - offsets[start])

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.remembered, self.tokens, self.first = 0, np.zeros(0, np.int32), np.zeros(1, np.int64)

    def remember(self, chunks: list[str]) -> np.ndarray:
        """Places of the chunks in ``tokens`` by ``first``; only chunks not seen before are encoded."""
        if self.remembered > MEMORY:
            self._forget()
        new = [c for c in chunks if c not in self.place]
        tokens, first = self.encode_chunks(new)
        self.remembered += sum(map(len, new))
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        self.first = np.concatenate([self.first, first[1:] + len(self.tokens)])
        self.tokens = np.concatenate([self.tokens, tokens.astype(np.int32)])
        return np.fromiter(map(self.place.__getitem__, chunks), np.int64, len(chunks))

    def text(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The tokens' names with a space between them, for the runs of ``ids`` between ``bounds``."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), self.names.take(pa.array(ids))), pa.scalar(" ", pa.large_string())).cast(pa.string())


def gather(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs values[start : start + length] one after the other, and where each begins (and the total)."""
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], length)
    return values[at], offsets


_held: dict[int, Vocabulary] = {}


def _vocabulary(shared) -> Vocabulary:
    """The broadcast file's vocabulary, built once a Python worker."""
    key = hash(shared.value)
    if key not in _held:
        _held.clear()
        _held[key] = Vocabulary(shared.value)
    return _held[key]


def row_slices(batch: pa.RecordBatch, text: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose texts have ``most`` bytes together, or one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(size, before + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _shared(spark: SparkSession, path: str):
    ship(spark)
    with open(path, "rb") as f:
        raw = f.read()
    if json.loads(raw).get("decoder"):
        raise ValueError("the file names a decoder of its own")
    return spark.sparkContext.broadcast(raw)


def encode(docs: DataFrame, path: str, text: str = "text", into: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the token ids of ``text`` (array of int) and, where ``decoded`` names a column, with the text that
    they decode to.  ``path`` is a vocabulary file on the driver."""
    shared = _shared(docs.sparkSession, path)
    added = [T.StructField(fresh(into, docs.columns), T.ArrayType(T.IntegerType(), False))]
    if decoded:
        added.append(T.StructField(fresh(decoded, [*docs.columns, added[0].name]), T.StringType()))
    names = [*docs.columns, *(f.name for f in added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared)
        for whole in batches:
            for batch in row_slices(whole, text):
                chunks = pc.ascii_split_whitespace(pc.fill_null(batch.column(text).cast(pa.large_string()), ""))
                coded = pc.dictionary_encode(chunks.flatten())
                which = vocabulary.remember(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
                flat, offsets = gather(vocabulary.tokens, vocabulary.first[which], np.diff(vocabulary.first)[which])
                bounds = offsets[chunks.offsets.to_numpy(zero_copy_only=False) - chunks.offsets[0].as_py()]
                found = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))]
                if decoded:
                    found.append(vocabulary.text(flat, bounds))
                yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def decode(tokens: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``tokens`` with the text of its ``ids``: the tokens' names, special ones included, with a space between
    them, as the library joins them for a file that names no decoder.  Ids that are null or outside the
    vocabulary give no name."""
    shared = _shared(tokens.sparkSession, path)
    into = fresh(into, tokens.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared)
        for batch in batches:
            column = batch.column(ids)
            lists = pc.if_else(column.is_null(), pa.scalar([], column.type), column)
            flat = lists.flatten()
            known = pc.fill_null(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, vocabulary.size)), False)
            kept = np.concatenate([[0], np.cumsum(known.to_numpy(zero_copy_only=False))])
            bounds = kept[lists.offsets.to_numpy(zero_copy_only=False) - lists.offsets[0].as_py()]
            yield pa.RecordBatch.from_arrays([*batch.columns, vocabulary.text(flat.filter(known).to_numpy(zero_copy_only=False), bounds)], names=[*batch.schema.names, into])

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField(into, T.StringType())]))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded text, of every document."""
    import public_tokenizers

    path = public_tokenizers.path(FILE)
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded="decoded")
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
