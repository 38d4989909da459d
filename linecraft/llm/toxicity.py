"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Every word enters as a word embedding (by hash) beside the sum of the embeddings of its character
n-grams.  A word of more than ``PIECE`` bytes (joined tokens, scripts without spaces) enters as pieces
of that size that overlap by half: each piece is an input word of its own, with the n-grams of its
bytes, an edge mark only where the word has its edge, and the whole word's embedding.  A forward and
a backward gated recurrent network read windows of ``T`` words that overlap by half; attention pools the states of a window into one, and a logistic unit scores it.  All
windows of the whole text are scored and a document's score is that of its worst window.

The network learns on the driver from a bounded sample of labelled documents (``SAMPLE_TOXIC`` toxic
and ``SAMPLE_CLEAN`` clean ones, by hash of the id, whole texts of any length until ``SAMPLE_CHARS``
characters of a label are reached; of rows that share an id the first by hash of the text).
Labels belong to documents, so training picks the windows: first the window with the highest sum of
log-odds of its words and n-grams, then the one that the network scores highest; clean documents
give random windows and those that the network takes for toxic.

Defined cases: null and empty texts and texts without a word score 0; without a label of either
kind every text scores 0; a text of fewer than ``T`` words is one padded window; equal rows score
alike; ``n_windows`` counts windows of words and pieces; labels that contradict each other for one id
count as toxic; very long texts are scored whole; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, ship, table
from .textops import _CODE_LOWER, Hasher, Words, mix, slices, words

T, STRIDE, HIDDEN, EMBED, ATTEND = 24, 12, 8, 6, 8
BUCKETS, GRAMS = 1 << 15, (3, 4, 5)
PIECE = 40
#: Characters or n-grams worked on at once.
CHUNK = 1 << 20
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 1000, 1800, 6_000_000
STEPS, ROUNDS, BATCH, RATE = 200, 3, 96, 0.01
#: Share of whole-word embeddings hidden in a training step, so that characters must do as well.
HIDE = 0.4
CUT = 0.7


@dataclass
class Vocabulary:
    """Distinct words and pieces of some texts: bucket of each word, buckets of its n-grams, ids of all words."""

    word: np.ndarray
    gram: np.ndarray
    first: np.ndarray
    ids: np.ndarray


@dataclass
class Pieces(Words):
    """Words and pieces of long words, in order of the text, with the hash of the whole word."""

    whole: np.ndarray
    head: np.ndarray  # whether the word begins here
    tail: np.ndarray  # whether the word ends here


def pieces(data: np.ndarray, off: np.ndarray) -> Pieces:
    w = words(data, off)
    size, step = w.end - w.start, PIECE // 2
    n = 1 + np.maximum(0, -(-(size - PIECE) // step))
    so_far = np.concatenate([[0], np.cumsum(n)])
    of = np.repeat(np.arange(len(n)), n)
    start = w.start[of] + np.minimum((np.arange(len(of)) - so_far[of]) * step, np.maximum(size[of] - PIECE, 0))
    end = np.minimum(start + PIECE, w.end[of])
    return Pieces(start, end, w.doc[of], so_far[w.first], Hasher(data, lower=True)(w.start, w.end)[of], start == w.start[of], end == w.end[of])


def vocabulary(data: np.ndarray, w: Pieces) -> Vocabulary:
    h = w.whole.copy()
    part = np.flatnonzero(~(w.head & w.tail))
    if len(part):
        edges = (w.head[part] + 2 * w.tail[part]).astype(np.uint64)
        h[part] = mix(mix(Hasher(data, lower=True)(w.start[part], w.end[part]) + edges) ^ h[part])
    _, at, ids = np.unique(h, return_index=True, return_inverse=True)
    start, size, head = w.start[at], w.end[at] - w.start[at], w.head[at].astype(np.int64)
    # characters of the distinct words, with a mark on the edges of the word
    length = size + head + w.tail[at]
    so_far = np.concatenate([[0], np.cumsum(length)])
    grams, counts, lo = [np.zeros(0, np.int32)], np.zeros(len(at), np.int64), 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(so_far, so_far[lo] + CHUNK, "right")) - 1)
        owner = np.repeat(np.arange(lo, hi), length[lo:hi])
        place = np.arange(so_far[lo], so_far[hi]) - so_far[owner] - head[owner]
        inner = (place >= 0) & (place < size[owner])
        code = np.full(len(owner), np.uint64(0x51ED270B))
        code[inner] = _CODE_LOWER[data[start[owner[inner]] + place[inner]]]
        parts, owners = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for n in GRAMS:
            if len(code) < n:
                continue
            total = np.zeros(len(code) - n + 1, np.uint64)
            for j in range(n):
                total = total * np.uint64(0x9E3779B97F4A7C15) + code[j : len(code) - n + 1 + j]
            ok = owner[: len(total)] == owner[n - 1 :]
            parts.append((mix(total[ok] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int32))
            owners.append(owner[: len(total)][ok])
        own = np.concatenate(owners)
        grams.append(np.concatenate(parts)[np.argsort(own, kind="stable")])
        counts[lo:hi] = np.bincount(own - lo, minlength=hi - lo)
        lo = hi
    return Vocabulary((mix(w.whole[at]) % np.uint64(BUCKETS)).astype(np.int32), np.concatenate(grams), np.concatenate([[0], np.cumsum(counts)]), ids)


def windows_of(counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, first word) of all windows: every ``STRIDE`` words, the last one at the text's end."""
    n = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - T) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(counts)), n)
    k = np.arange(len(doc)) - np.concatenate([[0], np.cumsum(n)])[doc]
    return doc, first[doc] + np.minimum(k * STRIDE, np.maximum(counts[doc] - T, 0))


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``values`` summed by ``at``."""
    return np.stack([np.bincount(at, column, n) for column in values.T], axis=1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters, forward and backward pass.  Arrays over a window's words are (T, windows, ...)."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        f = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        d = 2 * EMBED
        self.p = {"word": f(BUCKETS, EMBED) * 0.0, "gram": f(BUCKETS, EMBED) * 0.0, "va": f(ATTEND), "wa": f(2 * HIDDEN, ATTEND), "out": f(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        self.p["word"] += (rng.standard_normal((BUCKETS, EMBED)) * 0.02).astype(np.float32)
        self.p["gram"] += (rng.standard_normal((BUCKETS, EMBED)) * 0.02).astype(np.float32)
        for way in "fb":
            self.p |= {f"x{way}": f(d, 3 * HIDDEN), f"c{way}": np.zeros(3 * HIDDEN, np.float32), f"u{way}": f(HIDDEN, 3 * HIDDEN)}

    def embed(self, v: Vocabulary, known: np.ndarray | None = None) -> np.ndarray:
        """Word inputs; ``known`` (0 or 1 a word) hides whole-word embeddings in training."""
        n = np.diff(v.first)
        grams = np.zeros((len(v.word), EMBED), np.float32)
        some = np.flatnonzero(n > 0)
        begin, lo = v.first[some], 0
        while lo < len(some):
            hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + CHUNK)))
            at, last = some[lo:hi], v.first[some[hi - 1] + 1]
            grams[at] = np.add.reduceat(self.p["gram"][v.gram[begin[lo] : last]], begin[lo:hi] - begin[lo], axis=0) / np.sqrt(n[at])[:, None]
            lo = hi
        word = self.p["word"][v.word]
        return np.concatenate([word if known is None else word * known[:, None], grams], axis=1)

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Input part of all gates for each distinct word, with a last row for padding."""
        x = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
        return {way: x @ self.p[f"x{way}"] + self.p[f"c{way}"] for way in "fb"}

    def read(self, rows: np.ndarray, table_: dict[str, np.ndarray], keep: bool = False):
        """States (T, windows, 2 * HIDDEN) over ``rows`` (T, windows) of the input table."""
        steps, n = rows.shape
        states, kept = np.empty((steps, n, 2 * HIDDEN), np.float32), {}
        for way, order, lo in (("f", range(steps), 0), ("b", range(steps - 1, -1, -1), HIDDEN)):
            h, u, x = np.zeros((n, HIDDEN), np.float32), self.p[f"u{way}"], table_[way]
            trace = []
            for t in order:
                a, g = x[rows[t]], h @ u
                zr = _sigmoid(a[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = np.tanh(a[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
                if keep:
                    trace.append((t, h, z, r, new, g[:, 2 * HIDDEN :]))
                h = new + z * (h - new)
                states[t, :, lo : lo + HIDDEN] = h
            kept[way] = trace
        return states, kept

    def pool(self, states: np.ndarray, mask: np.ndarray):
        """Logits, attention weights, attention features and pooled states."""
        e = np.tanh(states @ self.p["wa"])
        s = np.where(mask, e @ self.p["va"], np.float32(-1e9))
        a = np.exp(s - s.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tn,tnk->nk", a, states)
        return pooled @ self.p["out"] + self.p["bias"][0], a, e, pooled

    def gradients(self, rows: np.ndarray, mask: np.ndarray, v: Vocabulary, y: np.ndarray, known: np.ndarray) -> dict[str, np.ndarray]:
        x = self.embed(v, known)
        states, kept = self.read(rows, self.project(x), keep=True)
        logit, a, e, pooled = self.pool(states, mask)
        d = (_sigmoid(logit) - y).astype(np.float32) / len(y)
        g = {"out": pooled.T @ d, "bias": np.array([d.sum()], np.float32)}
        d_pooled = d[:, None] * self.p["out"]
        d_states = a[:, :, None] * d_pooled
        d_a = np.einsum("nk,tnk->tn", d_pooled, states)
        d_s = a * (d_a - (a * d_a).sum(0))
        g["va"] = np.einsum("tn,tnk->k", d_s, e)
        d_e = d_s[:, :, None] * self.p["va"] * (1 - e * e)
        g["wa"] = np.einsum("tnk,tnj->kj", states, d_e)
        d_states += d_e @ self.p["wa"].T
        d_x = np.zeros((len(x) + 1, x.shape[1]), np.float32)
        xs = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
        for way, lo in (("f", 0), ("b", HIDDEN)):
            u, d_u = self.p[f"u{way}"], np.zeros_like(self.p[f"u{way}"])
            d_in = np.empty((*rows.shape, 3 * HIDDEN), np.float32)
            d_h = np.zeros((rows.shape[1], HIDDEN), np.float32)
            for t, h, z, r, new, gn in reversed(kept[way]):
                d_h = d_h + d_states[t, :, lo : lo + HIDDEN]
                d_new = d_h * (1 - z) * (1 - new * new)
                d_z = d_h * (h - new) * z * (1 - z)
                d_r = d_new * gn * r * (1 - r)
                d_in[t] = np.concatenate([d_z, d_r, d_new], axis=1)
                d_g = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_u += h.T @ d_g
                d_h = d_h * z + d_g @ u.T
            d_gates = _sums(rows.ravel(), d_in.reshape(-1, 3 * HIDDEN), len(xs))
            g |= {f"u{way}": d_u, f"c{way}": d_gates.sum(0), f"x{way}": xs.T @ d_gates}
            d_x += d_gates @ self.p[f"x{way}"].T
        d_x, n = d_x[:-1], np.diff(v.first)
        g["word"] = _sums(v.word, d_x[:, :EMBED] * known[:, None], BUCKETS)
        share = d_x[:, EMBED:] / np.sqrt(np.maximum(n, 1))[:, None]
        g["gram"] = _sums(v.gram, np.repeat(share, n, axis=0), BUCKETS)
        return g

    def scores(self, rows: np.ndarray, mask: np.ndarray, v: Vocabulary, batch: int = 2048) -> np.ndarray:
        """Score of each window (windows, T)."""
        table_ = self.project(self.embed(v))
        out = np.empty(len(rows), np.float32)
        for k in range(0, len(rows), batch):
            part = np.ascontiguousarray(rows[k : k + batch].T)
            out[k : k + batch] = _sigmoid(self.pool(self.read(part, table_)[0], mask[k : k + batch].T)[0])
        return out


def _rows(first: np.ndarray, counts: np.ndarray, doc: np.ndarray, start: np.ndarray, ids: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Word rows (windows, T) of windows and which of them are words."""
    at = start[:, None] + np.arange(T)
    mask = at < (first[doc] + counts[doc])[:, None]
    return np.where(mask, ids[np.minimum(at, len(ids) - 1)], pad).astype(np.int32), mask


def _part(v: Vocabulary, rows: np.ndarray) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary of some windows only, and their rows in it."""
    pad = len(v.word)
    used, back = np.unique(rows, return_inverse=True)
    real = used[used < pad]
    n = v.first[real + 1] - v.first[real]
    at = np.repeat(v.first[real] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(real) else np.zeros(0, np.int64)
    return Vocabulary(v.word[real], v.gram[at], np.concatenate([[0], np.cumsum(n)]), np.zeros(0, np.int64)), back.reshape(rows.shape)


def _grams_of(v: Vocabulary, of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``of_word``, bucket) of all n-grams of some words."""
    n = v.first[of_word + 1] - v.first[of_word]
    at = np.repeat(v.first[of_word] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    return np.repeat(np.arange(len(of_word)), n), v.gram[at]


def _log_odds(w, v: Vocabulary, toxic: np.ndarray, buckets_of, block: int = 64) -> np.ndarray:
    """Clipped log-odds of each bucket, by the documents of either label that have it."""
    a, b = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for lo in range(0, len(toxic), block):
        part = slice(w.first[lo], w.first[min(lo + block, len(toxic))])
        key = np.unique((w.doc[part] - lo) * np.int64(len(v.word)) + v.ids[part])
        of_doc, of_word = key // len(v.word), key % len(v.word)
        at, bucket = buckets_of(of_word)
        pair = np.unique(of_doc[at] * np.int64(BUCKETS) + bucket)
        bad = toxic[lo + pair // BUCKETS]
        a += np.bincount(pair[bad] % BUCKETS, minlength=BUCKETS)
        b += np.bincount(pair[~bad] % BUCKETS, minlength=BUCKETS)
    value = np.log((a + 0.5) / (toxic.sum() + 1)) - np.log((b + 0.5) / ((~toxic).sum() + 1))
    return np.where(a + b >= 4, np.clip(value, -1, 5), 0).astype(np.float32)


def train(texts: list[str], toxic: np.ndarray, seed: int = 5) -> Network:
    """Fit on whole texts and their labels; windows of toxic texts are chosen as described above."""
    rng = np.random.default_rng(seed)
    column = pa.array(texts, pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64)[: len(texts) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[: off[-1]]
    w = pieces(data, off)
    v = vocabulary(data, w)
    doc, start = windows_of(w.counts, w.first)
    rows, mask = _rows(w.first, w.counts, doc, start, v.ids, len(v.word))
    net = Network(seed)
    for name, at in (("word", lambda of_word: (np.arange(len(of_word)), v.word[of_word])), ("gram", lambda of_word: _grams_of(v, of_word))):
        net.p[name][:, 0] = _log_odds(w, v, toxic, at) / 4
    each = net.embed(v)
    value = np.append(np.maximum(each[:, 0], 0) + np.maximum(each[:, EMBED], 0), 0)
    first_of = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    value = (value * value).astype(np.float32)
    ranking = np.partition(value[rows], T - 3, axis=1)[:, -3:].sum(1)
    m, s2 = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}
    step = 0
    for r in range(ROUNDS):
        order = np.lexsort((-ranking, doc))
        top = order[first_of]  # the highest window of each document
        positive = top[toxic[doc[top]]]
        # toxic documents without any evidence so far would teach their accidental words
        floor = 0.2 * np.median(ranking[positive])
        positive = positive[ranking[positive] >= floor]
        second = order[np.minimum(first_of + 1, len(order) - 1)]
        second = second[toxic[doc[second]] & (ranking[second] > 0.7 * np.median(ranking[positive]))]
        positive = np.concatenate([positive, second])
        clean = np.flatnonzero(~toxic[doc])
        hard = clean[np.argsort(-ranking[clean], kind="stable")[: max(64, len(positive))]]
        for _ in range(STEPS):
            half = BATCH // 2
            pick = np.concatenate([rng.choice(positive, half), rng.choice(clean, half), rng.choice(hard, half)])
            sub, back = _part(v, rows[pick])
            known = (rng.random(len(sub.word)) > HIDE).astype(np.float32)
            g = net.gradients(np.ascontiguousarray(back.T), mask[pick].T, sub, toxic[doc[pick]].astype(np.float32), known)
            step += 1
            for k, x in net.p.items():
                m[k] += 0.1 * (g[k] - m[k])
                s2[k] += 0.01 * (g[k] * g[k] - s2[k])
                x -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s2[k] / (1 - 0.99**step)) + 1e-6)
        if r + 1 < ROUNDS:
            ranking = net.scores(rows, mask, v)
    return net


def fitting(chars: np.ndarray, most: int) -> np.ndarray:
    """Which texts to take, in order, so that they have ``most`` characters together: one that does not fit is passed over,
    later ones are not; if none fits, the shortest is taken, so that a label with texts is never without one."""
    keep, total = np.zeros(len(chars), bool), 0
    for k, n in enumerate(chars):
        if total + n <= most:
            keep[k], total = True, total + n
    if len(chars) and not keep.any():
        keep[int(np.argmin(chars))] = True
    return keep


def learn(docs: DataFrame, labels: DataFrame) -> Network | None:
    """Train on the labelled rows of ``docs``; None where one of the two labels is absent."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    known = known.withColumn("place", F.crc32(F.concat_ws("/", F.lit("t"), F.col("doc_id").cast("string")).cast("binary")))
    first = F.struct(F.xxhash64("text").alias("key"), F.char_length("text").alias("chars"))
    ids = docs.filter(F.col("text").rlike(r"\S")).groupBy("doc_id").agg(F.min(first).alias("one")).join(known, "doc_id")
    ids = ids.select("doc_id", "toxic", "place", "one.key", "one.chars")
    rows = []
    for is_toxic, most in ((True, SAMPLE_TOXIC), (False, SAMPLE_CLEAN)):
        some = ids.filter(F.col("toxic") == is_toxic).orderBy("place", "doc_id").limit(most).toPandas()
        rows.append(some[fitting(some["chars"].to_numpy(), SAMPLE_CHARS)])
    chosen = pd.concat(rows)
    if not len(chosen):
        return None
    sample = spark.createDataFrame(chosen[["doc_id", "toxic", "key"]])
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").filter(F.xxhash64("text") == F.col("key"))
    got = texts.dropDuplicates(["doc_id", "key"]).toPandas().sort_values("doc_id", kind="stable")
    toxic = got["toxic"].to_numpy(bool)
    if not toxic.any() or toxic.all():
        return None
    return train(got["text"].to_list(), toxic)


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network()
        if sent is not None:
            net.p = sent.value
        for batch in batches:
            for lo, hi, data, off in slices(batch.column("text"), 2 << 20):
                w = pieces(data, off)
                score = np.zeros(hi - lo)
                n_windows = np.zeros(hi - lo, np.int64)
                if len(w.start) and sent is not None:
                    v = vocabulary(data, w)
                    doc, start = windows_of(w.counts, w.first)
                    rows, mask = _rows(w.first, w.counts, doc, start, v.ids, len(v.word))
                    np.maximum.at(score, doc, net.scores(rows, mask, v).astype(float))
                    n_windows = np.bincount(doc, minlength=hi - lo)
                ids, held = batch.column("doc_id").slice(lo, hi - lo), batch.column("held_out").slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([ids, held, pa.array(score), pa.array((score >= CUT).astype(np.int32)), pa.array(n_windows)], ["doc_id", "held_out", "score", "predicted", "n_windows"])

    return run


def score_documents(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, score, predicted and n_windows of each row of ``docs``."""
    ship(docs.sparkSession)
    sent = None if net is None else docs.sparkSession.sparkContext.broadcast(net.p)
    return docs.select("doc_id", "held_out", "text").mapInArrow(_score(sent), "doc_id long, held_out boolean, score double, predicted int, n_windows long")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id"), 3) == 1)
    return score_documents(docs, learn(docs.filter(~F.col("held_out")), table(spark, sf_dir, "labels")))
