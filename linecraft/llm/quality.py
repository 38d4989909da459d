"""Quality rules by sequence labelling of lines.

A linear-chain conditional random field labels each line of a document content or boilerplate from
features of the line; Viterbi decoding gives the most likely sequence.  A document is kept if the
words of its content lines are at least ``SHARE`` of its words and it passes the base rules (20
words or more; at most 30 % of its words inside repeated 8-word windows).

The field learns from documents that are labelled good or bad as a whole: all lines of a good one
are content; lines of a bad one start as boilerplate and are then relabelled by the fitted field, at
least one line of each staying boilerplate.  It is fitted on the driver from line features of a
bounded sample: labelled documents, however long, are cut into sequences of at most ``RUN`` lines,
and of the sequences of ``SAMPLE`` documents ``SAMPLE`` are taken by the hash of document and place.
The features, the decoding and the counts cover every document and whole texts.

Defined cases: null and empty texts have no words and are not kept; equal rows are judged alike;
without labels every line is content, so that the base rules decide alone; further columns are
carried by ``label_documents`` only as far as named.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table
from .textops import Hasher, lines, per_doc, shingles, slices, words

SAMPLE, RUN, SHARE = 3000, 64, 0.5
MIN_WORDS, WINDOW = 20, 8


def _set(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_SYMBOL, _PIPE, _SHOUT = _set("#*$%&|<>"), _set("|"), _set("!")
_UPPER, _LETTER, _DIGIT = _set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), _set("0123456789")
_STOP = _set(".?!:;,")
#: One column of the line features each.
FEATURES = ("bias", "symbols", "pipes", "upper", "shouts", "digits", "repeated line", "repeated words", "doubled words", "word length", "words", "stop")


@dataclass
class Measured:
    base: dict[str, np.ndarray]
    features: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    line_words: np.ndarray


def measure(data: np.ndarray, off: np.ndarray) -> Measured:
    """Base counts of each document and the features of each of its lines that has a word."""
    n = len(off) - 1
    w, ln, hasher = words(data, off), lines(data, off), Hasher(data, lower=False)
    def at(flags: np.ndarray) -> np.ndarray:
        out = np.zeros(len(flags) + 1, np.int32 if len(flags) < 1 << 30 else np.int64)
        np.cumsum(flags, out=out[1:])
        return out

    lead = at((data & 0xC0) != 0x80)
    chars = per_doc(lead[w.end] - lead[w.start], w.first)
    word = hasher(w.start, w.end)
    h, doc = shingles(word, w, WINDOW)
    full = w.counts[doc] >= WINDOW
    h, doc = h[full], doc[full]
    order = np.lexsort((h, doc))
    same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    start = np.arange(len(h)) - np.searchsorted(doc, doc) + w.first[doc] if len(h) else np.zeros(0, np.int64)
    cover = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(cover, start[twice], 1)
    np.add.at(cover, start[twice] + WINDOW, -1)
    repeated = np.cumsum(cover)[:-1] > 0
    # lines with a word
    a, b = np.searchsorted(w.start, ln.start), np.searchsorted(w.start, ln.end)
    has = b > a
    l_start, l_end, l_doc, a, b = ln.start[has], ln.end[has], ln.doc[has], a[has], b[has]
    lh = hasher(l_start, l_end)
    order = np.lexsort((np.arange(len(lh)), lh, l_doc))
    again = np.zeros(len(lh), bool)
    if len(lh):
        again[order[1:]] = (lh[order][1:] == lh[order][:-1]) & (l_doc[order][1:] == l_doc[order][:-1])
    n_words = (b - a).astype(float)
    in_words = at(lead[w.end] - lead[w.start])  # code points of words, by word
    l_chars = np.maximum(in_words[b] - in_words[a], 1).astype(float)
    part = lambda table_: (lambda c: (c[l_end] - c[l_start]).astype(float))(at(table_[data]))
    rep, twin = at(repeated), at(np.concatenate([[False], word[1:] == word[:-1]])[: len(word)])
    last = w.end[b - 1] - 1 if len(b) else np.zeros(0, np.int64)
    features = np.stack([
        np.ones(len(lh)),
        np.minimum(part(_SYMBOL) / l_chars * 4, 1),
        np.minimum(part(_PIPE) / n_words * 2, 1),
        part(_UPPER) / np.maximum(part(_LETTER), 1),
        np.minimum(part(_SHOUT) / n_words, 1),
        np.minimum(part(_DIGIT) / l_chars * 2, 1),
        again.astype(float),
        (rep[b] - rep[a]) / n_words,
        np.minimum((twin[b] - twin[np.minimum(a + 1, b)]) / n_words * 2, 1),
        np.minimum(l_chars / n_words / 12, 2),
        np.log1p(n_words) / 6,
        _STOP[data[last]].astype(float),
    ], axis=1) if len(lh) else np.zeros((0, len(FEATURES)))
    base = {
        "n_words": w.counts,
        "word_chars": chars,
        "n_symbols": per_doc(_SYMBOL[data], off),
        "n_dup_lines": np.bincount(l_doc[again], minlength=n),
        "n_repeat_words": per_doc(repeated, w.first),
    }
    return Measured(base, features, l_doc, np.searchsorted(l_doc, np.arange(n + 1)), b - a)


@dataclass
class Field:
    """Scores of boilerplate against content: of the features, of the first line, of neighbours."""

    weight: np.ndarray
    start: np.ndarray
    move: np.ndarray

    @classmethod
    def content_only(cls) -> Field:
        weight = np.zeros(len(FEATURES))
        weight[0] = -1.0
        return cls(weight, np.zeros(2), np.zeros((2, 2)))


def _rows(first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each position, the documents that have it (longest first) and the index of that line."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    sizes = length[order]
    for t in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -t, "left"))
        yield order[:n], first[order[:n]] + t


def viterbi(field: Field, features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The most likely label (1: boilerplate) of each line."""
    score = np.stack([np.zeros(len(features)), features @ field.weight], axis=1)
    label = np.zeros(len(features), np.int8)
    best = np.zeros((len(first) - 1, 2))
    steps, back = list(_rows(first)), []
    for t, (doc, line) in enumerate(steps):
        if t == 0:
            best[doc] = field.start + score[line]
            continue
        ways = best[doc][:, :, None] + field.move
        come = ways.argmax(1).astype(np.int8)
        back.append(come)
        best[doc] = ways.max(1) + score[line]
    state = best.argmax(1).astype(np.int8)
    length = np.diff(first)
    for t in range(len(steps) - 1, -1, -1):
        doc, line = steps[t]
        label[line] = state[doc]
        if t:
            state[doc] = back[t - 1][np.arange(len(doc)), state[doc]]
    assert len(length) == len(best)
    return label


def fit(features: np.ndarray, first: np.ndarray, bad: np.ndarray, rounds: int = 4, steps: int = 200) -> Field:
    """Maximise the likelihood of the line labels, relabelling the lines of bad documents in between.

    The first rounds leave the chain out: while whole documents bear one label, neighbours agree by
    construction and would teach the field to copy the label of the line before.
    """
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    label = bad[doc].astype(np.int8)
    field = Field(np.zeros(features.shape[1]), np.zeros(2), np.zeros((2, 2)))
    for r in range(rounds):
        field = _climb(features, first, label, steps, chain=r >= 2)
        if r + 1 < rounds:
            new = viterbi(field, features, first)
            raw = features @ field.weight
            order = np.lexsort((-raw, doc))
            worst = order[np.concatenate([[True], doc[order][1:] != doc[order][:-1]])] if len(order) else order
            new[worst] = 1
            label = np.where(bad[doc], new, 0).astype(np.int8)
    return field


def _climb(features: np.ndarray, first: np.ndarray, label: np.ndarray, steps: int, chain: bool) -> Field:
    n_lines, dim = features.shape
    theta, m, v = np.zeros(dim + 6), np.zeros(dim + 6), np.zeros(dim + 6)
    rows = list(_rows(first)) if chain else []
    follows = np.ones(n_lines, bool)
    follows[first[:-1][np.diff(first) > 0]] = False
    after = np.flatnonzero(follows)
    seen_move = np.zeros((2, 2))
    np.add.at(seen_move, (label[after - 1], label[after]), 1)
    seen_start = np.bincount(label[~follows], minlength=2)[:2]
    seen_weight = features.T @ label
    lse = lambda x, axis: np.logaddexp(np.take(x, 0, axis), np.take(x, 1, axis))
    for k in range(1, steps + 1):
        weight, start, move = theta[:dim], theta[dim : dim + 2], theta[dim + 2 :].reshape(2, 2)
        score = np.stack([np.zeros(n_lines), features @ weight], axis=1)
        alpha, beta = score.copy(), np.zeros((n_lines, 2))
        for t, (_, line) in enumerate(rows):
            alpha[line] = score[line] + (start if t == 0 else lse(alpha[line - 1][:, :, None] + move, 1))
        for t in range(len(rows) - 1, 0, -1):
            line = rows[t][1]
            beta[line - 1] = lse(move[None] + (score[line] + beta[line])[:, None, :], 2)
        total = lse(alpha + beta, 1)
        p = np.exp(alpha + beta - total[:, None])
        pair = np.exp(alpha[after - 1][:, :, None] + move + (score[after] + beta[after])[:, None, :] - total[after][:, None, None])
        grad = np.concatenate([seen_weight - features.T @ p[:, 1], (seen_start - p[~follows].sum(0)) * chain, (seen_move - pair.sum(0)).ravel() * chain]) / max(n_lines, 1) - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Field(theta[:dim], theta[dim : dim + 2], theta[dim + 2 :].reshape(2, 2))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, off in slices(batch.column("text")):
            found = measure(data, off)
            ids, bad = batch.column("doc_id").slice(lo, hi - lo), batch.column("bad").slice(lo, hi - lo)
            runs = [(doc, k, found.features[x : min(x + RUN, b)].ravel()) for doc, (a, b) in enumerate(zip(found.first[:-1], found.first[1:], strict=True)) for k, x in enumerate(range(a, b, RUN))]
            for at in range(0, len(runs), 4096):
                doc, place, rows = zip(*runs[at : at + 4096], strict=True)
                of = pa.array(doc, pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(of), pa.array(place, pa.int32()), bad.take(of), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "place", "bad", "f"])


def learn_field(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """Fit the field on ``sample`` sequences of lines of as many labelled documents, chosen by hash."""
    ship(docs.sparkSession)
    chosen = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    chosen = chosen.orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(sample)
    runs = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(_features, "doc_id long, place int, bad boolean, f array<double>")
    by = F.crc32(F.concat_ws("/", F.col("doc_id").cast("string"), "place").cast("binary"))
    rows = runs.orderBy(by, "doc_id", "place", "f").limit(sample).toPandas().sort_values(["doc_id", "place"], kind="stable")
    if not len(rows):
        return Field.content_only()
    sizes = np.array([len(x) // len(FEATURES) for x in rows["f"]])
    features = np.concatenate(rows["f"].to_list()).reshape(-1, len(FEATURES))
    return fit(features, np.concatenate([[0], np.cumsum(sizes)]), rows["bad"].to_numpy(bool))


def _label(field: Field, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in slices(batch.column("text")):
                found = measure(data, off)
                label = viterbi(field, found.features, found.first)
                b = found.base
                content = np.bincount(found.doc, found.line_words * (label == 0), hi - lo)
                failed = (b["n_words"] < MIN_WORDS) | (100 * b["n_repeat_words"] > 30 * b["n_words"])
                part = content / np.maximum(b["n_words"], 1)
                kept = ~failed & (part >= share)
                n_lines = np.diff(found.first)
                junk = np.bincount(found.doc, label, hi - lo).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), *(pa.array(b[k].astype(np.int64)) for k in b), pa.array(failed), pa.array(kept), pa.array(n_lines.astype(np.int64)), pa.array(junk), pa.array(part)],
                    ["doc_id", *b, "base_failed", "kept", "n_lines", "n_boilerplate_lines", "content_share"],
                )

    return run


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_boilerplate_lines long, content_share double"


def label_documents(docs: DataFrame, field: Field, share: float = SHARE) -> DataFrame:
    """The base counts, the verdict and the labelled lines' counts of each document."""
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_label(field, share), SCHEMA)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return label_documents(docs, learn_field(docs, table(spark, sf_dir, "labels")))


def _kept(field: Field, share: float):
    label = _label(field, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array(np.arange(batch.num_rows))
            rows = pa.RecordBatch.from_arrays([ids, batch.column("text")], ["doc_id", "text"])
            kept = [x.column("kept") for x in label(iter([rows]))]
            yield batch.filter(pa.concat_arrays(kept)) if kept else batch

    return run


def keep_good(docs: DataFrame, field: Field, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    ship(docs.sparkSession)
    return docs.mapInArrow(_kept(field, share), docs.schema)
