"""Language identification by rank-order profiles of letter n-grams.

Words are runs of letters, lower-cased and padded with one blank on each side; n-grams of one to
three characters are taken from the padded words.  The profile of a language ranks the most frequent
n-grams of all its training texts, the profile of a document those of its whole text.  The
out-of-place distance sums, over the document's profile, how far each n-gram's rank is from its rank
in the language's profile (the profile's length where it is absent); the nearest language wins.

Defined cases: a null text or one without a letter gives ``und`` with score 0, as does every text
when no language was learned; rows with a null language teach nothing; ties between n-grams are
broken by code point, ties between languages by name; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fold, ship, table
from .textops import slices

#: N-grams in a profile.
LENGTH = 400
BLANK, NONE = 0x20, 0


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _grams(texts: list[str], group: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, packed code, count) of the distinct n-grams of each group of texts, and the alphabet.

    A packed code is ((a * A) + b) * A + c over positions in the sorted alphabet of these texts, of
    size A; 0 stands for no character.  Codes are ascending within a group.
    """
    low = [t.lower() for t in texts]
    code = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(group, [len(t) + 1 for t in low])
    owner = np.concatenate([owner[:1], owner])
    letter = _letters()[code]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    code, letter, owner = np.where(letter, code, BLANK)[keep], letter[keep], owner[keep]
    seen = np.zeros(0x110000, bool)
    seen[code] = True
    alphabet = np.concatenate([[NONE], np.flatnonzero(seen)])
    at = np.zeros(0x110000, np.int64)
    at[alphabet] = np.arange(len(alphabet))
    c, a = at[code], len(alphabet)
    two_owner = np.where(letter[:-1], owner[:-1], owner[1:])
    mid = letter[1:-1]
    key = np.concatenate([
        owner[letter] * a**3 + c[letter] * (a * a),
        two_owner * a**3 + c[:-1] * (a * a) + c[1:] * a,
        (owner[1:-1] * a**3 + c[:-2] * (a * a) + c[1:-1] * a + c[2:])[mid],
    ])
    key.sort()
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(key)))
    key = key[new]
    return key // a**3, key % a**3, count, alphabet


def _texts(column: pa.Array, lo: int, hi: int) -> list[str]:
    return [t or "" for t in column.slice(lo, hi - lo).to_pylist()]


def _code_points(gram: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    a = len(alphabet)
    return (alphabet[gram // (a * a)] << 42) | (alphabet[gram // a % a] << 21) | alphabet[gram % a]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        text, lang = batch.column("text"), batch.column("lang").to_pylist()
        for lo, hi, _, _ in slices(text):
            names = sorted(set(lang[lo:hi]))
            index = {x: i for i, x in enumerate(names)}
            group, gram, count, alphabet = _grams(_texts(text, lo, hi), np.array([index[x] for x in lang[lo:hi]]), len(names))
            packed = _code_points(gram, alphabet)
            for i, name in enumerate(names):
                mine = group == i
                was = total.get(name, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                keys, back = np.unique(np.concatenate([was[0], packed[mine]]), return_inverse=True)
                total[name] = keys, np.bincount(back, np.concatenate([was[1], count[mine]]), len(keys)).astype(np.int64)
    for name, (keys, counts) in total.items():
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys)), pa.array(keys), pa.array(counts)], ["lang", "gram", "n"])


def learn_profiles(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """lang, gram (code points packed in 21 bits each), rank from 0; ``length`` rows a language at most."""
    ship(docs.sparkSession)
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    return counts.withColumn("rank", place - 1).filter(F.col("rank") < length).select("lang", "gram", "rank")


def _nearest(profiles, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, grams, ranks = profiles.value
        parts = [grams >> 42, grams >> 21 & 0x1FFFFF, grams & 0x1FFFFF]
        for batch in batches:
            text = batch.column("text")
            pred, score = np.full(len(text), "und", object), np.zeros(len(text))
            for lo, hi, _, _ in slices(text) if len(names) else ():
                n = hi - lo
                doc, gram, count, alphabet = _grams(_texts(text, lo, hi), np.arange(n), n)
                top = int(count.max(initial=0)) + 1
                order = np.argsort(doc * top + (top - 1 - count), kind="stable")
                doc, gram = doc[order], gram[order]
                rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
                head = rank < length
                doc, gram, rank = doc[head], gram[head], rank[head]
                at = np.full(0x110000, -1, np.int64)
                at[alphabet] = np.arange(len(alphabet))
                a, b, c = (at[x] for x in parts)
                known = np.flatnonzero((a >= 0) & (b >= 0) & (c >= 0))
                code = ((a * len(alphabet) + b) * len(alphabet) + c)[known]
                by = np.argsort(code)
                code, known = code[by], known[by]
                far = np.bincount(doc, minlength=n)[:, None] * np.full(len(names), float(length))
                if len(code):
                    place = np.minimum(np.searchsorted(code, gram), len(code) - 1)
                    hit = code[place] == gram
                    cost = np.abs(ranks[known[place[hit]]] - rank[hit, None])
                    cost = np.where(ranks[known[place[hit]]] >= length, 0, cost - length)
                    for k in range(len(names)):
                        far[:, k] += np.bincount(doc[hit], cost[:, k], n)
                used = np.bincount(doc, minlength=n)
                best = far.argmin(1)
                some = used > 0
                pred[lo:hi][some] = names[best[some]]
                score[lo:hi][some] = np.clip(1 - far[np.arange(n), best][some] / (length * used[some]), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(pred.tolist(), pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, profiles: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, held_out, lang_pred, score for ``docs`` (doc_id, held_out, text).

    The profiles are broadcast: ``length`` rows for each of the languages, whose number is a property
    of the label set and not of the corpus.
    """
    ship(docs.sparkSession)
    rows = profiles.toPandas()
    names = np.array(sorted(rows["lang"].unique()), object)
    grams = np.unique(rows["gram"].to_numpy(np.int64)) if len(rows) else np.zeros(0, np.int64)
    ranks = np.full((len(grams), len(names)), length, np.int64)
    for k, name in enumerate(names):
        mine = rows[rows["lang"] == name]
        ranks[np.searchsorted(grams, mine["gram"].to_numpy(np.int64)), k] = mine["rank"].to_numpy(np.int64)
    sent = docs.sparkSession.sparkContext.broadcast((names, grams, ranks))
    return docs.select("doc_id", "held_out", "text").mapInArrow(_nearest(sent, length), "doc_id long, held_out boolean, lang_pred string, score double")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id"), 5) == 0)
    return identify(docs, learn_profiles(docs.filter(~F.col("held_out"))))
