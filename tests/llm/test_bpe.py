import hashlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from linecraft.llm import bpe
from linecraft.llm.queries import QUERIES

PATH = public_tokenizers.path(bpe.FILE)
ODD = [
    None, "", " \t\n", "a", "İstanbul ǅ ß ſ K", "é e ́", "don't WE'LL 'S", "x y z　", "<|startoftext|>a<|endoftext|>b<|endof", "<|<|startoftext|>|>",
    "a\x1cb\x85c", "\x00\x00", "🎉🎉👩‍👩‍👧", "a" * 5000, "ab" * 3000 + "é" * 1000, "123 4５ Ⅷ", "한국어 中文 ไทย", "</w> w> </w</w>", "ΣΑΣ", "...---!!!" * 50,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as f:
        return bpe.Vocabulary(f.read())


def plain(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    out = library.decode(ids, skip_special_tokens=False)
    return len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), out))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("abcdehilnorst'ZÉéß1 9!?.ñ世́ "), min_size=1, max_size=25), min_size=1, max_size=8))
def test_chunks(library, vocabulary, chunks):
    tokens, first = vocabulary.encode_chunks(chunks)
    for k, chunk in enumerate(chunks):
        assert tokens[first[k] : first[k + 1]].tolist() == library.encode(chunk, add_special_tokens=False).ids


def test_pairs(vocabulary):
    """The check of a pair agrees with merging its units, for random pairs and for pairs of frequent tokens."""
    rng = np.random.default_rng(1)
    plain_tokens = np.array([i for i, n in enumerate(vocabulary.names.to_pylist()) if not n.endswith("</w>") and i < 49406])
    ends = np.setdiff1d(np.arange(49406), plain_tokens)
    a = np.concatenate([rng.choice(plain_tokens, 3000), rng.choice(plain_tokens[:600], 3000)])
    b = np.concatenate([rng.choice(ends, 3000), rng.choice(ends[:600], 3000)])

    def units(t):
        return [t] if vocabulary.left[t] < 0 else units(vocabulary.left[t]) + units(vocabulary.right[t])

    parts = [units(x) + units(y) for x, y in zip(a, b, strict=True)]
    tokens, word = vocabulary.merge(np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts]))
    kept = [tokens[word == k].tolist() == [a[k], b[k]] for k in range(len(parts))]
    assert vocabulary.meet(a, b).tolist() == kept and 0 < sum(kept) < len(kept)


def test_proposals_fail_and_are_mended(vocabulary, library):
    words = "theren undoable mississippi unhappiness thtionoues erreoror whererst ingeaing".split()
    units, first = vocabulary.units(words)
    tokens, word = vocabulary.longest(units, first)
    greedy = [tokens[word == k].tolist() for k in range(len(words))]
    want = [library.encode(w, add_special_tokens=False).ids for w in words]
    assert greedy != want
    tokens, first = vocabulary.encode_words(words)
    assert [tokens[first[k] : first[k + 1]].tolist() for k in range(len(words))] == want


@pytest.mark.parametrize("most", [bpe.SLICE, 40])
def test_odd_rows(spark, library, monkeypatch, most):
    monkeypatch.setattr(bpe.row_slices, "__defaults__", (most,))
    monkeypatch.setattr(bpe, "MEMORY", most)
    rows = [(k, t, "x", [k]) for k, t in enumerate([*ODD, ODD[4], ODD[4]])] + [(None, "no id", "y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids array<int>").repartition(3)
    found = bpe.decode(bpe.encode(docs, PATH, decoded="decoded"), PATH, "ids_", "again")
    assert found.columns == ["doc_id", "text", "decoded", "ids", "ids_", "decoded_", "again"]
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids_ == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded_ == r.again == library.decode(r.ids_, skip_special_tokens=False)
        assert r.decoded == ("x" if r.doc_id is not None else "y")


def test_decode_of_odd_ids(spark, library):
    rows = [(1, None), (2, []), (3, [49407, -1, 320, None, 60000, 49406])]
    got = bpe.decode(spark.createDataFrame(rows, "k int, ids array<int>"), PATH).orderBy("k").collect()
    assert [r.decoded for r in got] == ["", "", library.decode([49407, 320, 49406], skip_special_tokens=False)]


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op13_bpe"](spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_query(spark, sf_dir, library):
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pandas()
    got = {r.doc_id: r[1:] for r in QUERIES["op13_bpe"](spark, sf_dir).collect()}
    assert got == {i: plain(library, t) for i, t in zip(docs["doc_id"], docs["text"], strict=True)}


def test_other_vocabularies_are_refused():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f, pytest.raises(ValueError):
        bpe.Vocabulary(f.read())
