import collections
import hashlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from linecraft.llm import crosstoken
from linecraft.llm.queries import QUERIES

A, B = public_tokenizers.path(crosstoken.A_FILE), public_tokenizers.path(crosstoken.B_FILE)
ODD = [
    None, "", " ", "\n", " \n", "a ", "a\r\nb", ";\r\n x", " \r a", "\t\tif x:\n\t\t\treturn 1;\r\n", "x y 　z\x85 w\x1c v", "a▁b", "fine ▁ text", "the end\n\n\nof  it  ", "<|endoftext|> <s> </s> <unk> <0x41>",
    "don't we'll 'S", "日本語 のテキスト", "🎉🎉 party👩‍👩‍👧", "\x00 a\x00", "é é", "word " * 3000, "x" * 4000, "plain text with words the end", "plain text with words the end",
]


@pytest.fixture(scope="module")
def library():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


@pytest.fixture(scope="module")
def tools():
    both = crosstoken.Tokenisers(open(A, "rb").read(), open(B, "rb").read())
    return both, crosstoken.Splitter(both)


def plain_groups(tools, library, text):
    """Groups of A and B ids of a whole text, and the linked pairs."""
    if not text:
        return [], []
    a, b = library[0].encode(" " + text, add_special_tokens=False).ids, library[1].encode(text)
    ta, tb = ([side[i].as_py() for i in ids] for side, ids in zip(tools[0].bytes, (a, b), strict=True))
    if b"".join(ta) != (" " + text).encode() or b"".join(tb) != (" " + text).encode():
        return [], []
    groups, links, i, j = [], [], 0, 0
    while i < len(a):
        ga, gb, x, y = [a[i]], [b[j]], len(ta[i]), len(tb[j])
        while x != y:
            if x < y:
                i += 1
                ga.append(a[i])
                x += len(ta[i])
            else:
                j += 1
                gb.append(b[j])
                y += len(tb[j])
        groups.append((ga, gb))
        links.append((a[i], b[j]))
        i, j = i + 1, j + 1
    assert j == len(b)
    return groups, links


def plain(tools, library, texts):
    found = [plain_groups(tools, library, t) for t in texts]
    count = collections.Counter(p for _, links in found for p in links)
    best = collections.defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    for groups, links in found:
        line = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        yield (
            sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
            sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(line.encode()).hexdigest() if line else "",
        )


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab;.'s t1é世 \n\t\r\x0b 　\u2003\u1680\x85\xa0à\x1c"), max_size=40))
def test_segments_do_not_see_each_other(tools, library, text):
    segments = tools[1](text)
    assert "".join(segments) == (" " + text if text else "")
    if not text:
        return
    ids = [i for e in tools[0].a.encode_batch(segments, add_special_tokens=False) for i in e.ids]
    assert ids == library[0].encode(" " + text, add_special_tokens=False).ids
    assert [i for x in tools[0].pieces(segments) for i in x] == library[1].encode(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**30)))
def test_pack(values):
    raw, first = crosstoken.pack(np.array(values, np.int64))
    back, stop = crosstoken.unpack(raw)
    assert back.tolist() == values and stop.tolist() == first[1:].tolist()


def test_starts_come_from_the_vocabularies(tools):
    assert set(tools[1].starts) == set(" \t\n\x0b\x0c")  # side B has tokens such as ;\r
    assert tools[1]("a b\n c\rd  e\n") == [" a", " b", "\n c\rd", "  e", "\n"]


@pytest.mark.parametrize("chunk", [crosstoken.CHUNK, 60])
def test_odd_rows(spark, tools, library, chunk):
    rows = [(k, t, "x", 1, 2) for k, t in enumerate(ODD)] + [(None, "no id", None, None, None), (3, "shared id", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, segment string, n long, groups long").repartition(3)
    got = crosstoken.align(docs, A, B, chunk).selectExpr("doc_id", "n_a", "n_b", "n_groups", "n_groups AS n_links", "n_best", "count_sum", "IF(n_a > 0, sha2(groups, 256), '') AS groups_sha256").collect()
    want = [(r[0], *w) for r, w in zip(rows, plain(tools, library, [r[1] for r in rows]), strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    zero = {r.doc_id for r in got if not r.n_a}
    assert zero == {0, 1, 11, 12}


def test_query(spark, sf_dir, tools, library):
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pandas()
    got = {r.doc_id: tuple(r[n] for n in NAMES) for r in QUERIES["op12_cross_tokenizer"](spark, sf_dir).collect()}
    assert got == dict(zip(docs["doc_id"], plain(tools, library, docs["text"]), strict=True))


def test_empty(spark):
    out = crosstoken.align(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert out.count() == 0
    only_null = crosstoken.align(spark.createDataFrame([(1, None)], "doc_id long, text string"), A, B).collect()
    assert [tuple(r) for r in only_null] == [(1, 0, 0, 0, 0, 0, "")]
