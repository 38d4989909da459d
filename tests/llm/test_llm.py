import collections
import hashlib
import itertools
import os
import shutil
import sys
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from comparing import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from linecraft.llm import ctw, decontam, jaccard, language, mixing, quality, repeats, toxicity
from linecraft.llm.queries import ORACLE_SQL, QUERIES
from linecraft.llm.suffixarray import common_prefixes, suffix_array

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    for c in SPACE:
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


@pytest.fixture(scope="session")
def docs(sf_dir):
    return pq.read_table(f"{sf_dir}/documents.parquet").to_pandas()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_suffix_array(values):
    t = np.array([*values, 0])
    sa = suffix_array(t)
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    phi, plcp = common_prefixes(t.astype(np.uint8), np.full(len(t), len(t)), sa)
    for i in range(len(t)):
        if phi[i] >= 0:
            a, b = t[i:].tolist(), t[phi[i] :].tolist()
            assert plcp[i] == len(os.path.commonprefix([a, b]))


def test_suffix_array_steps():
    """A long string with deep repeats is sorted by whole arrays: far fewer Python lines run than it has symbols."""
    rng = np.random.default_rng(3)
    passage = rng.integers(2, 9, 3000)
    t = np.concatenate([x for _ in range(8) for x in (passage[: int(rng.integers(1000, 3000))], rng.integers(2, 9, 50), [1])] + [np.tile([3, 2, 2], 400), [0]])
    lines = 0

    def count(frame, event, arg):
        nonlocal lines
        lines += event == "line"
        return count

    before = sys.gettrace()
    sys.settrace(count)
    try:
        sa = suffix_array(t)
    finally:
        sys.settrace(before)
    raw = t.astype(np.uint8).tobytes()
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: raw[i:])
    assert lines < len(t)


def plain_repeats(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        yield len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()


@pytest.mark.parametrize("most", [2000, 2])
def test_repeats(spark, monkeypatch, most):
    """Both the suffix arrays and the parts and windows of large groups give the plain result."""
    monkeypatch.setattr(repeats, "SHARD_SEGMENTS", most)
    rng = np.random.default_rng(5)
    draw = lambda n, k: bytes(rng.integers(97, 97 + k, n, dtype=np.uint8)).decode()
    passage, other = draw(90, 20), draw(60, 20)
    texts = [draw(30, 20) + passage + draw(int(n), 20) for n in rng.integers(5, 60, 12)]
    texts += [draw(50, 20) + other[:50] + draw(9, 20) + passage[20:80] for _ in range(4)]
    texts += ["a" * 120, "ab" * 60, draw(200, 2), texts[0], texts[0], None, "", "é" * 50 + passage, passage]
    data = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    got = repeats.repeats(spark.createDataFrame(data, "doc_id long, text string"), 40, 8).toPandas().sort_values("doc_id")
    want = list(plain_repeats([(t or "").encode() for t in texts], 40))
    assert list(got[["n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False, name=None)) == want


def test_ctw_is_exact(spark, monkeypatch):
    """Against the recursive definition, with some strings outside the broadcast."""
    monkeypatch.setattr(ctw, "HOT_STRINGS", 5)
    train, held = ["abracadabra abra", "banana", ""], ["abba x", None, "banana"]
    data = [(i, t in held, t) for i, t in enumerate(train + held[:2])]
    got = ctw.score_by_flag(spark.createDataFrame(data, "doc_id long, held_out boolean, text string")).toPandas().set_index("doc_id")
    bits = [(tuple(([0] * ctw.DEPTH + list(t.encode()) + [0])[i : i + ctw.DEPTH][::-1]), b) for d, h, t in data if not h for i, b in enumerate(t.encode() + b"\0")]

    def predict(context, node, k, seen, depth):
        """(weighted log probability of the counts, probability of a one)."""
        ones = sum(b >> (7 - k) & 1 for _, b in seen)
        zeros = len(seen) - ones
        from math import exp, lgamma, log

        own = lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(len(seen) + 1) - log(np.pi)
        kt = (ones + 0.5) / (len(seen) + 1)
        if depth == ctw.DEPTH:
            return own, kt
        below, p = 0.0, 0.5
        for c in {s[0][depth] for s in seen} | {context[depth]}:
            w, q = predict(context, node, k, [s for s in seen if s[0][depth] == c], depth + 1)
            below += w
            if c == context[depth]:
                p = q
        share = exp(own) / (exp(own) + exp(below))
        return log((exp(own) + exp(below)) / 2), share * kt + (1 - share) * p

    for d, _, t in data:
        total, raw = 0.0, (t or "").encode()
        for i, b in enumerate(raw + b"\0"):
            context = ([0] * ctw.DEPTH + list(raw))[i : i + ctw.DEPTH][::-1]
            for k in range(8):
                node = [s for s in bits if s[1] >> (8 - k) == b >> (8 - k)]
                p = predict(context, b >> (8 - k), k, node, 0)[1]
                total += np.log10(p if b >> (7 - k) & 1 else 1 - p)
        assert got.loc[d, "score"] == pytest.approx(total, rel=1e-5)


def test_op2_base(spark, sf_dir, docs):
    got = QUERIES["op2_ctw"](spark, sf_dir).toPandas().set_index("doc_id")
    tokens = {i: [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in words(t)] + [None] for i, t in zip(docs["doc_id"], docs["text"], strict=True)}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = got.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
    assert (got["score"] < 0).all()


def test_op10_base(spark, sf_dir, docs):
    got = QUERIES["op10_quality"](spark, sf_dir).toPandas().set_index("doc_id")
    for i, text in zip(docs["doc_id"], docs["text"], strict=True):
        text = text or ""
        ws = words(text)
        windows = collections.Counter(tuple(ws[j : j + 8]) for j in range(len(ws) - 7))
        hit = {k for j in range(len(ws) - 7) if windows[tuple(ws[j : j + 8])] > 1 for k in range(j, j + 8)}
        lines, seen, dup = text.split("\n"), set(), 0
        for line in lines:
            dup += bool(words(line)) and line in seen
            seen.add(line)
        failed = len(ws) < 20 or 100 * len(hit) > 30 * len(ws)
        r = got.loc[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit), failed)
        assert not (failed and r.kept)


def test_op5_scattered_parts(spark):
    """Items whose parts lie far apart, among parts of others or not, beside short ones: SQL's rows."""
    rng = np.random.default_rng(3)
    draw = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    items = [draw(50) for _ in range(60)] + [["Three", "short", "words"], [], draw(12)]
    apart = [[*draw(9), *w[:17], *draw(300), *w[17:34], *draw(300), *w[34:]] for w in items[:60]]
    among = [[*draw(5), *w[:17], *items[i - 1][:30], *draw(300), *w[17:34], *items[i - 2][9:40], *draw(300), *w[34:], *items[i - 3][20:]] for i, w in enumerate(items[:60])]
    texts = [" ".join(w) for w in (*apart, *among, sum(items, []), sum(apart[:30], []), ["so", "THREE", "short\nwords"], items[0][:41], items[0][:40])]
    found = pd.DataFrame({"doc_id": pd.array([*range(len(texts)), 7, None, 900], "Int64"), "text": [*texts, texts[7], texts[8], None]})
    asked = pd.DataFrame({"item_id": pd.array([*range(len(items)), None, 901], "Int64"), "text": [*(" ".join(w) for w in items), " ".join(items[5]), None]})
    got = decontam.containment_search(*(spark.createDataFrame(x.astype(object).where(x.notna(), None), f"{c} long, text string") for x, c in ((found, "doc_id"), (asked, "item_id")))).toPandas()
    con = duckdb.connect()
    con.register("documents", found), con.register("benchmark", asked)
    want = con.execute(decontam.ORACLE).df()
    assert len(want) > 200 and rows(got) == rows(want)


def test_op6_mix(spark, sf_dir):
    a, b = (QUERIES["op6_mixing"](spark, sf_dir).toPandas() for _ in range(2))
    assert rows(a) == rows(b)
    assert (a["taken"] <= 3 * a["size"]).all() and (a["taken"] >= 0).all()
    by = a.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), largest=("size", "max"), told=("source_size", "first"))
    assert (by["size"] == by["told"]).all() and (by["target"] <= 3 * by["size"] + 1e-6).all()
    assert ((by["taken"] - by["target"]).abs() <= 0.02 * by["target"] + 2).all()  # ten documents a source


def test_learned_operators_hold_out(spark, sf_dir, docs):
    lang = QUERIES["op3_language"](spark, sf_dir).toPandas().merge(docs[["doc_id", "lang"]])
    lang = lang[lang["held_out"] & lang["lang"].notna()]
    assert (lang["lang_pred"] == lang["lang"]).mean() > 0.9
    # The smaller tables have too few toxic labels to learn from (under 40 for training at scale 0.01,
    # where recall was measured as 0.11).
    more = sf_dir.replace("sf0.001", "sf0.1")
    labels = pq.read_table(f"{more}/labels.parquet").to_pandas()
    tox = QUERIES["op1_toxicity"](spark, more).toPandas().merge(labels)
    held = tox[tox["held_out"]]
    # A good part of the toxic labels lies on texts without any abusive word, which no score from the
    # text can find; so the test asks for most of the others and for few false alarms.
    toxic, clean = (held[held["toxic"] == y]["score"] for y in (1, 0))
    assert (toxic >= 0.7).mean() >= 0.4 and (clean >= 0.7).mean() <= 0.02


def test_op1_reads_long_words_to_their_end(spark):
    """Abuse behind byte 40 of joined tokens that were never seen before is found."""
    rng = np.random.default_rng(8)
    filler = ["".join(rng.choice(list("abdefghiklmnoprstu"), int(n))) for n in rng.integers(3, 9, 300)]
    token = lambda end: "_".join([*rng.choice(filler, 12), *end, *rng.choice(filler, 2)])
    text = lambda bad: " ".join([*rng.choice(filler, 20), token(["zorkvyxq"] if bad else []), *rng.choice(filler, 20)])
    bad = [i % 3 == 0 for i in range(700)]
    data = [(i, i >= 500, text(b)) for i, b in enumerate(bad)]
    docs = spark.createDataFrame(data, "doc_id long, held_out boolean, text string")
    labels = spark.createDataFrame([(i, int(b)) for i, b in enumerate(bad[:500])], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, toxicity.learn(docs.filter("NOT held_out"), labels)).toPandas().sort_values("doc_id")
    hit, toxic = (got["score"] >= 0.7).to_numpy()[500:], np.array(bad[500:])
    assert hit[toxic].mean() >= 0.8 and hit[~toxic].mean() <= 0.1


def shingle_set(text, k):
    ws = [w.lower() for w in words(text)]
    return {tuple(ws[i : i + k]) for i in range(max(len(ws) - k + 1, 1))} if ws else set()


def plain_jaccard(data, k, percent):
    """Component of each row's id: rows of one id are one document."""
    sets = [shingle_set(t, k) for _, t in data]
    up = {i: i for i, _ in data}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, (i, _) in enumerate(data):
        for y, (j, _) in enumerate(data[:x]):
            if sets[x] and sets[y] and i != j and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i) if s else i) for (i, _), s in zip(data, sets, strict=True))


@pytest.mark.parametrize("limit", [jaccard.LIMIT, 900])
def test_jaccard_shared_ids_and_large_regions(spark, limit):
    """One id with several texts, groups of near copies of a base, chains; both region sizes."""
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [list(rng.choice(vocabulary, 60)) for _ in range(4)]
    data = []
    for i in range(90):
        ws = list(base[i % 4])
        for _ in range(int(rng.integers(0, 4))):
            ws[int(rng.integers(0, 60))] = str(rng.choice(vocabulary))
        data.append((i, " ".join(ws)))
    data += [(5, data[6][1]), (300, data[1][1]), (300, "alone in the world"), (301, "alone in the WORLD"), (302, ""), (303, "two words")]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted(map(tuple, jaccard.jaccard_components(frame, percent=80, limit=limit).collect()))
    assert got == plain_jaccard(data, 3, 80)


def test_jaccard_strangers_are_told_apart_by_parts(spark, monkeypatch):
    """150 texts of twelve words form one large region by shingles in common; no two of them meet, their near copies do."""
    rng = np.random.default_rng(14)
    texts = [[f"w{x}" for x in rng.integers(0, 12, 80)] for _ in range(150)]
    data = [(i, " ".join(ws)) for i, ws in enumerate(texts)] + [(200 + i, " ".join([*ws[: len(ws) - i], *ws[:i]])) for i, ws in enumerate(texts[:8])]
    frame, seen = spark.createDataFrame(data, "doc_id long, text string"), []
    parted = jaccard._parted
    monkeypatch.setattr(jaccard, "_parted", lambda members, *a: seen.append(members.count()) or parted(members, *a))
    monkeypatch.setattr(jaccard, "_compared", None)
    got = sorted(map(tuple, jaccard.jaccard_components(frame, limit=2000).collect()))
    assert got == plain_jaccard(data, 3, 90) and len({r[2] for r in got}) < len(data)
    assert seen[0] > 100


@pytest.mark.parametrize("percent", [60, 80, 90, 95])
def test_linked_sets_share_a_part(percent):
    """pairs that just link, of all sizes and ways to differ, have a cell of whole parts in common."""
    rng = np.random.default_rng(percent)
    for _ in range(300):
        x = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 400)), dtype=np.uint64))
        n = len(x)
        gone = int(rng.integers(0, n * (100 - percent) // 100 + 1))
        room = (100 * (n - gone)) // percent - n  # more shingles that the other one may have
        y = np.unique(np.concatenate([x[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, room + 1)) if rng.random() < 0.5 else room, dtype=np.uint64)]))
        if len(y) == 0 or 100 * (n - gone) < percent * (n + len(y) - (n - gone)):
            continue
        rows_ = pa.table({"doc_id": [1, 2], "region": [7, 7], "set": [x.tobytes(), y.tobytes()]}).to_batches()
        one, two = next(iter(jaccard._parts(percent)(iter(rows_)))).column("cells").to_pylist()
        assert set(one) & set(two)


def test_mix_lands_on_the_target(spark):
    """Few documents, one far larger than the others: the words come within a few of the target."""
    data = [(i, f"s{i % 3}", "w " * (3000 if i == 6 else 5 + 17 * (i % 23))) for i in range(240)]
    got = mixing.balanced_mix(spark.createDataFrame(data, "doc_id long, source string, text string")).toPandas()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((by["taken"] - by["target"]).abs() <= 10).all()


def test_viterbi_is_the_best_of_all_sequences():
    rng = np.random.default_rng(2)
    field = quality.Field(rng.standard_normal(3), rng.standard_normal(2), rng.standard_normal((2, 2)))
    first = np.array([0, 5, 5, 6, 13])
    x = rng.standard_normal((13, 3))
    label = quality.viterbi(field, x, first)

    def value(seq, rows_):
        own = sum(float(r @ field.weight) for s_, r in zip(seq, rows_, strict=True) if s_)
        return own + field.start[seq[0]] + sum(field.move[a, b] for a, b in itertools.pairwise(seq))

    for a, b in itertools.pairwise(first):
        if b > a:
            assert tuple(label[a:b]) == max(itertools.product((0, 1), repeat=b - a), key=lambda q: value(q, x[a:b]))


def test_op1_gradient():
    """Back-propagation against differences of the loss."""
    rng = np.random.default_rng(6)
    column = pa.array(["some words here " * 4, "others stand there too", "a b"], pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64)[:4]
    data = np.frombuffer(column.buffers()[2], np.uint8)[: off[-1]]
    w = toxicity.pieces(data, off)
    v = toxicity.vocabulary(data, w)
    doc, start = toxicity.windows_of(w.counts, w.first)
    at, mask = toxicity._rows(w.first, w.counts, doc, start, v.ids, len(v.word))
    net = toxicity.Network(3)
    net.p = {k: (x + rng.standard_normal(x.shape) * 0.3).astype(np.float64) for k, x in net.p.items()}
    y, known = np.array([1.0, 0.0, 1.0])[doc], np.ones(len(v.word))

    def loss():
        logit = net.pool(net.read(at.T, net.project(net.embed(v, known)))[0], mask.T)[0].astype(np.float64)
        return float(np.mean(np.log1p(np.exp(logit)) - y * logit))

    g = net.gradients(np.ascontiguousarray(at.T), mask.T, v, y, known)
    for name in net.p:
        flat = net.p[name].reshape(-1)
        for i in np.abs(g[name].reshape(-1)).argsort()[-3:]:
            held, step = flat[i], 1e-2
            flat[i] = held + step
            up = loss()
            flat[i] = held - step
            down = loss()
            flat[i] = held
            assert (up - down) / (2 * step) == pytest.approx(g[name].reshape(-1)[i], rel=0.05, abs=2e-4), name


def test_op3_is_the_out_of_place_distance(spark):
    """Profiles and distances against a plain version, on a few texts."""
    data = [(1, "en", "the cat sat on the mat and the dog"), (2, "de", "der Hund und die Katze auf der Matte"), (3, "en", "a dog"), (4, "fr", "le chat et le chien sur le tapis"), (5, None, "x"), (6, "en", None)]
    asked = [(10, "The dog AND the cat"), (11, "die Matte"), (12, "42 !"), (13, None), (14, "sur le tapis, le chat")]

    def grams(text):
        out = collections.Counter()
        for w in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
            p = f" {w} "
            out.update(p[i : i + n] for n in (1, 2, 3) for i in range(len(p) - n + 1))
            out[" "] -= 2
        return +out

    rank = lambda c: {x: i for i, (x, _) in enumerate(sorted(c.items(), key=lambda e: (-e[1], [ord(y) for y in e[0]] + [0] * (3 - len(e[0]))))[:language.LENGTH])}
    profiles = {}
    for name in ("de", "en", "fr"):
        profiles[name] = rank(sum((grams(t) for _, x, t in data if x == name), collections.Counter()))
    docs = spark.createDataFrame(data, "doc_id long, lang string, text string")
    found = language.identify(spark.createDataFrame([(i, True, t) for i, t in asked], "doc_id long, held_out boolean, text string"), language.learn_profiles(docs))
    for r in found.collect():
        mine = rank(grams(dict(asked)[r.doc_id]))
        far = {n: sum(abs(k - p[g]) if g in p else language.LENGTH for g, k in mine.items()) for n, p in profiles.items()}
        assert r.lang_pred == (min(sorted(far), key=far.get) if mine else "und")
        assert r.score == pytest.approx(1 - min(far.values()) / (language.LENGTH * len(mine)) if mine else 0)


def plain_line_dedup(data):
    """Brute force: a line goes if it lies in a run of ten words or more that has an earlier place."""
    lines = {i: [(at, x) for at, x in enumerate((t or "").split("\n")) if words(x)] for i, t in data}
    first, gone = {}, collections.defaultdict(set)
    for i in sorted(lines):
        seq = lines[i]
        for a in range(len(seq)):
            n = 0
            for b in range(a, len(seq)):
                n += len(words(seq[b][1]))
                if n >= 10:
                    first.setdefault(tuple(x for _, x in seq[a : b + 1]), (i, a))
                    if first[tuple(x for _, x in seq[a : b + 1])] < (i, a):
                        gone[i].update(at for at, _ in seq[a : b + 1])
    for i, t in data:
        text = "\n".join(x for at, x in enumerate((t or "").split("\n")) if at not in gone[i])
        if not gone[i] or (words(text) and 100 * len(words(text)) >= 20 * len(words(t))):
            yield i, text


def test_pipeline_stages_against_plain_versions(spark, sf_dir, tmp_path):
    """Line dedup, Jaccard join and decontamination on planted rows, each on its own input."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights"]
    rng = np.random.default_rng(9)
    sentence = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 100_000, n))
    page = [sentence(14) for _ in range(20)]
    near = [*page[:7], sentence(14), *page[8:]]
    items = [sentence(40), sentence(60)]
    texts = ["\n".join(page), "\n".join(near), "\n".join([sentence(20), page[3], page[4], sentence(20)]), sentence(80), *(sentence(30) + " " + x + " " + sentence(30) for x in items), "\n".join([sentence(9), "short", sentence(9)])]
    base = pq.read_table(f"{sf_dir}/documents.parquet").schema
    frame = lambda data: spark.createDataFrame([(i, t, "en", "s", len(t or ""), "mine") for i, t in data], "doc_id long, text string, lang string, source string, n_chars long, n_removed string")
    assert {"doc_id", "text", "lang", "source", "n_chars"} <= set(base.names)
    pq.write_table(pa.table({"item_id": [1, 2], "text": items}), tmp_path / "benchmark.parquet")

    data = list(enumerate(texts))
    got = stages["line dedup"](spark, frame(data), str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(plain_line_dedup(data))
    assert all((r.n_removed, r.n_chars) == ("mine", len(r.text)) for r in got) and 1 not in {r.doc_id for r in got}

    same = [(None, texts[0]), (None, texts[0]), (2, texts[1]), (1, texts[3]), (1, texts[2]), (7, texts[1]), (3, ""), (None, None), (None, texts[6])]
    got = stages["n-gram Jaccard join"](spark, frame(same), str(tmp_path)).collect()
    # the near copies with and without an id are one group, of which id 2 stays
    want = [(2, texts[1]), (1, texts[3]), (1, texts[2]), (3, ""), (None, None), (None, texts[6])]
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(want)

    leaks = [(None, texts[4]), (4, texts[5]), (4, texts[3]), (5, items[0]), (6, None), (None, texts[2])]
    got = stages["benchmark decontamination"](spark, frame(leaks), str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter([(4, texts[3]), (6, None), (None, texts[2])])


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert len(out) and (out["times"] > 0).all() and out["doc_id"].is_unique


NAMES = sorted(QUERIES)
CLASHES = ["rid", "row", "key", "h", "s", "n", "l", "size", "held_out", "start", "word", "title", "n_lines", "n_removed", "n_spans", "set", "cell", "region", "p", "waits", "chunk", "place", "text_"]


@pytest.fixture(scope="session")
def odd(tmp_path_factory, sf_dir):
    """Nulls everywhere, empty and very long texts, repeated rows, columns with clashing names."""
    folder = tmp_path_factory.mktemp("odd")
    base = pq.read_table(f"{sf_dir}/documents.parquet").to_pandas().head(60)
    more = pd.DataFrame({"doc_id": [None, 10_001, 10_002, 10_003, 10_004, 10_004], "text": ["no id at all", None, "", " \n\t\n", "word " * 60_000, "word " * 60_000], "lang": [None, None, "en", "en", None, None], "source": [None, "src0", None, "", "src1", "src1"], "n_chars": [None, None, 0, 4, 300_000, 300_000]})
    both = pd.concat([base, base.head(3), more])
    both["doc_id"], both["n_chars"] = both["doc_id"].astype("Int64"), both["n_chars"].astype("Int64")
    for name in CLASHES:
        both[name] = "x"
    pq.write_table(pa.Table.from_pandas(both, preserve_index=False), folder / "documents.parquet")
    for name in ("benchmark", "labels", "conversations"):
        shutil.copy(f"{sf_dir}/{name}.parquet", folder)
    return str(folder), len(both)


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, odd, name):
    got = QUERIES[name](spark, odd[0]).toPandas()
    if name not in ("op5_decontamination", "op7_licenses", "op11_conversation_repair"):
        assert len(got) == odd[1]


def test_pipeline_odd_rows(spark, odd, tmp_path):
    """Rows without words go, equal rows stay once, the mix takes whole documents; columns of clashing names do no harm."""
    import corpus_pipeline

    data = pq.read_table(f"{odd[0]}/documents.parquet").to_pandas()
    for name in ("gone", "__gone", "keep", "target_", "times", "r", "c"):
        data[name] = "x"
    pq.write_table(pa.Table.from_pandas(data, preserve_index=False), tmp_path / "documents.parquet")
    for name in ("benchmark", "labels"):
        shutil.copy(f"{odd[0]}/{name}.parquet", tmp_path)
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    texts = collections.defaultdict(set)
    for i, t in zip(data["doc_id"], data["text"], strict=True):
        texts[None if pd.isna(i) else int(i)].add(t)
    assert len(out) and out["doc_id"].is_unique and set(out["doc_id"]) <= set(texts) - {10_001, 10_002, 10_003}
    for r in out.itertuples():
        assert r.taken == r.times * r.size and 0 < r.size <= max(len(words(t)) for t in texts[r.doc_id])
    assert (out.groupby("source", dropna=False)["taken"].sum() > 0).all()


def test_pipeline_empty_tables(spark, sf_dir, tmp_path):
    import corpus_pipeline

    for table in ("documents", "benchmark", "labels"):
        pq.write_table(pq.read_table(f"{sf_dir}/{table}.parquet").slice(0, 0), tmp_path / f"{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_frees_what_it_stores(spark, sf_dir, tmp_path):
    """After a run only the last stage's result is left."""
    import corpus_pipeline

    from linecraft.llm.common import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, sf_dir)
    assert len(set(os.listdir(folder)) - before) == 1 and out.count() > 0


def test_pipeline_first_and_last_stage(spark, sf_dir):
    """The quality stage keeps what op10 keeps, the mix of all documents is op6's."""
    import corpus_pipeline

    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in QUERIES["op10_quality"](spark, sf_dir).filter("kept").collect()}
    got = stages["quality rules"](spark, docs, sf_dir)
    assert got.columns == docs.columns and {r.doc_id for r in got.select("doc_id").collect()} == kept and 0 < len(kept) < docs.count()
    mix = {(r.doc_id, r.taken) for r in stages["mixing sources to target weights"](spark, docs, sf_dir).collect()}
    assert mix == {(r.doc_id, r.taken) for r in QUERIES["op6_mixing"](spark, sf_dir).filter("taken > 0").collect()}


def test_sample_of_long_texts():
    """One text that is too long takes no other with it, and a label is never left without a text."""
    assert toxicity.fitting(np.array([9, 3, 5, 4, 2]), 10).tolist() == [True, False, False, False, False]
    assert toxicity.fitting(np.array([99, 3, 5, 4, 2]), 10).tolist() == [False, True, True, False, True]
    assert toxicity.fitting(np.array([99, 33]), 10).tolist() == [False, True] and toxicity.fitting(np.array([], int), 10).tolist() == []


def test_blocks_of_items_one_at_a_time(spark):
    """Several blocks find what one finds."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(40)], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(5, 20))) for i in range(0, 40, 2)], "item_id long, text string")
    one, many = (sorted(map(tuple, decontam.containment_search(docs, items, block=b).collect())) for b in (decontam.BLOCK, 40))
    assert one == many and len(one) == 20
    clean = decontam.keep_clean(docs, items, block=40)
    assert sorted(r.doc_id for r in clean.collect()) == list(range(1, 40, 2))


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, sf_dir, tmp_path, name):
    for table in ("documents", "benchmark", "labels", "conversations"):
        pq.write_table(pq.read_table(f"{sf_dir}/{table}.parquet").slice(0, 0), tmp_path / f"{table}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0
