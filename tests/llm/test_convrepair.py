import collections
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linecraft.llm import convrepair
from linecraft.llm.queries import QUERIES

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def faults(rows):
    """'blank', 'duplicate', 'truncated' or '' for each (turn, role, text)."""
    seen = set()
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        yield "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))


def cheapest(rows, found):
    """(cost, letters, lines) by plain backward recursion over rows and the last role."""
    ends = {q: (0, "", ()) if q in ("", "a") else (10**9, "", ()) for q in ("", "s", "u", "a")}

    def inserted(table):
        for _ in range(4):
            table = {q: min([table[q], *((c + 5, "I" + t, (f"{n}:", *ls)) for n in ("user", "assistant") if (q, n[0]) in NEXT for c, t, ls in [table[NEXT[q, n[0]]]])], key=lambda x: x[:2]) for q in table}
        return table

    table = inserted(ends)
    for (_, role, text), fault in zip(reversed(rows), reversed(found), strict=True):
        cut, new = 5 * (fault == "truncated"), {}
        for q in table:
            ways = [(table[q][0] + 2, "D" + table[q][1], table[q][2])]
            for name, letter, price in ((role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                if fault not in ("blank", "duplicate") and (q, name[:1]) in NEXT:
                    c, t, ls = table[NEXT[q, name[:1]]]
                    ways.append((c + price + cut, letter + t, (f"{name}:{text}", *ls)))
            new[q] = min(ways, key=lambda x: x[:2])
        table = inserted(new)
    return table[""]


def plain(rows):
    """The result's columns for one conversation's (turn, role, text) rows."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    found, turns = list(faults(rows)), [t for t, _, _ in rows if t is not None]
    cost, letters, lines = cheapest(rows, found)
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def damaged(table):
    out = collections.defaultdict(list)
    for conv, turn, role, text in table:
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        out[conv] += [] if draw == 0 else [(turn, "user" if draw == 4 else role, "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text)] * (1 + (draw == 3))
    return out


def of(frame):
    return {r.conv_id: tuple(r[n] for n in NAMES) for r in frame.collect()}


ROWS = st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "u2"]), st.sampled_from(["a.", "b!", "c", " ", "", "d? ", "e"])), max_size=9)


@settings(max_examples=400, deadline=None)
@given(st.lists(ROWS, min_size=1, max_size=6))
def test_walks(many):
    """Costs and edit strings of several conversations at once against the recursion."""
    found = [[(k, *r) for k, r in enumerate(rows)] for rows in many]
    codes, first = [], [0]
    for rows in found:
        seen = set()
        for _, role, text in rows:
            codes.append(convrepair._code(role, text, (role, text) in seen))
            seen.add((role, text))
        first.append(len(codes))
    n, walks = len(many), convrepair.Walks(np.array(codes, np.int64), np.array(first))
    ahead, behind = walks.forward(np.tile(convrepair.START, (n, 1))), walks.backward(np.tile(convrepair.END, (n, 1)))
    last = walks.node + walks.n
    ahead[last] = (ahead[last][:, :, None] + convrepair._FREE).min(1)
    letters, _ = walks.letters(ahead, behind, behind[walks.node, 0], np.tile(convrepair.START == 0, (n, 1)), np.ones(n, bool))
    for k, rows in enumerate(found):
        cost, text, _ = cheapest(rows, list(faults(rows)))
        assert (behind[walks.node[k], 0], letters[k].decode()) == (cost, text)


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(4)
    roles, texts = ["system", "user", "assistant", "tool", "", None], ["Yes.", "No!", "cut", "", None, "What? ", "\n"]
    rows = [(int(c), None if rng.random() < 0.05 else int(rng.integers(0, 30)), roles[int(rng.choice(6, p=[0.1, 0.4, 0.4, 0.04, 0.03, 0.03]))], texts[int(rng.integers(7))] if rng.random() < 0.3 else f"text {rng.integers(400)}" + "." * int(rng.random() < 0.8)) for c in rng.integers(0, 40, 700)]
    rows += [(None, k, ["user", "assistant"][k % 2], f"Hi {k // 3}.") for k in range(20)] + [(99, int(k), ["user", "assistant"][k % 2], f"turn {k % 90}.") for k in range(300)]
    return rows + [(98, 3, "user", "Same.")] * 70 + [(97, 2**40, "user", "x" * 100_000 + "."), (97, -5, "system", "s.")]


@pytest.mark.parametrize("long", [convrepair.LONG, 4, 16])
def test_repair(spark, made, long):
    """Whole conversations and such in blocks, with nulls, ties, equal rows, many repeats and a hot conversation."""
    want = collections.defaultdict(list)
    for conv, *row in made:
        want[conv].append(tuple(row))
    rows = spark.createDataFrame([(*r, "x", 1) for r in made], "conv_id long, turn long, role string, text string, pos string, there int").repartition(5)
    everyone = spark.createDataFrame([(c,) for c in [*want, 1234]], "conv_id long")
    got = of(convrepair.repair(rows, everyone, long))
    assert got.pop(1234) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: plain(r) for c, r in want.items()}


def test_damage(spark, made):
    rows = spark.createDataFrame([(*r, 0) for r in made], "conv_id long, turn long, role string, text string, draw int")
    got = collections.Counter((r.conv_id, r.turn, r.role, r.text) for r in convrepair.damage(rows).collect())
    assert got == collections.Counter((c, *r) for c, found in damaged(made).items() for r in found)


def test_query(spark, sf_dir):
    table = pq.read_table(f"{sf_dir}/conversations.parquet").to_pandas()
    rows = list(table[["conv_id", "turn", "role", "text"]].itertuples(index=False, name=None))
    found = damaged(rows)
    got = of(QUERIES["op11_conversation_repair"](spark, sf_dir))
    assert got == {c: plain(found[c]) for c in set(table["conv_id"])}


def test_all_rows_dropped_and_empty(spark, tmp_path):
    gone = next((c, t) for c in range(1000) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    pd.DataFrame([(*gone, "user", "Hi.")], columns=["conv_id", "turn", "role", "text"]).to_parquet(tmp_path / "conversations.parquet")
    got = of(QUERIES["op11_conversation_repair"](spark, str(tmp_path)))
    assert got == {gone[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    pq.write_table(pq.read_table(tmp_path / "conversations.parquet").slice(0, 0), tmp_path / "conversations.parquet")
    assert QUERIES["op11_conversation_repair"](spark, str(tmp_path)).count() == 0
