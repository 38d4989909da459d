"""Cheapest repair of conversations into ``system? (user assistant)+`` or nothing.

The rows of a conversation and the states of the wanted form span a graph: an arc keeps, re-roles or deletes
the next row or inserts an empty one, at a price.  Minimum costs forward from the beginning and backward from
the end tell which arcs lie on a cheapest way (they are *tight*); following all tight arcs at once, as a set of
states, and taking the smallest edit letter of any of them at each step gives the first of all cheapest edit
strings.  The string fixes the repaired rows: how many remain tells whether a system row leads.

A conversation of up to ``LONG`` rows is repaired whole, many at a time, in a task that reads its partition in
order.  Longer ones are cut into blocks in a sorted, stored table: each block gives the costs between its
first and last states (4 x 4), a pass over those gives every block its costs before and behind, each block is
walked from every set of tight states that it can be entered with, and a second pass over the blocks picks
the sets.  Only the digest of the repaired text, which is sequential by definition, reads a long conversation
in one task, as a stream, and a conversation's edit string is one value, a byte a row.

Edits: Keep 0, Rerole 1, Delete 2 (the only way for blank and duplicate rows), Insert 5; a truncated row
that stays costs 5 more.

Defined cases: null roles and texts are one space (so such a text is blank, such a role fits nowhere); null
turns come first; rows of one turn are ordered by role and text; equal rows are duplicates; a role counts by
its first letter, and an empty role fits nowhere; conversations without rows (named by ``everyone``) cost
nothing; a null id is a conversation of its own; further columns are not read; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, ship, stored, table

#: Rows up to which a conversation is repaired in one piece; also the rows of a block of a longer one.
LONG = 1 << 13
WHITE = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
_INF = np.int64(1) << 40
#: States: nothing yet, after a system row, after a user row, after an assistant row.
_STATES, _ACCEPT = 4, np.array([0, _INF, _INF, 0])
#: Where a user or an assistant row leads.
_USER, _ASSISTANT = [(0, 2), (1, 2), (3, 2)], [(2, 3)]
#: A row's code: 0 to 3 for system, user, assistant and other roles, 4 more if truncated, 8 if it must go.
_GONE = 8
_FORM = {"s": 0, "u": 1, "a": 2}


def _weights() -> np.ndarray:
    """Cost of Delete, Insert, Keep and Rerole by row code, state before and state after."""
    w = np.full((4, 9, _STATES, _STATES), _INF)
    for code in range(9):
        cut = CUT if 4 <= code < 8 else 0
        w[0, code][np.diag_indices(_STATES)] = DELETE
        for a, b in _USER + _ASSISTANT:
            w[1, code, a, b] = INSERT
        if code < _GONE:
            for a, b in [[(0, 1)], _USER, _ASSISTANT, []][code % 4]:
                w[2, code, a, b] = cut
            for a, b in _USER + _ASSISTANT:
                w[3, code, a, b] = REROLE + cut
    return w


_WEIGHT = _weights()
#: Cheapest way over a row, and over any number of insertions.
_ROW = _WEIGHT[[0, 2, 3]].min(0)
_FREE = np.where(np.eye(_STATES, dtype=bool), 0, _INF)
for _ in range(2):
    _FREE = np.minimum(_FREE, (_FREE[:, :, None] + np.minimum(_WEIGHT[1, 0], np.where(np.eye(_STATES, dtype=bool), 0, _INF))[None]).min(1))
#: Cost behind the last row.
END = (_FREE + _ACCEPT).min(1)
START = np.array([0, _INF, _INF, _INF])
_LETTERS = np.frombuffer(b"DIKR", np.uint8)


class Walks:
    """Costs of many blocks of rows at once; block k has the codes first[k] to first[k + 1]."""

    def __init__(self, codes: np.ndarray, first: np.ndarray):
        self.codes, self.n = codes, np.diff(first)
        self.first, self.node = first[:-1], first[:-1] + np.arange(len(first) - 1)
        self.by_length = np.argsort(-self.n, kind="stable")
        self.lengths = self.n[self.by_length]

    def _alive(self, i: int) -> np.ndarray:
        """Blocks with more than ``i`` rows."""
        return self.by_length[: np.searchsorted(-self.lengths, -i, "left")]

    def forward(self, start: np.ndarray) -> np.ndarray:
        """Costs at each node from ``start`` (a row a block), insertions at the node included; the last node's are left out."""
        cost = np.full((len(self.codes) + len(self.n), _STATES), _INF)
        cost[self.node] = start
        for i in range(int(self.n.max(initial=0)) + 1):
            at = self.node if i == 0 else self.node[self._alive(i)] + i
            cost[at] = np.minimum((cost[at][:, :, None] + _FREE).min(1), _INF)
            on = self._alive(i)
            at = self.node[on] + i
            cost[at + 1] = np.minimum((cost[at][:, :, None] + _ROW[self.codes[self.first[on] + i]]).min(1), _INF)
        return cost

    def backward(self, end: np.ndarray) -> np.ndarray:
        """Costs at each node to the end, where ``end`` (a row a block) holds; insertions at the node included."""
        cost = np.full((len(self.codes) + len(self.n), _STATES), _INF)
        cost[self.node + self.n] = end
        for i in range(int(self.n.max(initial=0)) - 1, -1, -1):
            on = self._alive(i)
            at = self.node[on] + i
            over = (_ROW[self.codes[self.first[on] + i]] + cost[at + 1][:, None, :]).min(2)
            cost[at] = np.minimum((_FREE + over[:, None, :]).min(2), _INF)
        return cost

    def across(self) -> np.ndarray:
        """Costs from each state before a block to each state behind it (blocks x 4 x 4)."""
        out = np.empty((len(self.n), _STATES, _STATES), np.int64)
        for q in range(_STATES):
            start = np.full((len(self.n), _STATES), _INF)
            start[:, q] = 0
            out[:, q] = self.forward(start)[self.node + self.n]
        return out

    def letters(self, ahead: np.ndarray, behind: np.ndarray, best: np.ndarray, sets: np.ndarray, last: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """First cheapest edit strings from the states ``sets`` (bool, a row a block), and the states they end in.

        ``last`` marks blocks that end their conversation: there, rows may be inserted behind the last one.
        """
        i, states = np.zeros(len(self.n), np.int64), sets.copy()
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        live = np.arange(len(self.n))
        while True:
            at = self.node[live] + i[live]
            over = (i[live] == self.n[live]) & (~last[live] | (states[live] & (ahead[at] == best[live, None]) & (_ACCEPT == 0)).any(1))
            live, at = live[~over], at[~over]
            if not len(live):
                break
            inside = i[live] < self.n[live]
            code = self.codes[np.where(inside, self.first[live] + i[live], 0)] if len(self.codes) else np.zeros(len(live), np.int64)
            base = np.where(states[live], ahead[at], _INF)[:, :, None]
            moved, chosen = np.zeros((len(live), _STATES), bool), np.full(len(live), -1)
            for k in range(4):
                to = behind[at] if k == 1 else behind[np.where(inside, at + 1, at)]
                tight = (base + _WEIGHT[k, code] + to[:, None, :] == best[live, None, None]).any(1)
                take = (chosen < 0) & tight.any(1) & (inside | (k == 1))
                moved[take], chosen[take] = tight[take], k
            states[live] = moved
            i[live] += chosen != 1
            steps.append((live, chosen))
        owner = np.concatenate([s[0] for s in steps]) if steps else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        text = _LETTERS[np.concatenate([s[1] for s in steps])[order] if steps else np.zeros(0, np.int64)].tobytes()
        bounds = np.searchsorted(owner[order], np.arange(len(self.n) + 1))
        return [text[bounds[k] : bounds[k + 1]] for k in range(len(self.n))], states


def _code(role: str, text: str, seen: bool) -> int:
    body = text.strip(WHITE)
    if not body or seen:
        return _GONE
    return _FORM.get(role[:1], 3) + (0 if body[-1] in ".!?" else 4)


def _written(letters: str, roles: list[str], texts: list[str], place: int, odd: int) -> list[str]:
    """``role:text`` of the rows that stay; the first of them is at ``place``, ``odd`` is 1 if a system row leads."""
    out, k = [], 0
    for letter in letters:
        if letter == "D":
            k += 1
            continue
        role = "user" if (place + len(out) - odd) % 2 == 0 else "assistant"
        if letter == "I":
            out.append(f"{role}:")
        else:
            out.append(f"{roles[k] if letter == 'K' else role}:{texts[k]}")
            k += 1
    return out


def _facts(codes: list[int], roles: list[str], turns: list[int | None], seen: list[bool]) -> tuple:
    """blank, duplicate, truncated, illegal, first and last initial, least, largest and number of turns."""
    duplicate = sum(s and c == _GONE for s, c in zip(seen, codes, strict=True))
    starts = [r[:1] for r in roles]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:], strict=False))
    known = [t for t in turns if t is not None]
    return codes.count(_GONE) - duplicate, duplicate, sum(4 <= c < _GONE for c in codes), illegal, starts[0], starts[-1], known[0] if known else None, known[-1] if known else None, len(set(known))


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repairs the conversations of a sorted partition; the last one of a batch waits for the next batch."""
    names = ["conv_id", "turn", "role", "text", "there"]
    rest, kind = None, None
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        both = pa.Table.from_batches([batch]).select(names)
        both = both if rest is None else pa.concat_tables([rest, both])
        ids = both.column("conv_id").to_pylist()
        at = len(ids) - 1
        while at and ids[at - 1] == ids[at]:
            at -= 1
        rest = both.slice(at)
        if at:
            yield _repaired(both.slice(0, at), kind)
    if rest is not None:
        yield _repaired(rest, kind)


def _repaired(rows: pa.Table, kind: pa.DataType) -> pa.RecordBatch:
    ids, turns, roles, texts, there = (rows.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "there"))
    heads = [0, *(k for k in range(1, len(ids)) if ids[k] != ids[k - 1]), len(ids)]
    convs, kept, codes, facts, first = [], [], [], [], [0]
    for lo, hi in zip(heads, heads[1:], strict=False):
        mine = [k for k in range(lo, hi) if there[k]]
        known: set = set()
        seen = [(roles[k], texts[k]) in known or known.add((roles[k], texts[k])) is not None for k in mine]
        own = [_code(roles[k], texts[k], s) for k, s in zip(mine, seen, strict=True)]
        # a row without content is blank, whether or not it was seen before
        seen = [s and bool(texts[k].strip(WHITE)) for k, s in zip(mine, seen, strict=True)]
        convs.append(ids[lo])
        kept.append(mine)
        codes += own
        first.append(len(codes))
        facts.append(_facts(own, [roles[k] for k in mine], [turns[k] for k in mine], seen) if mine else (0, 0, 0, 0, "", "", None, None, 0))
    walks = Walks(np.array(codes, np.int64), np.array(first, np.int64))
    n = len(convs)
    ahead, behind = walks.forward(np.tile(START, (n, 1))), walks.backward(np.tile(END, (n, 1)))
    best = behind[walks.node, 0]
    closed = np.minimum((ahead[walks.node + walks.n][:, :, None] + _FREE).min(1), _INF)
    ahead[walks.node + walks.n] = closed
    audits, _ = walks.letters(ahead, behind, best, np.tile(START == 0, (n, 1)), np.ones(n, bool))
    hashes = []
    for mine, audit in zip(kept, audits, strict=True):
        letters = audit.decode()
        stay = len(letters) - letters.count("D")
        lines = _written(letters, [roles[k] for k in mine], [texts[k] for k in mine], 0, stay % 2)
        hashes.append(hashlib.sha256("\n".join(lines).encode()).hexdigest())
    gaps = [0 if f[6] is None else f[7] - f[6] + 1 - f[8] for f in facts]
    columns = [pa.array(convs, kind), pa.array(gaps, pa.int64()), *(pa.array([f[k] for f in facts], pa.int64()) for k in range(4)), pa.array(best), pa.array([a.decode() for a in audits], pa.string()), pa.array(hashes, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])


# Conversations of more than LONG rows.


def _summary(key, rows: pd.DataFrame) -> pd.DataFrame:
    """A block's codes, facts and costs from state to state."""
    rows = rows.sort_values("pos")
    roles, texts = rows["role"].tolist(), rows["text"].tolist()
    seen = [s and bool(t.strip(WHITE)) for s, t in zip(rows["seen"], texts, strict=True)]
    codes = [_code(r, t, s) for r, t, s in zip(roles, texts, seen, strict=True)]
    facts = _facts(codes, roles, [None if pd.isna(t) else int(t) for t in rows["turn"]], seen)
    across = Walks(np.array(codes, np.int64), np.array([0, len(codes)])).across()[0]
    return pd.DataFrame([[*key, bytes(codes), *facts, across.ravel().tolist()]])


def _placed(rows: pd.DataFrame) -> pd.DataFrame:
    """Costs before and behind every block of a conversation, and the sums of its facts."""
    rows = rows.sort_values("block")
    across = [np.array(x, np.int64).reshape(_STATES, _STATES) for x in rows["across"]]
    ahead, behind = [START], [END]
    for m in across[:-1]:
        ahead.append(np.minimum((ahead[-1][:, None] + m).min(0), _INF))
    for m in across[:0:-1]:
        behind.append(np.minimum((m + behind[-1]).min(1), _INF))
    behind = behind[::-1]
    best = int((across[0] + behind[0]).min(1)[0])
    ends = list(zip(rows["last"], rows["first"].iloc[1:], strict=False))
    illegal = int(rows["illegal"].sum()) + sum(a + b not in ("su", "ua", "au") for a, b in ends)
    known = rows[rows["n_turns"] > 0]
    both = (known["low"].to_numpy()[1:] == known["high"].to_numpy()[:-1]).sum()
    gaps = 0 if known.empty else int(known["high"].max() - known["low"].min() + 1 - known["n_turns"].sum() + both)
    out = rows[["conv_id", "block"]].copy()
    out["ahead"], out["behind"] = [x.tolist() for x in ahead], [x.tolist() for x in behind]
    out["final"] = [False] * (len(rows) - 1) + [True]
    for name, value in {"gaps": gaps, **{c: int(rows[c].sum()) for c in ("blank", "duplicate", "truncated")}, "illegal": illegal, "cost": best}.items():
        out[name] = value
    return out


def _walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each block's edit string from every set of tight states that it may be entered with."""
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            codes = np.frombuffer(r.codes, np.uint8).astype(np.int64)
            walks, best = Walks(codes, np.array([0, len(codes)])), np.array([r.cost])
            ahead, behind = walks.forward(np.array(r.ahead)[None]), walks.backward(np.array(r.behind)[None])
            if r.final:
                ahead[-1] = np.minimum((ahead[-1][:, None] + _FREE).min(0), _INF)
            tight = np.flatnonzero(np.array(r.ahead) + behind[0] == r.cost)
            for size in range(1, len(tight) + 1):
                for some in combinations(tight.tolist(), size):
                    entry = np.isin(np.arange(_STATES), some)
                    (letters,), states = walks.letters(ahead, behind, best, entry[None], np.array([r.final]))
                    bits = 1 << np.arange(_STATES)
                    out.append((r.conv_id, r.block, int(entry @ bits), int(states[0] @ bits), len(letters) - letters.count(b"D"), letters.decode()))
        yield pd.DataFrame(out, columns=["conv_id", "block", "entered", "left", "stay", "letters"])


def _picked(rows: pd.DataFrame) -> pd.DataFrame:
    """The set of states with which each block of a conversation is entered."""
    ways = {b: {r.entered: r for r in mine.itertuples(index=False)} for b, mine in rows.groupby("block")}
    at, place, out = 1, 0, []
    for block in sorted(ways):
        way = ways[block][at]
        out.append((way.conv_id, block, at, place))
        at, place = way.left, place + way.stay
    return pd.DataFrame([(*o, place % 2) for o in out], columns=["conv_id", "block", "entered", "place", "odd"]).astype({"conv_id": rows["conv_id"].dtype})


def _rewritten(key, rows: pd.DataFrame, way: pd.DataFrame) -> pd.DataFrame:
    rows, w = rows.sort_values("pos"), way.iloc[0]
    lines = _written(w["letters"], rows["role"].tolist(), rows["text"].tolist(), int(w["place"]), int(w["odd"]))
    return pd.DataFrame([[*key, w["letters"], "\n".join(lines), len(lines)]])


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edit strings and digests of conversations whose blocks come in order."""
    held: list = [None, None, [], None]  # id, digest, letters, whether a line has been written

    def out():
        return pd.DataFrame([(held[0], "".join(held[2]), held[1].hexdigest())], columns=["conv_id", "audit", "repaired_sha256"])

    for batch in batches:
        for r in batch.itertuples(index=False):
            if held[1] is None or not (r.conv_id == held[0] or (pd.isna(r.conv_id) and pd.isna(held[0]))):
                if held[1] is not None:
                    yield out()
                held[:] = [r.conv_id, hashlib.sha256(), [], False]
            held[2].append(r.letters)
            if r.lines:
                held[1].update((("\n" if held[3] else "") + r.repaired).encode())
                held[3] = True
    if held[1] is not None:
        yield out()


def _in_blocks(rows: DataFrame, most: int) -> DataFrame:
    """The result for conversations that are not held in one piece; a column ``id`` tells equal rows apart."""
    kind = dict(rows.dtypes)["conv_id"]
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "id"]
    held = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("id").withColumn("pos", F.monotonically_increasing_id()))
    first = held.groupBy("conv_id", "role", "text").agg(F.min("pos").alias("first_pos")).select("first_pos")
    marked = held.join(first, F.col("pos") == F.col("first_pos"), "left").select("conv_id", F.floor(F.col("pos") / most).alias("block"), "pos", "turn", "role", "text", F.col("first_pos").isNull().alias("seen"))
    facts = "blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, n_turns long"
    marked = stored(marked)
    summary = stored(marked.groupBy("conv_id", "block").applyInPandas(_summary, f"conv_id {kind}, block long, codes binary, {facts}, across array<long>"))
    counts = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    placed = summary.drop("codes").groupBy("conv_id").applyInPandas(_placed, f"conv_id {kind}, block long, ahead array<long>, behind array<long>, final boolean, {counts}")
    placed = stored(placed)
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & (a["block"] == b["block"])
    entries = summary.select("conv_id", "block", "codes").alias("s")
    entries = entries.join(placed.alias("p"), same({c: F.col(f"s.{c}") for c in ("conv_id", "block")}, {c: F.col(f"p.{c}") for c in ("conv_id", "block")})).select("s.conv_id", "s.block", "codes", "ahead", "behind", "final", "cost")
    ways = stored(entries.mapInPandas(_walked, f"conv_id {kind}, block long, entered int, left int, stay long, letters string"))
    picked = ways.drop("letters").groupBy("conv_id").applyInPandas(_picked, f"conv_id {kind}, block long, entered int, place long, odd long")
    picked = picked.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.col("entered").alias("e"), "place", "odd")
    chosen = ways.join(picked, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")) & (F.col("entered") == F.col("e"))).select("c", "b", "letters", "place", "odd")
    texts = marked.groupBy("conv_id", "block").cogroup(chosen.groupBy("c", "b")).applyInPandas(_rewritten, f"conv_id {kind}, block long, letters string, repaired string, lines long")
    folded = texts.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInPandas(_folded, f"conv_id {kind}, audit string, repaired_sha256 string")
    sums = placed.filter("final").select(F.col("conv_id").alias("c"), *[n.split()[0] for n in counts.split(", ")])
    out = stored(sums.join(folded, F.col("c").eqNullSafe(F.col("conv_id"))).drop("c"))
    free(held, marked, summary, placed, ways)
    return out


def repair(turns: DataFrame, everyone: DataFrame | None = None, long: int = LONG) -> DataFrame:
    """Faults and the cheapest repair of each conversation of ``turns`` (conv_id, turn, role, text).

    Returns conv_id, gaps (turns missing between the first and the last), blank, duplicate, truncated (each
    row's first fault), illegal (neighbours whose roles cannot follow one another), cost, audit (the first of
    the cheapest edit strings) and the digest of the repaired rows.  ``everyone`` (conv_id) names conversations
    that have to be in the result though they have no rows.
    """
    spark = turns.sparkSession
    ship(spark)
    kind = dict(turns.dtypes)["conv_id"]
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    large = stored(rows.groupBy("conv_id").count().filter(F.col("count") > long).select(F.col("conv_id").alias("large")))
    far = None
    if not large.isEmpty():
        at = F.col("conv_id").eqNullSafe(F.col("large"))
        held = stored(rows.join(large, at, "left_semi").withColumn("id", F.monotonically_increasing_id()))
        far = _in_blocks(held, long)
        free(held)
        rows = rows.join(large, at, "left_anti")
    rows = rows.withColumn("there", F.lit(True))
    if everyone is not None:
        names = everyone.select("conv_id")
        names = names.join(large, F.col("conv_id").eqNullSafe(F.col("large")), "left_anti") if far is not None else names
        rows = rows.unionByName(names.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(False).alias("there")))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    near = rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_whole, f"conv_id {kind}, {_RESULT}")
    return near if far is None else near.unionByName(far)


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` with faults put in by a hash of conversation and turn, one row in 20 each: dropped, emptied, without
    its full stops, repeated, or given to the user."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    draw = F.crc32(name.cast("binary")) % 20
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), draw.alias("draw")).filter("draw <> 0")
    rows = rows.withColumn("text", F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("draw") == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair of all conversations after the damage."""
    turns = table(spark, sf_dir, "conversations")
    return repair(damage(turns), turns.select("conv_id").distinct())
