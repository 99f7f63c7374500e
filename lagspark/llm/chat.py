"""Conversations repaired at least cost to legal turn orders, then rendered.

The automaton: an optional system turn, then user and assistant in turn, ending
after an assistant.  A turn may be relabelled, merged into the one before, or
preceded by empty turns; a dynamic program over the automaton's states chooses.
One input turn is a small matrix of least costs from state to state, and these
compose, so a conversation of any length is cut into blocks: blocks sum up
their part as one matrix, matrices of many consecutive parts are composed in
turn, and a route through these, then through the parts of each, gives every
block the states between which it repairs its own turns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, partitions

# States: before any turn, then the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = ["", "system", "user", "assistant"]
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
RELABEL, MERGE, MERGE_OTHER, INSERT = 2, 1, 3, 3
#: Costs are compared first, then the number of turns; both are sums.
TURN = 1
COST = 1 << 40
NEVER = 1 << 60
BLOCK_ROWS = 20_000
#: Consecutive parts of one conversation that are composed before a route is chosen.
SPAN = 1024
SCHEMA = "conv_id long, seq long, turn_no long, role string, action string, source_turn long, text string, rendered string"


def _steps() -> dict[int, list[tuple[int, int, int, tuple[int, ...], str]]]:
    """By input role (START for an unknown one): (from, to, weight, inserted roles, action)."""
    out: dict[int, list] = {}
    for role in range(4):
        found: list = []
        for a in range(4):
            # Up to two empty turns may come before the turn itself.
            paths: list[tuple[int, ...]] = [()]
            for _ in range(2):
                paths += [(*p, q) for p in paths if len(p) == len(paths[-1]) for q in NEXT[p[-1] if p else a]]
            for p in dict.fromkeys(paths):
                for q in NEXT[p[-1] if p else a]:
                    same = q == role
                    found.append((a, q, (len(p) * INSERT + (0 if same else RELABEL)) * COST + (len(p) + 1) * TURN, p, "keep" if same else "relabel"))
            if a != START:
                found.append((a, a, (MERGE if a == role else MERGE_OTHER) * COST, (), "merge"))
        out[role] = found
    return out


STEPS = _steps()
#: Empty turns that end a conversation legally, by state.
CLOSING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def _matrix(role: int) -> np.ndarray:
    m = np.full((4, 4), NEVER, np.int64)
    for a, b, w, _, _ in STEPS[role]:
        m[a, b] = min(m[a, b], w)
    return m


_MATRIX = [_matrix(r) for r in range(4)]
_UNIT = np.where(np.eye(4, dtype=bool), 0, NEVER)


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least cost of going by a, then by b."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), NEVER)


def closing(state: int) -> int:
    return len(CLOSING[state]) * (INSERT * COST + TURN)


def repair(roles: list[int], entry: int = START, leave: int | None = None) -> tuple[list[tuple[tuple[int, ...], str, int]], int]:
    """([(inserted roles, action, role)], last state) of least cost; leave: the state to end in, else the cheapest to close."""
    cost, back = [NEVER] * 4, []
    cost[entry] = 0
    for r in roles:
        new, how = [NEVER] * 4, [None] * 4
        for step in STEPS[r]:
            a, b, w = step[:3]
            if cost[a] < NEVER and cost[a] + w < new[b]:
                new[b], how[b] = cost[a] + w, step
        cost = new
        back.append(how)
    end = leave if leave is not None else min(range(4), key=lambda s: (cost[s] + closing(s), s))
    state, out = end, []
    for how in reversed(back):
        a, b, _, inserted, action = how[state]
        out.append((inserted, action, b))
        state = a
    return out[::-1], end


def route(matrices: list[np.ndarray], entry: int = START, leave: int | None = None) -> list[int]:
    """States before, between and after matrices along the cheapest way; leave None: to the state that is cheapest to close."""
    cost = [np.where(np.arange(4) == entry, 0, NEVER)]
    for m in matrices:
        cost.append(np.minimum((cost[-1][:, None] + m).min(axis=0), NEVER))
    states = [leave if leave is not None else min(range(4), key=lambda s: (cost[-1][s] + closing(s), s))]
    for c, m in zip(cost[-2::-1], matrices[::-1]):
        states.append(int(np.argmin(c + m[:, states[-1]])))
    return states[::-1]


def _turns(m: np.ndarray, a: int, b: int) -> int:
    return int(m[a, b] % COST)


def _parts(t: pa.Table) -> list[tuple[int, int]]:
    """Ranges of rows of one conversation, in a sorted block."""
    ids, out, at = t.column("conv_id").to_pylist(), [], 0
    for i in range(1, len(ids) + 1):
        if i == len(ids) or ids[i] != ids[at]:
            out.append((at, i))
            at = i
    return out


_ORDER = [("conv_id", "ascending"), ("turn", "ascending"), ("role", "ascending"), ("text", "ascending")]


def _sorted(t: pa.Table) -> pa.Table:
    keys = [k for k in _ORDER if k[0] in t.column_names]
    return t.take(pa.compute.sort_indices(t, sort_keys=keys, null_placement="at_start"))


def _codes(t: pa.Table) -> list[int]:
    return [ROLES.get((r or "").strip().lower(), START) for r in t.column("role").to_pylist()]


def _matrices(t: pa.Table) -> list[np.ndarray]:
    return [np.array(m).reshape(4, 4) for m in t.column("m").to_pylist()]


def _plans(blocks: DataFrame, span: int) -> DataFrame:
    """(block, part, entry, leave, turns, first, last) of the parts of conversations that a block's edge cuts.

    first is the block in which the conversation begins, turns the legal turns
    before the part; leave is null at the end.  Only roles are read.
    """

    def edges(key: tuple, t: pa.Table) -> pa.Table:
        t = _sorted(t)
        parts, codes = _parts(t), _codes(t)
        rows = []
        for k in dict.fromkeys((0, len(parts) - 1)):
            m = _UNIT
            for r in codes[slice(*parts[k])]:
                m = compose(m, _MATRIX[r])
            conv = t.column("conv_id")[parts[k][0]].as_py()
            rows.append(("null" if conv is None else str(conv), key[0].as_py(), k, m.ravel().tolist()))
        types = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), types)], ["conv", "block", "part", "m"])

    def fold(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        m = _UNIT
        for x in _matrices(t):
            m = compose(m, x)
        return pa.table({"conv": pa.array([key[0].as_py()], pa.string()), "chunk": pa.array([key[1].as_py()], pa.int64()), "parts": pa.array([len(t)], pa.int64()), "block": pa.array([t.column("block")[0].as_py()], pa.int32()), "m": pa.array([m.ravel().tolist()], pa.list_(pa.int64()))})

    def top(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        ms = _matrices(t)
        own = sum(t.column("parts").to_pylist()) > 1
        states, before = route(ms) if own else [], 0
        rows = []
        for k, chunk in enumerate(t.column("chunk").to_pylist() if own else []):
            rows.append((key[0].as_py(), chunk, states[k], states[k + 1], before, t.column("block")[0].as_py(), k == len(ms) - 1))
            before += _turns(ms[k], states[k], states[k + 1])
        types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, types)], ["conv", "chunk", "entry", "leave", "turns", "first", "last"])

    def within(key: tuple, t: pa.Table, plan: pa.Table) -> pa.Table:
        rows = []
        if len(plan) and len(t):
            t, (p,) = t.sort_by("block"), plan.to_pylist()
            ms, before = _matrices(t), p["turns"]
            states = route(ms, p["entry"], p["leave"])
            for k, (block, part) in enumerate(zip(t.column("block").to_pylist(), t.column("part").to_pylist())):
                rows.append((block, part, states[k], states[k + 1], before, p["first"], p["last"] and k == len(ms) - 1))
                before += _turns(ms[k], states[k], states[k + 1])
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, types)], ["block", "part", "entry", "leave", "turns", "first", "last"])

    found = blocks.select("conv_id", "turn", "role", "block").groupBy("block").applyInArrow(edges, "conv string, block int, part int, m array<long>")
    found = found.withColumn("chunk", F.floor(F.col("block") / span))
    chunks = found.groupBy("conv", "chunk").applyInArrow(fold, "conv string, chunk long, parts long, block int, m array<long>")
    ways = chunks.groupBy("conv").applyInArrow(top, "conv string, chunk long, entry int, leave int, turns long, first int, last boolean")
    return found.groupBy("conv", "chunk").cogroup(ways.groupBy("conv", "chunk")).applyInArrow(within, "block int, part int, entry int, leave int, turns long, first int, last boolean")


def format_chats(conversations: DataFrame, *, block_rows: int = BLOCK_ROWS, span: int = SPAN) -> DataFrame:
    """One row per turn of the repaired conversations that came in or was put in (SCHEMA).

    Rows of a conversation in the order of seq are its repaired form; turn_no
    numbers the legal turns, merged rows sharing one.  action: keep, relabel,
    merge or insert.  `rendered` joined in that order is the whole chat: each
    turn opens with <|role|>, the one before it being closed with <|end|>.
    Turns are taken by turn, then role and text, nulls first; unknown or null
    roles are relabelled; null texts are empty; rows that repeat are turns of
    their own; rows with a null conv_id form one conversation.  A very long
    conversation is cut into blocks, a very long text is one turn.  Other
    columns are ignored, whatever their names.  No rows give no rows.
    """
    spark = conversations.sparkSession
    scratch = Scratch(spark, "chat")
    slim = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"), F.monotonically_increasing_id().alias("tie"))
    n = max(partitions(spark), slim.count() // block_rows + 1)
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text", "tie")]
    blocks = scratch.put("blocks", slim.repartitionByRange(n, *order).select("*", F.spark_partition_id().alias("block")).drop("tie"))

    def run(key: tuple, t: pa.Table, plans: pa.Table) -> pa.Table:
        t, block = _sorted(t), key[0].as_py()
        plan = {p["part"]: p for p in plans.to_pylist()}
        codes, texts, turns, ids = _codes(t), t.column("text").to_pylist(), t.column("turn").to_pylist(), t.column("conv_id").to_pylist()
        out: list[tuple] = []
        for k, (i, j) in enumerate(_parts(t)):
            p = plan.get(k, {"entry": START, "leave": None, "turns": 0, "first": block, "last": True})
            entry, leave, turn_no, seq, last = p["entry"], p["leave"], p["turns"], (block - p["first"]) << 40, p["last"]
            path, end = repair(codes[i:j], entry, leave)
            open_ = entry != START

            def put(role: int, action: str, text: str, turn: int | None) -> None:
                nonlocal turn_no, seq, open_
                if action == "merge":
                    shown = "\n" + text
                else:
                    turn_no += 1
                    shown = ("<|end|>\n" if open_ else "") + f"<|{NAMES[role]}|>\n" + text
                    open_ = True
                out.append((ids[i], seq, turn_no - 1, NAMES[role], action, turn, text, shown))
                seq += 1

            for (inserted, action, role), text, turn in zip(path, texts[i:j], turns[i:j]):
                for q in inserted:
                    put(q, "insert", "", None)
                put(role, action, text or "", turn)
            if last:
                for q in CLOSING[end]:
                    put(q, "insert", "", None)
                out[-1] = (*out[-1][:-1], out[-1][-1] + "<|end|>\n")
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        return pa.table({c.split()[0]: pa.array(list(v), k) for c, v, k in zip(SCHEMA.split(", "), zip(*out), types)})

    plans = _plans(blocks, span)
    return blocks.groupBy("block").cogroup(plans.groupBy("block")).applyInArrow(run, SCHEMA)
