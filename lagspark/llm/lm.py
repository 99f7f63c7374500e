"""Corpus language model as a weighted backoff automaton, built in parts and traversed once per text.

Smoothed n-grams are states: a state h has an arc for every word seen after it,
weighted log10((c(hw) + m * P(w | h')) / (c(h) + m)), that leads to the longest
state which ends the history hw, and a failure arc to the shorter history h',
weighted log10(m / (c(h) + m)); so every state's probabilities sum to one.

No model of the whole corpus is ever in one place.  Tasks cut their rows into
chunks.  A chunk sends its distinct n-grams, as sorted hashes with counts,
in one block per range of hashes; the node that owns a range adds up the blocks of a
group of chunks.  One group answers them at once; with more groups, nodes send
what they have combined on to the nodes of finer ranges, and answers come back
the same way.  The number of ranges is bounded, so blocks, rows and bytes grow
in proportion to the corpus, and no node holds more than a few chunks' n-grams.
With the answers a chunk builds the part of the automaton that its texts can
reach, and traverses each text from left to right.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .shared import Scratch, partitions

#: Text bytes at which a chunk is closed.
CHUNK_BYTES = 6 << 20
#: Chunks' n-grams that a node holds, and ranges that a node cuts its keys into at most.
NODE_CHUNKS, MOST_RANGES = 2, 4096
#: Prior weights of the shorter history, by length of the longer one from one word on: near the
#: best of a grid for the held-out documents at sf0.1 (3.36 decimal digits a token; 3.64 at 20, 5).
PRIORS = (2000.0, 3.0)
#: Bits that name an n-gram: of 10**12 different ones, one in 70,000 shares its name with another.
KEY_BITS = 56
#: Tokens that one lane of a traversal scores.
LANE = 512
#: Documents whose crc32 leaves this remainder are held out.
MODULUS, HELD_OUT = 7, 2
_END, _BEGIN = T.stream(2, 909)
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_TYPES = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
_ASKED = "node long, part int, child long, mark long, keys binary, counts binary, words binary, tokens long"
_ANSWERED = "child long, part int, mark long, totals binary, tokens long, vocabulary long"


# Blocks of keys and counts.


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct 64-bit keys as differences of the least whole number of bytes."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    width = data[0]
    cut = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(cut) + 1, 8), np.uint8)
    steps[1:, :width] = cut
    steps[0] = np.frombuffer(data, np.uint8, 8, 1)
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """A byte per count, compressed after their number; counts from 255 on follow as 64-bit integers, in order."""
    counts = np.asarray(counts, np.int64)
    raw = np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()
    return struct.pack("<qq", len(counts), len(raw)) + pa.compress(raw, "zstd", asbytes=True)


def unpack_counts(data: bytes) -> np.ndarray:
    n, size = struct.unpack_from("<qq", data)
    raw = pa.decompress(data[16:], size, "zstd", asbytes=True)
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw[n:], "<i8")
    return out


@lru_cache(64)
def _inner(path: int, ranges: int, depth: int) -> np.ndarray:
    """Bounds between the ranges that a node's range is cut into; path numbers it among ranges**depth."""
    whole = ranges ** (depth + 1)
    return np.array([((path * ranges + q) << KEY_BITS) // whole for q in range(1, ranges)], np.uint64)


def _cut(keys: np.ndarray, inner: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.searchsorted(keys, inner), [len(keys)]))


# The n-grams of a chunk.


class Grams:
    """The distinct n-grams of some texts, and which of them ends at each token.

    Tokens are a text's lower-cased words, then one end; the beginning is a
    word of histories.  keys: sorted hashes; first: first token of each text,
    and the number of tokens; place[n - 1][i]: position in keys of the n-gram
    that ends at token i, or -1 where the text doesn't reach back that far;
    begin: position of the beginning.
    """

    def __init__(self, texts: pa.Array | pa.ChunkedArray, order: int):
        counts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for _, _, w in T.batches(texts):
            counts.append(w.counts)
            hashes.append(w.hashes())
        counts = np.concatenate(counts)
        self.order, self.first = order, np.concatenate(([0], np.cumsum(counts + 1)))
        tokens = np.full(self.first[-1], _END, np.uint64)
        self.is_end = np.zeros(len(tokens), bool)
        self.is_end[self.first[1:] - 1] = True
        tokens[~self.is_end] = np.concatenate(hashes)
        del hashes
        self.room = np.arange(len(tokens)) - np.repeat(self.first[:-1], counts + 1)
        starts = self.room == 0
        self.mark = int(T.signed(T.mix(tokens + np.arange(len(tokens), dtype=np.uint64)).sum(dtype=np.uint64, keepdims=True))[0]) if len(tokens) else 0

        real = [self.room >= n - 2 for n in range(1, order + 1)]
        parts = [np.array([_BEGIN], np.uint64), tokens]
        history = np.empty_like(tokens)
        history[1:] = tokens[:-1]
        history[starts] = _BEGIN
        with np.errstate(over="ignore"):
            for n in range(2, order + 1):
                gram = T.mix(T.mix(history + np.uint64(n)) * np.uint64(3) + tokens)
                parts.append(gram[real[n - 1]])
                history[1:] = gram[:-1]
        every = np.concatenate(parts) >> np.uint64(64 - KEY_BITS)
        cut = np.cumsum([0] + [len(p) for p in parts])
        del parts, history
        by = np.argsort(every)
        own = every[by]
        del every
        fresh = np.empty(len(own), bool)
        fresh[:1], fresh[1:] = True, own[1:] != own[:-1]
        self.keys = own[fresh]
        where = np.empty(len(own), np.int32)
        where[by] = np.cumsum(fresh, dtype=np.int32) - 1
        del own, by
        self.begin, self.place = int(where[0]), []
        for n, (a, b) in enumerate(zip(cut[1:-1], cut[2:])):
            place = np.full(len(tokens), -1, np.int32)
            place[real[n]] = where[a:b]
            self.place.append(place)

    def counts(self, train: np.ndarray) -> np.ndarray:
        """How often each n-gram occurs in the texts marked in train; the beginning once a text."""
        use, n = np.repeat(train, np.diff(self.first)), len(self.keys)
        out = np.zeros(n, np.int64)
        for place in self.place:
            out += np.bincount(place[use & (place >= 0)], minlength=n)
        out[self.begin] += int(train.sum())
        return out


class Automaton:
    """States, arcs and failure arcs of the n-grams of some texts.

    State 0 is the empty history; its arcs are an array by word, with the weight
    of an unknown one where a word has no arc.  Other arcs are sorted by state
    and word.
    """

    def __init__(self, grams: Grams, totals: np.ndarray, n_train: int, vocabulary: int, priors: Sequence[float] = PRIORS):
        n, order = len(grams.keys), grams.order
        self.words, self.size = n, grams.order
        rep, length = np.zeros(n, np.int32), np.zeros(n, np.int8)
        for k, place in enumerate(grams.place):
            at = np.flatnonzero(place >= 0)
            rep[place[at]] = at
            length[place[at]] = k + 1
        length[grams.begin] = 0
        ends = grams.is_end[rep] if len(grams.is_end) else np.zeros(n, bool)
        known = totals > 0
        is_state = known & (length < order) & ~(ends & (length > 0))
        state = np.zeros(n, np.int32)
        state[is_state] = np.arange(1, int(is_state.sum()) + 1, dtype=np.int32)
        self.state_of, self.start = state, int(state[grams.begin])

        p = np.zeros(n)
        self.root_weight, self.root_to = np.full(n, -np.log10(n_train + vocabulary + 1)), np.zeros(n, np.int32)
        heads, words, to, arcs = [], [], [], []
        self.fail_to, self.fail_weight = np.zeros(int(is_state.sum()) + 1, np.int32), np.zeros(int(is_state.sum()) + 1)

        def fail(g: np.ndarray, shorter: np.ndarray | int, prior: float) -> None:
            self.fail_to[state[g]] = shorter
            self.fail_weight[state[g]] = np.log10(prior / (totals[g] + prior))

        if self.start:
            fail(np.array([grams.begin]), 0, priors[0])
        for k in range(1, order + 1):
            g = np.flatnonzero(known & (length == k))
            at = rep[g]
            if k == 1:
                p[g] = (totals[g] + 1) / (n_train + vocabulary + 1)
                self.root_weight[g], self.root_to[g] = np.log10(p[g]), state[g]
                shorter = np.zeros(len(g), np.int32)
            else:
                arcs.append(g)
                words.append(grams.place[0][at])
                before = np.where(grams.room[at] == 0, grams.begin, grams.place[k - 2][at - 1])
                ending = grams.place[k - 2][at]
                prior = priors[k - 2]
                p[g] = (totals[g] + prior * p[ending]) / (totals[before] + prior)
                heads.append(state[before])
                to.append(state[g] if k < order else state[ending])
                shorter = state[ending]
            own = is_state[g]
            if own.any():
                fail(g[own], shorter[own], priors[k - 1])
        keys = np.concatenate(heads).astype(np.int64) * n + np.concatenate(words)
        by = np.argsort(keys)
        self.arc_keys = np.append(keys[by], np.iinfo(np.int64).max)
        self.arc_to = np.append(np.concatenate(to)[by], 0)
        self.arc_weight = np.append(np.log10(p[np.concatenate(arcs)[by]]), 0.0)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, log10 probabilities) of reading a word in each state."""
        state, out = state.copy(), np.zeros(len(state))
        at_root = state == 0
        todo = np.flatnonzero(~at_root)
        while len(todo):
            key = state[todo].astype(np.int64) * self.words + word[todo]
            arc = np.searchsorted(self.arc_keys, key)
            hit = self.arc_keys[arc] == key
            done, arc = todo[hit], arc[hit]
            out[done] += self.arc_weight[arc]
            state[done] = self.arc_to[arc]
            todo = todo[~hit]
            out[todo] += self.fail_weight[state[todo]]
            state[todo] = self.fail_to[state[todo]]
            fell = state[todo] == 0
            at_root[todo[fell]] = True
            todo = todo[~fell]
        root = np.flatnonzero(at_root)
        out[root] += self.root_weight[word[root]]
        state[root] = self.root_to[word[root]]
        return state, out

    def lanes(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first token, text) of pieces of at most LANE tokens."""
        pieces = -(-np.diff(first) // LANE)
        doc = np.repeat(np.arange(len(pieces)), pieces)
        return first[doc] + LANE * (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)), doc

    def traverse(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of each text.

        All lanes go from left to right together, each carrying its state.  The
        state after order - 1 words doesn't depend on the state before them, so
        a lane inside a text reads these words first, and scores from then on.
        """
        start, doc = self.lanes(first)
        inside = start > first[doc]
        warm = np.where(inside, self.size - 1, 0)
        begin = start - warm
        steps = np.minimum(start + LANE, first[doc + 1]) - begin
        by = np.argsort(-steps, kind="stable")
        begin, steps, warm = begin[by], steps[by], warm[by]
        state, total = np.where(inside[by], 0, self.start).astype(np.int32), np.zeros(len(by))
        for k in range(int(steps[0]) if len(steps) else 0):
            m = int(np.searchsorted(-steps, -k, "left"))
            state[:m], gain = self.step(state[:m], words[begin[:m] + k])
            total[:m] += np.where(k >= warm[:m], gain, 0.0)
        back = np.empty(len(by))
        back[by] = total
        return np.add.reduceat(back, np.searchsorted(doc, np.arange(len(first) - 1))) if len(back) else back


# Chunks and their exchange.


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, pa.Table]]:
    """(id, rows) of the chunks of a task: rows in their order, closed at `limit` bytes of text."""
    task, number = TaskContext.get().partitionId() << 32, 0
    parts, room = [], limit
    for batch in batches:
        at, sizes = 0, np.diff(T.flat(batch.column("text"))[1]) + 16
        ends = np.cumsum(sizes)
        while at < len(ends):
            done = int(ends[at - 1]) if at else 0
            cut = int(np.searchsorted(ends, done + room))
            if cut == len(ends):  # the rest leaves room
                parts.append(batch.slice(at))
                room -= int(ends[-1]) - done
                break
            parts.append(batch.slice(at, cut + 1 - at))
            yield task + number, pa.Table.from_batches(parts)
            at, number, parts, room = cut + 1, number + 1, [], limit
    if parts:
        yield task + number, pa.Table.from_batches(parts)


def _asked(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [f.split()[0] for f in _ASKED.split(", ")])


def _blocks(node, child: int, mark: int, keys: np.ndarray, counts: np.ndarray, word: np.ndarray, tokens: int, inner: np.ndarray) -> pa.RecordBatch:
    """A row per range; node: from a range's number to the node that owns it.  Tokens go with the first."""
    cut = _cut(keys, inner)
    return _asked([(node(q), q, child, mark, pack_keys(keys[a:b]), pack_counts(counts[a:b]), np.packbits(word[a:b]).tobytes(), 0 if q else tokens) for q, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist()))])


class _Node:
    """The blocks of a node's children, combined: keys, counts, which are words, tokens; where: of each child's keys."""

    def __init__(self, table: pa.Table):
        self.child, self.marks = table.column("child").to_pylist(), table.column("mark").to_pylist()
        self.part = table.column("part").to_pylist()
        own = [unpack_keys(x) for x in table.column("keys").to_pylist()]
        self.sizes = np.cumsum([0] + [len(k) for k in own])
        every = np.concatenate(own)
        del own
        by = np.argsort(every, kind="stable")  # runs are sorted
        every = every[by]
        fresh = np.empty(len(every), bool)
        fresh[:1], fresh[1:] = True, every[1:] != every[:-1]
        self.keys = every[fresh]
        del every
        self.where = np.empty(len(by), np.int32)
        self.where[by] = np.cumsum(fresh, dtype=np.int32) - 1
        del by, fresh
        self.counts = np.zeros(len(self.keys), np.int64)
        self.word = np.zeros(len(self.keys), bool)
        for a, b, counts, marks in zip(self.sizes[:-1], self.sizes[1:], table.column("counts").to_pylist(), table.column("words").to_pylist()):
            at = self.where[a:b]  # distinct
            self.counts[at] += unpack_counts(counts)
            self.word[at] |= np.unpackbits(np.frombuffer(marks, np.uint8), count=len(at)).astype(bool)
        self.tokens = sum(table.column("tokens").to_pylist())

    def answers(self, totals: np.ndarray, tokens: int, vocabulary: int) -> pa.Table:
        m = len(self.child)
        return pa.table({
            "child": pa.array(self.child, pa.int64()),
            "part": pa.array(self.part, pa.int32()),
            "mark": pa.array(self.marks, pa.int64()),
            "totals": pa.array([pack_counts(totals[self.where[a:b]]) for a, b in zip(self.sizes[:-1], self.sizes[1:])], pa.binary()),
            "tokens": pa.array([tokens] * m, pa.int64()),
            "vocabulary": pa.array([vocabulary] * m, pa.int64()),
        })


def _joined(answer: pa.Table) -> tuple[np.ndarray, int, int]:
    """(totals, tokens, vocabulary) from a child's answers."""
    answer = answer.sort_by("part")
    return np.concatenate([unpack_counts(x) for x in answer.column("totals").to_pylist()]), sum(answer.column("tokens").to_pylist()), sum(answer.column("vocabulary").to_pylist())


def _exchange(asked: DataFrame, groups: list[int], ranges: int, depth: int = 0) -> DataFrame:
    """(child, part, mark, totals, tokens, vocabulary) for the blocks asked; groups: their number at every depth."""
    span = ranges ** (depth + 1)  # nodes of one group

    def last(table: pa.Table) -> pa.Table:
        own = _Node(table)
        out = own.answers(own.counts, own.tokens, int(own.word.sum()))
        T.release()
        return out

    if groups[depth] == 1:
        return asked.groupBy("node").applyInArrow(last, _ANSWERED)
    further = span * ranges

    def combine(key: tuple, table: pa.Table) -> pa.Table:
        node, own = key[0].as_py(), _Node(table)
        group, path = divmod(node, span)
        out = _blocks(lambda q: (group % groups[depth + 1]) * further + path * ranges + q, node, 0, own.keys, own.counts, own.word, own.tokens, _inner(path, ranges, depth + 1))
        T.release()
        return pa.Table.from_batches([out])

    def pass_down(key: tuple, table: pa.Table, answer: pa.Table) -> pa.Table:
        out = _Node(table).answers(*_joined(answer))
        T.release()
        return out

    above = _exchange(asked.groupBy("node").applyInArrow(combine, _ASKED), groups, ranges, depth + 1)
    return asked.groupBy("node").cogroup(above.groupBy("child")).applyInArrow(pass_down, _ANSWERED)


def _plan(total: int, chunk_bytes: int, most_ranges: int) -> tuple[int, list[int]]:
    """(ranges, groups of chunks at every depth): the fewest depths whose nodes hold NODE_CHUNKS chunks' n-grams."""
    chunks, depths = total // chunk_bytes + 1, 1
    while True:
        ranges = max(2, -(-round(chunks ** (1 / depths)) // NODE_CHUNKS))
        if ranges <= most_ranges:
            break
        depths += 1
    size = NODE_CHUNKS * ranges
    return ranges, [max(1, -(-chunks // size ** (d + 1))) for d in range(depths - 1)] + [1]


def score(docs: DataFrame, *, order: int = 3, priors: Sequence[float] = PRIORS, chunk_bytes: int = CHUNK_BYTES, most_ranges: int = MOST_RANGES, rescan: bool = False) -> DataFrame:
    """SCHEMA for every row of docs; the model learns from rows that aren't held out.

    Tokens are lower-cased words, then one end.  base_score sums log10 of
    add-one unigram probabilities, score is the automaton's log10 probability;
    both are rounded to six decimals.  Every row is read twice: rescan says
    that docs gives the same rows in the same order then, as a scan of files
    does; else docs is written first.  A null or blank text is its end alone.
    A null doc_id counts as the empty text for the split and is trained on;
    repeated rows count as often as they occur; a very long text is one chunk,
    traversed in pieces; other columns are ignored, whatever their names; an
    empty table gives an empty result.
    """
    if len(priors) != order - 1:
        raise ValueError("a prior for every length of history")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % MODULUS == HELD_OUT
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held"))
    if not rescan:
        slim = Scratch(docs.sparkSession, "lm").put("texts", slim)
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunk_bytes = max(min(chunk_bytes, total // (2 * partitions(docs.sparkSession))), chunk_bytes // 6)  # no fewer chunks than tasks
    ranges, groups = _plan(total, chunk_bytes, most_ranges)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for child, table in _chunks(batches, chunk_bytes):
            own = Grams(table.column("text"), order)
            train = ~np.array(table.column("held"), bool)
            use = np.repeat(train, np.diff(own.first))
            word = np.zeros(len(own.keys), bool)
            word[own.place[0][use]] = True
            group = int(T.mix(np.array([child], np.uint64))[0]) % groups[0]
            yield _blocks(lambda q: group * ranges + q, child, own.mark, own.keys, own.counts(train), word, int(use.sum()), _inner(0, ranges, 0))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for child, table in _chunks(batches, chunk_bytes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                out.write_table(table.combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([child], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["child", "rows"])

    def run(key: tuple, sent: pa.Table, answer: pa.Table) -> pa.Table:
        (rows,) = sent.column("rows").to_pylist()
        table = pa.ipc.open_stream(rows).read_all()
        own = Grams(table.column("text"), order)
        totals, n_train, vocabulary = _joined(answer)
        if set(answer.column("mark").to_pylist()) != {own.mark}:
            raise ValueError("the rows came in another order when read again: write them first")
        model = Automaton(own, totals, n_train, vocabulary, priors)
        known, ends = totals[own.place[0]], own.first[:-1]
        start, doc = model.lanes(own.first)
        base = np.add.reduceat(np.log10((known + 1) / (n_train + vocabulary + 1)), start)
        columns = [
            table.column("doc_id"), table.column("held"), np.diff(own.first), np.add.reduceat((known > 0).astype(np.int64), ends), [n_train] * len(table),
            np.add.reduceat(base, np.searchsorted(doc, np.arange(len(ends)))).round(6), model.traverse(own.place[0], own.first).round(6),
        ]
        del own, model
        T.release()
        return pa.table({n: c if isinstance(c, pa.ChunkedArray) else pa.array(c, t) for n, c, t in zip(_NAMES, columns, _TYPES)})

    answers = _exchange(slim.mapInArrow(T.lean(ask), _ASKED), groups, ranges)
    return slim.mapInArrow(T.lean(send), "child long, rows binary").groupBy("child").cogroup(answers.groupBy("child")).applyInArrow(run, SCHEMA)
