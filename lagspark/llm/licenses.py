"""License notices in texts: MinHash bands over overlapping windows, then shingle containment.

Templates are few and fixed, so their bands travel with the tasks.  Windows are
a little longer than the templates of their length class and start at every
quarter of its length, so some window holds any whole notice.  Of a notice with
the least containment such a window still has a Jaccard similarity of 0.35 to
the template, and misses all of 64 bands of one coordinate with probability
(1 - 0.35) ** 64, 1e-12; tests compare with containment at every word.  A window
that collides retrieves its template, whose containment is then taken over the
adjacent windows as well, so that words put into a notice don't hide it.  A
window can only collide if it has a shingle of a template; the others are not
hashed.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .license_texts import TEXTS
from .near_dup import _circle, signature

#: Bands of one coordinate: a window collides if any coordinate does.
WORDS, PERCENT, BANDS, ROWS = 5, 75, 64, 1
SCHEMA = "doc_id long, license_id string, start long, `end` long, shared long, total long, containment double"

# Words of notices are runs of letters, digits and non-ASCII characters.
_PLAIN = np.full(256, 32, np.uint8)
for _c in (*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)):
    _PLAIN[_c] = _c


class Library:
    """Templates with their shingles, and the bands of their signatures."""

    def __init__(self, templates: Mapping[str, str], words: int = WORDS, bands: int = BANDS, rows: int = ROWS):
        self.words, self.bands, self.rows = words, bands, rows
        self.circle = _circle(bands * rows)
        self.names, self.sets, self.lengths = [], [], []
        for name, text in templates.items():
            (_, _, w), = T.batches(pa.array([_plain(text.encode())]))
            (s,) = T.shingle_sets(w, words)
            if len(s):
                self.names.append(name)
                self.sets.append(s)
                self.lengths.append(int(w.counts[0]))
        self.all = np.unique(np.concatenate(self.sets))
        self.band: dict[tuple, list[int]] = {}
        for i, s in enumerate(self.sets):
            for key in self.keys(s):
                self.band.setdefault(key, []).append(i)
        # Length classes: half as long again each time.
        classes: dict[int, list[int]] = {}
        for i, n in enumerate(self.lengths):
            size = words
            while size < n:
                size = max(size + 1, size * 3 // 2)
            classes.setdefault(size, []).append(i)
        self.classes = [(size + max(1, size // 4), max(1, size // 4), set(own)) for size, own in classes.items()]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"circle": None}  # a view of a table, far larger when written out

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state | {"circle": _circle(state["bands"] * state["rows"])}

    def keys(self, shingles: np.ndarray) -> list[tuple]:
        sig = signature(shingles, self.circle).reshape(self.bands, self.rows).tolist()
        return [(b, *row) for b, row in enumerate(sig)]


def _plain(data: bytes) -> bytes:
    return _PLAIN[np.frombuffer(data, np.uint8)].tobytes()


def _shortest(part: np.ndarray) -> tuple[int, int]:
    """The shortest slice of part with every value of part, the first of these."""
    count, least, best, a = {}, len(set(part.tolist())), (0, len(part)), 0
    for b, h in enumerate(part.tolist()):
        count[h] = count.get(h, 0) + 1
        while len(count) == least:
            if b + 1 - a < best[1] - best[0]:
                best = (a, b + 1)
            x = int(part[a])
            count[x] -= 1
            if not count[x]:
                del count[x]
            a += 1
    return best


def _around(lib: Library, i: int, hashes: np.ndarray, spans: list[tuple[int, int, int]], reach: int, percent: int) -> list[tuple[int, int, int]]:
    """spans (first, last + 1, shared) of template i with its missing shingles nearby, and notices that no window holds.

    Places of its shingles less than reach apart are in adjacent windows.
    """
    at = np.flatnonzero(np.isin(hashes, lib.sets[i]))
    spans, out = sorted(spans), []
    for k, (a, b, _) in enumerate(spans):
        have = set(hashes[at[(at >= a) & (at + lib.words <= b)]].tolist())
        low, high = out[-1][1] if out else 0, spans[k + 1][0] if k + 1 < len(spans) else len(hashes) + lib.words
        edge = a
        for p in at[(at >= low) & (at < a)][::-1].tolist():
            if edge - p >= reach:
                break
            edge = p
            if int(hashes[p]) not in have:
                have.add(int(hashes[p]))
                a = p
        edge = b - lib.words
        for p in at[(at > b - lib.words) & (at + lib.words <= high)].tolist():
            if p - edge >= reach:
                break
            edge = p
            if int(hashes[p]) not in have:
                have.add(int(hashes[p]))
                b = p + lib.words
        out.append((a, b, len(have)))
    limits = [0, *[x for a, b, _ in out for x in (a, b)], len(hashes) + lib.words]
    todo = []
    for low, high in zip(limits[::2], limits[1::2]):
        free = at[(at >= low) & (at + lib.words <= high)]
        todo += np.split(free, np.flatnonzero(np.diff(free) >= reach) + 1)
    while todo:
        own = todo.pop()
        if 100 * len(np.unique(hashes[own])) >= percent * len(lib.sets[i]):
            a, b = _shortest(hashes[own])
            first, last = int(own[a]), int(own[b - 1]) + lib.words
            out.append((first, last, len(np.unique(hashes[own]))))
            todo += [own[own + lib.words <= first], own[own >= last]]
    return out


def find(lib: Library, hashes: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int, int, int]]:
    """(template, first word, last word + 1, shared shingles) of notices in one text.

    hashes: the shingle hash at each word that begins one.  Of overlapping
    windows with one template the best counts, then the first; then the text
    around counts, so words put into a notice don't hide its other part.
    """
    hit = np.flatnonzero(np.isin(hashes, lib.all))
    if not len(hit):
        return []
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    reach: dict[int, int] = {}  # of templates that a window collides with
    last_start = len(hashes) + lib.words - 1
    for size, step, own in lib.classes:
        span = max(1, size - lib.words + 1)  # shingles in a window
        first = np.maximum(0, (hit - span + step) // step)
        starts = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(first, hit // step)])) * step
        for start in starts.tolist():
            part = hashes[start : min(start + span, last_start)]
            part_set = np.unique(part)
            for i in {i for key in lib.keys(part_set) for i in lib.band.get(key, ())} & own:
                reach[i] = 2 * span
                at = np.flatnonzero(np.isin(part, lib.sets[i]))
                # One run without a wide gap is enough, if it is; else the whole window counts.
                runs = np.split(at, np.flatnonzero(np.diff(at) > max(lib.words, lib.lengths[i] // 4)) + 1)
                best = max(runs, key=lambda r: len(np.unique(part[r])))
                for own_at in (best, at):
                    shared = len(np.unique(part[own_at]))
                    if 100 * shared >= percent * len(lib.sets[i]):
                        a, b = _shortest(part[own_at])  # not the edge of another copy
                        found.setdefault(i, []).append((start + int(own_at[a]), start + int(own_at[b - 1]) + lib.words, shared, i))
                        break
    out = []
    for i, far in reach.items():
        taken: list[tuple] = []
        for a, b, shared, _ in sorted(found.get(i, []), key=lambda x: (-x[2], x[1] - x[0], x[0])):
            if all(b <= c or d <= a for c, d, _ in taken):
                taken.append((a, b, shared))
        out += [(i, a, b, shared) for a, b, shared in _around(lib, i, hashes, taken, far, percent)]
    return sorted(out, key=lambda x: (x[1], x[0]))


def scan(docs: DataFrame, templates: Mapping[str, str] = TEXTS, *, percent: int = PERCENT) -> DataFrame:
    """A row per notice found in docs (SCHEMA): the span in code points and how
    much of the template's five-word shingles it has, at least percent of them.

    Words are lower-cased runs of letters, digits and non-ASCII characters.  A
    template of fewer than five words is one shingle and is found only as a
    whole text of these words.  Null and blank texts have none; of a very long
    text only the words around shingles of templates are compared; repeated rows
    and null doc_ids are scanned like others; other columns are ignored; no
    rows give no rows.
    """
    lib = Library(templates)
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    names = ["doc_id", "license_id", "start", "end", "shared", "total", "containment"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = T.stream(lib.words, 101)
        for batch in batches:
            buf, offs = T.flat(batch.column("text"))
            ids, rows = batch.column("doc_id").to_pylist(), []
            for i, j in T.passes(offs):
                own, raw = offs[i : j + 1] - offs[i], buf[offs[i] : offs[j]]
                w = T.split(_PLAIN[raw], own)
                h = w.hashes()
                n = len(h) - lib.words + 1
                if n < 1:
                    short = np.flatnonzero(w.counts)
                    whole = np.zeros(0, np.uint64)
                else:
                    with np.errstate(over="ignore"):
                        whole = np.zeros(n, np.uint64)
                        for k in range(lib.words):
                            whole += T.mix(h[k : n + k] ^ salt[k])
                        whole = T.mix(whole)
                    short = np.flatnonzero((w.counts > 0) & (w.counts < lib.words))
                near = np.flatnonzero(np.isin(whole, lib.all))
                cand = np.unique(np.concatenate((w.doc[near] if len(near) else np.zeros(0, np.int64), short)))
                points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                for d in cand.tolist():
                    a, b = int(w.first[d]), int(w.first[d + 1])
                    if b - a >= lib.words:
                        hashes = whole[a : b - lib.words + 1]
                    else:
                        with np.errstate(over="ignore"):
                            hashes = T.mix(np.array([T.mix(h[a:b] ^ salt[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
                    for k, p, q, shared in find(lib, hashes, percent):
                        q, base = min(q, b - a), points[own[d]]
                        rows.append((ids[i + d], lib.names[k], int(points[w.starts[a + p]] - base), int(points[w.ends[a + q - 1]] - base), shared, len(lib.sets[k]), shared / len(lib.sets[k])))
            columns = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(T.lean(run), SCHEMA)
