"""Quality rules: counts of words, symbols and lines, and suffix-array repetition.

For the latter, prefix doubling sorts the word suffixes of a document, longest
common prefixes of neighbours in that order give the LCP intervals, and the
widest interval around a suffix is the longest maximal repeated substring that
starts there.  The union of their spans is the repeated part of the document.
All documents of a numpy pass are sorted at once, documents being part of the
words' identity so that repeats never cross them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

# The characters counted as symbols, and the base rule's limits.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 50, 3, 50
#: Repeats of fewer words don't count; limits on the repeated part and on the longest repeat.
MIN_REPEAT, COVERED_PERCENT, LONGEST_WORDS = 5, 40, 100

_POWER = T.stream(1, 404)[0]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of flags between consecutive positions."""
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[at])


def longest_repeats(ids: np.ndarray) -> np.ndarray:
    """For each suffix of ids (64-bit hashes), the length of its longest prefix that another suffix starts with.

    Prefix doubling ranks suffixes by their first 1, 2, 4, .. ids; only those
    that still tie are sorted again.  The common prefixes of neighbours, which
    bound the LCP intervals, come from halving steps over prefix sums of the
    ids times powers.  Memory is a few numbers per word, however repetitive
    the text is.
    """
    n = len(ids)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    order = np.argsort(ids, kind="stable")
    own = ids[order]
    fresh = np.concatenate(([True], own[1:] != own[:-1]))
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    tied = np.concatenate((~fresh, [False]))
    active = order[tied[:-1] | tied[1:]]
    del order, own, fresh, tied
    tie0, span = active, 1
    while len(active):
        ahead = active + span
        second = np.where(ahead < n, rank[np.minimum(ahead, n)] + 1, 0)
        group = rank[active]
        key = group * np.int64(n + 2) + second
        o = np.argsort(key, kind="stable")
        active, group, key = active[o], group[o], key[o]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        top = np.concatenate(([True], group[1:] != group[:-1]))
        j = np.arange(len(active))
        place = group + j - np.maximum.accumulate(np.where(top, j, 0))
        rank[active] = place[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        tied = np.concatenate((~fresh, [False]))
        active = active[tied[:-1] | tied[1:]]
        span *= 2
    # Suffix array of the suffixes that share a first id, and common prefixes of neighbours.
    sa = tie0[np.argsort(rank[tie0], kind="stable")]
    del rank
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, _POWER))))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(ids * power[:n], dtype=np.uint64)))
        a, b = sa[:-1], sa[1:]
        common = np.zeros(len(a), np.int64)
        for k in range(span.bit_length() - 1, -1, -1):
            x, y = a + common, b + common
            at = np.flatnonzero(np.maximum(x, y) + (1 << k) <= n)
            x, y = x[at], y[at]
            same = (sums[x + (1 << k)] - sums[x]) * power[n - x] == (sums[y + (1 << k)] - sums[y]) * power[n - y]
            common[at[same]] += 1 << k
    best = np.zeros(len(sa), np.int64)
    best[:-1] = common
    best[1:] = np.maximum(best[1:], common)
    out[sa] = best
    return out


def measure(w: T.Words, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of every document of one pass; offsets are its byte offsets."""
    buf, n_docs, n = w.buf, len(offsets) - 1, len(w.doc)
    out = {"n_words": w.counts}
    points = (buf & 0xC0) != 0x80
    out["word_chars"] = _sums(points & ~T.SPACE[buf], offsets)
    out["n_symbols"] = _sums(_SYMBOL[buf], offsets)

    cut = np.flatnonzero(buf == 10)
    starts = np.unique(np.concatenate((offsets[:-1], cut + 1)))
    starts = starts[starts < len(buf)]
    ends = np.concatenate((starts[1:], [len(buf)]))
    ends = ends - (buf[ends - 1] == 10) if len(ends) else ends
    solid = np.concatenate(([0], np.cumsum(~T.SPACE[buf])))
    real = solid[ends] > solid[starts] if len(ends) else np.zeros(0, bool)
    starts, ends = starts[real], ends[real]
    doc = np.searchsorted(offsets, starts, "right") - 1
    lines = T.Words(buf, starts, ends, doc, doc)
    with np.errstate(over="ignore"):
        own = T.mix(lines.hashes(lower=False) ^ T.mix(doc.astype(np.uint64)))
        _, where = np.unique(own, return_index=True)
        out["n_dup_lines"] = np.bincount(doc, minlength=n_docs) - np.bincount(doc[where], minlength=n_docs)
        ids = T.mix(w.hashes(lower=False) ^ T.mix(w.doc.astype(np.uint64) + np.uint64(1 << 40)))
    repeat = longest_repeats(ids)

    def covered(least: int) -> np.ndarray:
        at = np.flatnonzero(repeat >= least)
        length = repeat[at] if least != REPEAT_WINDOW else np.full(len(at), REPEAT_WINDOW)
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length, -1)
        return _sums(np.cumsum(edge[:-1]) > 0, w.first)

    out["n_repeat_words"] = covered(REPEAT_WINDOW)
    out["covered_words"] = covered(MIN_REPEAT)
    longest = np.zeros(n_docs, np.int64)
    np.maximum.at(longest, w.doc, repeat)
    out["longest_repeat"] = longest
    return out


def rules(docs: DataFrame, *, covered_percent: int = COVERED_PERCENT, longest_words: int = LONGEST_WORDS) -> DataFrame:
    """One row per row of docs (SCHEMA), whole texts; no shuffle.

    base_failed: under 50 words, or over half of them in three-word windows
    that occur twice.  kept: not base_failed, at most covered_percent of the
    words in repeats of five words or more, and no repeat over longest_words.
    Null and blank texts have no words and fail.  doc_id is passed on, null or
    repeated or not; other columns are ignored; no rows give no rows.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = T.flat(batch.column("text"))
            parts = []
            for i, j in T.passes(offs):
                own = offs[i : j + 1] - offs[i]
                parts.append(measure(T.split(buf[offs[i] : offs[j]], own), own))
            m = {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in names if k not in ("doc_id", "base_failed", "kept")}
            failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])
            m["base_failed"] = failed
            m["kept"] = ~failed & (100 * m["covered_words"] <= covered_percent * m["n_words"]) & (m["longest_repeat"] <= longest_words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id") if k == "doc_id" else pa.array(m[k]) for k in names], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(T.lean(run), SCHEMA)


def kept_rows(docs: DataFrame, **limits) -> DataFrame:
    """The rows of docs that pass, with all their columns, whatever their names; judged in place, without a shuffle.

    Null, empty and blank texts have no words and go; repeated rows pass or go
    together; a very long text is judged whole, in memory that grows with its
    words only.  An empty table stays empty.
    """

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # a dot in a name would be read as a field
    text = f"c{docs.columns.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        covered, longest = limits.get("covered_percent", COVERED_PERCENT), limits.get("longest_words", LONGEST_WORDS)
        for batch in batches:
            buf, offs = T.flat(batch.column(text).cast(pa.large_string()))
            good = [np.zeros(0, bool)]
            for i, j in T.passes(offs):
                own = offs[i : j + 1] - offs[i]
                m = measure(T.split(buf[offs[i] : offs[j]], own), own)
                good.append((m["n_words"] >= MIN_WORDS) & (100 * m["n_repeat_words"] <= REPEAT_PERCENT * m["n_words"]) & (100 * m["covered_words"] <= covered * m["n_words"]) & (m["longest_repeat"] <= longest))
            yield batch.filter(pa.array(np.concatenate(good)))

    return plain.mapInArrow(T.lean(run), plain.schema).toDF(*docs.columns)
