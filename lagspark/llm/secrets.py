"""Secrets in texts: three fixed rules, and character Markov models.

Two first-order models, of random strings and of ordinary identifiers, are
trained from labelled samples; a run of key characters is a secret when the
log-likelihood ratio of the two is high enough.  Runs and fixed-alphabet
matches are found by numpy over the whole text buffer; the rules that need a
regular expression run only on texts with the characters they can't do without.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

# The base rules, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
#: Parts of runs of fewer characters, or of fewer different letters and digits (as rules and
#: placeholders are; 16 random hex digits have 5 or fewer once in 30,000), aren't secrets to the models.
RUN_LEAST, DISTINCT_LEAST = 16, 6
#: Natural-log likelihood ratio a run needs, in all and per character.  Trained at sf0.1, these catch
#: all of 5,000 held-out random strings and of the tables' 657 planted values of 16 characters or more,
#: flag nothing else in the tables, and 6% of names made of English words that training has not seen.
#: At 20 these are 2%, but 1.6% of keys of 20 small letters are lost (0.5% here).
RATIO, RATIO_EACH = 12.0, 0.4
#: Documents of good quality whose identifiers are counted, and random strings made.
SAMPLE_ROWS, SAMPLE_RANDOM = 2000, 4000

# Words that names in programs are made of, labelled ordinary.
CODE_WORDS = """account action address admin agent alert alias amount api app application archive array asset async attribute
channel check child class client clone cloud cluster code collection column command commit component config configuration
dashboard data database date debug default delete deploy description detail device dialog directory document domain
export expression factory feature fetch field file filter folder format frame function generate global group handle
integer interface interval invoice item iterator java job json kernel key label language last layout library limit link
metric min mode model module monitor month name network node notification number object option order output package page
product profile project property protocol provider proxy public query queue random range read record reference region
runtime sample scale schedule schema scope script search security select send sequence server service session set
subscription switch symbol sync system table tag target task template test text thread throw time timeout timer title
validate value variable vector version view visible volume wait warning web widget window worker write xml year zone""".split()

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_CODE = np.full(256, -1, np.int64)
_CODE[list(ALPHABET.encode())] = np.arange(len(ALPHABET))
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_WORD = re.compile("[A-Za-z]{3,24}")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def transitions(values: list[str]) -> np.ndarray:
    """Counts of first characters, then of pairs of neighbours, row-major, in strings over the alphabet."""
    k = len(ALPHABET)
    codes = _CODE[np.frombuffer(("\n" + "\n".join(values)).encode(), np.uint8)]
    before, own = codes[:-1], codes[1:]
    inside = (before >= 0) & (own >= 0)
    first = np.bincount(own[(before < 0) & (own >= 0)], minlength=k)
    return np.concatenate((first, np.bincount(before[inside] * k + own[inside], minlength=k * k))).astype(float)


@dataclass(frozen=True)
class Models:
    """Log-likelihood ratio of random to ordinary for first characters and transitions."""

    first: np.ndarray
    step: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> "Models":
        """counts: of first characters and transitions, (2, k + k * k), ordinary before random; smoothed by one half."""
        k = len(ALPHABET)
        first, step = counts[:, :k] + 0.5, counts[:, k:].reshape(2, k, k) + 0.5
        first = np.log(first / first.sum(axis=1, keepdims=True))
        step = np.log(step / step.sum(axis=2, keepdims=True))
        return cls(first[1] - first[0], step[1] - step[0])

    @classmethod
    def train(cls, samples: Iterable[tuple[str, int]]) -> "Models":
        """samples: (string, 1 for random or 0 for ordinary)."""
        samples = list(samples)
        return cls.of(np.stack([transitions([v for v, label in samples if label == own]) for own in (0, 1)]))

    def ratio(self, value: str) -> float:
        codes = _CODE[np.frombuffer(value.encode(), np.uint8)]
        return float(self.first[codes[0]] + self.step[codes[:-1], codes[1:]].sum())

    def secrets(self, value: str) -> list[tuple[int, int]]:
        """(start, end) of the secrets in a run of key characters.

        The whole run is one if its ratio is high enough; else the part of at least
        RUN_LEAST characters with the largest sum of ratios over RATIO_EACH may be,
        and what is left on both sides is judged again.
        """
        codes = _CODE[np.frombuffer(value.encode(), np.uint8)]
        sums = np.concatenate(([0.0], np.cumsum(self.step[codes[:-1], codes[1:]])))
        head = self.first[codes] - sums
        out, todo = [], [(0, len(value))]

        def good(a: int, b: int) -> bool:
            ratio = head[a] + sums[b - 1]
            return ratio >= RATIO and ratio >= RATIO_EACH * (b - a) and len({c for c in value[a:b] if c.isalnum()}) >= DISTINCT_LEAST

        while todo:
            a, b = todo.pop()
            if b - a < RUN_LEAST:
                continue
            if not good(a, b):
                starts = head[a : b - RUN_LEAST + 1] + RATIO_EACH * np.arange(a, b - RUN_LEAST + 1)
                ends = sums[a + RUN_LEAST - 1 : b] - RATIO_EACH * np.arange(a + RUN_LEAST, b + 1)
                best = np.maximum.accumulate(starts)
                e = int(np.argmax(best + ends))
                i, j = a + int(np.argmax(starts[: e + 1])), a + RUN_LEAST + e
                if (i, j) == (a, b) or best[e] + ends[e] < 0:
                    continue
                todo += [(a, i), (j, b)]
                if not good(i, j):
                    continue
                a, b = i, j
            out.append((a, b))
        return sorted(out)


def random_strings(n: int, seed: int = 5) -> list[str]:
    """Strings drawn evenly from the alphabets that keys use."""
    rng = np.random.default_rng(seed)
    sets = ["0123456789abcdef", "0123456789ABCDEF", ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], ALPHABET[:26] + "0123456789", ALPHABET[:62] + "_-"]
    return ["".join(rng.choice(list(sets[i % len(sets)]), int(rng.integers(16, 65)))) for i in range(n)]


def identifiers(words: list[list[str]]) -> list[str]:
    """Words as they are, and joined as identifiers join them."""
    out = []
    for own in words:
        out += own
        for i, (a, b) in enumerate(zip(own, own[1:])):
            out.append((a + b.capitalize(), f"{a}_{b}".lower(), f"{a}-{b}".lower(), f"{a}_{b}".upper(), f"{a}{i % 100}")[i % 5])
    return out


def train(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS, randoms: int = SAMPLE_RANDOM) -> Models:
    """Models of random strings, and of identifiers: those in the whole texts of at most `rows` documents of good
    quality, and names made of CODE_WORDS, which count as much in all.

    Characters are counted where the texts are; the driver gets one number per
    pair of characters.  Null texts, null ids and repeated labels are allowed;
    without labelled documents every transition is as likely as any other.
    """
    k = len(ALPHABET)
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("good")).distinct()
    chosen = F.broadcast(good.orderBy(F.xxhash64("good"), "good").limit(rows))  # at most `rows` ids
    own = docs.select(F.col("doc_id").cast("long").alias("good"), F.col("text").cast("string").alias("text")).join(chosen, "good", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for batch in batches:
            for text in batch.column("text"):
                total += transitions(identifiers([_WORD.findall(text.as_py() or "")]))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["at", "n"])

    counts = np.zeros((2, k + k * k))
    for at, n in own.mapInArrow(T.lean(run), "at int, n double").groupBy("at").agg(F.sum("n")).collect():  # at most k + k * k rows
        counts[0, at] = n
    rng = np.random.default_rng(6)
    code = transitions(identifiers([rng.permutation(CODE_WORDS).tolist() for _ in range(20)]))
    counts[0] += code * (max(counts[0].sum(), code.sum()) / code.sum())
    counts[1] = transitions(random_strings(randoms))
    return Models.of(counts)


def _runs(mask: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) in bytes of maximal runs of at least `least` within documents."""
    edge = np.zeros(len(mask) + 1, bool)
    edge[offsets] = True
    inside = np.concatenate(([False], mask, [False]))
    starts = np.flatnonzero(mask & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(mask & (~inside[2:] | edge[1:])) + 1
    keep = ends - starts >= least
    starts, ends = starts[keep], ends[keep]
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends


def find(texts: list[str], buf: np.ndarray, offsets: np.ndarray, models: Models) -> list[list[tuple[int, int, int]]]:
    """Spans (start, kind, end) in code points of each text, base kinds and the models', sorted."""
    out: list[list] = [[] for _ in texts]
    points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    for d, a, b in zip(*(x.tolist() for x in _runs(_HEX[buf], offsets, HEX_LEAST))):
        base = points[offsets[d]]
        out[d].append((int(points[a] - base), 2, int(points[b] - base)))
    for d, t in enumerate(texts):
        if ":" in t or "=" in t:
            out[d] += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if m.end() - m.start(1) >= ASSIGN_LEAST]
        if "AKIA" in t:
            out[d] += [(m.start(), 1, m.end()) for m in ACCESS.finditer(t) if m.end() - m.start() >= ACCESS_LEAST]
    for d, a, b in zip(*(x.tolist() for x in _runs(_CODE[buf] >= 0, offsets, RUN_LEAST))):
        base = points[offsets[d]]
        start, end = int(points[a] - base), int(points[b] - base)
        # What base spans leave of the run.
        cuts = sorted((max(s, start), min(e, end)) for s, k, e in out[d] if k < 3 and s < end and start < e)
        for s, e in [*cuts, (end, end)]:
            if s - start >= RUN_LEAST:
                out[d] += [(start + i, 3, start + j) for i, j in models.secrets(texts[d][start:s])]
            start = max(start, e)
    return [sorted(x) for x in out]


def scan(docs: DataFrame, models: Models) -> DataFrame:
    """One row per row of docs (SCHEMA): counts of base spans, their digest, and all spans.

    Spans are kind:start:end in code points, end exclusive, by start and then
    kind in the order of KINDS, joined by commas.  Base matches are found from
    the left per kind and dropped when too short; spans of the models never
    overlap them.  Null and empty texts have none; a text of any length is
    searched whole, its runs one by one.  doc_id is passed on, null
    or repeated or not; other columns are ignored; no rows give no rows.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text").cast(pa.large_string())
            buf, offs = T.flat(column)
            rows: list[tuple] = []
            for i, j in T.passes(offs):
                own = offs[i : j + 1] - offs[i]
                for spans in find([t or "" for t in column[i:j].to_pylist()], buf[offs[i] : offs[j]], own, models):
                    named = [f"{KINDS[k]}:{a}:{b}" for a, k, b in spans]
                    base = ",".join(x for x, s in zip(named, spans) if s[1] < 3)
                    kinds = [s[1] for s in spans]
                    rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(base.encode()).hexdigest(), ",".join(named)))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:3]], *[pa.array(c, pa.string()) for c in columns[3:]]], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(T.lean(run), SCHEMA)
