"""Near-duplicate components by circulant MinHash, bands and exact Jaccard.

One permutation scatters shingles over a circle of D slots; a second one is
read at K consecutive shifts, so signature coordinate k of a document is the
least ``pi[(slot + k) mod D]`` over its shingles.  Bands of coordinates give
candidate buckets.  Documents with equal shingle sets are one class from the
start, so copies never multiply.  Within a bucket, members are first compared
with a centre, the member that meets most others over all buckets, and what
that leaves in different components pair by pair.  Counts of shared shingles
bound the similarity a pair can have, so hardly any pairs are left to compare:
shingles that no other candidate has are in no intersection; a pair either has
a shingle that at most three candidates share, and is found by it, or its
intersection has frequent shingles only.  None of this loses a link; the bands
miss one at similarity 0.75 with probability 2 in 100,000.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .graph import components
from .shared import Scratch, partitions, whole

CIRCLE_BITS = 20
#: Members of one comparison chunk; a centre's text is repeated once per chunk.
CHUNK = 512
#: Bands of the first round, which joins most near copies before the others are looked at.
FIRST = 8


def _circle(k: int) -> np.ndarray:
    order = np.argsort(T.mix(np.arange(1 << CIRCLE_BITS, dtype=np.uint64) + np.uint64(7)), kind="stable")
    pi = np.empty(1 << CIRCLE_BITS, np.uint32)
    pi[order] = np.arange(1 << CIRCLE_BITS, dtype=np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: k - 1]]), k)


def signature(shingles: np.ndarray, circle: np.ndarray) -> np.ndarray:
    """K circulant MinHash coordinates of a non-empty shingle set."""
    slots = (T.mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - CIRCLE_BITS)).astype(np.intp)
    best = circle[slots[:512]].min(axis=0)
    for i in range(512, len(slots), 512):
        np.minimum(best, circle[slots[i : i + 512]].min(axis=0), out=best)
    return best


def _prints(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits that name a shingle set."""
    return T.mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64), T.mix(s ^ np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)


def sketches(docs: DataFrame, bands: int = 40, rows: int = 5, words: int = 5) -> DataFrame:
    """(doc_id, n_shingles, fa, fb, bands) of every row; bands is empty without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circle, salts = _circle(bands * rows), T.stream(bands * rows, 303).reshape(bands, rows)
        for batch in batches:
            n, fa, fb, keys = [], [], [], []
            for _, _, w in T.batches(batch.column("text")):
                for s in T.shingle_sets(w, words):
                    n.append(len(s))
                    a, b = _prints(s) if len(s) else (0, 0)
                    fa.append(a)
                    fb.append(b)
                    if len(s):
                        sig = signature(s, circle).astype(np.uint64).reshape(bands, rows)
                        keys.append(T.mix(T.mix(sig * salts + salts).sum(axis=1, dtype=np.uint64) + salts[:, 0]))
            at = np.concatenate([[0], np.cumsum([bands * bool(x) for x in n])]).astype(np.int32)
            flat = T.signed(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(T.signed(fa)), pa.array(T.signed(fb)), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))],
                ["doc_id", "n_shingles", "fa", "fb", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(T.lean(run), "doc_id long, n_shingles long, fa long, fb long, bands array<long>")


def _verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int, n: int) -> DataFrame:
    """(a, b) of those pairs (a: centre) whose full shingle sets have 100 * intersection >= percent * union.

    Members stream past their centre, sorted behind it, in chunks of a bounded
    number; a task holds one centre at a time.  texts: (doc_id, text), ids distinct.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    text = texts.select("doc_id", "text")
    centre = sizes.join(text, F.col("a") == F.col("doc_id")).select("a", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)).alias("chunk"), F.lit(None).cast("long").alias("b"), "text")
    member = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), "chunks").cast("int").alias("chunk")).join(text, F.col("b") == F.col("doc_id")).select("a", "chunk", "b", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            sets = [s for _, _, w in T.batches(batch.column("text")) for s in T.shingle_sets(w, words)]
            good = []
            for a, chunk, b, s in zip(*(batch.column(c).to_pylist() for c in ("a", "chunk", "b")), sets):
                if b is None:
                    at, own = (a, chunk), s
                elif at == (a, chunk):
                    both = len(own) + len(s) - len(np.union1d(own, s))
                    if 100 * both >= percent * (len(own) + len(s) - both):
                        good.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in good], pa.int64()) for i in (0, 1)], ["a", "b"])

    rows = centre.unionByName(member).repartition(n, "a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    return rows.mapInArrow(T.lean(run), "a long, b long")


def _first_of(texts: DataFrame, words: int) -> DataFrame:
    """texts without rows that repeat a doc_id with another set than (fa, fb) names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, _, w in T.batches(batch.column("text")) for s in T.shingle_sets(w, words)]
            good = [tuple(map(int, T.signed(_prints(s)))) == own for s, own in zip(sets, zip(batch.column("fa").to_pylist(), batch.column("fb").to_pylist()))]
            yield batch.filter(pa.array(good, pa.bool_()))

    return texts.mapInArrow(T.lean(run), texts.schema).dropDuplicates(["doc_id"])


def _rare(texts: DataFrame, words: int) -> DataFrame:
    """(c, lo, mid, hi) per shingle that c of the candidate texts have, c being 1, 2 or 3: these texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(batch.column("doc_id"), np.int64)
            for i, j, w in T.batches(batch.column("text")):
                sets = T.shingle_sets(w, words)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[i:j], [len(x) for x in sets])), pa.array(T.signed(np.concatenate(sets)))], ["rep", "h"])

    each = texts.select("doc_id", "text").mapInArrow(T.lean(run), "rep long, h long")
    few = each.groupBy("h").agg(F.count("*").alias("c"), F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.bit_xor("rep").alias("x")).where("c <= 3")
    return few.select("c", "lo", F.col("x").bitwiseXOR(F.col("lo")).bitwiseXOR(F.col("hi")).alias("mid"), "hi")


def _shared(texts: DataFrame, rare: DataFrame) -> DataFrame:
    """(rep, m, often): shingles of a text that another candidate has, and that three others have."""
    has = F.when(F.col("c") == 1, F.array("lo")).when(F.col("c") == 2, F.array("lo", "hi")).otherwise(F.array("lo", "mid", "hi"))
    own = rare.select("c", F.explode(has).alias("rep")).groupBy("rep").agg(F.count_if(F.col("c") == 1).alias("alone"), F.count("*").alias("rare"))
    return texts.select(F.col("doc_id").alias("rep"), "n").join(own, "rep", "left").select("rep", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("m"), (F.col("n") - F.coalesce("rare", F.lit(0))).alias("often"))


def _rare_pairs(rare: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of texts that have a shingle together with at most one other."""
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    both = F.when(F.col("c") == 2, F.array(pair("lo", "hi"))).otherwise(F.array(pair("lo", "mid"), pair("mid", "hi"), pair("lo", "hi")))
    return rare.where("c > 1").select(F.explode(both).alias("p")).select("p.a", "p.b").distinct()


def _possible(percent: int, a: str, b: str, m: str = "m") -> str:
    """Whether two texts can reach the similarity if only m shingles of each can be in their intersection."""
    most = f"least({a}{m}, {b}{m})"
    return f"100 * {most} >= {percent} * ({a}n + {b}n - {most})"


def _star(rows: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Pairs (centre, member) of different components for every bucket of rows (key, rep, n, m, cnt, label)."""
    degree = rows.groupBy("rep").agg(F.sum("cnt").alias("degree"))
    ranked = rows.join(degree, "rep")
    centre = ranked.groupBy("key").agg(F.max(F.struct("degree", (-F.col("rep")).alias("neg"), "n", "m", "label")).alias("c")).select("key", (-F.col("c.neg")).alias("a"), F.col("c.n").alias("an"), F.col("c.m").alias("am"), F.col("c.label").alias("al"))
    centre = scratch.put("centres", centre)
    return rows.join(centre.hint("merge"), "key").where(f"label <> al and {_possible(percent, '', 'a')}").select("a", F.col("rep").alias("b")).distinct()


def _bucketed(rows: DataFrame) -> DataFrame:
    """rows with the count of their key, for keys that have two or more.

    Here and below, joins by key are merge joins, even with small tables: a
    crowd of near copies makes hot keys, and a merge join can be split.
    """
    count = rows.groupBy("key").agg(F.count("*").alias("cnt")).where("cnt > 1")
    return rows.join(count.hint("merge"), "key")


def _unresolved(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with labels, of buckets whose members are in several components."""
    own = rows.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    mixed = own.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    return own.join(mixed.hint("merge"), "key")


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of members in different components of a bucket that often-shared
    shingles alone could link; each pair by the first of the buckets it shares.

    Most members of a crowd's bucket are in one component.  Only the others are
    paired, with members of other components.
    """
    rows = rows.where(f"100 * often >= {percent} * n")
    keys = rows.groupBy("rep").agg(F.collect_list("key").alias("keys"))  # at most one key a band
    rows = rows.join(keys, "rep")
    sizes = rows.groupBy("key", "label").agg(F.count("*").alias("c"))
    major = sizes.groupBy("key").agg(F.max(F.struct("c", "label")).alias("most")).select("key", F.col("most.label").alias("major"))
    x, y = rows.join(major.hint("merge"), "key").where("label <> major").alias("x"), rows.alias("y")
    once = "(y.label = x.major or x.rep < y.rep)"
    near = f"x.label <> y.label and {once} and {_possible(percent, 'x.', 'y.', 'often')} and array_min(array_intersect(x.keys, y.keys)) = x.key"
    return x.hint("merge").join(y, (F.col("x.key") == F.col("y.key")) & F.expr(near)).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))


def _beside(pairs: DataFrame, shared: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) that are in different components and could be links."""
    facts = shared.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "n", "m", F.coalesce("label", "rep").alias("label"))
    out = pairs
    for side in ("a", "b"):
        out = out.join(facts.select(*[F.col(c).alias(side if c == "rep" else side + c) for c in facts.columns]), side)
    return out.where(f"alabel <> blabel and {_possible(percent, 'a', 'b')}").select("a", "b")


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 75, bands: int = 40, rows: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept, class_id.

    Documents are linked when 100 * intersection >= percent * union of their
    sets of distinct word shingles; component_id is the smallest doc_id that
    links reach, class_id the smallest doc_id with an equal set.  Other columns
    of docs are ignored, whatever their names.  A null or blank text has no
    shingles and is linked with nothing (class_id null).  A null doc_id is never linked: its component_id
    is null and it is kept.  Rows that repeat a doc_id stand for one document
    and share its component; of documents that tie, the smallest doc_id names
    the component.  A very long text is one set of shingles in one task.  An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch, n = Scratch(spark, "near-dup"), partitions(spark)
    sk = scratch.put("sketches", sketches(docs, bands, rows, words))
    real = sk.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.put("classes", real.groupBy("fa", "fb").agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands")))
    buckets = scratch.put("buckets", _bucketed(classes.select(F.posexplode("bands").alias("band", "key"), "rep", "n")))

    # A doc_id that repeats with different texts links its classes.
    again = scratch.put("repeated", real.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"))
    unique, edges = again.isEmpty(), []
    if not unique:
        named = real.join(again, "doc_id", "left_semi").join(classes.select("fa", "fb", "rep"), ["fa", "fb"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        edges.append(scratch.put("same-id", named))

    # Texts of representatives that meet any other in a bucket.
    meet = buckets.select(F.col("rep").alias("doc_id")).distinct()
    keyed = classes.join(meet, classes.rep == meet.doc_id, "left_semi").select(F.col("rep").alias("doc_id"), "fa", "fb", "n")
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(keyed, "doc_id")
    texts = scratch.put("texts", texts if unique else _first_of(texts, words))
    rare = scratch.put("rare", _rare(texts, words))
    shared = scratch.put("shared", _shared(texts, rare))
    buckets = scratch.put("buckets", _bucketed(buckets.drop("cnt").join(shared.where(f"100 * m >= {percent} * n").drop("n"), "rep")))
    tried: list[DataFrame] = []

    def compare(name: str, pairs: DataFrame) -> DataFrame:
        """Checks the pairs that weren't yet, keeps the links, returns the components so far."""
        new = scratch.put(f"pairs-{name}", pairs)
        if tried:
            old = _all(tried).select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
            new = scratch.put(f"untried-{name}", new.join(old, (F.least("a", "b") == F.col("lo")) & (F.greatest("a", "b") == F.col("hi")), "left_anti"))
        tried.append(new)
        edges.append(scratch.put(f"links-{name}", _verify(new, texts, words, percent, n)))
        return scratch.put(f"labels-{name}", components(_all(edges), scratch))

    labels = compare("first", _star(buckets.where(f"band < {FIRST}").withColumn("label", F.col("rep")), scratch, percent))
    left = scratch.put("left", _unresolved(buckets, labels))
    if not left.isEmpty():
        labels = compare("stars", _star(left, scratch, percent))
        left = scratch.put("left", _unresolved(left.drop("label"), labels))
    if not left.isEmpty():
        # A link either has a shingle that at most three texts share, or consists of frequent ones.
        rest = left.select("rep").distinct()
        near = _rare_pairs(rare).join(rest.withColumnRenamed("rep", "a"), "a").join(rest.withColumnRenamed("rep", "b"), "b")
        labels = compare("last", _across(left, percent).unionByName(_beside(near, shared, labels, percent)).distinct())

    comp = classes.select("fa", "fb", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("fa", "fb", F.col("rep").alias("class_id"), F.coalesce("label", "rep").alias("component_id"))
    comp = scratch.put("components", comp)
    scratch.clear(sk, comp)
    out = sk.select("doc_id", "n_shingles", F.when(F.expr("n_shingles > 0 and doc_id is not null"), F.col("fa")).alias("fa"), "fb")
    lone = out.where("fa is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("class_id"))
    joined = out.where("fa is not null").join(comp.hint("merge"), ["fa", "fb"]).select("doc_id", "n_shingles", "component_id", "class_id")
    both = joined.unionByName(lone)
    return both.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "class_id")


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names: one document of each component.

    Rows with null or blank texts stay, and so do null doc_ids; where rows
    repeat the doc_id that stays, so do they.  An empty table stays empty.
    """
    drop = near_duplicates(docs, **options).where("not kept").select(F.col("doc_id").alias("drop")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), whole(docs))
    return rows.join(drop, F.col("id") == F.col("drop"), "left_anti").select("row.*")
