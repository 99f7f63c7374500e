"""Every text operator against brute force, with the odd cases each docstring names."""

import base64
import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lagspark.llm import chat, exact_dup, graph, licenses, lm, mixing, near_dup, packing, quality, secrets, warc
from lagspark.llm import text as T
from lagspark.llm.queries import tokenizer_path
from lagspark.llm.shared import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, `order` string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def prose(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, a shared passage, ties, repeats, nulls, blank and very long texts."""
    rng = random.Random(7)
    texts = [prose(rng, rng.randrange(3, 150), 5000) for _ in range(120)]
    base = prose(rng, 120, 9000)
    for _ in range(25):  # near copies of a base
        w = base.split()
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    passage = prose(rng, 60, 9000)
    texts += [prose(rng, 50, 9000) + " " + passage for _ in range(20)]
    texts += [texts[0], texts[0].replace(" ", "\n"), texts[1].upper(), texts[1], "", None, " \t\n", "one", "one two", "one  two", prose(rng, 30_000, 50_000), "naïve café 漢字 😀 " * 30, "a b c d e", "A b C d e"]
    out = [(i, t, "en", f"s{i % 4}" if i % 7 else None, len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]
    return out + [out[3], out[3], (3, "another text with the same id", "en", "s1", 3, "x", "y", "z"), (None, texts[5], "en", "s1", 1, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_hash_and_split_within_documents():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \n\té漢") for _ in range(rng.randrange(12))) for _ in range(300)] + [None, "x" * 5000]
    buf, offs = T.flat(pa.chunked_array([pa.array(texts[:100]), pa.array(texts[100:])]))
    for limit in (40, 10**6):
        got = []
        for i, j in T.passes(offs, limit):
            own = offs[i : j + 1] - offs[i]
            w = T.split(buf[offs[i] : offs[j]], own)
            h = w.hashes()
            got += [h[a:b].tolist() for a, b in zip(w.first[:-1], w.first[1:])]
        seen = {}
        for t, hs in zip(texts, got):
            words = WORD.findall(t or "")
            assert len(words) == len(hs)
            for a, b in zip(words, hs):
                assert seen.setdefault(a, b) == b
        assert len(set(seen.values())) == len(seen)
    sliced = pa.array(["aa", "bb cc", None, "dd"])[1:]
    assert T.flat(sliced)[1].tolist() == [0, 5, 5, 7]
    long = ["x" * n + y for n in (7, 8, 9, 127, 128, 129, 300, 5000) for y in ("", "a", "\0b", "ab")] + ["X" * 5000]
    for lower in (True, False):
        buf, offs = T.flat(pa.array(long))
        assert len(set(T.split(buf, offs).hashes(lower).tolist())) == len(long) - lower


# 1


def brute_components(rows):
    sets = []
    for d, t, *_ in rows:
        w = WORD.findall(lower(t))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = {d: d for d, *_ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2):
        x, y = rows[i][0], rows[j][0]
        if a and b and x is not None and y is not None and 100 * len(a & b) >= 75 * len(a | b):
            x, y = find(x), find(y)
            parent[max(x, y)] = min(x, y)
    return [(d, len(s), find(d)) for (d, *_), s in zip(rows, sets)]


def key(r):
    return tuple((x is None, x) for x in r)


def test_near_duplicates(docs, rows):
    got = near_dup.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute_components(rows), key=key)
    assert all(r.kept == (r.doc_id == r.component_id or r.doc_id is None) for r in got)
    kept = near_dup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_near_duplicates_of_a_crowd_without_its_original(spark):
    """Copies of an absent base link to some copies only; every link counts."""
    rng = random.Random(3)
    base = prose(rng, 150, 90_000).split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = f"y{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {d: c for d, _, c in brute_components(rows)}
    assert {r.doc_id: r.component_id for r in got} == want


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    circle = near_dup._circle(256)
    x, y = near_dup.signature(a[:2000], circle), near_dup.signature(a[500:2500], circle)
    assert np.mean(x == y) == pytest.approx(1500 / 2500, abs=0.12)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(5, 5), (300, 301), (301, 302), (302, 303)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in {v for a, b in edges if a != b for v in (a, b)}}


# 2


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, None, None), (4, "http://c/\r\nInjected: 1", ""), (5, "u", "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (6, "u", "tail WARC/1.0\r\n"), (7, "é", "WARC/1.0\r\n" * 40 + "\r\n\r\n"), (None, "n", "lonely"), (8, "u", "x" * 40_000), (9, "u", "y"), (9, "u", "y")]
    pages += [(20 + i, "u", "z" * (37 * i) + "WARC/1.0\r\nContent-Length: %d\r\n\r\n" % (i * 211)) for i in range(30)]
    df = spark.createDataFrame([(*r, "x", 1) for r in pages], "page_id long, url string, html string, file string, at long")
    for compression, size, part in (("gzip", "128m", 700), ("none", "6000", 1000)):
        path = f"file://{tmp_path}/{compression}-{size}"
        warc.write(df.coalesce(2), path, compression=compression)
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        cost = spark.conf.get("spark.sql.files.openCostInBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            got = warc.read(spark, path, part_bytes=part).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
            spark.conf.set("spark.sql.files.openCostInBytes", cost)
        want, last = [], {}
        for p, _, h in pages:
            last[h or ""] = max(last.get(h or "") or -1, p or -1)
        for p, _, h in pages:
            b, keep = (h or "").encode(), last[h or ""]
            own = keep != -1 and p != keep
            want.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if own else "response", keep if own else None))
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
        assert all(r.intact for r in got)
    path = f"file://{tmp_path}/least"
    warc.write(df, path, least=5)
    assert warc.read(spark, path).count() == len(pages)
    assert {r.page_id for r in warc.read(spark, path).collect() if r.record_type == "revisit"} == {1}


# 3


def test_exact_duplicates(docs, rows, empty):
    got = exact_dup.decisions(docs, capacity=2000).collect()
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((d, t or ""))
    want = []
    for n, own in groups.items():
        best = sorted(own, key=lambda x: (-len(x[1]), x[0] is None, x[0]))[0][0]
        want += [(d, best, len(own), hashlib.sha256(n.encode()).hexdigest()) for d, _ in own]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(want, key=key)
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept.collect()) == sorted(groups)


def test_directory_doubles_only_where_needed():
    w = np.zeros(64)
    w[5], w[6], w[40] = 10, 10, 3
    d = exact_dup.Directory(10, 6).grow(w)
    sizes = Counter()
    for cell, x in enumerate(w):
        sizes[d.bucket(cell << 58)] += x
    assert max(sizes.values()) <= 10 and d.depth == 5 and d.bucket((40 << 58) - (1 << 64)) == d.bucket(40 << 58)


def test_owner_compares_bytes_under_one_key(spark):
    rows = [(0, 7, 10, b"a"), (0, 7, 11, b"b"), (0, 7, 12, b"a"), (0, 8, 13, b"a")]
    got = exact_dup._owners(spark.createDataFrame(rows, "bucket int, key long, carrier long, plain binary"), 2).collect()
    assert {r.carrier: r.leader for r in got} == {10: 10, 11: 11, 12: 10, 13: 13}


# 4


def test_secrets(docs, rows, spark):
    odd = ["password = 'Abcdef123456'", "secret=token : abcdefghijkl12", "API_KEY:\"" + "x" * 11, "AKIA" + "A" * 13 + " AKIA" + "B" * 14, "é" * 3 + "0123456789abcdef", "paſſword=abcdefghijklmnop", "token=" + "a" * 40, "q9Zr8Tk2Lm5Wx7Yv3Bn6Pd1Sf4Gh0Jc", "handleUserRequestAndRespond2", None, ""]
    own = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    models = secrets.Models.train([(x, 1) for x in secrets.random_strings(2000)] + [(x, 0) for x in secrets.identifiers([["handle", "user", "request", "response", "number", "window", "service", "manager"]] * 200)])
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for df, texts in ((own, dict(enumerate(odd))), (docs.where("doc_id > 3"), {r[0]: r[1] for r in rows if r[0] is not None and r[0] > 3})):
        for r in secrets.scan(df, models).collect():
            t = texts[r.doc_id] or ""
            spans = [[(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12], [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18], [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]]
            base = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(sum(spans, [])))
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(map(len, spans)) and r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    spans = {r.doc_id: r.spans for r in secrets.scan(own, models).collect()}
    assert spans[7] == "model:0:31" and spans[8] == ""
    for fresh, good in ((secrets.random_strings(300, 99), 0.95), (secrets.identifiers([["manager", "service", "window"]] * 40), 0)):
        hits = np.mean([(v := models.ratio(x)) >= secrets.RATIO and v >= secrets.RATIO_EACH * len(x) for x in fresh])
        assert hits >= good if good else hits == 0


# 5


def test_licenses(spark):
    rng = random.Random(5)
    mit = licenses.TEXTS["mit"]
    worn = mit.split()
    worn[10] = "thing"
    broken = [w if i % 4 else "zz" for i, w in enumerate(mit.split())]
    texts = [prose(rng, 300) + "\n" + mit + "\n" + prose(rng, 200), " ".join(worn), " ".join(broken), licenses.TEXTS["mit-line"], prose(rng, 9) + " Ünd released UNDER the MIT license! " + prose(rng, 9), None, "", "MIT", mit + " " + prose(rng, 30) + " " + mit, prose(rng, 20_000)]
    got = licenses.scan(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, license_id string")).collect()
    found = {(r.doc_id, r.license_id): r for r in got}
    assert {k for k in found} == {(0, "mit"), (1, "mit"), (3, "mit-line"), (4, "mit-line"), (8, "mit")}
    assert texts[0][found[0, "mit"].start : found[0, "mit"].end].strip(".") == mit.strip(".") and found[0, "mit"].containment == 1
    assert texts[4][found[4, "mit-line"].start : found[4, "mit-line"].end] == "released UNDER the MIT license"
    assert sum(r.doc_id == 8 for r in got) == 2 and found[1, "mit"].containment < 1


# 6


def brute_quality(t):
    t = t or ""
    w = WORD.findall(t)
    n, three = len(w), Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    mark = {j for i in range(n - 2) if three[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(mark)


def brute_repeats(w):
    out = [0] * len(w)
    for i, j in itertools.combinations(range(len(w)), 2):
        k = 0
        while j + k < len(w) and w[i + k] == w[j + k]:
            k += 1
        out[i], out[j] = max(out[i], k), max(out[j], k)
    return out


def test_suffix_repeats():
    rng = random.Random(4)
    for _ in range(200):
        w = [rng.randrange(3) for _ in range(rng.randrange(30))]
        assert quality.longest_repeats(np.array(w, np.uint64)).tolist() == brute_repeats(w)


def test_quality_rules(spark):
    rng = random.Random(6)
    line = prose(rng, 12)
    texts = [prose(rng, 80, 9000), "\n".join([line] * 9), prose(rng, 100, 9000) + "\n" + line + "\n" + line, "a b c " * 60, None, "", "#*$%&|<> x\r\nx\r\n", prose(rng, 49, 9000), "é ß 漢 " * 20 + prose(rng, 60, 9000), prose(rng, 300, 9000) + " " + " ".join(sorted(prose(rng, 90, 99999).split()) * 2), prose(rng, 20_000, 99_999)]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    got = {r.doc_id: r for r in quality.rules(df).collect()}
    for i, t in enumerate(texts):
        r, b = got[i], brute_quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0])
        if b[0] < 500:
            rep = brute_repeats(WORD.findall(t or ""))
            cover = {j for k, x in enumerate(rep) if x >= quality.MIN_REPEAT for j in range(k, k + x)}
            assert (r.covered_words, r.longest_repeat) == (len(cover), max(rep, default=0))
    assert {i for i in got if got[i].kept} == {0, 2, 9, 10}
    kept = quality.kept_rows(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {0, 2, 9, 10}
    assert not quality.rules(spark.createDataFrame([(1, prose(rng, 150, 9000) + " " + " ".join([prose(random.Random(9), 101, 9000)] * 2))], "doc_id long, text string")).first().kept


# 7


def test_packing(docs, rows):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(docs.where("doc_id is not null and doc_id <> 3"), tokenizer_path()).collect()
    ids = {d: lib.encode(t or "", add_special_tokens=False).ids + [1] for d, t, *_ in rows if d is not None and d != 3}
    at, windows = Counter(), {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(own) and r.length > 0
        at[r.doc_id] += r.length
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at == {d: len(x) for d, x in ids.items()}
    for own in windows.values():
        end = 0
        for o, n in sorted(own):
            assert o == end
            end += n
        assert end == 2048 or (end < 2048 and end & (end - 1) == 0)
    assert packing.pack(docs, tokenizer_path()).where("doc_id is null").count() >= 2


def test_encoder_equals_the_library():
    rng = random.Random(3)
    letters = [*"ab Z09 '\n\t\r .,!_-  ", "'s", "'ll", " é", "ñ", " ", "\u0085", "\x1c", "\x0b", "漢", "😀", "ɐ", "Ȁ", "<|endoftext|>", " the", "\n\n"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(25))) for _ in range(4000)] + ["".join(rng.choice("ab é'1.\n") for _ in range(rng.randrange(25))) for _ in range(4000)]
    e = packing.Encoder(tokenizer_path())
    buf, offs = T.flat(pa.array(texts))
    plain = packing.plainness(buf, offs)
    assert e.encode(texts, plain) == e.whole(texts) and sum(plain) > 2000


def test_sum_of_squares_choice():
    p = packing.Packer(0, 10)
    p.count[[3, 5, 7]] = [1, 4, 2]

    def squares(c):
        return int((c[1:10] ** 2).sum())

    for n in range(1, 10):
        best = None
        for h in (0, 3, 5, 7):
            if h + n <= 10:
                c = p.count.copy()
                c[h] -= bool(h)
                c[h + n] += h + n < 10
                best = min(best, squares(c)) if best is not None else squares(c)
        h = p.level(n)
        c = p.count.copy()
        c[h] -= bool(h)
        c[h + n] += h + n < 10
        assert squares(c) == best


# 8


def legal(roles):
    body = roles[1:] if roles[:1] == ["system"] else roles
    return all(r == ("user", "assistant")[i % 2] for i, r in enumerate(body)) and len(body) % 2 == 0


def cheapest(roles):
    """Least cost by search over edits."""
    best = {(-1, chat.START): 0}
    queue = [(0, -1, chat.START)]
    import heapq

    while queue:
        cost, i, s = heapq.heappop(queue)
        if cost > best.get((i, s), 1e9):
            continue
        if i == len(roles) - 1 and s in (chat.ASSISTANT, chat.START):
            return cost
        moves = [(cost + chat.INSERT, i, q) for q in chat.NEXT[s]]
        if i + 1 < len(roles):
            r = chat.ROLES.get(roles[i + 1], 0)
            moves += [(cost + (0 if q == r else chat.RELABEL), i + 1, q) for q in chat.NEXT[s]]
            if s != chat.START:
                moves.append((cost + (chat.MERGE if s == r else chat.MERGE_OTHER), i + 1, s))
        for c, j, q in moves:
            if c < best.get((j, q), 1e9):
                best[j, q] = c
                heapq.heappush(queue, (c, j, q))


@pytest.mark.parametrize("block_rows, span", [(20_000, 1024), (3, 1024), (3, 2)])
def test_chats(spark, block_rows, span):
    rng = random.Random(8)
    kinds = ["user", "assistant", "system", "tool", None, " User "]
    rows = [(c, t, rng.choice(kinds), f"{c}.{t}" if t % 5 else None) for c in range(12) for t in range(rng.randrange(1, 9))]
    rows += [(77, t, rng.choice(kinds[:3]), str(t)) for t in range(60)] + [(None, 1, "user", "n"), (99, None, "assistant", "a"), (98, 1, "user", "tie"), (98, 1, "user", "tie"), (97, 1, "user", "long " * 200_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, seq string")
    got = {}
    for r in chat.format_chats(df, block_rows=block_rows, span=span).collect():
        got.setdefault(r.conv_id, []).append(r)
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).append(r)
    assert got.keys() == convs.keys()
    for c, own in convs.items():
        own.sort(key=lambda r: tuple((x is not None, x) for x in r[1:]))
        out = sorted(got[c], key=lambda r: r.seq)
        assert [r.text for r in out if r.action != "insert"] == [r[3] or "" for r in own]
        turns = [r.role for r in out if r.action != "merge"]
        assert legal(turns) and [r.turn_no for r in out if r.action != "merge"] == list(range(len(turns)))
        roles = [(r[2] or "").strip().lower() for r in own]
        cost, k = 0, 0
        for r in out:
            if r.action == "insert":
                cost += chat.INSERT
                continue
            same = roles[k] == r.role
            cost += {"keep": 0, "relabel": chat.RELABEL, "merge": chat.MERGE if same else chat.MERGE_OTHER}[r.action]
            k += 1
        assert cost == cheapest(roles)
        shown = "".join(r.rendered for r in out)
        assert re.findall(r"<\|(system|user|assistant)\|>", shown) == turns and shown.count("<|end|>") == len(turns) and shown.endswith("<|end|>\n")


# 9


def brute_scores(rows, priors):
    """(doc_id, held out, tokens, known, training tokens, base, score) by counting n-grams of every order."""
    toks = [(d, WORD.findall(lower(t)) + [None], zlib.crc32(str(d).encode() if d is not None else b"") % 7 == 2) for d, t, *_ in rows]
    count, after, order = Counter(), Counter(), len(priors) + 1
    for _, w, held in toks:
        if not held:
            w = ["<s>", *w]
            for i in range(1, len(w)):
                for k in range(1, order + 1):
                    if i - k >= -1:
                        count[tuple(w[max(0, i - k + 1) : i + 1]), k] += 1
                        after[tuple(w[max(0, i - k + 1) : i]), k - 1] += 1
    n, v = sum(c for (g, k), c in count.items() if k == 1), sum(k == 1 for _, k in count)

    def p(h, x):
        if not h:
            return (count[(x,), 1] + 1) / (n + v + 1)
        return (count[(*h, x), len(h) + 1] + priors[len(h) - 1] * p(h[1:], x)) / (after[h, len(h)] + priors[len(h) - 1])

    out = []
    for d, w, held in toks:
        s = ["<s>", *w]
        base = sum(math.log10((count[(x,), 1] + 1) / (n + v + 1)) for x in w)
        out.append((d, held, len(w), sum(count[(x,), 1] > 0 for x in w), n, base, sum(math.log10(p(tuple(s[max(0, i - order + 1) : i]), s[i])) for i in range(1, len(s)))))
    return out


@pytest.mark.parametrize("priors, options", [((5.0,), {}), ((5.0, 2.0), {"rescan": True}), ((9.0, 4.0, 2.0), {"chunk_bytes": 3000, "most_ranges": 3}), ((5.0, 2.0), {"chunk_bytes": 20_000})])
def test_lm_scores(docs, rows, priors, options):
    found = lm.score(docs, order=len(priors) + 1, priors=priors, **options).collect()
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found), key=lambda r: key((*r[:5], round(r[6], 3))))
    want = sorted(brute_scores(rows, priors), key=lambda r: key((*r[:5], round(r[6], 3))))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=2e-6)


def test_lm_plans_are_linear():
    for total in (0, 10**6, 10**9, 10**12, 10**14):
        ranges, groups = lm._plan(total, lm.CHUNK_BYTES, lm.MOST_RANGES)
        chunks = total // lm.CHUNK_BYTES + 1
        assert ranges <= lm.MOST_RANGES and groups[-1] == 1
        assert chunks <= (lm.NODE_CHUNKS * ranges) ** len(groups)
    assert len(lm._plan(10**14, lm.CHUNK_BYTES, lm.MOST_RANGES)[1]) == 2 and lm._plan(10**14, 100, 4)[1][-2] > 1


def test_lm_states_sum_to_one():
    rng = random.Random(12)
    texts = [prose(rng, rng.randrange(0, 30), 12) for _ in range(60)] + [""]
    g = lm.Grams(pa.array(texts), 3)
    train = np.arange(len(texts)) % 3 > 0
    totals = g.counts(train)
    words = np.unique(g.place[0])
    known = words[totals[words] > 0]
    m = lm.Automaton(g, totals, int(np.repeat(train, np.diff(g.first)).sum()), len(known), (5.0, 2.0))
    states = len(m.fail_to)
    assert states > 50 and m.start > 0 and len(m.arc_keys) > states
    state, word = np.repeat(np.arange(states), len(known)), np.tile(known.astype(np.int64), states)
    to, gain = m.step(state, word)
    unknown = m.step(np.arange(states), np.full(states, g.begin))[1]  # no text has the beginning as a word
    assert np.allclose((10**gain).reshape(states, -1).sum(1) + 10**unknown, 1, atol=1e-12)
    assert to.max() < states and (m.fail_to < states).all() and (m.fail_weight[1:] < 0).all()
    assert m.traverse(g.place[0], g.first).shape == (len(texts),)


def test_lm_lanes_score_like_one_traversal(monkeypatch):
    rng = random.Random(13)
    g = lm.Grams(pa.array([prose(rng, n, 40) for n in (700, 0, 1, 90, 8, 7)]), 3)
    m = lm.Automaton(g, g.counts(np.ones(6, bool)), int(g.first[-1]), len(np.unique(g.place[0])), (5.0, 2.0))
    whole = []
    for a, b in zip(g.first[:-1], g.first[1:]):
        state, total = np.array([m.start]), 0.0
        for w in g.place[0][a:b]:
            state, gain = m.step(state, np.array([w], np.int64))
            total += gain[0]
        whole.append(total)
    for lane in (2, 3, 8, 10_000):
        monkeypatch.setattr(lm, "LANE", lane)
        assert np.allclose(m.traverse(g.place[0], g.first), whole, rtol=1e-12)


def test_lm_blocks_round_trip():
    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    for k in (keys, keys[:1], keys[:0], np.array([0, (1 << 64) - 1], np.uint64)):
        assert (lm.unpack_keys(lm.pack_keys(k)) == k).all() and len(lm.unpack_keys(lm.pack_keys(k))) == len(k)
    for top in (1, 254, 255, 256, 70_000, 1 << 40):
        c = np.array([0, top, 1, top, 255])
        assert lm.unpack_counts(lm.pack_counts(c)).tolist() == c.tolist()
    assert lm.unpack_counts(lm.pack_counts(np.zeros(0))).tolist() == []


# 10


def test_mixing(docs, rows):
    taken = mixing.mix(docs, None, buckets=8).collect()
    sizes = Counter()
    for _, t, _, s, *_ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(order)
    left = total
    while True:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        open_ -= over
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    got = Counter()
    for r in taken:
        s = r.row.source
        got[s] += r.taken
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and r.taken in {k * r.size for k in range(4)}
    longest = max(r.size for r in taken)
    for s in order:
        assert abs(got[s] - target[s]) <= longest
        if target[s] >= sizes[s]:  # complete epochs come first
            assert all(r.taken >= r.size for r in taken if r.row.source == s)
    again = mixing.mix(docs.repartition(5), None, buckets=300)
    pick = lambda rs: sorted((key((r.doc_id, r.size, r.taken)) for r in rs))
    assert pick(again.collect()) == pick(taken)
    assert mixing.mixed_rows(docs).columns == docs.columns and mixing.mixed_rows(docs).count() == sum(r.copies for r in mixing.mix(docs).collect())


def test_quality_weights_shift_the_draw(spark):
    rows = [(i, "w " * 10, "a" if i < 2000 else "b") for i in range(2600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(2600)] + [(0, 1), (0, 1)], "doc_id long, quality int")
    got = mixing.mix(df, lab, weights=(1, 3)).where("source_size > 0 and doc_id < 2000").groupBy((F.col("doc_id") % 2).alias("q")).agg(F.avg((F.col("taken") > 0).cast("double")).alias("p")).collect()
    p = {r.q: r.p for r in got}
    assert p[1] > p[0] + 0.2


def test_mixing_orders_many_sources_in_ranges(docs):
    pick = lambda df: sorted(key((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken)) for r in df.collect())
    assert pick(mixing.mix(docs, task_sources=2)) == pick(mixing.mix(docs))


def test_exact_duplicates_of_a_text_in_very_many_tasks(spark):
    rows = [(i, ("same  text" if i % 3 else "same text") if i % 2 else f"own {i}") for i in range(400)] + [(1000 + i, None) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(24)
    few, plain = exact_dup.decisions(df, many=4), exact_dup.decisions(df, many=10**9)
    pick = lambda d: sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in d.collect())
    assert pick(few) == pick(plain) and sum(r[3] for r in pick(few)) == 202
    assert {r[1:3] for r in pick(few) if r[0] % 2 and r[0] < 1000} == {(1, 200)}


def test_stages_keep_columns_of_any_name(spark):
    """Names that the operators use themselves, in rows with ties, repeats and nulls."""
    names = ["id", "h", "id2", "h2", "row", "all", "rows", "copies", "nth", "drop", "__id", "__h", "__drop", "__all", "__own", "a.b", "col", "kept", "bucket", "key", "label", "size"]
    rng = random.Random(14)
    text = prose(rng, 80, 5000)
    rows = [(i, t, "en", "s", 1, *[f"{i}{n}" for n in names]) for i, t in enumerate([text, text, prose(rng, 80, 5000), None, "", prose(rng, 90, 5000)])]
    rows += [rows[2], (2, rows[2][1], "en", "s", 1, *["other"] * len(names)), (None, text, None, None, None, *[None] * len(names))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for stage, n in ((exact_dup.deduplicate, 4), (near_dup.deduplicate, 8), (quality.kept_rows, 7)):
        out = stage(df)
        assert out.columns == df.columns and out.count() == n and set(map(tuple, out.collect())) <= set(map(tuple, df.collect()))
    mixed = mixing.mixed_rows(df)
    assert mixed.columns == df.columns and set(map(tuple, mixed.collect())) <= set(map(tuple, df.collect()))
    assert exact_dup.deduplicate(df.repartition(7)).exceptAll(exact_dup.deduplicate(df.coalesce(1))).count() == 0


def test_very_long_repetitive_texts():
    import tracemalloc

    tracemalloc.start()
    got = quality.longest_repeats(np.full(300_000, 77, np.uint64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == np.maximum(np.arange(300_000)[::-1], np.arange(300_000)[::-1] + 1 - (np.arange(300_000) == 0))).all() and peak < 300_000 * 150


def test_a_shared_folder_is_asked_for_on_a_cluster():
    from lagspark.llm import shared

    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Session.conf)

    with pytest.raises(ValueError, match="checkpoint"):
        shared.folder(Session)


def test_empty_tables(spark, empty, tmp_path):
    assert near_dup.near_duplicates(empty).count() == 0 and near_dup.deduplicate(empty).count() == 0
    assert exact_dup.decisions(empty).count() == 0 and exact_dup.deduplicate(empty).count() == 0
    assert quality.rules(empty).count() == 0 and quality.kept_rows(empty).count() == 0
    assert licenses.scan(empty).count() == 0 and packing.pack(empty, tokenizer_path()).count() == 0
    assert secrets.scan(empty, secrets.Models.train([])).count() == 0
    assert np.isfinite(secrets.train(empty, spark.createDataFrame([], "doc_id long, quality int")).step).all()
    assert lm.score(empty).count() == 0 and mixing.mix(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/w")
    assert warc.read(spark, f"file://{tmp_path}/w").count() == 0


def test_pipeline(spark, tmp_path, docs):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline as C

    rng = random.Random(11)
    rows = [(i, prose(rng, 120, 90_000), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s1", 1) for i in range(10)] + [(200, "too short", "en", "s1", 1), (201, None, None, None, None)]
    w = rows[20][1].split()
    w[50] = "changed"
    rows += [(300, " ".join(w), "en", "s0", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = [n for n, _ in C.STAGES]
    assert names == ["quality_rules", "exact_dedup", "near_dedup", "mix_sources", "pack_windows"]
    docs, counts = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for n, f in C.STAGES:
        f(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        counts.append(docs.count())
        if n != names[-1]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert counts[:3] == [71, 61, 60]
    ids = {r.doc_id for r in C.run(spark, str(tmp_path)).collect()}
    assert ids <= set(range(60))


def test_secret_models_tell_keys_from_names(spark):
    """Held-out random strings and names: nearly every key is caught, hardly any name is."""
    rng = random.Random(21)
    docs = spark.createDataFrame([(i, prose(rng, 400), "x") for i in range(20)], "doc_id long, text string, good string")
    models = secrets.train(docs, spark.createDataFrame([(i, 1) for i in range(20)] + [(3, 1), (None, 1)], "doc_id long, quality int"))
    assert np.mean([bool(models.secrets(x)) for x in secrets.random_strings(1000, 99)]) > 0.99
    parts = "quarterly revenue forecast exporter legacy invoice printer adapter unsafe pointer arithmetic helper gradient descent optimizer warmup".split()
    names = [x for x in secrets.identifiers([rng.sample(parts, 4) for _ in range(100)]) + ["".join(w.capitalize() for w in rng.sample(parts, 3)) for _ in range(200)] if len(x) >= 16]
    assert len(names) > 200 and np.mean([bool(models.secrets(x)) for x in names]) < 0.1


def test_secrets_in_parts_of_runs():
    models = secrets.Models.train([(x, 1) for x in secrets.random_strings(2000)] + [(x, 0) for x in secrets.identifiers([["handle", "user", "request", "response", "number", "window", "service", "manager"]] * 200)])
    draw = lambda k, n, of: "".join(random.Random(k).choices(of, k=n))
    letters, short = draw(1, 32, secrets.ALPHABET[:52]), draw(2, 17, secrets.ALPHABET[:62])
    path, hexed = "requestManager" * 12 + "_", "0123456789abcdef"
    texts = [letters, short, path + letters, hexed + "Z" + letters, "-" * 40, "x" * 30, "=" * 16, path]
    buf, offs = T.flat(pa.array(texts, pa.large_string()))
    got = [[t[a:b] for a, k, b in found if k == 3] for t, found in zip(texts, secrets.find(texts, buf, offs, models))]
    assert got[:2] == [[letters], [short]] and got[4:] == [[]] * 4
    assert len(got[2]) == 1 and letters[2:-2] in got[2][0] and len(got[2][0]) < 40
    assert got[3] == ["Z" + letters]


def test_license_bands_miss_nothing_that_is_contained():
    """Worn notices: every (text, licence) with enough containment in some stretch of words is found, and nothing else."""
    rng = random.Random(31)
    lib = licenses.Library(licenses.TEXTS)
    wanted = caught = 0
    for _ in range(400):
        i = rng.randrange(len(lib.names))
        w = re.sub("[^A-Za-z0-9]", " ", licenses.TEXTS[lib.names[i]]).split()
        a, wear = rng.randrange(max(1, len(w) // 5)), rng.choice([0, 0.01, 0.02, 0.04, 0.06])
        w = [x if rng.random() >= wear else f"q{rng.randrange(999)}" for x in w[a:]]
        text = prose(rng, rng.randrange(60)) + " " + " ".join(w) + " " + prose(rng, rng.randrange(60))
        (_, _, words), = T.batches(pa.array([licenses._plain(text.encode())]))
        with np.errstate(over="ignore"):
            h, salt = words.hashes(), T.stream(5, 101)
            hashes = T.mix(sum(T.mix(h[k : len(h) - 4 + k] ^ salt[k]) for k in range(5)))
        got = {k for k, *_ in licenses.find(lib, hashes)}
        # At every word: the shingles of each template from there over twice its length.
        want = set()
        for k, own in enumerate(lib.sets):
            hit = np.isin(hashes, own)
            if any(100 * len(np.unique(hashes[s : s + 2 * lib.lengths[k]][hit[s : s + 2 * lib.lengths[k]]])) >= 75 * len(own) for s in np.flatnonzero(hit)):
                want.add(k)
        wanted, caught = wanted + len(want), caught + len(want & got)
        assert got <= want
    assert wanted > 200 and caught >= 0.99 * wanted


def test_licenses_with_words_put_in(spark):
    rng = random.Random(6)
    texts = []
    for name in ("mit", "apache-2.0", "gpl-3.0", "zlib"):
        w = licenses.TEXTS[name].split()
        texts.append(prose(rng, 50) + " " + " ".join(w[: len(w) // 2]) + " " + prose(rng, 80) + " " + " ".join(w[len(w) // 2 :]) + " " + prose(rng, 50))
    texts.append(licenses.TEXTS["gpl-3.0"] + " " + prose(rng, 5) + " " + licenses.TEXTS["gpl-3.0"])
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = sorted((r.doc_id, r.license_id) for r in got if r.license_id in ("mit", "apache-2.0", "gpl-3.0", "zlib"))
    assert found == [(0, "mit"), (1, "apache-2.0"), (2, "gpl-3.0"), (3, "zlib"), (4, "gpl-3.0"), (4, "gpl-3.0")]
    named = {(r.doc_id, r.license_id): r for r in got}
    assert all(named[k].total - named[k].shared <= 4 for k in found)
    # Relatives that share three quarters are found as well, with less containment.
    assert named[2, "agpl-3.0"].containment < named[2, "gpl-3.0"].containment
