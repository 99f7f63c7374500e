"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each task packs the documents of its own input split, so there is no shuffle.
Whole windows are cut from long documents; the rest of a document goes to the
fill level that minimises the sum of squared counts of partially filled windows
per level.  When the split ends, windows still open are filled up from the
emptiest ones, and the last is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

WINDOW = 2048
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_loaded: dict = {}
#: Marks that are often last in a word, and form one piece there.
TAIL = ".,;:!?"
# Fixed rule of byte-level vocabularies: a byte stands for its own character
# where that is printable in Latin-1, others take characters from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class Words(dict):
    """Ids of words, each encoded when it is first looked up; lead is what stands before them."""

    def __init__(self, encoder: "Encoder", lead: str):
        super().__init__()
        self.encoder, self.lead, self.mark = encoder, lead, "\u0120" if lead else ""

    def __missing__(self, word: str) -> bytes:
        e, core = self.encoder, word.rstrip(TAIL)
        if core.isalpha() or core.isdecimal():
            # Letters or digits are one piece, and so are the marks behind them.
            if len(core) < len(word):
                out = self[core] + e.tail(word[len(core) :])
            else:
                letters = core if core.isascii() else core.encode().decode("latin-1").translate(BYTE_LETTERS)
                out = b"".join([e.id_bytes[p.id] for p in e.split(self.mark + letters)])
        else:
            parts = word.split("\n")
            if len(parts) > 1 and all(p and p == p.strip() for p in parts):
                out = e.line.join([self[parts[0]], *[e.first[p] for p in parts[1:]]])
            else:
                out = e.whole([self.lead + word])[0]
        self[word] = out
        return out


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, by the tokenizers library.

    Byte-level BPE of this kind splits a text before each single space, and
    around a single line end between other characters, so the ids of a word
    with the space before it (or at the start of a line) never depend on what
    surrounds it.  They are kept and looked up again.  `plainness` tells which
    texts allow that; others go through the library whole.
    """

    KEEP = 1_000_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        self.line = self.whole(["\n"])[0]
        self.split = self.lib.model.tokenize  # of one piece, in the letters that stand for bytes
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.lib.get_vocab_size())]
        self.tails: dict[str, bytes] = {}
        self.clear()

    def clear(self) -> None:
        self.after, self.first = Words(self, " "), Words(self, "")

    @classmethod
    def at(cls, path: str) -> "Encoder":
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def tail(self, marks: str) -> bytes:
        if marks not in self.tails:
            self.tails[marks] = self.whole([marks])[0]
        return self.tails[marks]

    def encode(self, texts: list[str], plain: list[bool]) -> list[bytes]:
        if len(self.after) + len(self.first) > self.KEEP:
            self.clear()
        after, first, out = self.after.__getitem__, self.first, []
        for text, is_plain in zip(texts, plain):
            if is_plain:
                head, *words = text.split(" ")
                out.append((first[head] if head else b"") + b"".join(map(after, words)))
            else:
                out.append(self.whole([text])[0])
        return out


_WHITE = T.SPACE.copy()
_ODD = np.zeros(256, bool)
_ODD[[*range(0x1C, 0x20), *range(0xC9, 256)]] = True


def plainness(buf: np.ndarray, offsets: np.ndarray) -> list[bool]:
    """Of each document, whether its words can be encoded apart: code points below
    U+0240 only, where every version of the split agrees, no white space beside a
    single space, and no rare white space."""
    n = len(buf)
    bad = _ODD[buf]
    if n:
        white, space = _WHITE[buf], buf == 0x20
        bad[1:] |= (space[1:] & white[:-1]) | (white[1:] & space[:-1]) | ((buf[:-1] == 0xC2) & ((buf[1:] == 0x85) | (buf[1:] == 0xA0)))
    total = np.concatenate(([0], np.cumsum(bad)))
    return (total[offsets[1:]] == total[offsets[:-1]]).tolist()


class Packer:
    """Open windows by fill level; `done` holds pieces of closed ones."""

    def __init__(self, base: int, window: int = WINDOW):
        self.window, self.next = window, base
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list] = [[] for _ in range(window)]  # level -> windows, each a list of pieces
        self.done: list[tuple] = []

    def close(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, tokens in pieces:
            self.done.append((doc, start, len(ids) // 4, zlib.crc32(ids), tokens, self.next, offset))
            offset += len(ids) // 4
        self.next += 1

    def level(self, n: int) -> int:
        """The level, 0 for a new window, from which n more tokens cost least; ties go to the fullest."""
        fits = self.count[: self.window - n + 1]
        after = self.count[n:].copy()
        change = 2 * (after - fits) + 2
        change[-1] = 1 - 2 * fits[-1]  # fills the window
        change[0] = 2 * after[0] + 1 if n < self.window else 0
        usable = fits > 0
        usable[0] = True
        change[~usable] = np.iinfo(np.int64).max
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def add(self, doc, ids: bytes) -> None:
        tokens, width = len(ids) // 4, 4 * self.window
        for i in range(0, len(ids) - width + 1, width):
            self.close([(doc, i // 4, ids[i : i + width], tokens)])
        rest = tokens % self.window
        if not rest:
            return
        h = self.level(rest)
        own = []
        if h:
            own = self.open[h].pop()
            self.count[h] -= 1
        own.append((doc, tokens - rest, ids[4 * (tokens - rest) :], tokens))
        if h + rest == self.window:
            self.close(own)
        else:
            self.open[h + rest].append(own)
            self.count[h + rest] += 1

    def finish(self) -> None:
        left = [w for level in self.open for w in level]  # by rising level
        pool: list = []  # pieces of windows that were given up, last first
        i, j = 0, len(left) - 1
        while j >= i or pool:
            own = left[j] if j >= i else []
            j -= 1 if j >= i else 0
            room = self.window - sum(len(p[2]) // 4 for p in own)
            while room:
                if not pool:
                    if j < i:
                        break
                    pool = left[i][::-1]
                    i += 1
                doc, start, ids, tokens = pool.pop()
                own.append((doc, start, ids[: 4 * room], tokens))
                if len(ids) > 4 * room:
                    pool.append((doc, start + room, ids[4 * room :], tokens))
                room -= len(own[-1][2]) // 4
            if room:
                self.powers(own)
            else:
                self.close(own)

    def powers(self, pieces: list) -> None:
        """Cut a last window into sequences of powers of two."""
        pieces = pieces[::-1]
        size = sum(len(p[2]) // 4 for p in pieces)
        while size:
            room = 1 << (size.bit_length() - 1)
            size -= room
            own = []
            while room:
                doc, start, ids, tokens = pieces.pop()
                own.append((doc, start, ids[: 4 * room], tokens))
                if len(ids) > 4 * room:
                    pieces.append((doc, start + room, ids[4 * room :], tokens))
                room -= len(own[-1][2]) // 4
            self.close(own)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents in sequences of at most `window` ids (SCHEMA).

    tokenizer: path of a tokenizer file.  A document is the ids of its text,
    then end_id; null or empty texts are end_id alone.  Rows are packed as they
    come: repeated rows and null doc_ids are packed like others, other columns
    are ignored.  Sequence ids are distinct, gapless within a task only.  An
    empty table gives an empty result.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder.at(tokenizer), Packer(TaskContext.get().partitionId() << 40, window)
        tail = np.array([end_id], "<u4").tobytes()

        def out() -> pa.RecordBatch:
            rows, packer.done = packer.done, []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(names))], names)

        for batch in batches:
            column = batch.column("text").cast(pa.large_string())
            buf, offs = T.flat(column)
            ids = batch.column("doc_id").to_pylist()
            for i, j in T.passes(offs, 1 << 20):
                texts = [t or "" for t in column[i:j].to_pylist()]
                plain = plainness(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                for doc, own in zip(ids[i:j], encoder.encode(texts, plain)):
                    packer.add(doc, own + tail)
            yield out()
        packer.finish()
        yield out()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(T.lean(run), SCHEMA)
