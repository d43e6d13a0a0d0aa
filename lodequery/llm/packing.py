"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each Spark partition packs its own documents in the order they are read. A level array counts the
partially filled windows by fill; a document's last piece goes to the level that keeps the sum of the
squared counts smallest. Documents of a window or more fill whole windows first. What is still open
at the end of a partition is closed by cutting: full windows, then windows of powers of two.

Nothing is shuffled. A task holds the ids of one document and of its open windows; those of windows beyond
`max_open` wait in a temporary file of the task, which changes nothing in the packing, since ids of open
windows are read only when they are cut at the end.

Cases: null or empty text is the end id alone; null doc_id is kept; repeated rows are packed each;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
#: Characters at which str.split() parts words and the tokenizer doesn't.
ODD_SPACES = "\x1c\x1d\x1e\x1f"


#: Letters with one lower-case form and no decomposition, then ASCII marks but the apostrophe: two pre-tokens at most.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Ids (little-endian 32-bit bytes) of texts, word by word: the tokenizer never joins across white space.

    The ids of words, and of the letters of plain words in lower case, are kept; a full memory (`most`
    words) starts anew. Plain words go to the tokenizer's model directly, others through all its steps.
    """

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def part(self, piece: str) -> bytes:
        if (ids := self.parts.get(piece)) is None:
            written = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            ids = b"".join(x.id.to_bytes(4, "little") for x in self.model.tokenize(written))
            self.parts[piece] = ids
        return ids

    def word(self, word: str) -> bytes:
        if not (m := PLAIN.fullmatch(word)):
            return self.whole(word)
        ids = self.part(m[1].lower())
        return ids + self.part(m[2]) if m[2] else ids

    def encode(self, text: str) -> bytes:
        if any(x in text for x in ODD_SPACES):
            return self.whole(text)
        words = text.split()
        ids = list(map(self.known.get, words))
        if None in ids:
            if len(self.known) > self.most:
                self.known.clear()
                self.parts.clear()
            new = {w for w, x in zip(words, ids, strict=True) if x is None}
            new = {w: self.word(w) for w in new}
            ids = [new[w] if x is None else x for w, x in zip(words, ids, strict=True)]
            self.known.update(new)
        return b"".join(ids)


class Held:
    """Ids of pieces in open windows: up to `most` pieces in memory, others in a temporary file."""

    def __init__(self, most: int):
        self.most, self.own, self.file, self.made = most, {}, None, 0

    def put(self, ids: bytes) -> int | tuple[int, int]:
        """A key for ids: a number in memory, (place, size) in the file."""
        if len(self.own) < self.most:
            self.made += 1
            self.own[self.made] = ids
            return self.made
        self.file = self.file or tempfile.TemporaryFile()
        at = self.file.seek(0, os.SEEK_END)
        self.file.write(ids)
        return at, len(ids)

    def drop(self, key: int | tuple[int, int]) -> None:
        self.own.pop(key, None)

    def get(self, key: int | tuple[int, int]) -> bytes:
        if isinstance(key, int):
            return self.own.pop(key)
        self.file.seek(key[0])
        return self.file.read(key[1])


class SquaresPacker:
    """Windows of `size` ids; add() and close() give the pieces that are final: (document, start, length, crc32, window, offset)."""

    def __init__(self, size: int, max_open: int):
        self.size, self.windows, self.held = size, 0, Held(max_open)
        self.levels = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list[tuple]]] = {}

    def place(self, length: int) -> int:
        """The fill level (0: a new window) that makes the sum of squared level counts grow least; the fullest of equals."""
        room = self.size - length
        levels = self.levels[: room + 1]
        after = self.levels[length : self.size + 1].copy()
        after[room] = 0  # a full window leaves the array
        grows = 2 * (after - levels) + 2
        grows[room] -= 1
        grows[0] = (2 * after[0] + 1) if room else 0
        grows[1:][levels[1:] == 0] = np.iinfo(np.int64).max
        return room - int(np.argmin(grows[::-1]))

    def add(self, document: tuple, ids: bytes) -> Iterator[tuple]:
        size, total = self.size, len(ids) // 4
        whole = total - total % size
        for start in range(0, whole, size):
            yield from self.out([(document, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]))])
        if whole < total:
            rest, length = ids[4 * whole :], total - whole
            level = self.place(length)
            window = self.open[level].pop() if level else []
            self.levels[level] -= bool(level)
            if level + length == size:
                for piece in window:
                    self.held.drop(piece[4])
                yield from self.out([*window, (document, whole, length, zlib.crc32(rest))])
            else:
                window.append((document, whole, length, zlib.crc32(rest), self.held.put(rest)))
                self.levels[level + length] += 1
                self.open.setdefault(level + length, []).append(window)

    def close(self) -> Iterator[tuple]:
        """Cuts the pieces of the windows that are open at the end into full windows and, last, powers of two."""
        pieces = [p for level in sorted(self.open, reverse=True) for w in self.open[level] for p in w]
        self.open, self.levels[:] = {}, 0
        left = sum(p[2] for p in pieces)
        window, filled, room = [], 0, self.size
        for document, start, _, _, key in pieces:
            ids = self.held.get(key)
            while ids:
                if not filled:
                    room = self.size if left >= self.size else 1 << (left.bit_length() - 1)
                take = min(room - filled, len(ids) // 4)
                window.append((document, start, take, zlib.crc32(ids[: 4 * take])))
                ids, start, filled, left = ids[4 * take :], start + take, filled + take, left - take
                if filled == room:
                    yield from self.out(window)
                    window, filled = [], 0

    def out(self, window: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for document, start, length, crc, *_ in window:
            yield document, start, length, crc, self.windows, offset
            offset += length
        self.windows += 1


_ENCODERS: dict[str, WordEncoder] = {}


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, max_open: int = 4096) -> DataFrame:
    """Pieces of all documents of docs (doc_id, text) in windows of `size` ids, as SCHEMA says.

    sequence_id is the partition's number in the high bits and a count in the low 33; a task that runs
    again reads the same rows and gives the same windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.setdefault(tokenizer, None) or WordEncoder(tokenizer)
        _ENCODERS[tokenizer] = encoder
        packer, end = SquaresPacker(size, max_open), np.array([end_id], "<u4").tobytes()
        base, rows = TaskContext.get().partitionId() << 33, []

        def note(pieces: Iterator[tuple]) -> None:
            for (doc_id, total), start, length, crc, window, offset in pieces:
                rows.append((doc_id, start, length, crc, total, base + window, offset))

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(FIELDS)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], FIELDS)

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = encoder.encode(text.as_py() or "") + end
                note(packer.add((doc_id, len(ids) // 4), ids))
                if len(rows) >= 10_000:
                    yield batch()
        note(packer.close())
        yield batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
