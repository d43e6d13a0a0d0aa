"""Byte-level BPE encoding and decoding with overlapping chunks.

Long texts are cut into overlapping chunks that are pre-tokenised in parallel. Neighbouring chunks
are stitched at the first position of their overlap where the pre-token boundaries of both
resynchronise; where an overlap has none, the left chunk's last boundary is extended over the text of
the next. The stitched text is cut at sure boundaries into pieces that are encoded and decoded in parallel;
their ids and bytes are hashed in order. Decoding concatenates the raw bytes of the ids.

Texts of one chunk, up to `chunk` characters, need no stitching and stay in the task that read them; only
chunks of long texts are shuffled, spread by text and chunk number. A task holds one text at a time.

Cases: null or empty text has no ids and the hashes of the empty string; null doc_id and repeated rows
are kept, each row on its own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class ByteBPE:
    """Merges by rank inside each pre-token; ids are little-endian 32-bit bytes.

    Where no white space stands beside other white space, the pattern never matches across the start
    of a space, so the ids of " word" are kept (at most `most` of them) and looked up.
    """

    def __init__(self, path: str, pattern: str, most: int = 500_000):
        import re

        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = {i: x for x, i in self.ranks.items()}
        self.find, self.doubled = regex.compile(pattern).finditer, re.compile(r"\s\s|^\s|\s$").search
        self.known: dict[str, bytes] = {}
        self.most = most

    def ends(self, text: str) -> list[int]:
        """Where the pre-tokens of text end."""
        return [m.end() for m in self.find(text)]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the pair of least rank is joined first, the leftmost of equals."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        ranks, n = self.ranks, len(piece)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or end[j] != stop:
                continue
            alive[j], end[i], after[i] = False, stop, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (k := before[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
                heapq.heappush(heap, (r, k, stop))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def encode_pieces(self, text: str, ends: list[int]) -> bytes:
        out, begin = [], 0
        for stop in ends:
            piece = text[begin:stop]
            if (ids := self.known.get(piece)) is None:
                ids = np.array(self.merge(piece.encode()), "<u4").tobytes()
                if len(self.known) > self.most:
                    self.known.clear()
                if len(piece) < 100:
                    self.known[piece] = ids
            out.append(ids)
            begin = stop
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if self.doubled(text) or not text:
            return self.encode_pieces(text, self.ends(text))
        first, *rest = text.split(" ")
        units = [first, *[" " + x for x in rest]]
        ids = list(map(self.known.get, units))
        if None in ids:
            new = {x: self.encode_pieces(x, self.ends(x)) for x, y in zip(units, ids, strict=True) if y is None}
            ids = [new[x] if y is None else y for x, y in zip(units, ids, strict=True)]
            self.known.update((x, y) for x, y in new.items() if len(x) < 100)
        return b"".join(ids)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def stitch(bpe: ByteBPE, text: str, chunks: list[tuple[int, np.ndarray]]) -> list[int]:
    """Pre-token ends of the whole text from those of its overlapping chunks, as (chunk's start, ends in the text).

    Of two chunks the left holds until the first boundary that both have in their overlap. A chunk's last
    end is its own edge and counts as no boundary, and no white-space run's end does, since what follows
    the edge may change how the pattern parts it.
    """
    ends = chunks[0][1].tolist()
    for at, right in chunks[1:]:
        del ends[-2:]
        tail = ends[bisect_right(ends, at) :]
        both = [p for p in np.intersect1d(tail, right).tolist() if text[p].isspace() and not text[p - 1].isspace()]
        if both:
            del ends[bisect_right(ends, both[0]) :]
            ends.extend(right[right > both[0]].tolist())
        else:  # never in step: read on from the last sure boundary
            begin = ends[-1] if ends else 0
            ends.extend(begin + e for e in bpe.ends(text[begin : int(right[-1])]))
    return ends


_CODERS: dict[tuple, ByteBPE] = {}


def coder(path: str, pattern: str) -> ByteBPE:
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = ByteBPE(path, pattern)
    return _CODERS[path, pattern]


def digest(bpe: ByteBPE, ids: bytes) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()


def encode(docs: DataFrame, ranks: str, pattern: str, chunk: int = 65_536, overlap: int = 1_024) -> DataFrame:
    """Token count and hashes of the ids and of the decoded bytes of each row of docs (doc_id, text), as SCHEMA says."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    long = F.length("text") > chunk

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks, pattern)
        for b in batches:
            rows = [digest(bpe, bpe.encode(x.as_py())) for x in b.column("text")]
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                text, row = text.as_py(), row + 1
                for part, at in enumerate(range(0, len(text), chunk)):
                    yield pa.RecordBatch.from_pylist([{"row": row, "part": part, "doc_id": doc_id, "at": max(0, at - overlap), "text": text[max(0, at - overlap) : at + chunk]}], part_schema)

    part_schema = pa.schema([("row", pa.int64()), ("part", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("text", pa.string())])

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks, pattern)
        for b in batches:
            ends = [(np.array(bpe.ends(x.as_py()), np.int64) + at).tobytes() for x, at in zip(b.column("text"), b.column("at").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends, pa.binary())], [*b.schema.names, "ends"])

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        """A long text's pieces of about `chunk` characters, each ending where a pre-token ends."""
        bpe, rows = coder(ranks, pattern), rows.sort_values("part")
        text = "".join(x[(part > 0) * overlap :] for part, x in zip(rows["part"], rows["text"], strict=True))
        chunks = [(at, np.frombuffer(x, np.int64)) for at, x in zip(rows["at"], rows["ends"], strict=True)]
        ends = np.array(stitch(bpe, text, chunks), np.int64)
        cuts = np.unique(np.searchsorted(ends, np.arange(chunk, len(text) + chunk, chunk)).clip(max=len(ends) - 1))
        edges, out = ends[cuts].tolist(), []
        for i, (a, b, own) in enumerate(zip([0, *edges[:-1]], edges, np.split(ends, cuts[:-1] + 1), strict=True)):
            out.append((rows["row"].iloc[0], i, rows["doc_id"].iloc[0], 0, text[a:b], (own - a).tobytes()))
        return pd.DataFrame(out, columns=["row", "part", "doc_id", "at", "text", "ends"]).astype({"doc_id": "Int64"})

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks, pattern)
        for b in batches:
            ids = [bpe.encode_pieces(x.as_py(), np.frombuffer(e.as_py(), np.int64).tolist()) for x, e in zip(b.column("text"), b.column("ends"), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("row", "part", "doc_id")), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.binary())], ["row", "part", "doc_id", "ids", "decoded"])

    def hashed(rows: pd.DataFrame) -> pd.DataFrame:
        ids, decoded, n = hashlib.sha256(), hashlib.sha256(), 0
        rows = rows.sort_values("part")
        for a, b in zip(rows["ids"], rows["decoded"], strict=True):
            ids.update(a)
            decoded.update(b)
            n += len(a) // 4
        return pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64").iloc[:1], "n_tokens": [n], "ids_sha256": [ids.hexdigest()], "decoded_sha256": [decoded.hexdigest()]})

    fields = "row long, part long, doc_id long, at long, text string"
    chunks = docs.where(long).mapInArrow(parts, fields).repartition("row", "part").mapInArrow(pretokenise, f"{fields}, ends binary")
    pieces = chunks.groupBy("row").applyInPandas(join, f"{fields}, ends binary").repartition("row", "part")
    pieces = pieces.mapInArrow(encoded, "row long, part long, doc_id long, ids binary, decoded binary")
    return docs.where(~long).mapInArrow(short, SCHEMA).unionByName(pieces.groupBy("row").applyInPandas(hashed, SCHEMA))
