"""Removal of bytes that repeat, as part of a string of `length` bytes, from a document of smaller id; by sorted suffixes.

A suffix counts by its first `length` bytes. Sorting all of them would move the corpus fifty times over, so suffixes that no other
document can share are ruled out first, without loss:

- Anchors. Of the `gram`-byte strings in each window of `length` bytes, those of least hash are anchors; equal windows have equal
  anchors. An anchor is sent as two hashes, of its gram and of all bytes that a window around it can hold (its context).
- A context that a document of smaller id has too repeats with all windows around its anchor: those are removed. Inside a
  task such anchors don't leave the task, so that of many copies one is sent. Grams that only one document has are done, as are
  those of a single context.
- What is left are anchors in several contexts, mostly the rims of copies. Their bytes are fetched and their suffixes
  sorted: anchors are partitioned by range of their gram, with splitters that Spark samples, and each partition sorts the
  suffixes of the windows around them by multikey quicksort: symbols are eight bytes, a step splits all open groups by their next
  symbol, and groups of one are done. Neighbours in that order that are equal belong to one run, and the least id of the run decides.
- Grams of many contexts (more than `most_rows`, or common in a sample of the documents) would make one large partition. Their suffixes
  are partitioned by range of all their bytes, then id and place, so that one string may reach over many partitions;
  each tells its first and last string, and the first run of a partition is compared with the last one before it.

Hashes have 64 bits; a context is taken as equal where both its hashes are. Suffixes are compared byte by byte.
Joins with the texts broadcast the found places while these are below `most_broadcast` bytes, else they shuffle.

Cases: null texts are empty; texts shorter than `length` have nothing to remove; rows without id count as of the largest id;
rows that share an id don't remove from each other and are returned each; matches overlap and never cross documents; texts of any length
are read in segments; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodequery.llm.common import deleted, stored

LAST = 2**63 - 1
RUN, WIDE, NARROW = 0, 1, 2
FOUND = pa.schema([("o", pa.int64()), ("th", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())])
FOUND_SQL = "o long, th long, begin long, end long, kind int"


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    return x


#: A hash for each byte, and one for what lies outside a document.
BYTES = mixed(mixed(np.arange(1, 258, dtype=np.uint64), np.arange(257, dtype=np.uint64)), np.full(257, 11, np.uint64))


def extreme(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The least (or greatest) of each `width` neighbours."""
    n = 1
    while 2 * n <= width:
        x, n = best(x[:-n], x[n:]), 2 * n
    return best(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


class Anchors:
    """Finds the anchors of texts; keeps them until taken."""

    def __init__(self, length: int, segment: int = 1 << 18):
        self.length, self.segment = length, segment
        self.gram = 1 << max(0, (length // 3).bit_length() - 1)
        self.back = length - self.gram
        self.o: list[int] = []
        self.th: list[int] = []
        self.known: set[tuple[int, int]] = set()
        self.bytes = 0
        self.pieces: list[tuple] = []
        self.size = 0
        self.found: list[tuple[np.ndarray, ...]] = []

    def add(self, o: int, th: int, text: bytes) -> None:
        windows = len(text) - self.length + 1
        if windows <= 0 or (o, th) in self.known:  # a row that repeats another has its result
            return
        self.known.add((o, th))
        self.o.append(o)
        self.th.append(th)
        self.bytes += len(text)
        whole = np.frombuffer(text, np.uint8)
        for begin in range(0, windows, self.segment):
            end = min(windows, begin + self.segment)
            first, last = max(0, begin - self.back), min(len(text), end - 1 + self.length + self.back)
            # the symbols before the first window, the number of windows, the bytes
            self.pieces.append((len(self.o) - 1, begin, end - begin, first - (begin - self.back), whole[first:last]))
            self.size += end - begin + 2 * self.back + self.length - 1
            if self.size >= self.segment:
                self.scan()

    def scan(self) -> None:
        if not self.pieces:
            return
        symbols = np.full(self.size, 256, np.uint16)
        starts, at = [], 0
        valid = np.zeros(self.size, bool)
        for _, _, n, skip, part in self.pieces:
            symbols[at + skip : at + skip + len(part)] = part
            starts.append(at)
            valid[at + self.back : at + self.back + n] = True
            at += n + 2 * self.back + self.length - 1
        h, n = BYTES[symbols], 1
        while n < self.gram:
            h, n = mixed(h[:-n], h[n:]), 2 * n
        least = extreme(h, self.back + 1, np.minimum)
        least[~valid[: len(least)]] = 0
        reached = extreme(np.concatenate([np.zeros(self.back, np.uint64), least, np.zeros(self.back, np.uint64)]), self.back + 1, np.maximum)
        p = np.flatnonzero((reached == h) & (h > 0))
        context = np.zeros(len(p), np.uint64)
        for off in [*range(-self.back, self.back, self.gram), self.back]:
            context = mixed(context, h[p + off])
        which = np.searchsorted(starts, p, "right") - 1
        doc, begin = (np.array([x[i] for x in self.pieces])[which] for i in (0, 1))
        self.found.append((h[p], context, doc.astype(np.int32), p - np.array(starts)[which] - self.back + begin))
        self.pieces, self.size = [], 0

    def taken(self) -> tuple[np.ndarray, ...]:
        """h, context, o, th, place of all anchors since the last time."""
        self.scan()
        h, c, doc, p = (np.concatenate(x) for x in zip(*self.found, strict=True)) if self.found else (np.zeros(0, k) for k in (np.uint64, np.uint64, np.int32, np.int64))
        out = h, c, np.array(self.o, np.int64)[doc], np.array(self.th, np.int64)[doc], p
        self.o, self.th, self.known, self.bytes, self.found = [], [], set(), 0, []
        return out


def starts_of(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before; the first row does."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def run_minima(new: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each row the least value of its run."""
    begin = np.flatnonzero(new)
    return np.minimum.reduceat(values, begin)[np.cumsum(new) - 1] if len(begin) else values


def repeats(h: np.ndarray, c: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Which anchors have a context that a smaller id has too."""
    out = np.zeros(len(h), bool)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    several = np.zeros(len(h), bool)
    several[1:] |= same
    several[:-1] |= same
    rows = order[several]
    rows = rows[np.lexsort((o[rows], c[rows], h[rows]))]
    out[rows] = o[rows] > run_minima(starts_of(h[rows], c[rows]), o[rows])
    return out


def squeezed(x: np.ndarray) -> bytes:
    return zstandard.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 1)


def opened(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def merged(o: np.ndarray, th: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal runs of each (o, th): spans that overlap or touch become one."""
    order = np.lexsort((begin, th, o))
    o, th, begin, end = o[order], th[order], begin[order], end[order]
    doc = np.cumsum(starts_of(o, th)) if len(o) else np.zeros(0, np.int64)
    # ends grow along the spans of a document; the number of the document keeps the documents apart
    step = int(end.max(initial=0)) + 1
    reach = np.maximum.accumulate(end + doc * step) if len(o) else end
    new = np.ones(len(o), bool)
    new[1:] = begin[1:] + doc[1:] * step > reach[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(o)]]) - 1 if len(first) else first
    return o[first], th[first], begin[first], (reach - doc * step)[last]


def found_batch(o: np.ndarray, th: np.ndarray, begin: np.ndarray, end: np.ndarray, kind: np.ndarray | int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(o), pa.array(th), pa.array(begin), pa.array(end), pa.array(np.broadcast_to(np.asarray(kind, np.int32), len(o)))], schema=FOUND)


def words(x: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of eight-byte symbols that compare as the bytes do."""
    n, width = x.shape
    full = np.zeros((n, -(-width // 8) * 8), np.uint8)
    full[:, :width] = x
    return full.view(">u8").astype(np.uint64)


def multikey(symbols: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by group, then symbols (stable), and where in it a row differs from the one before.

    Multikey quicksort with all open groups split side by side: rows that share a group and all symbols so far are told apart
    by the next one; groups of one row are done.
    """
    order = np.argsort(group, kind="stable")
    new = starts_of(group[order])
    for column in symbols.T:
        alone = new & np.concatenate([new[1:], [True]])
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        rows, of = order[at], np.cumsum(new)[at]
        again = np.lexsort((column[rows], of))
        order[at] = rows[again]
        key = column[order[at]]
        new[at[1:]] |= key[1:] != key[:-1]
    return order, new


def removed(docs: DataFrame, length: int = 50, bucket_bytes: int = 32 << 20, flush_bytes: int = 16 << 20, most_rows: int = 4096, rows_per_task: int = 200_000, sample_bytes: int = 32 << 20, most_broadcast: int = 64 << 20, segment: int = 1 << 18) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs (doc_id, text).

    bucket_bytes: text whose anchors one task gathers; flush_bytes: text whose anchors a task compares before it sends them;
    most_rows: contexts of one gram that a task sorts together; the sample of about sample_bytes only finds common grams.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"))
    rows = rows.withColumns({"o": F.coalesce("doc_id", F.lit(LAST)), "th": F.xxhash64("text")})
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-total // bucket_bytes))
    back = Anchors(length).back

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for o, th, t in zip(b.column("o").to_pylist(), b.column("th").to_pylist(), b.column("text"), strict=True):
                finder = Anchors(length, segment)
                finder.add(o, th, t.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(finder.taken()[0]).view(np.int64))], ["h"])

    share = min(1.0, sample_bytes / max(1, total))
    common = rows.sample(share, 17).mapInArrow(sampled, "h long").groupBy("h").count().where(F.col("count") >= max(8, int(5 * most_rows * share)))
    hot = spark.sparkContext.broadcast(np.sort(np.array([r["h"] for r in common.select("h").collect()], np.int64).view(np.uint64)))  # at most sample_bytes / 8 / length grams

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Anchors(length, segment)
        for b in batches:
            for o, th, t in zip(b.column("o").to_pylist(), b.column("th").to_pylist(), b.column("text"), strict=True):
                finder.add(o, th, t.as_py())
                if finder.bytes >= flush_bytes:
                    yield from flushed(finder)
        yield from flushed(finder)

    def flushed(finder: Anchors) -> Iterator[pa.RecordBatch]:
        h, c, o, th, p = finder.taken()
        if not len(h):
            return
        again = repeats(h, c, o)
        if again.any():
            yield blob(int(h[0] % np.uint64(buckets)), RUN, merged(o[again], th[again], np.maximum(0, p[again] - back), p[again] + length))
        h, c, o, th, p = (x[~again] for x in (h, c, o, th, p))
        is_hot = np.isin(h, hot.value)
        bucket = (np.where(is_hot, mixed(h, c), h) % np.uint64(buckets)).astype(np.int64) * 2 + is_hot
        order = np.argsort(bucket, kind="stable")
        for part in np.split(order, np.flatnonzero(starts_of(bucket[order]))[1:]):
            b = int(bucket[part[0]])
            yield blob(b // 2, NARROW if b % 2 else WIDE, (h[part], c[part], o[part], th[part], p[part]))

    def blob(bucket: int, kind: int, columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"bucket": bucket, "kind": kind, "columns": [squeezed(np.ascontiguousarray(x)) for x in columns]}], pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("columns", pa.list_(pa.binary()))]))

    def compared(group: pa.Table) -> pa.Table:
        """The spans that a bucket's anchors settle, and the anchors whose suffixes are to be sorted (begin: their place)."""
        out = [FOUND.empty_table()]
        for kind in (RUN, WIDE, NARROW):
            blobs = [b for k, b in zip(group.column("kind").to_pylist(), group.column("columns").to_pylist(), strict=True) if k == kind]
            if not blobs:
                continue
            types = (np.int64,) * 4 if kind == RUN else (np.uint64, np.uint64, np.int64, np.int64, np.int64)
            columns = [np.concatenate([opened(b[i], t) for b in blobs]) for i, t in enumerate(types)]
            if kind == RUN:
                out.append(pa.Table.from_batches([found_batch(*columns, RUN)]))
                continue
            h, c, o, th, p = columns
            again = repeats(h, c, o)
            out.append(pa.Table.from_batches([found_batch(*merged(o[again], th[again], np.maximum(0, p[again] - back), p[again] + length), RUN)]))
            h, c, o, th, p = (x[~again] for x in columns)
            order = np.lexsort((p, th, o, c, h))
            h, c, o, th, p = (x[order] for x in (h, c, o, th, p))
            once = starts_of(h, c, o, th, p)  # rows that repeat
            h, c, o, th, p = (x[once] for x in (h, c, o, th, p))
            kinds = np.full(len(h), kind)
            if kind == WIDE:
                new, first = starts_of(h), starts_of(h, c)
                of, begin = np.cumsum(new) - 1, np.flatnonzero(new)
                least, most = np.minimum.reduceat(o, begin)[of], np.maximum.reduceat(o, begin)[of]
                # a group needs two contexts and two ids; the least id loses nothing, so it sends each context once
                keep = (np.add.reduceat(first.astype(np.int64), begin)[of] > 1) & (least < most) & ((o > least) | first)
                kinds = np.where(np.add.reduceat(keep.astype(np.int64), begin)[of] > most_rows, NARROW, WIDE)
                o, th, p, kinds = (x[keep] for x in (o, th, p, kinds))
            out.append(pa.Table.from_batches([found_batch(o, th, p, p, kinds)]))
        return pa.concat_tables(out)

    anchors = rows.select("o", "th", "text").mapInArrow(sent, "bucket int, kind int, columns array<binary>")
    found = stored(anchors.groupBy("bucket").applyInArrow(compared, FOUND_SQL), "suffix-found")

    def packed(spans: DataFrame) -> tuple[DataFrame, bool]:
        """A row for each (o, th) with its places, sorted, by kind; and whether all of that is small."""

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []

            def closed(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                o, th, begin, end, kind = (np.concatenate([np.asarray(b.column(i)) for b in parts]) for i in range(5))
                cut = np.flatnonzero(starts_of(o, th))
                out = {"o": [], "th": [], "runs": [], "wide": [], "narrow": []}
                for at, to in zip(cut, [*cut[1:], len(o)], strict=True):
                    own, kinds = slice(at, to), kind[at:to]
                    is_run = kinds == RUN
                    runs = merged(o[own][is_run], th[own][is_run], begin[own][is_run], end[own][is_run])
                    out["o"].append(int(o[at]))
                    out["th"].append(int(th[at]))
                    out["runs"].append(np.stack([runs[2], runs[3]], axis=1).astype(np.int32).tobytes())
                    for name, k in (("wide", WIDE), ("narrow", NARROW)):
                        out[name].append(np.unique(begin[own][kinds == k]).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_pydict(out, pa.schema([("o", pa.int64()), ("th", pa.int64()), ("runs", pa.binary()), ("wide", pa.binary()), ("narrow", pa.binary())]))

            for b in batches:  # documents are together; the last of a batch may go on in the next
                if not b.num_rows:
                    continue
                last = starts_of(np.asarray(b.column(0)), np.asarray(b.column(1))).nonzero()[0][-1]
                if held and (last > 0 or (held[0].column(0)[0], held[0].column(1)[0]) != (b.column(0)[0], b.column(1)[0])):
                    yield from closed([*held, b.slice(0, last)])
                    held = [b.slice(last)]
                elif not held and last > 0:
                    yield from closed([b.slice(0, last)])
                    held = [b.slice(last)]
                else:
                    held.append(b)
            if held:
                yield from closed(held)

        out = stored(spans.repartition("o", "th").sortWithinPartitions("o", "th").mapInArrow(pack, "o long, th long, runs binary, wide binary, narrow binary"), "suffix-packed")
        size = out.agg(F.coalesce(F.sum(100 + F.octet_length("runs") + F.octet_length("wide") + F.octet_length("narrow")), F.lit(0))).first()[0]
        return out, size <= most_broadcast

    wanted, small = packed(found.where(F.col("kind") != RUN))
    asked = rows.select("o", "th", "text").join(F.broadcast(wanted) if small else wanted, ["o", "th"])

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """lead and body, the bytes to sort by; left and right: how many bytes beside the gram lie in the document."""
        known: set[tuple[int, int]] = set()
        for b in batches:
            for o, th, text_, wide, narrow in zip(*(b.column(n).to_pylist() if n in ("o", "th") else b.column(n) for n in ("o", "th", "text", "wide", "narrow")), strict=True):
                if (o, th) in known:
                    continue
                known.add((o, th))
                whole, size = np.frombuffer(text_.as_buffer(), np.uint8), len(text_.as_buffer())
                around = np.concatenate([np.zeros(back, np.uint8), whole, np.zeros(length, np.uint8)])
                windows = np.lib.stride_tricks.sliding_window_view(around, 2 * back + (length - back))
                for places, kind in ((np.frombuffer(wide.as_buffer(), np.int32).astype(np.int64), WIDE), (np.frombuffer(narrow.as_buffer(), np.int32).astype(np.int64), NARROW)):
                    for begin in range(0, len(places), 4096):
                        p = places[begin : begin + 4096]
                        left, right = np.minimum(back, p), np.minimum(back, size - p - (length - back))
                        full = windows[p]
                        lead, body = full[:, back : back + length - back], np.concatenate([full[:, :back], full[:, length:]], axis=1)
                        if kind == NARROW:  # every window around the anchor is a suffix of its own
                            which, shift = np.nonzero((np.arange(back + 1) <= left[:, None]) & (back - np.arange(back + 1) <= right[:, None]))
                            p = np.unique(p[which] - shift)
                            lead, body = np.lib.stride_tricks.sliding_window_view(whole, length)[p], np.zeros((len(p), 0), np.uint8)
                            left = right = np.zeros(len(p), np.int64)
                        text_of = lambda m: pa.FixedSizeBinaryArray.from_buffers(pa.binary(m.shape[1]), len(m), [None, pa.py_buffer(np.ascontiguousarray(m))]).cast(pa.binary()) if m.shape[1] else pa.array([b""] * len(m), pa.binary())
                        yield pa.RecordBatch.from_arrays([text_of(lead), text_of(body), pa.array(np.full(len(p), o)), pa.array(np.full(len(p), th)), pa.array(p), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), pa.array(np.full(len(p), kind, np.int32))], SUFFIX.names)

    SUFFIX = pa.schema([("lead", pa.binary()), ("body", pa.binary()), ("o", pa.int64()), ("th", pa.int64()), ("p", pa.int64()), ("left", pa.int32()), ("right", pa.int32()), ("kind", pa.int32())])
    suffixes = stored(asked.mapInArrow(fetched, "lead binary, body binary, o long, th long, p long, left int, right int, kind int"), "suffix-bytes")
    counts = {r["kind"]: r["count"] for r in suffixes.groupBy("kind").count().collect()}
    ranges = lambda kind: max(1, -(-counts.get(kind, 0) // rows_per_task))
    around_grams = suffixes.where(F.col("kind") == WIDE).repartitionByRange(ranges(WIDE), "lead").mapInArrow(lambda batches: sorted_around(batches, length, back), FOUND_SQL)
    alone = suffixes.where(F.col("kind") == NARROW).repartitionByRange(ranges(NARROW), "lead", "o", "th", "p")
    edges = stored(alone.mapInArrow(lambda batches: sorted_alone(batches, length), f"{FOUND_SQL}, least long, part int, first binary, last binary, first_least long, last_least long"), "suffix-edges")

    # compare across boundaries: the first run of a partition goes on with the last of the one before where the strings are equal
    carried: list[tuple[int, int]] = []
    last, least = None, 0
    for r in edges.where("part is not null and first is not null").orderBy("part").select("part", "first", "last", "first_least", "last_least").collect():  # a row a partition
        if r["first"] == last:
            carried.append((r["part"], least))
        least = least if r["first"] == last == r["last"] else r["last_least"]
        last = r["last"]
    before = F.broadcast(spark.createDataFrame(carried, "at int, carry long"))
    spans = edges.where("first is null").join(before, F.col("part") == F.col("at"), "left").where(F.col("o") > F.least("least", "carry"))
    runs, small = packed(found.where(F.col("kind") == RUN).unionByName(around_grams).unionByName(spans.select(*FOUND.names)))
    for table in (found, wanted, suffixes, edges):
        deleted(table)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        for b in batches:
            out = []
            for doc_id, text_, spans in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("runs"), strict=True):
                data, digest, at, gone, n = memoryview(text_.as_buffer()), hashlib.sha256(), 0, 0, 0
                if spans.is_valid:
                    for begin, end in np.frombuffer(spans.as_buffer(), np.int32).reshape(-1, 2).tolist():
                        end = min(end, len(data))
                        digest.update(data[at:begin])
                        at, gone, n = end, gone + end - begin, n + 1
                digest.update(data[at:])
                out.append((doc_id, len(data), gone, n, digest.hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(),) * 4 + (pa.string(),)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)

    return rows.join(F.broadcast(runs) if small else runs, ["o", "th"], "left").select("doc_id", "text", "runs").mapInArrow(finished, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def byte_rows(column: pa.Array) -> np.ndarray:
    """A column of byte strings of one length as a matrix."""
    n = len(column)
    begin = np.asarray(column.buffers()[1]).view(np.int32)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int32)
    data = np.frombuffer(column.buffers()[2], np.uint8) if n and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[begin[0] : begin[-1]].reshape(n, -1 if begin[-1] > begin[0] else 0)


def gathered(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
    held = list(batches)
    names = ("lead", "body", "o", "th", "p", "left", "right")
    if not sum(b.num_rows for b in held):
        return {}
    return {n: np.concatenate([byte_rows(b.column(n)) if n in ("lead", "body") else np.asarray(b.column(n)) for b in held if b.num_rows]) for n in names}


def sorted_around(batches: Iterator[pa.RecordBatch], length: int, back: int, block: int = 16_384) -> Iterator[pa.RecordBatch]:
    """Spans of the windows around anchors that a smaller id has too; all rows of a gram are in one partition, a block of grams is sorted at a time."""
    x = gathered(batches)
    if not x:
        return
    order, new = multikey(words(x["lead"]), np.zeros(len(x["o"]), np.int64))
    begins = np.flatnonzero(new)
    gram = np.cumsum(new)
    at = 0
    while at < len(order):
        to = len(order) if at + block >= len(order) else int(begins[np.searchsorted(begins, at + block, "left")]) if begins[-1] >= at + block else len(order)
        rows, grams = order[at:to], gram[at:to]
        at = to
        o = x["o"][rows]
        shift = np.arange(back + 1)  # a window begins so many bytes before the gram
        which, b = np.nonzero((shift <= x["left"][rows][:, None]) & (back - shift <= x["right"][rows][:, None]))
        # the bytes of a window but those of the gram, which all rows of the gram have
        others = np.lib.stride_tricks.sliding_window_view(x["body"][rows], back, axis=1)[which, back - b] if back else np.zeros((len(which), 0), np.uint8)
        by, runs = multikey(words(others), grams[which] * (back + 1) + b)
        own = o[which][by]
        again = by[own > run_minima(runs, own)]
        r, begin = rows[which[again]], x["p"][rows[which[again]]] - b[again]
        yield found_batch(*merged(x["o"][r], x["th"][r], begin, begin + length), RUN)


EDGES = pa.schema([*FOUND, ("least", pa.int64()), ("part", pa.int32()), ("first", pa.binary()), ("last", pa.binary()), ("first_least", pa.int64()), ("last_least", pa.int64())])


def sorted_alone(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans of suffixes that a smaller id has too, those of the partition's first run with the run's least id whether or not it is smaller, and
    a row that tells the partition's first and last string with their least ids."""
    x, part = gathered(batches), TaskContext.get().partitionId()
    if not x:
        return
    by_id = np.argsort(x["o"], kind="stable")
    order, new = multikey(words(x["lead"][by_id]), np.zeros(len(by_id), np.int64))
    order = by_id[order]
    o = x["o"][order]
    least = run_minima(new, o)
    first = np.cumsum(new) == 1
    rows = first | (o > least)
    n = int(rows.sum())
    spans, nothing = order[rows], pa.nulls(n)
    batch = found_batch(x["o"][spans], x["th"][spans], x["p"][spans], x["p"][spans] + length, RUN)
    parts = pa.array(np.where(first[rows], part, -1).astype(np.int32))
    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least[rows]), parts, *(nothing.cast(f.type) for f in list(EDGES)[7:])], schema=EDGES)
    ends = {"part": part, "first": x["lead"][order[0]].tobytes(), "last": x["lead"][order[-1]].tobytes(), "first_least": int(least[0]), "last_least": int(least[-1])}
    yield pa.RecordBatch.from_pylist([ends], EDGES)


ORACLE = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS o, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS MATERIALIZED (SELECT rid, o, p, md5(substr(x, 2 * p + 1, 100)) AS s FROM (SELECT rid, o, x, unnest(range(greatest(0, length(x) // 2 - 49))) AS p FROM d)),
f AS (SELECT s, min(o) AS least FROM g GROUP BY s HAVING min(o) < max(o)),
w AS (SELECT rid, p FROM g JOIN f USING (s) WHERE o > least),
m AS (SELECT rid, p, CASE WHEN p <= lag(p) OVER (PARTITION BY rid ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM w),
r AS (SELECT rid, run, min(p) AS b, max(p) + 50 AS e FROM (SELECT rid, p, sum(fresh) OVER (PARTITION BY rid ORDER BY p) AS run FROM m) GROUP BY rid, run),
k AS (SELECT r.rid, sum(e - b) AS gone, count(*) AS n, max(e) AS tail, string_agg(substr(d.x, 2 * prev + 1, 2 * (b - prev)), '' ORDER BY b) AS head
  FROM (SELECT *, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY b), 0) AS prev FROM r) r JOIN d USING (rid) GROUP BY r.rid)
SELECT d.doc_id, CAST(length(d.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(d.x, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""
