"""Codes of vectors: each is cut into parts, and each part is named by the nearest entry of its position's codebook.

Codebooks start as parts of given rows and are moved to the means of their parts in rounds. Parts are assigned by exponion
search: from the entry of the round before (entry 0 in the first round), at squared distance r2, only entries within twice
that distance of it can be as near, since d(entry, other) <= d(entry, part) + d(part, other). Every entry's
neighbours are kept sorted by distance, so a part scans a prefix of its entry's list. All is in integers: the
radius is tested as squared distance <= 4 * r2, and equal distances go to the lower index.

Rows with their codes are written after each round, so that the next one starts from them; sums and counts by
entry are made in the tasks and added up; the codebooks, of `entries` vectors, are what reaches the driver.

Cases: rows whose vector is null or holds null or non-finite components are dropped; rows without id are kept and come last
where the first codebooks are chosen; rows that repeat an id are coded each, and are ordered by vector there; with fewer rows than
entries a codebook has as many entries as rows; vectors of several lengths are coded apart, each length with codebooks of its
own; a length that the number of parts doesn't divide is cut at floor(length * part / parts); null labels are one label; integers
are held within a long, and an error that doesn't fit in one is null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodequery.llm.common import deleted, matrices, stored, whole


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x and y."""
    return ((x - y) ** 2).sum(axis=1)


class Book:
    """The entries of one codebook, each with the others sorted by distance from it, then by index."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.most = max(int(entries.max()), -int(entries.min())) if entries.size else 0
        wide = self.as_kind(entries, self.most)
        apart = ((wide[:, None, :] - wide[None, :, :]) ** 2).sum(axis=2)
        order = np.argsort(apart, axis=1, kind="stable")
        n = len(entries)
        self.others = order[order != np.arange(n)[:, None]].reshape(n, n - 1)
        self.far = np.take_along_axis(apart, self.others, axis=1)

    @staticmethod
    def as_kind(x: np.ndarray, most: int) -> np.ndarray:
        """x as longs where no squared distance between numbers up to `most` can pass a long, else as Python's integers."""
        return x.astype(np.int64 if (2 * most) ** 2 * 4 * max(1, x.shape[1]) < 2**63 else object)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the nearest entry for each row of x, ties to the lower, and the squared distance to it; start: where each row begins."""
        most = max(self.most, int(x.max()), -int(x.min())) if x.size else 0
        x, entries = self.as_kind(x, most), self.as_kind(self.entries, most)
        code, best = start.copy(), distances(x, entries[start])
        scanned = (self.far[start] <= 4 * best[:, None]).sum(axis=1)
        order = np.argsort(-scanned, kind="stable")
        ends = np.searchsorted(-scanned[order], -np.arange(len(entries)), "left")  # how many rows scan more than 0, 1, 2... neighbours
        for place in range(int(scanned.max(initial=0))):
            rows = order[: ends[place]]
            other = self.others[start[rows], place]
            d = distances(x[rows], entries[other])
            better = (d < best[rows]) | ((d == best[rows]) & (other < code[rows]))
            rows = rows[better]
            best[rows], code[rows] = d[better], other[better]
        return code, best


def cuts(d: int, parts: int) -> list[slice]:
    return [slice(d * i // parts, d * (i + 1) // parts) for i in range(parts)]


def code(table: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, factor: int = 256, label: str = "label", most_labels: int = 100_000, salts: int = 32) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row that is kept; parts and entries are at most 256.

    Totals by label are broadcast up to `most_labels` labels; beyond that they are joined by a shuffle, with rows dealt over `salts`.
    """
    spark = table.sparkSession
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label).alias("label"), F.col("embedding").cast("array<double>").alias("e")).where(whole(F.col("e")))
    rows = rows.select("vec_id", "label", F.transform("e", lambda c: F.floor(c * factor).cast("long")).alias("x"))
    first = Window.partitionBy(F.size("x")).orderBy(F.asc_nulls_last("vec_id"), "x")
    books: dict[int, list[np.ndarray]] = {}
    start: dict[int, list] = {}
    for r in rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= entries).orderBy("place").select("x").collect():  # `entries` rows a length
        start.setdefault(len(r["x"]), []).append(r["x"])
    for d, own in start.items():
        books[d] = [np.array(own, np.int64).reshape(len(own), d)[:, s] for s in cuts(d, parts)]

    def assigned(coded: DataFrame, books: dict[int, list[np.ndarray]]) -> DataFrame:
        """coded with the codes (bytes in part order) and errors by the given codebooks, stored."""
        held = spark.sparkContext.broadcast(books)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sorted_books = {d: [Book(p) for p in own] for d, own in held.value.items()}
            for b in batches:
                codes, errors = np.zeros((b.num_rows, parts), np.uint8), np.zeros(b.num_rows, object)
                if known := b.schema.names.count("code"):
                    before = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
                for at, x in matrices(b):
                    for i, s in enumerate(cuts(x.shape[1], parts)):
                        own, error = sorted_books[x.shape[1]][i].nearest(x[:, s], before[at, i] if known else np.zeros(len(at), np.int64))
                        codes[at, i] = own
                        errors[at] += error
                found = [pa.array([row.tobytes() for row in codes], pa.binary()), pa.array([int(e) if e < 2**63 else None for e in errors], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("vec_id", "label", "x")), *found], ["vec_id", "label", "x", "code", "error"])

        schema = coded.select("vec_id", "label", "x").schema.add("code", "binary").add("error", "long")
        return stored(coded.drop("error").mapInArrow(run, schema), "codes")

    def moved(coded: DataFrame, books: dict[int, list[np.ndarray]]) -> dict[int, list[np.ndarray]]:
        """The codebooks with each entry that is used at the floor of the mean of its parts."""

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[tuple[int, int, int], list] = {}
            for b in batches:
                codes = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(-1, parts)
                for at, x in matrices(b):
                    for i, s in enumerate(cuts(x.shape[1], parts)):
                        order = np.argsort(codes[at, i], kind="stable")
                        own = codes[at[order], i]
                        begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                        mine = x[order][:, s]
                        # the halves are summed apart, so that no sum passes a long
                        total = np.add.reduceat(mine >> 31, begin, axis=0).astype(object) * 2**31 + np.add.reduceat(mine & (2**31 - 1), begin, axis=0).astype(object)
                        for entry, n, row in zip(own[begin].tolist(), np.diff([*begin, len(own)]).tolist(), total, strict=True):
                            held = found.setdefault((x.shape[1], i, entry), [0, 0])
                            held[0], held[1] = held[0] + n, held[1] + row
            out = [{"d": d, "part": i, "entry": e, "at": j, "n": n, "total": Decimal(int(v))} for (d, i, e), (n, row) in found.items() for j, v in enumerate(row)]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("d", pa.int32()), ("part", pa.int32()), ("entry", pa.int32()), ("at", pa.int32()), ("n", pa.int64()), ("total", pa.decimal128(38, 0))]))

        sums = coded.select("x", "code").mapInArrow(partial, "d int, part int, entry int, at int, n long, total decimal(38,0)").groupBy("d", "part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        out = {d: [p.copy() for p in own] for d, own in books.items()}
        for r in sums.collect():  # a row for each number of the codebooks
            out[r["d"]][r["part"]][r["entry"], r["at"]] = int(r["total"]) // r["n"]
        return out

    coded = rows
    for turn in range(rounds + 1):
        before, coded = coded, assigned(coded, books)
        if turn:
            deleted(before)
        if turn < rounds:
            books = moved(coded, books)
    hashes = [(d, hashlib.sha256(",".join(str(v) for p in own for v in p.ravel().tolist()).encode()).hexdigest()) for d, own in books.items()]
    by_length = F.broadcast(spark.createDataFrame(hashes, "d int, codebooks_sha256 string"))
    labels = coded.groupBy("label").agg(F.try_sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"), F.count("*").alias("rows"), F.count("error").alias("known"))
    labels = labels.select(F.col("label").alias("of"), F.when(F.col("rows") == F.col("known"), F.col("label_error")).alias("label_error"))
    if labels.count() <= most_labels:
        joined = coded.join(F.broadcast(labels), F.col("label").eqNullSafe(F.col("of")), "left")
    else:
        dealt = labels.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)).cast("int")).join(dealt, F.col("label").eqNullSafe(F.col("of")) & (F.col("_salt") == F.col("salt")), "left")
    return joined.join(by_length, F.size("x") == F.col("d")).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256")


def oracle(parts: int = 16, entries: int = 64, rounds: int = 2, factor: int = 256) -> str:
    """The same rows in SQL, for vectors of one length that the parts divide."""
    steps = [f"""
c0 AS (SELECT CAST(row_number() OVER (PARTITION BY part ORDER BY vec_id NULLS LAST, x) - 1 AS INTEGER) AS entry, part, p FROM (SELECT part, vec_id, x, p FROM pt WHERE rid IN (SELECT rid FROM kept ORDER BY vec_id NULLS LAST, x LIMIT {entries})))"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (SELECT rid, part, entry, d2 FROM (SELECT t.rid, t.part, c.entry, list_sum(list_transform(list_zip(t.p, c.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2 FROM pt t JOIN c{i} c USING (part)) QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY d2, entry) = 1)""")
        if i < rounds:
            steps.append(f"""
m{i} AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS p FROM (SELECT part, entry, j, sum(v) AS s, count(*) AS n FROM (SELECT a.part, a.entry, unnest(t.p) AS v, generate_subscripts(t.p, 1) AS j FROM a{i} a JOIN pt t USING (rid, part)) GROUP BY 1, 2, 3) GROUP BY 1, 2),
c{i + 1} AS MATERIALIZED (SELECT c.entry, c.part, coalesce(m.p, c.p) AS p FROM c{i} c LEFT JOIN m{i} m USING (part, entry))""")
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda c: CAST(floor({factor} * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
pt AS MATERIALIZED (SELECT rid, vec_id, x, part, x[part * (len(x) // {parts}) + 1 : (part + 1) * (len(x) // {parts})] AS p FROM kept, (SELECT unnest(range({parts})) AS part)),{",".join(steps)},
e AS (SELECT rid, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code, CAST(sum(d2) AS BIGINT) AS error FROM a{rounds} GROUP BY rid),
b AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, j)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(p) AS v, generate_subscripts(p, 1) AS j FROM c{rounds})),
l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM kept JOIN e USING (rid) GROUP BY label)
SELECT k.vec_id, e.code, e.error, l.label_error, b.codebooks_sha256 FROM kept k JOIN e USING (rid) JOIN l ON l.label IS NOT DISTINCT FROM k.label CROSS JOIN b
"""


ORACLE = oracle()
