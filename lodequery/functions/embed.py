"""Embeddings without a model: hashed character n-grams, and means of given word vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Length of hashed vectors, sizes of n-grams, length of word vectors.
DIM, SIZES, WORD_DIM = 512, (3, 4, 5), 300


def ngrams(text: Column) -> Column:
    """Character n-grams of each white-space separated word in lower case with a space at both ends, repeats kept."""
    padded = F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    of = lambda w, n: F.when(F.length(w) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substring(w, i, F.lit(n))))
    return F.flatten(F.transform(padded, lambda w: F.concat(*(of(w, n) for n in SIZES))))


def place(gram: str) -> tuple[int, float]:
    """The dimension of an n-gram and its sign, which hangs on the same hash: below DIM / 2 it is always negative."""
    h = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "big")
    return h % DIM, 1.0 if h >> 8 & 1 else -1.0


def word_vector(word: str) -> np.ndarray:
    """Sum of the signed n-grams of one word."""
    out, padded = np.zeros(DIM), f" {word} "
    for n in SIZES:
        for i in range(len(padded) - n + 1):
            at, sign = place(padded[i : i + n])
            out[at] += sign
    return out


def codes(word: str) -> np.ndarray:
    """The n-grams of one word, each as twice its dimension and 1 where its sign is positive."""
    padded = f" {word} "
    places = (place(padded[i : i + n]) for n in SIZES for i in range(len(padded) - n + 1))
    return np.array([2 * at + (sign > 0) for at, sign in places], np.int16)


def hashed(rows: DataFrame, text: str = "text", vector: str = "vector", most: int = 200_000) -> DataFrame:
    """Rows with the unit vector of their text's hashed n-grams; a text without words has zeros. The places of words' n-grams are kept, of `most` words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        for b in batches:
            out = []
            for t in b.column(text).to_pylist():
                found = []
                for w in (t or "").lower().split():
                    if (own := known.get(w)) is None:
                        if len(known) >= most:
                            known.clear()
                        own = known[w] = codes(w)
                    found.append(own)
                seen = np.bincount(np.concatenate(found), minlength=2 * DIM) if found else np.zeros(2 * DIM)
                total = (seen[1::2] - seen[::2]).astype(np.float64)
                norm = np.sqrt((total**2).sum())
                out.append(total / norm if norm else total)
            flat = pa.array(np.concatenate(out) if out else np.zeros(0))
            column = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * DIM, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*b.columns, column], [*b.schema.names, vector])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{vector}` array<double>")


def plain_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, case kept."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[^0-9a-zA-Z]+"), lambda x: x != "")


def humps(token: Column) -> Column:
    """The words of a camelCase token in lower case."""
    return F.transform(F.regexp_extract_all(token, F.lit("([A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+)"), F.lit(1)), F.lower)


def word_vectors(spark: SparkSession, path: str, dim: int = WORD_DIM) -> DataFrame:
    """word and vector of a text file of `word v1 ... vn` lines; a line of another length is an error."""
    parts = F.split("value", " ")
    vector = F.when(F.size(parts) == dim + 1, F.transform(F.slice(parts, 2, dim), lambda x: x.cast("double"))).otherwise(F.raise_error(F.lit("unexpected line in the word vectors")).cast("array<double>"))
    return spark.read.text(path).select(parts[0].alias("word"), vector.alias("vector"))


def vectors_of(rows: DataFrame, vocabulary: DataFrame, id_: str, text: str = "text") -> DataFrame:
    """id, place and vector of each token that the vocabulary (word, vector) has; of others those of their humps it has."""
    tokens = rows.select(F.col(id_).alias("id"), F.posexplode(plain_tokens(F.col(text))).alias("place", "token"))
    found = tokens.withColumn("word", F.lower("token")).join(vocabulary, "word", "left")
    again = found.where("vector is null").select("id", "place", F.explode(humps(F.col("token"))).alias("word")).join(vocabulary, "word")
    return found.where("vector is not null").select("id", "place", "vector").unionByName(again.select("id", "place", "vector"))


def word_means(rows: DataFrame, vocabulary: DataFrame, id_: str, text: str = "text", dim: int = WORD_DIM) -> DataFrame:
    """id and the unit vector of the mean of its tokens' vectors; zeros where there is none."""
    each = vectors_of(rows, vocabulary, id_, text).select("id", F.posexplode("vector").alias("i", "x"))
    mean = each.groupBy("id", "i").agg(F.avg("x").alias("x")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    v = F.transform("v", lambda p: p["x"])
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    unit = mean.select("id", F.when(norm > 0, F.transform(v, lambda x: x / norm)).alias("vector"))
    return rows.select(F.col(id_).alias("id")).join(unit, "id", "left").select("id", F.coalesce("vector", F.array_repeat(F.lit(0.0), dim)).alias("vector"))
