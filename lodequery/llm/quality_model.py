"""Quality classifier of supervised subword embeddings.

A document is the average of learned vectors of its words' hashed features: the word, its character
n-grams, the hashed pair of neighbouring words and a mark for a word that repeats its neighbour. A
softmax over two labels follows. Vectors and softmax are trained by numpy stochastic gradient descent
on at most `most_train` labelled documents (the first by a hash of their id).

Since averaging and the last layer are linear, each hashed feature comes down to one number when the
model is applied, and tasks only add those up, for all distinct words of a batch at once.

Cases: null and empty texts get the score of the bias alone; null labels are skipped; with no labels of
both kinds every score is 0.5; repeated rows are scored each; null doc_id is kept; extra columns are
ignored; empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodequery.llm.common import Words, fold, labelled_sample, text_batches

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_features(types: list[str], bits: int, grams: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of words: (word's index, feature) pairs, and a 64-bit hash of each word.

    Features are the word itself and the byte n-grams of "<word>".
    """
    marked = [f"<{x}>".encode() for x in types]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(marked)), sizes)
    words = np.fromiter((zlib.crc32(x) for x in marked), np.uint64, len(marked)) * _MIX
    owners, codes = [np.arange(len(marked))], [words >> np.uint64(64 - bits)]
    for n in grams:
        if len(data) >= n:
            rolling = np.zeros(len(data) - n + 1, np.uint64)
            for i in range(n):
                rolling = rolling * np.uint64(257) + data[i : len(data) - n + 1 + i]
            inside = np.arange(len(rolling)) + n <= starts[owner[: len(rolling)] + 1]
            owners.append(owner[: len(rolling)][inside])
            codes.append(((rolling[inside] + np.uint64(n << 50)) * _MIX) >> np.uint64(64 - bits))
    return np.concatenate(owners), np.concatenate(codes).astype(np.int64), words


def pair_codes(words: np.ndarray, codes: np.ndarray, starts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashed pair of each word and the one before it in its text, and which words have one. Equal pairs are one feature."""
    has = np.ones(len(codes), bool)
    has[starts[:-1][starts[:-1] < len(codes)]] = False
    left = np.concatenate([[0], codes[:-1]]) if len(codes) else codes
    mixed = ((words[left] * np.uint64(31) + words[codes]) * _MIX) >> np.uint64(64 - bits)
    mixed[left == codes] = 0
    return mixed.astype(np.int64), has


@dataclass
class Model:
    weights: np.ndarray  # of each hashed feature: its vector's part in log odds of label 1
    bias: float
    bits: int
    grams: tuple[int, ...]

    def scores(self, texts: pa.Array) -> np.ndarray:
        w = Words(texts)
        owner, feature, words = word_features(w.types, self.bits, self.grams)
        sums = np.bincount(owner, self.weights[feature], len(w.types))
        many = np.bincount(owner, minlength=len(w.types))
        pairs, has = pair_codes(words, w.codes, w.starts, self.bits)
        value = w.per_text(sums[w.codes] + has * self.weights[pairs]) if len(w.codes) else np.zeros(len(texts))
        count = w.per_text(many[w.codes] + has) if len(w.codes) else np.zeros(len(texts))
        return 1 / (1 + np.exp(-(value / np.maximum(count, 1) + self.bias)))


def train(sample: list[tuple[str, int]], bits: int = 18, grams: tuple[int, ...] = (3, 4), dim: int = 8, epochs: int = 12, rate: float = 25.0, seed: int = 7) -> Model:
    """Vectors and softmax by stochastic gradient descent, one document a step, with a falling rate."""
    rng = np.random.default_rng(seed)
    labels = np.array([y for _, y in sample], int)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(1 << bits), 0.0, bits, grams)
    documents = []
    for text, _ in sample:
        w = Words(pa.array([text]))
        owner, feature, words = word_features(w.types, bits, grams)
        times = np.bincount(w.codes, minlength=len(w.types))
        pairs, has = pair_codes(words, w.codes, w.starts, bits)
        ids = np.concatenate([feature, pairs[has]])
        part = np.concatenate([times[owner], np.ones(int(has.sum()), int)]).astype(float)
        ids, at = np.unique(ids, return_inverse=True)
        documents.append((ids, np.bincount(at, part) / max(part.sum(), 1)))
    vectors = rng.normal(0, 0.1, (1 << bits, dim))
    last, bias = rng.normal(0, 0.1, (dim, 2)), np.zeros(2)
    steps, done = epochs * len(documents), 0
    for _ in range(epochs):
        for i in rng.permutation(len(documents)):
            ids, part = documents[i]
            now = 1 - done / steps
            done += 1
            held = part @ vectors[ids]
            out = held @ last + bias
            p = np.exp(out - out.max())
            p /= p.sum()
            p[labels[i]] -= 1
            vectors[ids] -= (rate * now) * np.outer(part, last @ p)
            last -= 0.1 * now * np.outer(held, p)
            bias -= 0.05 * now * p
    return Model(vectors @ (last[:, 1] - last[:, 0]), float(bias[1] - bias[0]), bits, grams)


def learned(docs: DataFrame, labels: DataFrame, held_out: Column, most_train: int, options: dict):
    """The model trained on labelled ids not held out, sent to the executors."""
    sample = labelled_sample(docs, labels, "quality", ~held_out, most_train)
    return docs.sparkSession.sparkContext.broadcast(train(sample, **options))


def score(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, threshold: float = 0.3, most_train: int = 3000, **options) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) of each document; learns from labelled ids not held out."""
    held_out = fold(F.col("doc_id"), 5) == 0 if held_out is None else held_out
    model = learned(docs, labels, held_out, most_train, options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in text_batches(iter([big])):
                p = model.value.scores(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text").mapInArrow(run, SCHEMA)


def kept(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, threshold: float = 0.3, most_train: int = 3000, **options) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold."""
    held_out = fold(F.col("doc_id"), 5) == 0 if held_out is None else held_out
    model = learned(docs, labels, held_out, most_train, options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in text_batches(iter([big])):
                yield b.filter(pa.array(model.value.scores(b.column("text")) >= threshold))

    return docs.mapInArrow(run, docs.schema)
