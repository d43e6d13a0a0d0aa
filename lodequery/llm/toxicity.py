"""Toxicity scores from a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words is the normalised inner product of their gap-weighted character triples: each
triple of characters (word edges included) within `span` places counts decay ** (places skipped). Letters inserted into a
word or left out therefore cost weight but not the match; case, marks and digits that stand for letters
are folded first, and single letters written apart are read as one word. The product is raised to `power`,
still a kernel, so that words sharing one syllable stay far apart. A sentence's kernel with a
landmark is the largest of its words; kernels under `floor` count as 0.

Landmarks are the words that set toxic training documents most apart, and frequent words as contrast.
The machine is linear on the Nyström features, trained (squared hinge) on labelled sentences: a toxic
document stands for its highest sentence, chosen anew each round, and for those with a word very near
a toxic landmark; others stand for their five highest. A
document's score is a fitted sigmoid of the margins of its three highest sentences.

Training reads at most `most_train` labelled documents (the first by a hash of their id); scoring reads
all texts whole, one batch of words at a time.

Cases: null and empty texts score as a sentence without known words; null labels are skipped; without
toxic and other training rows every score is 0; repeated rows are scored each; null doc_id is kept;
extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodequery.llm.common import Words, fold, labelled_sample, text_batches

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
#: digits and marks read as letters inside words
LIKE_LETTERS = str.maketrans("0134570@$!", "oieasto" + "asi")
_LETTERS = re.compile(r"[^\W\d_]+")


def folded(word: str) -> str:
    """The letters of a word in lower case; digits and marks between letters read as the letters they resemble."""
    word = word.lower()
    if word.isalpha():
        return word
    if found := re.search(r"[^\W\d_].*[^\W\d_]", word):
        word = found[0]
        if not word.isalpha():
            word = word.translate(LIKE_LETTERS)
    return "".join(_LETTERS.findall(word))


def triples(words: list[str], span: int, decay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word's index, triple, weight) by word and triple, each once; 32 letter classes make 32,768 triples.

    A mark stands before and after each word, so that a whole word is told from a part of one.
    """
    words = [f"~{x}~" if x else "" for x in words]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    letters = np.where((letters >= 97) & (letters < 123), letters - 97, np.where(letters == 126, 31, 26 + letters % 5))
    keys, weights = [], []
    for b in range(2, span):
        n = len(letters) - b
        if n <= 0:
            break
        inside = np.flatnonzero(owner[:n] == owner[b:])
        for a in range(1, b):
            code = letters[inside] << 10 | letters[inside + a] << 5 | letters[inside + b]
            keys.append(owner[inside] << 15 | code)
            weights.append(np.full(len(inside), decay ** (b - 2)))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key >> 15, key & 32767, np.bincount(at, np.concatenate(weights), len(key))


@dataclass
class Kernel:
    """Kernels of words with the landmarks, from lists of the landmarks that have a triple.

    owners, values: landmarks and their weights by triple; starts: where each triple's begin.
    """

    landmarks: list[str]
    span: int = 5
    decay: float = 0.6
    floor: float = 0.4
    power: int = 3
    owners: np.ndarray = field(init=False, repr=False)
    values: np.ndarray = field(init=False, repr=False)
    starts: np.ndarray = field(init=False, repr=False)
    largest: np.ndarray = field(init=False, repr=False)

    def __post_init__(self):
        owner, code, weight = triples(self.landmarks, self.span, self.decay)
        norm = np.sqrt(np.maximum(np.bincount(owner, weight**2, len(self.landmarks)), 1e-9))
        order = np.argsort(code, kind="stable")
        self.owners, self.values = owner[order], (weight / norm[owner])[order]
        self.starts = np.searchsorted(code[order], np.arange(32769))
        self.largest = np.zeros(32768)
        np.maximum.at(self.largest, code[order], self.values)

    def of(self, words: list[str], step: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
        """Which words have a kernel of `floor` or more with a landmark, and their kernels, lower ones as 0."""
        which, rows = [], []
        for begin in range(0, len(words), step):
            part = words[begin : begin + step]
            owner, code, weight = triples(part, self.span, self.decay)
            norm = np.sqrt(np.bincount(owner, weight**2, len(part)))
            hit = self.largest[code] > 0
            owner, code, weight = owner[hit], code[hit], weight[hit]
            some, starts = np.unique(owner, return_index=True)
            if not len(some):
                continue
            # no landmark can give more than the largest weight that any has for each triple
            enough = np.add.reduceat(weight * self.largest[code], starts) >= self.floor * norm[some] * 0.999
            keep = np.repeat(enough, np.diff(np.append(starts, len(owner))))
            owner, code, weight = owner[keep], code[keep], weight[keep]
            some, at = np.unique(owner, return_inverse=True)
            if not len(some):
                continue
            many = self.starts[code + 1] - self.starts[code]
            each = np.repeat(np.arange(len(code)), many)
            place = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many) + self.starts[code][each]
            n = len(self.landmarks)
            k = np.bincount(at[each] * n + self.owners[place], weight[each] * self.values[place], len(some) * n).reshape(-1, n) / norm[some, None]
            k = k.astype(np.float32)
            k[k < self.floor] = 0
            k **= self.power
            full = k.any(axis=1)
            which.append(begin + some[full])
            rows.append(k[full])
        if not rows:
            return np.zeros(0, np.int64), np.zeros((0, len(self.landmarks)))
        return np.concatenate(which), np.concatenate(rows)


def sentences(texts: pa.Array, kernel: Kernel) -> tuple[np.ndarray, np.ndarray]:
    """Of all sentences with a word near a landmark: the text's index and the kernels with the landmarks."""
    w = Words(texts)
    plain = [folded(x) for x in w.types]
    ends = np.fromiter((x[-1] in ".!?" for x in w.types), bool, len(w.types))
    which, rows = kernel.of(plain)
    row_of = np.full(len(plain) + 1, -1)
    row_of[which] = np.arange(len(which))
    text_of = np.repeat(np.arange(len(texts)), np.diff(w.starts))
    sentence = np.concatenate([[0], np.cumsum(ends[w.codes])[:-1]]) + text_of if len(w.codes) else np.zeros(0, np.int64)
    near = row_of[w.codes]
    at = np.flatnonzero(near >= 0)
    near, places = near[at], at
    single = np.fromiter((len(x) == 1 for x in plain), bool, len(plain))[w.codes] if len(w.codes) else np.zeros(0, bool)
    if single.any():  # letters written apart
        joins = single[1:] & single[:-1] & (text_of[1:] == text_of[:-1])  # with the word before, in the same text
        begins, ends_at = np.flatnonzero(single & ~np.append(False, joins)), np.flatnonzero(single & ~np.append(joins, False)) + 1
        runs = [(a, b) for a, b in zip(begins, ends_at, strict=True) if b - a >= 4]
        if runs:
            spelled, extra = kernel.of(["".join(plain[c] for c in w.codes[a:b]) for a, b in runs])
            near = np.concatenate([near, len(rows) + np.arange(len(spelled))])
            places = np.concatenate([places, np.array([runs[i][0] for i in spelled], np.int64)])
            rows = np.concatenate([rows, extra])
    if not len(places):
        return np.zeros(0, np.int64), np.zeros((0, rows.shape[1]))
    order = np.argsort(sentence[places], kind="stable")
    near, places = near[order], places[order]
    _, starts = np.unique(sentence[places], return_index=True)
    return text_of[places[starts]], np.maximum.reduceat(rows[near], starts)


def highest(of: np.ndarray, margins: np.ndarray, n: int, none: float, most: int = 3) -> np.ndarray:
    """The `most` highest sentence margins of each of n texts, `none` where a text has fewer."""
    out = np.full((n, most), none)
    order = np.lexsort((-margins, of))
    of, margins = of[order], np.maximum(margins[order], none)
    place = np.arange(len(of)) - np.searchsorted(of, of)
    out[of[place < most], place[place < most]] = margins[place < most]
    return out


@dataclass
class Model:
    kernel: Kernel | None = None
    weights: np.ndarray | None = None
    bias: float = 0.0
    sigmoid: np.ndarray | None = None

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.kernel is None:
            return np.zeros(len(texts))
        of, k = sentences(texts, self.kernel)
        top = highest(of, k @ self.weights + self.bias, len(texts), self.bias)
        return 1 / (1 + np.exp(-(top @ self.sigmoid[:-1] + self.sigmoid[-1])))


def margin_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, keep: float = 1e-5, steps: int = 30) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge, by Newton steps on the rows inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))])
    part = weight / weight.sum()
    w, active = np.zeros(x.shape[1]), np.ones(len(x), bool)
    for _ in range(steps):
        a = x[active] * part[active, None]
        w = np.linalg.solve(a.T @ x[active] + keep * np.eye(len(w)), a.T @ y[active])
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w


def sigmoid_fit(f: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes (not under 0) and shift of the probability of label 1 given margins, by Newton steps on smoothed targets."""
    pos = y.sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (len(y) - pos + 2))
    used = list(range(f.shape[1]))
    while True:
        x = np.hstack([f[:, used], np.ones((len(f), 1))])
        w = np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (p - target) + 1e-2 * w
            w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), grad)
        if not used or w[:-1].min() >= 0:
            break
        used.pop(int(np.argmin(w[:-1])))
    out = np.zeros(f.shape[1] + 1)
    out[[*used, f.shape[1]]] = w
    return out


def log_likelihood_gain(a: int, b: int, n: int, m: int) -> float:
    """Log likelihood ratio of a word in a of n toxic and b of m other documents having two rates, over its having one."""
    part = lambda x, total, rate: (x * np.log(rate) if x else 0) + ((total - x) * np.log(1 - rate) if total > x else 0)
    return part(a, n, a / n) + part(b, m, b / m) - part(a + b, n + m, (a + b) / (n + m))


def train(sample: list[tuple[str, int]], toxic_marks: int = 96, contrast: int = 32, least_gain: float = 10.0, most_sentences: int = 8, rounds: int = 4, seed: int = 3) -> Model:
    """The machine from labelled texts.

    least_gain: of a toxic landmark's log likelihood ratio, so that chance words stay out; most_sentences:
    so many of a document, those nearest to toxic landmarks, take part in training.
    """
    y = np.array([v for _, v in sample], int)
    if len(set(y.tolist())) < 2:
        return Model()
    counts = [Counter(), Counter()]
    for label in (1, 0):  # words of toxic documents alone; others can be no landmark
        for text, own in sample:
            if own == label:
                found = {p for x in set(text.split()) if len(p := folded(x)) >= 4}
                counts[label].update(found if label else found & counts[1].keys())
    n = np.bincount(y, minlength=2)
    gain = {w: log_likelihood_gain(a, counts[0][w], n[1], n[0]) for w, a in counts[1].items() if a >= 3 and a * n[0] > counts[0][w] * n[1]}
    apart = [w for w in sorted(gain, key=lambda w: (-gain[w], w)) if gain[w] >= least_gain][:toxic_marks]
    if not apart:
        return Model()
    common = [w for w, _ in counts[0].most_common(20 * contrast) if w not in apart][:: 20][:contrast]
    kernel = Kernel(apart + common)
    rng = np.random.default_rng(seed)

    def varied(word: str) -> str:
        at = rng.integers(1, len(word))
        return word[:at] + chr(97 + rng.integers(26)) + word[at:]

    parts = []
    for i in range(0, len(sample), 500):  # of each document its sentences nearest to toxic landmarks
        of, k = sentences(pa.array([t for t, _ in sample[i : i + 500]]), kernel)
        near = k[:, : len(apart)].max(axis=1) if len(k) else np.zeros(0)
        order = np.lexsort((-near, of))
        order = order[np.arange(len(of)) - np.searchsorted(of[order], of[order]) < most_sentences]
        parts.append((of[order] + i, k[order]))
    of, k = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
    gram = sentences(pa.array(kernel.landmarks), kernel)[1]
    values, axes = np.linalg.eigh((gram + gram.T) / 2)
    held = values > 1e-3
    nystrom = axes[:, held] / np.sqrt(values[held])
    z = k @ nystrom
    more_words = [varied(w) for w in apart for _ in range(3)] + [varied(w) for w in common for _ in range(3)]
    more_of, more_k = sentences(pa.array(more_words), kernel)
    more_z, more_y = more_k @ nystrom, np.where(more_of < 3 * len(apart), 1, -1)
    current = k[:, : len(apart)].max(axis=1) if len(k) else np.zeros(0)
    close = current >= 0.8
    for _ in range(rounds):
        order = np.lexsort((-current, of))
        place = np.arange(len(of)) - np.searchsorted(of[order], of[order])
        positive = order[((place == 0) | close[order]) & (y[of[order]] == 1)]
        negative = order[(place < 5) & (y[of[order]] == 0)]
        x = np.concatenate([z[positive], more_z, z[negative], np.zeros((1, z.shape[1]))])
        sign = np.concatenate([np.ones(len(positive)), more_y, -np.ones(len(negative) + 1)])
        weight = np.concatenate([np.full(len(positive), 1 / max(len(positive), 1)), np.full(len(more_z), 0.3 / max(len(more_z), 1)), np.full(len(negative), 1 / max(len(negative), 1)), [0.3]])
        w = margin_machine(x, sign, weight)
        current = z @ w[:-1] + w[-1]
    model = Model(kernel, nystrom @ w[:-1], float(w[-1]))
    model.sigmoid = sigmoid_fit(highest(of, current, len(y), model.bias), y)
    return model


def score(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, threshold: float = 0.7, most_train: int = 6000, **options) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) of each document; learns from labelled ids not held out."""
    held_out = fold(F.col("doc_id"), 3) == 1 if held_out is None else held_out
    sample = labelled_sample(docs, labels, "toxic", ~held_out, most_train)
    model = docs.sparkSession.sparkContext.broadcast(train(sample, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in text_batches(iter([big])):
                p = model.value.scores(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text").mapInArrow(run, SCHEMA)
