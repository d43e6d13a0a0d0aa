"""Secret scans by a linear-chain conditional random field over words.

Each line is a sequence of words tagged B (a secret begins), I (goes on) or O. Features of a word are its
shape (length, mix of characters, entropy), its own folded form, the words before and after, and the
file: how long it is and whether it holds assignments. Viterbi gives the best tags. The field is trained
by stochastic gradient on its likelihood, over at most `most_train` documents (the first by a hash of
their id among those with a match of a strict pattern, and as many others) and over written-out variants
of them, in which secrets of other forms stand in other settings. Labels are the strict matches.

A path that leaves O anywhere can only win with a word whose gain over O is positive, taking the best
transitions into and out of its tag; lines without such a word are all O and need no Viterbi. Gains are
computed for all words of a batch at once.

Spans of three strict patterns are always reported; the field's further spans are added as `crf`.
Positions are code points.

Cases: null and empty texts have no spans; repeated rows are scanned each; null doc_id is kept; without
training matches only strict spans are found; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodequery.llm.common import Words, cut, text_batches

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long"
#: kind, pattern, least characters of the value
STRICT = (
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII), 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 32),
)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BITS, TAGS = 16, 3  # O, B, I
#: Marks around a word that are no part of a secret.
EDGES = "\"'`,;:.()[]{}<>!?"


def strict_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strict matches, in order. Shorter values consume their match and are dropped."""
    out = []
    for kind, (_, pattern, least) in enumerate(STRICT):
        for m in pattern.finditer(text):
            if len(m[m.lastindex or 0]) >= least:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def values_of(text: str) -> list[tuple[int, int]]:
    """Where the secrets themselves stand: the value of an assignment, all of other matches."""
    return [m.span(m.lastindex or 0) for _, pattern, least in STRICT for m in pattern.finditer(text) if len(m[m.lastindex or 0]) >= least]


def hashed(feature: str) -> int:
    return zlib.crc32(feature.encode()) & ((1 << BITS) - 1)


def folded(word: str) -> str:
    return re.sub(r"[0-9]+", "0", word.strip(EDGES).lower())[:24]


def word_features(word: str) -> tuple[list[int], list[int], list[int]]:
    """Hashed features of a word for itself, for the word after it and for the word before it."""
    core = word.strip(EDGES)
    if core.isalpha() and len(word) - len(core) <= 1 and len(core) < 20:  # an ordinary word
        short = f"plain{min(len(core), 12) // 4}{core.isupper()}"
        near = core.lower()[:16]
        return [hashed(short)], [hashed(f"prev:{near}")], [hashed(f"next:{near}")]
    n, counts = len(core), Counter(core)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0
    digits = sum(x.isdigit() for x in core)
    kinds = "".join(k for k, p in (("a", "[a-z]"), ("A", "[A-Z]"), ("0", "[0-9]"), ("/", r"[+/=_-]"), (".", r"[.@:|#*$%&]"), ("u", r"[^\x00-\x7f]")) if re.search(p, core))
    size = min(n // 4, 12)
    own = [
        f"kinds:{kinds}", f"size:{size}", f"entropy:{round(2 * entropy)}", f"kinds+size:{kinds}:{size}", f"digits:{10 * digits // max(n, 1)}",
        f"hex:{bool(re.fullmatch('[0-9a-fA-F]+', core))}:{size}", f"head:{core[:4]}" if n >= 16 else "head", f"turns:{min(len(re.findall('(?<=[a-z])[A-Z0-9]|(?<=[0-9])[A-Za-z]', core)), 8)}",
        f"quoted:{word[:1] in EDGES}{word[-1:] in EDGES}:{n >= 8}", f"set:{bool(re.search('[:=]', core[:-1]))}:{size}",
    ]
    near = folded(word)
    return [hashed(x) for x in own], [hashed(f"prev:{near}"), hashed(f"prev-mark:{word[-1:] in ':='}")], [hashed(f"next:{near}")]


def file_features(words: int, assignments: bool) -> list[int]:
    return [hashed(f"file-size:{int(math.log2(words + 1)) // 2}"), hashed(f"file-sets:{assignments}"), hashed("bias")]


@dataclass
class Field:
    """weights: by hashed feature and tag; moves: by tag and next tag; begin: by first tag."""

    weights: np.ndarray
    moves: np.ndarray
    begin: np.ndarray

    def marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of tags and of neighbouring tag pairs for emissions e, by forward and backward sums."""
        n = len(e)
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[0] = self.begin + e[0]
        for i in range(1, n):
            x = a[i - 1][:, None] + self.moves
            top = x.max(axis=0)
            a[i] = top + np.log(np.exp(x - top).sum(axis=0)) + e[i]
        for i in range(n - 2, -1, -1):
            x = self.moves + e[i + 1] + b[i + 1]
            top = x.max(axis=1)
            b[i] = top + np.log(np.exp(x - top[:, None]).sum(axis=1))
        top = a[-1].max()
        z = top + np.log(np.exp(a[-1] - top).sum())
        pairs = np.exp(np.clip(a[:-1, :, None] + self.moves + (e[1:] + b[1:])[:, None, :] - z, -50, 0))
        return np.exp(np.clip(a + b - z, -50, 0)), pairs

    def viterbi(self, e: np.ndarray) -> list[int]:
        best, back = self.begin + e[0], []
        for row in e[1:]:
            x = best[:, None] + self.moves
            back.append(x.argmax(axis=0))
            best = x.max(axis=0) + row
        tags = [int(best.argmax())]
        for step in reversed(back):
            tags.append(int(step[tags[-1]]))
        return tags[::-1]

    def step_gain(self) -> np.ndarray:
        """An upper bound, for B and I, of what a word's tag can gain by transitions over staying in O."""
        m = self.moves
        leave = max(m[1, 0], m[2, 0]) - m[0, 0]
        into = np.array([max(m[0, 1] - m[0, 0], self.begin[1] - self.begin[0], m[1, 1] - m[0, 0], m[2, 1] - m[0, 0]), max(m[1, 2], m[2, 2]) - m[0, 0]])
        return into + max(leave, 0)


def line_starts(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """For each word whether a line break stands before it, as indexes of the first words of lines."""
    return [i for i, (a, _) in enumerate(spans) if i == 0 or "\n" in text[spans[i - 1][1] : a]]


def emissions(field: Field, features: list[tuple], file: list[int]) -> np.ndarray:
    w = field.weights
    own = np.array([w[f[0]].sum(axis=0) for f in features])
    before = np.array([w[f[1]].sum(axis=0) for f in features])
    after = np.array([w[f[2]].sum(axis=0) for f in features])
    own[1:] += before[:-1]
    own[:-1] += after[1:]
    return own + w[file].sum(axis=0)


def train(texts: list[str], epochs: int = 4, rate: float = 0.15, keep: float = 1e-5, window: int = 12, seed: int = 5) -> Field:
    """The field from texts, labelled by their strict matches, and from variants with secrets of other forms."""
    rng = np.random.default_rng(seed)
    field = Field(np.zeros((1 << BITS, TAGS)), np.zeros((TAGS, TAGS)), np.zeros(TAGS))
    field.begin[2] = field.moves[0, 2] = -30.0  # I only goes on from B or I
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"]
    settings = ['{k} = "{v}"', "{k}: {v}", "{k}={v}", '"{k}": "{v}",', "export {K}={v}", "--{k} {v}", "Authorization: Bearer {v}", "{k} is {v}", "{v}"]
    names = ["client_secret", "access_key", "auth", "private_key", "pwd", "credential", "api_token", "key", "bearer", "secret"]
    heads = ["", "", "", "ghp_", "sk-", "xoxb-", "AKIA", "glpat-"]

    def variant() -> tuple[str, str]:
        letters = alphabets[rng.integers(len(alphabets))]
        value = heads[rng.integers(len(heads))] + "".join(letters[i] for i in rng.integers(len(letters), size=rng.integers(20, 48)))
        name = names[rng.integers(len(names))]
        return settings[rng.integers(len(settings))].format(k=name, K=name.upper(), v=value), value

    sequences = []
    for text in texts:
        made = []
        lines = [x for x in text.split("\n") if x.strip()]
        for _ in range(2):
            if lines:
                line = lines[rng.integers(len(lines))].split()
                setting, value = variant()
                at = int(rng.integers(0, len(line) + 1))
                made.append((" ".join([*line[max(0, at - window) : at], setting, *line[at : at + window]]), value))
        sources = [(text, values_of(text))] + [(t, [(t.index(v), t.index(v) + len(v))]) for t, v in made]
        for source, values in sources:
            spans = [m.span() for m in WORD.finditer(source)]
            tags = np.zeros(len(spans), int)
            last = -1
            for i, (a, b) in enumerate(spans):
                for j, (x, y) in enumerate(values):
                    if a < y and x < b:
                        tags[i] = 2 if last == j and i and tags[i - 1] else 1
                        last = j
            file = file_features(len(spans), bool(re.search("[=:]", source)))
            starts = [*line_starts(source, spans), len(spans)]
            for x, y in zip(starts[:-1], starts[1:], strict=True):
                places = np.flatnonzero(tags[x:y]) + x
                cuts = [(max(x, p - window), min(y, p + window)) for p in places[:4]] or ([(x, min(y, x + 2 * window))] if rng.random() < 0.5 else [])
                for a, b in cuts:
                    sequences.append(([word_features(source[s:e]) for s, e in spans[a:b]], tags[a:b], file))
    total = np.full_like(field.weights, 1e-6)
    for epoch in range(epochs):
        for k in rng.permutation(len(sequences)):
            features, tags, file = sequences[k]
            e = emissions(field, features, file)
            p, pairs = field.marginals(e)
            p[np.arange(len(tags)), tags] -= 1
            rows = [(i, f) for i, own in enumerate(features) for f in own[0]]
            rows += [(i + 1, f) for i, own in enumerate(features[:-1]) for f in own[1]]
            rows += [(i - 1, f) for i, own in enumerate(features) if i for f in own[2]]
            rows += [(i, f) for i in range(len(features)) for f in file]
            at, f = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
            f, where = np.unique(f, return_inverse=True)
            grad = np.zeros((len(f), TAGS))
            np.add.at(grad, where, p[at])
            total[f] += grad**2
            field.weights[f] -= rate * (grad / np.sqrt(total[f]) + keep * field.weights[f])
            move = pairs.sum(axis=0)
            np.subtract.at(move, (tags[:-1], tags[1:]), 1)
            move[0, 2] = 0
            field.moves -= 0.02 * rate * np.clip(move, -5, 5)
    return field


@dataclass
class Scanner:
    field: Field | None

    def added(self, texts: pa.Array) -> dict[int, list[tuple[int, int]]]:
        """The field's spans (start, end) by text; only texts that have any."""
        if self.field is None:
            return {}
        w, field = Words(texts), self.field
        if not len(w.codes):
            return {}
        made = [word_features(x) for x in w.types]
        own, before, after = (self.summed([f[i] for f in made]) for i in range(3))
        sizes = np.diff(w.starts)
        strings = texts.to_pylist()
        file = np.array([field.weights[file_features(int(n), bool(x and ("=" in x or ":" in x)))].sum(axis=0) for n, x in zip(sizes, strings, strict=True)])
        text_of = np.repeat(np.arange(len(sizes)), sizes)
        e = own[w.codes] + file[text_of]
        same = text_of[1:] == text_of[:-1]
        # a neighbour may stand on another line and not count: only its gains enter the bound
        gain = e[:, 1:] - e[:, :1] + field.step_gain()
        prev = (before[:, 1:] - before[:, :1])[w.codes[:-1]]
        follow = (after[:, 1:] - after[:, :1])[w.codes[1:]]
        gain[1:] += np.where(same[:, None], np.maximum(prev, 0), 0)
        gain[:-1] += np.where(same[:, None], np.maximum(follow, 0), 0)
        hot = np.flatnonzero((gain > 0).any(axis=1))
        out: dict[int, list[tuple[int, int]]] = {}
        for t in np.unique(text_of[hot]).tolist():
            text, base = strings[t], int(w.starts[t])
            spans = [m.span() for m in WORD.finditer(text)]
            starts = np.array([*line_starts(text, spans), len(spans)])
            mine = hot[(hot >= base) & (hot < base + len(spans))] - base
            for line in np.unique(np.searchsorted(starts, mine, side="right") - 1).tolist():
                x, y = int(starts[line]), int(starts[line + 1])
                codes = w.codes[base + x : base + y]
                em = own[codes] + file[t]
                em[1:] += before[codes[:-1]]
                em[:-1] += after[codes[1:]]
                tags = field.viterbi(em)
                for i, tag in enumerate(tags):
                    a, b = spans[x + i]
                    if tag == 1:
                        out.setdefault(t, []).append((a, b))
                    elif tag == 2 and out.get(t):
                        out[t][-1] = (out[t][-1][0], b)
        return out

    def summed(self, features: list[list[int]]) -> np.ndarray:
        sizes = np.fromiter(map(len, features), np.int64, len(features))
        flat = np.fromiter((f for x in features for f in x), np.int64, int(sizes.sum()))
        return np.add.reduceat(self.field.weights[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]))


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """A span without the marks at its edges."""
    while a < b and text[a] in EDGES:
        a += 1
    while b > a and text[b - 1] in EDGES:
        b -= 1
    return a, b


def described(spans: list[tuple[int, int, int]]) -> str:
    names = [s[0] for s in STRICT] + ["crf"]
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, most_train: int = 600, **options) -> DataFrame:
    """Counts of strict spans, base_sha256 and all spans of each row of docs (doc_id, text), as SCHEMA says."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # a plain search goes before each pattern, which most texts then skip
    low = F.lower("text")
    named = F.lit(False)
    for name in ("passw", "secret", "token", "api"):
        named |= low.contains(name)
    hit = named & F.rlike("text", F.lit(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"))
    hit |= F.contains("text", F.lit("AKIA")) & F.rlike("text", F.lit("AKIA[A-Z0-9]{12}"))
    hit |= F.rlike("text", F.lit("[0-9a-f]{32}"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = cut(docs.select("doc_id", hit.alias("hit")))
    chosen = ids.where("hit").orderBy(*order).limit(most_train // 2).union(ids.where("not hit").orderBy(*order).limit(most_train // 2)).select("doc_id").distinct()
    texts = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).orderBy("doc_id").limit(most_train)
    sample = [r["text"] for r in texts.collect()]
    field = train(sample, **options) if any(values_of(x) for x in sample) else None
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(field))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in text_batches(iter([big])):
                rows, more = [], scanner.value.added(b.column("text"))
                for i, (doc_id, text) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)):
                    base = strict_spans(text)
                    extra = [s for s in (trimmed(text, *x) for x in more.get(i, ())) if s[0] < s[1] and not any(a < s[1] and s[0] < e for a, _, e in base)]
                    n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                    digest = hashlib.sha256(described(base).encode()).hexdigest()
                    rows.append((doc_id, *n, digest, described(base + [(a, 3, e) for a, e in extra]), len(extra)))
                columns = list(zip(*rows, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out_schema, strict=True)], schema=out_schema)

    out_schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])
    return docs.mapInArrow(run, SCHEMA)
