"""Language-model scores from a hierarchical Pitman-Yor model of word pairs.

Every word is a context with a restaurant of its own; all contexts share one parent restaurant, whose
base is uniform over the vocabulary and one unknown word. A context's customers are the training tokens
that follow it; each of its tables is a customer of the parent. Seating is sampled by Gibbs: the number
of tables of a dish is drawn from its exact conditional given all others of the restaurant, at every
count (see seating.py). Contexts and the parent are sampled in turn, and the seating is carried on:
`burn_in` rounds, then `samples` rounds whose predictive probabilities are averaged for each token.

The work is laid out for shuffles of packed arrays. Documents are tokenised once into blocks. Words are
counted by shards, ranges of their hashes, that give them dense ids. Pairs go to shards by context, those
of very frequent contexts by pair, so that no context needs one task. Shards grow in number with the
blocks, without a bound, and one shard is held at a time, so that a task's memory doesn't follow the corpus. Messages
between blocks and shards are written only where there is something to say: at most as many as there are pairs.
A pair seen once sits at one table whatever happens; such pairs are told to the word shards once, as counts,
and only the others take part in the rounds. Everything covers all training tokens.

Dishes of a shard are sampled in four parts, each given the tables of the others; a part's dishes, and contexts
that are spread over shards, see each other's tables of the part or round before, as parallel sampling must.
Words are told apart by 64-bit hashes. Each draw takes its chance from a hash of its dish and round,
so that results are the same for the same number of blocks.

Cases: null and empty texts are the end token alone; a null doc_id counts as the empty text for the
fold; repeated rows are trained on and scored each; without training rows every probability is 1 (the
base's one unknown word); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodequery.llm.common import Words, deleted, fold, released, stored, text_batches
from lodequery.llm.seating import chances, draw_tables, mixed, stirling, sweep  # noqa: F401

SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
END, BEGIN = np.uint64(1), np.uint64(2)
BLOBS = "abcde"
PACKED = "kind string, shard long, block long, n long, m long, " + ", ".join(f"{x} binary" for x in BLOBS)
ARROW = pa.schema([("kind", pa.string()), *((x, pa.int64()) for x in ("shard", "block", "n", "m")), *((x, pa.binary()) for x in BLOBS)])
NONE = np.zeros(0, np.int64)


def planes(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as they need, first bytes of all, then second ones and so on, which compresses well."""
    x = np.asarray(x)
    if x.dtype != np.uint64:
        most = max(int(x.max()), -int(x.min())) if len(x) else 0
        x = x.astype(np.int8 if most < 128 else np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)
    code = bytes([x.dtype.itemsize + 16 * (x.dtype.kind == "u")])
    return code + np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()


def ints(x: bytes) -> np.ndarray:
    """The numbers that planes() was given."""
    dtype = np.dtype(f"{'u' if x[0] > 16 else 'i'}{x[0] % 16}")
    out = np.ascontiguousarray(np.frombuffer(x, np.uint8, offset=1).reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype)
    return out if dtype.kind == "u" else out.astype(np.int64)


def steps(x: np.ndarray) -> bytes:
    """Numbers as their differences, for sorted or grouped ones."""
    return planes(np.diff(x, prepend=x.dtype.type(0)))


def summed_steps(x: bytes) -> np.ndarray:
    return np.cumsum(ints(x), dtype=np.uint64 if x[0] > 16 else np.int64)


def message(kind: str, shard: int, block: int, n: int = 0, m: int = 0, **blobs: bytes) -> dict:
    return {"kind": kind, "shard": int(shard), "block": int(block), "n": int(n), "m": int(m)} | {x: blobs.get(x) for x in BLOBS}


def frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "shard", "block", "n", "m", *BLOBS])


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in order, and the place of each number given among them: numbers and places are sorted as one where they fit into 63 bits."""
    bits = max(len(x) - 1, 1).bit_length()
    if not len(x) or x.dtype != np.int64 or int(x.min()) < 0 or int(x.max()).bit_length() + bits > 63:
        return np.unique(x, return_inverse=True)
    both = x << bits | np.arange(len(x))
    both.sort()
    values, place = both >> bits, both & ((1 << bits) - 1)
    new = np.ones(len(x), bool)
    new[1:] = values[1:] != values[:-1]
    at = np.empty(len(x), np.int64)
    at[place] = np.cumsum(new) - 1
    return values[new], at


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = distinct(keys)
    return keys, np.bincount(at, values, len(keys)).astype(np.int64)


def distinct_pairs(u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in order, as two arrays, and the place of each pair given among them."""
    width = int(w.max()) + 1 if len(w) else 1
    if len(u) and int(u.max()) < 2**63 // width:
        pairs, at = distinct(u * width + w)
        return pairs // width, pairs % width, at
    order = np.lexsort((w, u))  # ids too large for one number: slower, the same result
    new = np.ones(len(u), bool)
    new[1:] = (u[order[1:]] != u[order[:-1]]) | (w[order[1:]] != w[order[:-1]])
    at = np.empty(len(u), np.int64)
    at[order] = np.cumsum(new) - 1
    return u[order[new]], w[order[new]], at


def split(home: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[int, slice]]]:
    """An order by home (stable), and of each home that occurs the slice of that order."""
    small = len(home) and 0 <= int(home.min()) and int(home.max()) < 2**16
    order = np.argsort(home.astype(np.uint16) if small else home, kind="stable")  # numbers of two bytes are sorted by radix
    homes, starts = np.unique(home[order], return_index=True) if not small else ((n := np.bincount(home)).nonzero()[0], (np.cumsum(n) - n)[n > 0])
    return order, ((h, slice(a, b)) for h, a, b in zip(homes.tolist(), starts.tolist(), [*starts[1:].tolist(), len(home)][: len(homes)], strict=True))


def word_home(words: np.ndarray, shards: int) -> np.ndarray:
    """The word shard of hashes: equal ranges, so that sorted hashes are sorted by shard at any number of shards."""
    return ((words >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def pair_home(u: np.ndarray, w: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each pair: by context, and by pair where the context is hot."""
    return ((mixed(u) >> np.uint64(8)) + np.where(hot, mixed(w + 1) >> np.uint64(8), np.uint64(0))).astype(np.int64) % shards


# ---- blocks ------------------------------------------------------------------------------------


def block_tokens(b: pa.RecordBatch) -> dict:
    """A batch of documents as codes into its sorted distinct word hashes, with training counts of each."""
    w = Words(b.column("text"), lower=True)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, w.encoded()), np.uint64, len(w.words))
    hashed[hashed <= BEGIN] += np.uint64(7)
    n = np.diff(w.starts)
    words, back = np.unique(np.concatenate([hashed, [END, BEGIN]]), return_inverse=True)
    codes = np.full(int(n.sum() + len(n)), back[-2], np.int64)
    inside = np.ones(len(codes), bool)
    inside[np.cumsum(n + 1) - 1] = False
    codes[inside] = back[w.codes]
    held = np.asarray(b.column("held_out"))
    counts = np.bincount(codes, np.repeat(~held, n + 1), len(words)).astype(np.int64)
    counts[back[-1]] = int((~held).sum())
    return {"a": planes(codes), "b": planes(n + 1), "c": steps(words), "d": planes(counts), "e": planes(held.astype(np.int8)), "begin": int(back[-1])}


def token_pairs(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Context and word codes of a block's distinct pairs, training counts of those, and each token's pair."""
    codes, n = ints(row["a"]), ints(row["b"])
    before = np.concatenate([[0], codes[:-1]]) if len(codes) else codes
    before[np.concatenate([[0], np.cumsum(n)[:-1]])] = row["begin"]
    u, w, at = distinct_pairs(before, codes)
    learned = np.bincount(at, np.repeat(ints(row["e"]) == 0, n), len(u)).astype(np.int64)
    return u, w, learned, at


def of_words(replies: list, names: str) -> list[np.ndarray]:
    """What word shards replied to a block, in the order of its words, which is that of the shards."""
    own = sorted((r for r in replies if r["kind"] == "words"), key=lambda r: r["shard"])
    return [np.concatenate([ints(r[x]) for r in own] or [NONE]) for x in names]


def mapped(df: DataFrame, work, schema: pa.Schema = ARROW, ddl: str = PACKED) -> DataFrame:
    """work(row as a dict) gives rows; one row of df is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows = list(work(b.slice(i, 1).to_pylist()[0]))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                rows = None
            released()

    return df.mapInArrow(run, ddl)


def freed(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def score(
    docs: DataFrame, held_out: Column | None = None, block_bytes: int = 10_000_000, most_tasks: int = 10_000,
    strength: float = 1.0, root_discount: float = 0.8, root_strength: float = 1.0, burn_in: int = 2, samples: int = 3, seed: int = 13,
) -> DataFrame:
    """Scores of all rows of docs (doc_id, text), as SCHEMA says; learns from those not held out.

    The discount of contexts is n1 / (n1 + 2 n2), with the numbers of pairs seen once and twice. perplexity is
    10 ** (-score / n_tokens); that of a corpus is 10 ** (-sum of scores / sum of n_tokens). most_tasks: so many
    tasks a stage at most; more shards than that share tasks, one held at a time.
    """
    spark = docs.sparkSession
    held_out = fold(F.col("doc_id"), 10) == 0 if held_out is None else held_out
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for big in batches:
            for b in text_batches(iter([big]), block_bytes):
                made = block_tokens(b)
                tokens_ = {"part": "tokens", "block": block, "begin": made["begin"], "ids": b.column("doc_id").to_pylist()} | {x: made[x] for x in "abe"}
                yield pa.RecordBatch.from_pylist([tokens_, {"part": "words", "block": block} | {x: made[x] for x in "cd"}], block_schema)
                block += 1
            released()

    block_schema = pa.schema([("part", pa.string()), ("block", pa.int64()), ("begin", pa.int64()), ("ids", pa.list_(pa.int64())), *((x, pa.binary()) for x in BLOBS)])
    both = stored(docs.mapInArrow(tokenised, "part string, block long, begin long, ids array<long>, " + ", ".join(f"{x} binary" for x in BLOBS)), "blocks", "part")
    blocks = both.where("part = 'tokens'")
    n_blocks = max(blocks.count(), 1)
    shards = max(8, n_blocks)
    # some shards, or blocks, a task, one held at a time: starting a task takes about as long as a shard's work
    tasks, block_tasks = (min(x, max(24, -(-x // 3)), most_tasks) for x in (shards, n_blocks))

    def by_shard(df: DataFrame, work) -> DataFrame:
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            out = work(rows)
            released()
            return out

        return df.repartition(tasks, "shard").groupBy("shard").applyInPandas(run, PACKED)

    def with_replies(columns: list[str], replies: DataFrame, work, ddl: str) -> DataFrame:
        """work(block with its replies, as a dict), a block at a time; replies are at most one a shard and kind and in all bounded by the block, and stay rows of
        their own: neither the engine nor a worker holds several blocks' at once."""

        def run(own: pa.Table, told: pa.Table) -> pa.Table:
            row = own.to_pylist()[0] | {"replies": told.to_pylist()}
            own = told = None
            out = work(row)
            row = None
            released()
            return out

        own = blocks.select("block", "begin", *columns).repartition(block_tasks, "block").groupBy("block")
        return own.cogroup(replies.select("block", "kind", "shard", *BLOBS).repartition(block_tasks, "block").groupBy("block")).applyInArrow(run, ddl)

    # words: counts and dense ids, small ones for frequent words
    def ask_words(row: dict) -> Iterator[dict]:
        words, counts = summed_steps(row["c"]), ints(row["d"])
        _, parts = split(word_home(words, shards))
        for s, at in parts:
            yield message("ask", s, row["block"], a=steps(words[at]), b=planes(counts[at]))

    def count_words(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        asked = [summed_steps(x) for x in rows["a"]]
        words, at = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(at, np.concatenate([ints(x) for x in rows["b"]]), len(words)).astype(np.int64)
        order = np.argsort(-total, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        begin, out = 0, []
        for block, x in zip(rows["block"], asked, strict=True):
            own = at[begin : begin + len(x)]
            begin += len(own)
            out.append(message("words", shard, block, a=planes(rank[own] * shards + shard), b=planes(total[own])))
        real = (words != BEGIN) & (total > 0)
        return frame([*out, message("size", shard, len(words), n=real.sum(), m=total[words != BEGIN].sum())])

    said = stored(by_shard(mapped(both.where("part = 'words'").select("block", "c", "d"), ask_words), count_words), "words")
    deleted(both, "part=words")
    sizes = said.where("kind = 'size'")
    vocabulary, tokens = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()
    words_of = said.where("kind = 'words'").select("kind", "shard", "block", *BLOBS)
    hot = 0.5 * tokens / shards
    freed(spark)

    # pairs: merged by shard; what a block asked for is kept as places in the shard's arrays
    def ask_pairs(row: dict) -> pa.Table:
        ids, counts = of_words(row["replies"], "ab")
        u, w, learned, _ = token_pairs(row)
        is_hot = counts[u] > hot
        u, w = ids[u], ids[w]
        order, parts = split(pair_home(u, w, is_hot, shards))
        u, w, learned, is_hot = u[order], w[order], learned[order], is_hot[order]
        asked = (message("ask", s, row["block"], a=steps(u[at]), b=planes(w[at]), c=planes(learned[at]), d=planes(is_hot[at].astype(np.int8))) for s, at in parts)
        return pa.Table.from_pylist(list(asked), ARROW)

    def tells(shard: int, w: np.ndarray, t: np.ndarray, u: np.ndarray, hot_: np.ndarray) -> Iterator[dict]:
        """A shard's tables by word, and by hot context, for their word shards; the receiver replies in the same order."""
        for kind, keys, values in (("by word", w, t), ("by context", u[hot_ == 1], t[hot_ == 1])):
            keys, values = summed(keys, values)
            order, parts = split(keys % shards)
            for s, at in parts:
                yield message(kind, s, shard, a=steps(keys[order[at]] // shards), b=planes(values[order[at]]))

    def merge_pairs(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        u, w = np.concatenate([summed_steps(x) for x in rows["a"]]), np.concatenate([ints(x) for x in rows["b"]])
        sizes_ = [len(x) for x in map(ints, rows["c"])]
        all_hot = np.concatenate([ints(x) for x in rows["d"]])
        u, w, at = distinct_pairs(u, w)
        c = np.bincount(at, np.concatenate([ints(x) for x in rows["c"]]), len(u)).astype(np.int64)
        is_hot = np.zeros(len(u), np.int64)
        is_hot[at] = all_hot
        shared = np.flatnonzero(c >= 2)
        place = np.where(c == 0, -2, -1)
        place[shared] = np.arange(len(shared))
        begin, out = 0, []
        for block, size in zip(rows["block"], sizes_, strict=True):
            out.append(message("places", shard, block, a=planes(place[at[begin : begin + size]])))
            begin += size
        for kind, keys in (("ones of word", w[c == 1]), ("ones of context", u[c == 1])):
            keys, n = np.unique(keys, return_counts=True)
            order, parts = split(keys % shards)
            out.extend(message(kind, s, shard, a=steps(keys[order[x]] // shards), b=planes(n[order[x]])) for s, x in parts)
        contexts = np.unique(u[shared])
        ones = np.bincount(np.searchsorted(contexts, u[(c == 1) & np.isin(u, contexts)]), minlength=len(contexts))
        out.append(message("seats", shard, -1, n=(c == 1).sum(), m=(c == 2).sum(), a=steps(u[shared]), b=planes(w[shared]), c=planes(c[shared]), d=planes(is_hot[shared]), e=planes(ones)))
        out.extend(tells(shard, w[shared], np.ones(len(shared), np.int64), u[shared], is_hot[shared]))
        return frame(out)

    merged = stored(by_shard(with_replies(["a", "b", "e"], words_of, ask_pairs, PACKED), merge_pairs), "pairs")
    seats = merged.where("kind = 'seats'")
    places = merged.where("kind = 'places'").select(F.col("shard").alias("shard"), F.col("block").alias("block"), F.col("a").alias("place"))
    once, twice = seats.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()
    discount = float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.95))
    unseen = 1 / (vocabulary + 1)
    freed(spark)

    # rounds: the parent in word shards, contexts in pair shards
    def parent(round_: int, root_tables: float):
        """One word shard: its words' customers and tables in the parent, and replies to the shards that told of them."""

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            shard, kinds = int(rows["shard"].iloc[0]), dict(tuple(rows.groupby("kind")))
            if "size" in kinds:
                n = int(kinds["size"]["block"].iloc[0])
                ones = {}
                for kind in ("ones of word", "ones of context"):
                    ones[kind] = np.zeros(n, np.int64)
                    for a, b in zip(*(kinds[kind][x] for x in "ab"), strict=True) if kind in kinds else ():
                        ones[kind][summed_steps(a)] += ints(b)
                of_word, of_context, k, kept = ones["ones of word"], ones["ones of context"], np.zeros(n, np.int64), NONE
            else:
                state = kinds["state"].iloc[0]
                of_word, of_context, k, kept = (ints(state[x]) for x in "abcd")
                n = len(of_word)
            told = {"by word": of_word.copy(), "by context": of_context.copy()}
            for kind, sums in told.items():
                for a, b in zip(*(kinds[kind][x] for x in "ab"), strict=True) if kind in kinds else ():
                    sums[summed_steps(a)] += ints(b)
            customers = told["by word"]
            some = np.flatnonzero(customers)
            others = np.maximum((root_tables if root_tables else float(vocabulary)) - np.maximum(k[some], 1), 0.0)
            k[some] = draw_tables(customers[some], others, np.full(len(some), unseen), root_discount, root_strength, chances(seed, -round_ - 1, some * shards + shard))
            out = []
            for kind in told:
                for sender, a in zip(*(kinds[kind][x] for x in ("block", "a")), strict=True) if kind in kinds and round_ < burn_in + samples else ():
                    at = summed_steps(a)
                    out.append(message(kind, sender, shard, a=planes(told[kind][at]), b=planes(k[at])))
            if round_ > burn_in:
                kept = np.concatenate([kept, customers, k])
            if round_ < burn_in + samples:
                out.append(message("state", shard, -1, a=planes(of_word), b=planes(of_context), c=planes(k), d=planes(kept)))
            else:
                tables = np.tile(of_context, samples).reshape(samples, -1)
                for a, b in zip(*(kinds["contexts"][x] for x in "ab"), strict=True) if "contexts" in kinds else ():
                    tables[:, summed_steps(a)] += ints(b).reshape(samples, -1)
                out.append(message("final", shard, -1, a=planes(kept), b=planes(tables.ravel())))
            return frame([*out, message("total", shard, -2, n=customers.sum(), m=k.sum())])

        return run

    def contexts(round_: int, customers: float, tables: float):
        """One pair shard: its pairs' tables given the parent's probabilities, and what the word shards must know of them."""

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            kinds = dict(tuple(rows.groupby("kind")))
            if "seats" not in kinds:
                return frame([])
            seat = kinds["seats"].iloc[0]
            shard, u, w, c, is_hot, ones = int(seat["shard"]), summed_steps(seat["a"]), *(ints(seat[x]) for x in "bcde")
            if "tables" in kinds:
                held = kinds["tables"].iloc[0]
                t, sums, kept = (ints(held[x]) for x in "abc")
            else:
                t, sums, kept = np.ones(len(c), np.int64), np.zeros(len(c), np.int64), NONE
            got = {}
            words, at_word = distinct(w)
            for kind, keys in (("by word", words), ("by context", np.unique(u[is_hot == 1]))):
                order, parts = split(keys % shards)
                values, replies = np.zeros((2, len(keys)), np.int64), {}
                if kind in kinds:
                    replies = dict(zip(kinds[kind]["block"], zip(kinds[kind]["a"], kinds[kind]["b"], strict=True), strict=True))
                for s, at in parts:
                    values[:, order[at]] = [ints(x) for x in replies[s]]
                got[kind] = keys, values
            keys, (sat, k) = got["by word"]
            base = (sat - root_discount * k + (root_strength + root_discount * tables) * unseen) / (root_strength + customers)
            own, at = distinct(u)
            total = ones + np.bincount(at, t, len(own)).astype(np.int64)
            keys_hot, values = got["by context"]
            total[np.searchsorted(own, keys_hot)] = values[0]
            t = sweep(at, c, t, total, base[at_word], discount, strength, chances(seed, round_, u, w))
            out = list(tells(shard, w, t, u, is_hot))
            if round_ > burn_in:
                sums, kept = sums + t, np.concatenate([kept, np.bincount(at, t, len(own)).astype(np.int64)])
            if round_ == burn_in + samples:
                order, parts = split(own % shards)
                kept = kept.reshape(samples, -1)
                out.extend(message("contexts", s, shard, a=steps(own[order[x]] // shards), b=planes(kept[:, order[x]].ravel())) for s, x in parts)
                kept = NONE
            return frame([*out, message("tables", shard, -1, a=planes(t), b=planes(sums), c=planes(kept))])

        return run

    tables, replies, drawn = None, None, []
    for round_ in range(burn_in + samples + 1):
        told = merged.where("kind like 'ones of %' or kind like 'by %'").unionByName(sizes) if tables is None else tables.where("kind like 'by %' or kind = 'contexts'").unionByName(replies.where("kind = 'state'"))
        before, replies = replies, stored(by_shard(told, parent(round_, drawn[-1][1] if drawn else 0.0)), "parent")
        deleted(before)
        drawn.append(tuple(float(x) for x in replies.where("kind = 'total'").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()))
        if round_ < burn_in + samples:
            parts = seats.unionByName(replies.where("kind like 'by %'"))
            parts = parts if tables is None else parts.unionByName(tables.where("kind = 'tables'"))
            before, tables = tables, stored(by_shard(parts, contexts(round_ + 1, *drawn[-1])), "tables")
            deleted(before)
        told = parts = None
        freed(spark)
    drawn = drawn[burn_in + 1 :]

    # replies to blocks, and scores
    def word_replies(final: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked):
            kept, of_context = (ints(final[x].iloc[0]).reshape(rows, -1) for x, rows in (("a", 2 * samples), ("b", samples)))
            for s, b, x, y in zip(asked["shard"], asked["block"], asked["a"], asked["b"], strict=True):
                at = ints(x) // shards
                out.append(message("words", s, b, a=x, b=y, c=planes(kept[:, at].T.ravel()), d=planes(of_context[:, at].T.ravel())))
        return frame(out)

    def pair_replies(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked):
            # places -2 and -1, at the arrays' ends: never seen, and seen once at one table
            c, t = np.concatenate([ints(own["c"].iloc[0]), [0, 1]]), np.concatenate([ints(own["sums"].iloc[0]), [0, samples]])
            for s, b, x in zip(asked["shard"], asked["block"], asked["place"], strict=True):
                at = ints(x)
                out.append(message("pairs", s, b, a=planes(c[at]), b=planes(t[at])))
        return frame(out)

    final = replies.where("kind = 'final'").select("shard", "a", "b")
    to_words = final.repartition(tasks, "shard").groupBy("shard").cogroup(words_of.select("shard", "block", "a", "b").repartition(tasks, "shard").groupBy("shard")).applyInPandas(word_replies, PACKED)
    sums = seats.select("shard", "c").join(tables.where("kind = 'tables'").select("shard", F.col("b").alias("sums")), "shard")
    to_pairs = sums.repartition(tasks, "shard").groupBy("shard").cogroup(places.repartition(tasks, "shard").groupBy("shard")).applyInPandas(pair_replies, PACKED)

    def scored(row: dict) -> pa.Table:
        ids, counts, kept, of_context = of_words(row["replies"], "abcd")
        kept, of_context = kept.reshape(-1, samples, 2), of_context.reshape(-1, samples)
        u, w, _, at = token_pairs(row)
        order, parts = split(pair_home(ids[u], ids[w], counts[u] > hot, shards))
        pairs = {r["shard"]: r for r in row.pop("replies") if r["kind"] == "pairs"}
        p = np.zeros(len(u))
        for s, x in parts:
            p[order[x]] = ints(pairs[s]["a"]) - discount * ints(pairs[s]["b"]) / samples
        for i, (customers, tables_) in enumerate(drawn):  # each sample's predictive probability
            base = (kept[:, i, 0] - root_discount * kept[:, i, 1] + (root_strength + root_discount * tables_) * unseen) / (root_strength + customers)
            p += (strength + discount * of_context[u, i]) * base[w] / samples
        p /= strength + counts[u]
        n, codes = ints(row["b"]), ints(row["a"])
        unigram = np.log10((counts + 0.1) / (tokens + 0.1 * (vocabulary + 1)))
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        model, plain, known = (np.add.reduceat(x, starts) for x in (np.log10(p)[at], unigram[codes], (counts > 0)[codes].astype(np.int64)))
        out = {"doc_id": row["ids"], "held_out": ints(row["e"]) == 1, "n_tokens": n, "n_known": known, "train_tokens": np.full(len(n), tokens), "base_score": plain, "score": model, "perplexity": 10 ** (-model / n)}
        return pa.table({k: pa.array(v, pa.int64()) if k == "doc_id" else pa.array(v) for k, v in out.items()})

    return with_replies(["ids", "a", "b", "e"], to_words.unionByName(to_pairs), scored, SCHEMA)
