"""Packing and byte-level BPE against the tokenizer libraries and the rules of windows."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from lodequery.llm import byte_bpe, packing

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "\n\n  a\t\tb ", "it's IT'S we'll", "naïve café ÅNGSTRÖM ß", "12,345.67 -- ***", "日本語 текст 🙂🙂", "x" * 5000, "a\x1cb\x00c", "<|endoftext|> mid"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, length string")


def checked(rows, texts, size):
    """Each id lies in one piece, pieces match the tokenizer's ids, sequences are gapless and full or a power of two."""
    tok = Tokenizer.from_file(WORDS)
    ids = [tok.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["length"] > 0 and len(own) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, own in enumerate(ids):
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == len(own)
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == size or (at < size and at & (at - 1) == 0)


@pytest.mark.parametrize(("size", "max_open"), [(2048, 4096), (16, 4)])
def test_windows(spark, size, max_open):
    texts = ODD + ["the quick brown fox"] * 30 + ["word " * n for n in range(40)]
    rows = packing.pack(frame(spark, texts).repartition(3), WORDS, size=size, max_open=max_open).collect()
    checked(rows, texts, size)


def test_place_is_the_least_sum_of_squares():
    packer = packing.SquaresPacker(12, 100)
    rng = np.random.default_rng(1)
    for i in range(300):
        length = int(rng.integers(1, 12))
        choices = [level for level in range(12 - length + 1) if level == 0 or packer.levels[level]]

        def after(level):
            levels = packer.levels.copy()
            levels[level] -= level > 0
            levels[level + length] += level + length < 12
            return int((levels.astype(int) ** 2).sum())

        assert after(packer.place(length)) == min(map(after, choices))
        list(packer.add(i, b"\0\0\0\0" * length))


def test_documents_and_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    order = sorted(texts)
    rows = packing.pack(docs, WORDS).collect()
    at = {d: i for i, d in enumerate(order)}
    checked([{**r.asDict(), "doc_id": at[r["doc_id"]]} for r in rows], [texts[d] for d in order], 2048)
    assert packing.pack(frame(spark, ["x"]).where("false"), WORDS).count() == 0


@pytest.fixture(scope="module")
def coder():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize(("chunk", "overlap"), [(65536, 1024), (64, 16)])
def test_byte_bpe(spark, coder, chunk, overlap):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()
    texts = ODD + ["  lead", "a  b   c\n\n\nd", "word   " * 40, " " * 300, "it's " * 50 + "\t\n " * 40 + "end"] + [r["text"] for r in docs]
    got = {r["doc_id"]: r for r in byte_bpe.encode(frame(spark, texts), RANKS, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = coder.encode_ordinary(text or "")
        assert got[i]["n_tokens"] == len(ids), (i, text)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_byte_bpe_of_no_rows_and_repeated_rows(spark):
    docs = frame(spark, ["one two", None])
    assert byte_bpe.encode(docs.where("false"), RANKS, public_tokenizers.PATTERN).count() == 0
    assert byte_bpe.encode(docs.union(docs), RANKS, public_tokenizers.PATTERN).count() == 4
