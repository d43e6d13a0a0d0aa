"""Sorting of packed numbers in the word-pair model gives what numpy's unique() and argsort() give."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from lodequery.llm import common, pitman_yor

CASES = [np.zeros(0, np.int64), np.array([7]), np.array([5, 5, 2]), np.array([-1, 3, -1]), np.array([2**62, 1, 2**62]), np.array([2**63 + 1, 2], np.uint64), np.array([70000, 3, 70000, 65535, 65536]), np.random.default_rng(1).integers(0, 300, 5000)]


@pytest.mark.parametrize("x", CASES, ids=range(len(CASES)))
def test_distinct(x):
    want, got = np.unique(x, return_inverse=True), pitman_yor.distinct(x)
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(want, got, strict=True))


@pytest.mark.parametrize("x", [c for c in CASES if c.dtype == np.int64], ids=str)
def test_split(x):
    order, parts = pitman_yor.split(x)
    assert (order == np.argsort(x, kind="stable")).all()
    parts = list(parts)
    assert [h for h, _ in parts] == np.unique(x).tolist() and all((x[order[at]] == h).all() for h, at in parts) and sum(at.stop - at.start for _, at in parts) == len(x)


def test_words_in_lower_case_from_their_bytes():
    """Letters A-Z alone become small, and words are hashed from the array's bytes, also of slices."""
    texts = pa.array(["x", "ÄÖ İI Straße STRASSE aB\x0bC", "", None, " \t\n", "K K k \x1cA ab"])
    for own in (texts, texts.slice(2), texts.slice(0, 0)):
        words = common.Words(own, lower=True)
        want = [w for t in own.to_pylist() for w in re.split("[\x20\x09-\x0d]+", t or "") if w]
        want = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in want]
        assert [words.types[i] for i in words.codes] == want and len(set(words.types)) == len(words.types)
        assert list(words.encoded()) == [w.encode() for w in words.types]
