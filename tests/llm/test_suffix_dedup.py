"""Removal of repeated bytes against brute force over all windows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from lodequery.llm import suffix_dedup


def plain(rows, length):
    """rows: (id, text), ids may repeat or be null; the result of each, by comparing all windows."""
    texts = [(2**63 - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for o, x in texts:
        for p in range(len(x) - length + 1):
            least[x[p : p + length]] = min(o, least.get(x[p : p + length], o))
    out = []
    for (i, _), (o, x) in zip(rows, texts, strict=True):
        gone = bytearray(len(x))
        for p in range(len(x) - length + 1):
            if least[x[p : p + length]] < o:
                gone[p : p + length] = b"\1" * length
        spans = len(bytes(gone).replace(b"\0", b" ").split())
        out.append((i, len(x), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus():
    rng = random.Random(1)
    word = lambda: rng.choice(["lorem", "ipsum", "größe", "日本", "a", "dolor sit", "x" * 9])
    text = lambda n: " ".join(word() for _ in range(n))
    line, passage = text(14), text(40)
    rows = [(i, text(rng.randint(0, 60))) for i in range(60)]
    rows += [(100 + i, f"{text(rng.randint(0, 9))}\n{line}\n{text(rng.randint(0, 9))}") for i in range(60)]  # a common line in other texts
    rows += [(200 + i, text(5) + passage[i : 200 - i] + text(5)) for i in range(20)]
    rows += [(300 + i, rows[3][1]) for i in range(30)]  # copies
    rows += [(400 + i, rows[7][1].replace("lorem", f"l{i}", 1)) for i in range(20)]  # near copies
    rows += [(None, rows[3][1]), (None, passage), (3, passage), (3, passage), (-5, passage[50:150]), (500, None), (501, ""), (502, "short"), (503, "ab" * 300), (504, "ab" * 200), (505, "a" * 700)]
    return rows


@pytest.mark.parametrize("options", [{}, {"most_rows": 1, "rows_per_task": 40, "bucket_bytes": 3000, "flush_bytes": 1500, "most_broadcast": 0, "segment": 64}, {"most_rows": 5, "sample_bytes": 1, "bucket_bytes": 9000, "segment": 333}])
@pytest.mark.parametrize("length", [50, 12])
def test_removal_against_all_windows(spark, options, length):
    rows = corpus()
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, o long, lead int").repartition(3)
    assert found(suffix_dedup.removed(table, length=length, **options)) == plain(rows, length)


def test_no_rows_and_extra_columns(spark):
    assert suffix_dedup.removed(spark.createDataFrame([], "doc_id long, text string, runs string")).count() == 0


def test_multikey_sorts_as_bytes_do():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2, (500, 20)).astype(np.uint8) * 255
    x[:, :17] = x[rng.integers(0, 9, 500), :17]
    group = rng.integers(0, 3, 500)
    order, new = suffix_dedup.multikey(suffix_dedup.words(x), group)
    keys = [(int(g), r.tobytes()) for g, r in zip(group, x, strict=True)]
    assert [keys[i] for i in order] == sorted(keys)
    assert new.tolist() == [i == 0 or keys[order[i]] != keys[order[i - 1]] for i in range(500)]


def test_equal_windows_have_equal_anchors_whatever_the_segments():
    rng = random.Random(3)
    passage = bytes(rng.randrange(256) for _ in range(50))
    texts = [bytes(rng.randrange(256) for _ in range(n)) + passage + bytes(rng.randrange(256) for _ in range(300 - n)) for n in (0, 17, 250, 300)]
    hashes = []
    for segment in (16, 64, 1 << 18):
        for t in texts:
            finder = suffix_dedup.Anchors(50, segment)
            finder.add(1, 1, t)
            h, _, _, _, p = finder.taken()
            at = t.index(passage)
            hashes.append({(int(a), int(b) - at) for a, b in zip(h, p, strict=True) if at <= b <= at + finder.back})
    assert set.intersection(*hashes)


def test_one_string_over_many_partitions(spark):
    """A string that fills several sorted partitions is compared across their boundaries: all but the least id lose it."""
    rows = [(i, chr(65 + i % 26) * (i % 7) + str(i) + "=" + "the one common string of more than fifty bytes in all" + str(i)) for i in range(300)]
    df = suffix_dedup.removed(spark.createDataFrame(rows, "doc_id long, text string"), most_rows=2, rows_per_task=25)
    got = found(df)
    assert got == plain(rows, 50) and sum(r[3] for r in got) == 299


def test_merged_spans():
    o, th, begin, end = (np.array(x, np.int64) for x in ([2, 1, 1, 1, 1], [0, 0, 0, 5, 0], [0, 9, 3, 1, 5], [4, 12, 7, 2, 9]))
    assert [x.tolist() for x in suffix_dedup.merged(o, th, begin, end)] == [[1, 1, 2], [0, 5, 0], [3, 1, 0], [12, 2, 4]]
    assert suffix_dedup.byte_rows(pa.array([b"ab", b"cd", b"ef"], pa.binary())[1:]).tolist() == [[99, 100], [101, 102]]
