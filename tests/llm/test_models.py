"""The two classifiers and the quality rules: held-out accuracy, kernels and counts against plain code."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodequery.llm import quality_model, quality_rules, toxicity

SF = "/root/testdata/sf0.01"


def auc(scores, labels):
    order = np.argsort(scores)
    rank = np.empty(len(scores))
    rank[order] = np.arange(len(scores))
    y = np.array(labels) == 1
    return (rank[y].mean() - (y.sum() - 1) / 2) / max((~y).sum(), 1)


def held_out(spark, result, label):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r[label] is not None}
    rows = [r for r in result.collect() if r["held_out"] and r["doc_id"] in labels]
    return rows, [labels[r["doc_id"]] for r in rows]


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_on_held_out_documents(spark):
    docs, labels = tables(spark)
    out = quality_model.score(docs, labels)
    rows, y = held_out(spark, out, "quality")
    assert out.count() == docs.count() and len(rows) > 50
    assert auc([r["score"] for r in rows], y) > 0.9
    assert np.mean([r["predicted"] == v for r, v in zip(rows, y, strict=True)]) > 0.8
    for r in out.limit(50).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1


def test_quality_filter_agrees_with_the_scores(spark):
    docs, labels = tables(spark)
    kept = quality_model.kept(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in quality_model.score(docs, labels).where("predicted = 1").collect()}


def test_folded_weights_equal_the_network():
    """Averaging vectors and then the softmax gives the score that the summed weights give."""
    import pyarrow as pa

    sample = [("good words here", 1), ("bad bad spam", 0)] * 5
    model = quality_model.train(sample, bits=10, dim=4, epochs=3)
    text = "good bad words unseen"
    w = quality_model.Words(pa.array([text]))
    owner, feature, words = quality_model.word_features(w.types, 10, (3, 4))
    pairs, has = quality_model.pair_codes(words, w.codes, w.starts, 10)
    ids = [f for c in w.codes for f in feature[owner == c]] + list(pairs[has])
    want = 1 / (1 + math.exp(-(np.mean(model.weights[ids]) + model.bias)))
    assert model.scores(pa.array([text]))[0] == pytest.approx(want)


@pytest.mark.parametrize("operator", [quality_model, toxicity])
def test_classifiers_edge_cases(spark, operator):
    label = "quality" if operator is quality_model else "toxic"
    docs = spark.createDataFrame([(None, "a"), (1, None), (2, ""), (2, ""), (3, "x " * 20_000)], "doc_id long, text string").withColumn("score", F.lit("x"))
    none = spark.createDataFrame([(1, None), (None, 1)], f"doc_id long, {label} int")
    rows = operator.score(docs, none).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert operator.score(docs.where("false"), none.where("false")).count() == 0


def plain_kernel(a, b, span=5, decay=0.6):
    """Normalised gap-weighted triple kernel by listing all triples of places."""

    def features(word):
        out = defaultdict(float)
        for i, j, k in combinations(range(len(word)), 3):
            if k - i < span:
                out[word[i], word[j], word[k]] += decay ** (k - i - 2)
        return out

    x, y = features(f"~{a}~"), features(f"~{b}~")
    dot = lambda p, q: sum(v * q.get(t, 0) for t, v in p.items())
    return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))


def test_string_kernel_against_listing():
    words = ["idiot", "idxiot", "idot", "moron", "table", "idiotic", "ab", "a"]
    kernel = toxicity.Kernel(["idiot", "moron"], floor=0.0, power=1)
    which, k = kernel.of(words)
    at = {words[i]: row for i, row in zip(which.tolist(), k, strict=True)}
    for w in words:
        want = [plain_kernel(w, x) for x in ("idiot", "moron")]
        assert at.get(w, np.zeros(2)) == pytest.approx(want, abs=1e-6), w
    assert plain_kernel("idxiot", "idiot") > 2 * plain_kernel("table", "idiot")


@pytest.mark.parametrize(("written", "read"), [("MoRoN", "moron"), ("m0r0n!", "moron"), ("m.o.r.o.n", "moron"), ("123", ""), ("'word'", "word")])
def test_folding(written, read):
    assert toxicity.folded(written) == read


def test_spelled_out_words_score_alike_beside_any_rows():
    import pyarrow as pa

    model = toxicity.Model(toxicity.Kernel(["idiot", "moron"]), np.ones(2), -0.5, np.array([1.0, 1.0, 1.0, 0.0]))
    texts = ["you are an i d i o t", "A cat sat here", "i d i o t you are", "plan b", "i d i o t", "i d i o t", "m o r o n", "", None, "I a", "x y z", "m o r o n"]
    alone = [model.scores(pa.array([t], pa.string()))[0] for t in texts]
    assert min(alone[i] for i in (0, 2, 4, 6)) > max(alone[i] for i in (1, 3, 7, 8, 9, 10)) + 0.1
    for order in (range(12), range(11, -1, -1), np.random.default_rng(1).permutation(12)):
        for size in (2, 3, 5, 12):
            own = [list(order)[i : i + size] for i in range(0, 12, size)]
            got = {i: v for part in own for i, v in zip(part, model.scores(pa.array([texts[i] for i in part], pa.string())), strict=True)}
            assert [got[i] for i in range(12)] == pytest.approx(alone)


def test_toxicity_on_held_out_documents(spark):
    docs, labels = tables(spark)
    out = toxicity.score(docs, labels)
    rows, y = held_out(spark, out, "toxic")
    assert out.count() == docs.count()
    assert auc([r["score"] for r in rows], y) > 0.85
    predicted = np.array([r["predicted"] for r in rows])
    y = np.array(y)
    assert predicted[y == 0].mean() < 0.05
    for r in out.limit(50).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7)


# ---- quality rules -----------------------------------------------------------------------------


def words_of(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain_counts(text):
    text = text or ""
    w = words_of(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


ODD = [None, "", " \n", "a b c", "a a a a a", "a b c a b c x", "one\ntwo\none\n \n \none", "# * $ % & | < >", "x\x85y   z w", "l\r\nl\r\n", "word " * 5000, "🙂 é 🙂 é 🙂 é"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, f"s{i % 3}", 5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_words int")


def test_counts_and_base_rules(spark):
    texts = ODD + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = {r["doc_id"]: r for r in quality_rules.judge(frame(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        r, want = rows[i], plain_counts(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, (i, text)
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def outliers(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(3, 9)))
    texts = [" ".join(word() for _ in range(120)) for _ in range(300)]
    texts[7] = " ".join(word() + "###" for _ in range(120))
    texts[8] = " ".join(word() * 8 for _ in range(120))
    return frame(spark, texts)


@pytest.mark.parametrize("options", [{}, {"least_rows": 10_000}, {"most_groups": 0}, {"k": 200}])
def test_fences_drop_outliers_alone(spark, options):
    docs = outliers(spark)
    rows = quality_rules.judge(docs, **options).collect()
    assert {r["doc_id"] for r in rows if not r["kept"]} == {7, 8}
    kept = quality_rules.kept(docs, **options)
    assert kept.columns == docs.columns and kept.count() == 298 and kept.select("n_words").distinct().collect()[0][0] == 5


def test_fences_are_quartiles_of_small_groups(spark):
    """Sketches of few rows are exact: fences equal those of sorted values."""
    counted = quality_rules.counts(outliers(spark)).cache()
    fence = {(r["lang"], r["source"]): r["fence"] for r in quality_rules.fences(counted, least_rows=1).collect()}
    values = defaultdict(list)
    for r in counted.where("not base_failed").collect():
        values[r["lang"], r["source"]].append(r["word_chars"] / r["n_words"])
    for group, v in values.items():
        v.sort()
        q = lambda p, v=v: [v[max(math.ceil(p * len(v)) - 1, 0)], v[min(math.floor(p * len(v)), len(v) - 1)]]
        low = [b + 6 * (b - a) + 4.0 for a in q(0.25) for b in q(0.75)]
        assert min(low) - 1e-9 <= fence[group]["high_word_length"] <= max(low) + 1e-9
    counted.unpersist()


def of_sources(spark, own):
    """600 plain documents of three sources and `own` of a fourth, all of one language."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(3, 9)))
    texts = [" ".join(word() for _ in range(120)) for _ in range(600)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)] + [(600 + i, t, "en", "own") for i, t in enumerate(own(word))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def dropped(docs):
    return {r["doc_id"] for r in quality_rules.judge(docs).where("not kept and not base_failed").collect()}


def test_fences_follow_the_tail_of_plain_documents(spark):
    """Documents under the fixed slack (0.05 symbols, 0.4 repeats) or of very short words, where others have none such."""
    phrase = ["some", "words", "said"]
    odd = lambda word: [
        " ".join(word() + ("#" if i % 6 == 0 else "") for i in range(120)),
        " ".join(phrase * 14 + [word() for _ in range(78)]),
        " ".join(f"{chr(97 + i % 26)}{i // 26 or ''}" for i in range(120)),
    ]
    assert dropped(of_sources(spark, odd)) == {600, 601, 602}


def test_a_bad_source_does_not_open_its_own_fence(spark):
    bad = lambda word: [" ".join(word() + "###" * (1 + (i + j) % 3) for j in range(120)) for i in range(110)]
    assert dropped(of_sources(spark, bad)) >= set(range(600, 710))


def test_sources_of_other_habits_judge_one_text_differently(spark):
    """A text with 0.04 symbols a character passes where such are usual and goes where there are none."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, 5))
    text = lambda marks: " ".join(word() + ("$" if i < marks else "") for i in range(100))
    rows = [(i, text(16 if i % 2 else 0), "en", "maths" if i % 2 else "prose") for i in range(400)]
    same = text(20)
    docs = spark.createDataFrame([*rows, (1000, same, "en", "maths"), (1001, same, "en", "prose")], "doc_id long, text string, lang string, source string")
    assert {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs).where("doc_id >= 1000").collect()} == {1000: True, 1001: False}
    assert dropped(docs) == {1001}


def test_rules_of_no_rows_and_repeated_rows(spark):
    docs = frame(spark, ["a b", None])
    assert quality_rules.judge(docs.where("false")).count() == 0 and quality_rules.kept(docs.where("false")).count() == 0
    assert quality_rules.judge(docs.union(docs)).count() == 4
