"""The n-gram Jaccard join against all pairs."""

from __future__ import annotations

import random

import pytest

from lodequery.llm import jaccard_join

SF = "/root/testdata/sf0.001"


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    return [w for w in lower.split(" ") if w]


def shingles(text, n=5):
    w = words_of(text)
    return {tuple(w[i : i + min(n, len(w))]) for i in range(len(w) - min(n, len(w)) + 1)} if w else set()


def brute(texts, threshold=0.8):
    """(class, links) of each text: classes by least index."""
    sets, n = [shingles(t) for t in texts], len(texts)
    root, links = list(range(n)), [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (find(i), links[i]) for i in range(n)}


def planted(copies=60, seed=4):
    """A group of near copies over several blocks, exact copies, a chain, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(150)]
    texts = []
    for _ in range(copies):
        own = list(base)
        for _ in range(rng.randrange(0, 4)):
            own[rng.randrange(150)] = word()
        texts.append(" ".join(own))
    texts += [texts[0].upper()] * 3 + [texts[1].replace(" ", "\n\t")]
    chain = [word() for _ in range(200)]
    for i in range(6):  # neighbours are near copies, the ends are not
        texts.append(" ".join(chain[8 * i : 8 * i + 150]))
    return texts + ["one two", "One  two", "one", "", None, " \n", "", *(" ".join(word() for _ in range(30)) for _ in range(40))]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "k", i) for i, t in enumerate(texts)], "doc_id long, text string, key string, mark int")


@pytest.mark.parametrize("blocks", [{}, {"bucket_block": 8, "block": 4}, {"most_sent": 0}])
def test_planted_groups(spark, blocks):
    texts = planted()
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.join(frame(spark, texts).repartition(3), **blocks).collect()}
    assert got == brute(texts)


def test_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    texts = [r["text"] for r in rows]
    got = jaccard_join.join(frame(spark, texts)).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == brute(texts)


@pytest.mark.parametrize("most_sent", [2_000_000, 0])
def test_one_of_each_class_stays(spark, most_sent):
    texts = planted(20)
    classes = brute(texts)
    docs = frame(spark, texts)
    kept = jaccard_join.kept(docs, most_sent=most_sent)
    assert kept.columns == docs.columns
    got = sorted(r["doc_id"] for r in kept.collect())
    assert got == sorted({c for c, _ in classes.values()})
    twice = jaccard_join.kept(docs.union(docs), most_sent=most_sent)
    assert sorted(r["doc_id"] for r in twice.collect() if words_of(r["text"])) == [i for i in got if words_of(texts[i])]


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.join(docs).collect()), key=str)
    assert got == sorted([(7, 7, 2), (None, 7, 2), (None, 7, 2), (None, None, 0)], key=str)
    assert [r["doc_id"] for r in jaccard_join.kept(docs).where("text is not null").collect()] == [7]
    assert jaccard_join.join(docs.where("false")).count() == 0 and jaccard_join.kept(docs.where("false")).count() == 0


def test_pruning_rarely_drops_pairs_at_the_threshold():
    """P(fewer agreements than allowed | similarity = threshold) stays small at every step."""
    from math import comb

    lost = 0.0
    for n, m in jaccard_join.least_agreements(0.8, 1e-6):
        lost += sum(comb(n, i) * 0.8**i * 0.2 ** (n - i) for i in range(m))
    assert lost < 1e-4


@pytest.mark.parametrize("block", [1, 3, 8, 100])
def test_each_pair_of_a_group_meets_once_without_numbering_the_group(spark, block):
    from collections import Counter

    sizes = {1: 1, 2: 2, 3: 9, 4: 40}
    rows = [(g, f"{g}-{i}") for g, n in sizes.items() for i in range(n)]
    out = jaccard_join.in_blocks(spark.createDataFrame(rows, "bucket long, key string"), "bucket", "key", block)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    met, groups = Counter(), {}
    for r in out.collect():
        groups.setdefault(r["g"], []).append((r["side"], r["key"]))
    for own in groups.values():
        a, b = jaccard_join.pairs_of(jaccard_join.np.array([x for x, _ in own]))
        met.update(frozenset((own[i][1], own[j][1])) for i, j in zip(a, b, strict=True))
    want = {frozenset((f"{g}-{i}", f"{g}-{j}")) for g, n in sizes.items() for i in range(n) for j in range(i)}
    assert set(met) == want and set(met.values()) == {1}


def test_components_that_have_not_settled_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    with pytest.raises(RuntimeError, match="settled"):
        jaccard_join.components(chain, most_rounds=1)
    assert {(r["node"], r["root"]) for r in jaccard_join.components(chain).collect()} == {(i, 0) for i in range(65)}
