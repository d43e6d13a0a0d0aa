"""Draws of dishes of few customers without logarithms, and the form in which a block's replies reach it."""

import numpy as np

from lodequery.llm import pitman_yor, seating


def test_plain_weights_draw_as_logarithms_do(monkeypatch):
    rng = np.random.default_rng(3)
    for discount in (0.2, 0.73, 0.95):
        n = 4000
        c, others, base, chance = rng.integers(1, 80, n), 10 ** rng.uniform(0, 7, n) - 1, 10 ** -rng.uniform(0, 8, n), rng.random(n)
        with monkeypatch.context() as m:
            m.setattr(seating, "FEW", 0)
            want = seating.draw_tables(c, others, base, discount, 1.5, chance)
        assert seating.draw_tables(c, others, base, discount, 1.5, chance).tolist() == want.tolist()


def test_plain_weights_too_large_fall_back():
    n = 50
    c, others, base, chance = np.full(n, 48), np.full(n, 1e12), np.full(n, 1.0), (np.arange(n) + 0.5) / n
    assert seating.draw_of_few(c, others, base, 0.9, 1.0, chance, 48) is None
    assert seating.draw_tables(c, others, base, 0.9, 1.0, chance).tolist() == [48] * n


def test_a_blocks_replies_stay_rows(spark):
    docs = spark.createDataFrame([(i, f"a b c{i % 3} a b") for i in range(20)], "doc_id long, text string")
    rows = pitman_yor.score(docs)
    plan = rows._jdf.queryExecution().toString()
    assert "collect_list" not in plan  # one row of all replies was as large as block and replies, and some of these shared a batch
    assert rows.count() == 20
