"""Every query with a SQL twin gives the same rows in Spark and in DuckDB, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import rows, views

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return views(SF)


@pytest.mark.parametrize("name", [k for m in entry.PLANS for k in sorted(m.ORACLES)])
def test_same_rows(spark, db, name):
    df = entry.queries()[name](spark, SF)
    twin = db.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(twin.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(list(twin.columns), twin.fetchall())


@pytest.mark.parametrize("name", ["grf05b_find_every_symbol", "grf06b_who_calls_every_symbol", "grf08b_context_of_every_symbol"])
def test_lookups_cover_every_name(spark, db, name):
    from lodequery.sources.tables import graph

    nodes, edges = graph(spark, SF)
    wanted = nodes if name != "grf06b_who_calls_every_symbol" else nodes.join(edges.where("type = 'calls'").selectExpr("target AS id"), "id", "left_semi")
    assert {r["name"] for r in entry.queries()[name](spark, SF).select("name").collect()} == {r["name"] for r in wanted.select("name").collect()}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_call_sites_are_resolved_at_every_size(spark, size):
    """All called parts but the ambiguous tenths are targets, and only definitions of a called name are."""
    sf = f"/root/testdata/{size}"
    targets = {int(r[0][1:]) for r in entry.queries()["jon07b_resolved_calls_by_full_name"](spark, sf).select("target").distinct().collect()}
    called = {r[0] for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey").distinct().collect()}
    parts = {r[0] for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey").collect()}
    groups = {}
    for key in parts:
        groups.setdefault(key // 30 if key % 10 == 0 else ("pair", key // 10) if key % 10 <= 2 else ("own", key), set()).add(key)
    want = {key for own in groups.values() if len(own) <= 2 and own & called for key in own}
    assert targets == want and len(want) > 0.8 * len(called & parts)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_resolved_calls_hold_those_of_either_name(spark, size):
    """Every call of a name that has up to 40 definitions is resolved, the plain name's and the full one's."""
    sf, name = f"/root/testdata/{size}", "jon07_resolved_calls"
    db = views(sf)
    plain = "WITH def AS (SELECT p_partkey AS key, p_name AS name FROM part), tg AS (SELECT name FROM def GROUP BY name HAVING count(DISTINCT key) <= 40) SELECT DISTINCT 's' || l_suppkey AS source, 'p' || d.key AS target FROM lineitem JOIN def c ON c.key = l_partkey JOIN def d ON d.name = c.name JOIN tg ON tg.name = d.name"
    got = {tuple(r) for r in entry.queries()[name](spark, sf).select("source", "target").collect()}
    full = {tuple(r) for r in entry.queries()["jon07b_resolved_calls_by_full_name"](spark, sf).select("source", "target").collect()}
    assert got >= full | set(db.sql(plain).fetchall()) and got == {r for r in db.sql(f"SELECT source, target FROM ({ORACLES[name]})").fetchall()}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
