"""Every query of the library with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from plumbline.plans import load

DATA = os.environ.get("PLUMBLINE_TEST_DATA", "/root/testdata/sf0.001")
REGISTRY = load()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in sorted(os.listdir(DATA)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def cell(v):
        if v is None or v != v:
            return "null"
        return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(cell(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(REGISTRY.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = REGISTRY.QUERIES[name](spark, DATA)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    want = duck.execute(REGISTRY.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == normal(want.fetchall(), columns)


def test_forest_is_kruskals(spark):
    """Boruvka rounds on a total order give the forest of the greedy method."""
    from plumbline.plans.networks import supplier_edges

    edges = sorted(supplier_edges(spark, DATA.replace("sf0.001", "sf0.01")).collect(), key=lambda e: (e.weight, e.edge_id))
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    kept = set()
    for e in edges:
        a, b = find(e.src), find(e.dst)
        if a != b:
            root[a] = b
            kept.add(e.edge_id)
    found = REGISTRY.QUERIES["spanning_forest"](spark, DATA.replace("sf0.001", "sf0.01")).collect()
    assert {r.edge_id for r in found} == kept


def test_routes_hold_their_invariants(spark):
    rows = REGISTRY.QUERIES["grid_route"](spark, DATA).collect()
    assert rows
    assert all(r.orthogonal and r.collision_free for r in rows)
    assert all((r.status == "pass") == (r.reason == "") for r in rows)


def test_every_part_asks_for_a_route(spark):
    asked = sorted(r.request for r in REGISTRY.QUERIES["grid_route"](spark, DATA).collect())
    assert asked == sorted(r.p_partkey for r in spark.read.parquet(f"{DATA}/part.parquet").collect())
