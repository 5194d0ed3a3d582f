"""Every query of the catalogues against its SQL on the smallest tables; those without SQL must give rows."""

import duckdb
import pytest

from docloom.plans import catalogues

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {n: q for c in catalogues() for n, q in c.queries.items()}
SQL = {n: s for c in catalogues() for n, s in c.sql.items()}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or v != v:
        return "none"
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    got = QUERIES[name](spark, sf)
    rows = got.collect()
    if name not in SQL:
        assert rows
        return
    want = con.sql(SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted([plain(r[c]) for c in columns] for r in rows) == sorted([plain(r[i]) for i in at] for r in want.fetchall())


def test_names_are_unique():
    assert len(QUERIES) == sum(len(c.queries) for c in catalogues())


def test_filters_reach_the_scan(spark, sf):
    plan = QUERIES["kg_read_range_contains"](spark, sf)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(p_" in plan and "p_brand" not in plan.split("ReadSchema")[1]
    assert "LocalTableScan <empty>" in QUERIES["kg_scope_to_nothing"](spark, sf)._jdf.queryExecution().toString()


def test_reduced_notes_depend_on_every_note(spark):
    long = "a note of more than fifty characters, which a prefix of the group would stop in"
    rows = [(1, i, t, 0) for i, t in enumerate([long] * 5)] + [(2, i, t, 0) for i, t in enumerate([long] * 4 + [long + " other"])]
    notes = spark.createDataFrame(rows, "conv_id long, turn long, text string, role long")
    from docloom.plans import answering

    got = [r[1] for r in answering.reduce_notes(lambda name: notes).collect()]
    assert len(set(got)) == 2
