"""Every query against its SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from foliant.plans import registry

DATA = os.environ.get("FOLIANT_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    con = duckdb.connect()
    for name in sorted(os.listdir(DATA)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(rows, columns, names):
    order = [columns.index(n) for n in sorted(names)]
    tidy = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(tidy(r[i]) for i in order) for r in rows), key=repr)


def test_same_names():
    assert set(registry.SQL) == set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, DATA)
    want = db.execute(registry.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    a, b = plain([tuple(r) for r in got.collect()], got.columns, columns), plain(want.fetchall(), columns, columns)
    assert len(a) == len(b) and a == b


def test_boundaries_of_accented_words(spark, tmp_path):
    """Pages that start with a joining word and then an accented letter: the SQL's words end by ASCII."""
    starts = ("INÄTZ WORT", "ASÓ WORT", "Toé wort", "In DAS", "FORT WORT", "OF_X WORT", "BY9 WORT", "ÄIN WORT")
    pages = [f"{start} {'WORT ' * 60}"[:300] for start in starts]
    docs = [(i, "".join([pages[-1], *pages[i:], *pages[:i]])) for i in range(len(pages))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = registry.QUERIES["page_boundaries"](spark, str(tmp_path)), con.execute(registry.SQL["page_boundaries"])
    columns = [c[0] for c in want.description]
    rows = want.fetchall()
    assert plain([tuple(r) for r in got.collect()], got.columns, columns) == plain(rows, columns, columns)
    high = {r[columns.index("next_head")][:5] for r in rows if r[columns.index("severity")] == "high" and r[columns.index("joiner")] == "space"}
    assert {"INÄTZ", "ASÓ W", "Toé w", "In DA"} == high
