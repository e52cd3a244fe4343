"""Registered queries give what their SQL gives in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from quillmesh.plans import catalog

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        source = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM read_parquet('{source}')").fetchall()
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, views, name):
    mine = catalog.queries()[name](spark, SF)
    columns = sorted(mine.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in mine.collect()), key=str)
    cursor = views.cursor()
    result = cursor.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    assert got == want


@needs_data
@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["detect_card_luhn", "detect_counts", "detect_pages"])
def test_cards_side_by_side(spark, tmp_path, name):
    """As the SQL has it, which takes the character between two cards into the first one; the engine's rule finds both."""
    texts = ["see 2353820953013749 4550997810720808 there", "4111111111111111", "4111111111111111, 4550997810720808\n", "x4111 1111 1111 1111\n4550997810720808", "mail a@b.cc\u200b and 4550997810720808", None, ""]
    for table, columns in (("documents", "doc_id long, text string"), ("pages", "page_id long, html string")):
        spark.createDataFrame(list(enumerate(texts)), columns).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    cursor = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).select(*names).collect()) == sorted(cursor.fetchall())
    from quillmesh.operators import detect

    assert {e["value"] for e in detect.entities_of(texts[0]) if e["type"] == "CARD"} == {"4550997810720808"} | ({"2353820953013749"} if detect._card("2353820953013749") else set())


def test_golden_cases(spark):
    """The published scores of the rules alone, where the labelled cases are at hand (GOLDEN_CASES names their file)."""
    path = os.environ.get("GOLDEN_CASES", "")
    if not os.path.exists(path):
        pytest.skip("no labelled cases here")
    from pyspark.sql import functions as F

    from quillmesh.operators import detect, evaluate
    from quillmesh.sources.cases import read_cases

    cases = read_cases(spark, path)
    expected = detect.exploded(cases, "case_id")
    actual = detect.exploded(detect.with_entities(cases.drop("entities")), "case_id")
    pairs = evaluate.marked(expected, actual)
    row = evaluate.covered(pairs, cases).first()
    assert (row.expected_values, row.predicted_values, row.found_values, row.documents_with_entities, row.documents_fully_covered, row.values_left) == (72, 46, 40, 46, 20, 32)
    assert (row.recall, row.precision) == (0.5556, 0.8696)
    assert evaluate.per_type(pairs).where(F.col("type") == "PHONE").first().recall == 1.0
