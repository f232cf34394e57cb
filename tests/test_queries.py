"""Every query with SQL against DuckDB on the small tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tracemill.plans import catalog as own

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5)
    return float(x) if type(x).__name__ == "Decimal" else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(own.SQL))
def test_query(spark, duck, name):
    df = own.QUERIES[name](spark, SF)
    want = duck.sql(own.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    got, known = rows_of(df.columns, df.collect()), rows_of(want.columns, want.fetchall())
    assert len(got) == len(known)
    for a, b in zip(got, known):
        assert a == pytest.approx(b) if all(isinstance(x, float) for x in a) else all(
            x == pytest.approx(y, abs=2e-5) if isinstance(x, float) and isinstance(y, (int, float)) else x == y for x, y in zip(a, b)
        ), (a, b)


def test_question_overlap_is_by_normalized_text_or_prefix(spark, tmp_path):
    long = "What  is the\nsum of all whole numbers from one to one hundred, and why is it so?"
    docs = [(1, "HOW many\t apples "), (2, long[:66] + " another end"), (3, "x how many apples"), (4, None), (5, " "), (6, long.lower())]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    questions = [("how many apples",), (long,), (None,), ("",)]
    spark.createDataFrame(questions, "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = own.QUERIES["j12_question_overlap"](spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2, 6]
