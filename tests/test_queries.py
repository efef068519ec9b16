"""Every registered query against its SQL counterpart, on the smallest tables."""

import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from corpuskit.plans import oracles, registry
from corpuskit.plans.fixtures import BASE, view

QUERIES, ORACLES = registry.QUERIES, oracles.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    return int(value) if isinstance(value, decimal.Decimal) and value == int(value) else value


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(row[i]) for i in order]) for row in rows)


def test_names():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_result(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical(df.columns, df.collect()) == canonical(names, result.fetchall())


def test_spans_hold_every_character(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(length(replace(text, '\n', ''))) AS n").first().n
    assert view(spark, sf_dir, "spans").selectExpr("sum(length(text)) AS n").first().n >= docs


def test_ordered_results(spark, sf_dir):
    rows = QUERIES["admin_books"](spark, sf_dir).collect()
    assert rows == sorted(rows, key=lambda r: (r.created_at, r.id), reverse=True)
    tail = QUERIES["tail_logs"](spark, sf_dir).collect()
    assert [r.id for r in tail] == sorted(r.id for r in tail)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
