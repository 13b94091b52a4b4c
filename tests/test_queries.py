"""Every query against its SQL on the smallest sample."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as contract
from pubweave.plans.oracle import all_oracles
from pubweave.plans.queries import all_queries

QUERIES = all_queries()
ORACLES = all_oracles()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for file in os.listdir(sf_dir):
        connection.execute(
            f"CREATE VIEW {file.removesuffix('.parquet')} AS FROM '{sf_dir}/{file}'"
        )
    return connection


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, sf_dir, name):
    result = QUERIES[name](spark, sf_dir)
    columns = sorted(result.columns)
    ours = Counter(tuple(row[c] for c in columns) for row in result.collect())
    answer = duck.execute(ORACLES[name])
    names = [column[0] for column in answer.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = Counter(tuple(row[i] for i in order) for row in answer.fetchall())
    assert ours == theirs


def test_entry(spark):
    assert contract.entry(spark).columns == ["id", "tag"]
