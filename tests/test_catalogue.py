"""Every query of the catalogue against its SQL on the smallest tables."""

import duckdb
import pytest

from graphfold.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"sim_join_text", "family_collapse", "threshold_ladder_cluster", "store_after_fold"}


def canonical(rows, columns):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(columns), sorted(tuple(text(r[i]) for i in places) for r in rows)


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(set(catalogue.ORACLES) - SLOW))
def test_matches_sql(spark, database, name):
    frame = catalogue.QUERIES[name](spark, FOLDER)
    found = canonical([tuple(r) for r in frame.collect()], frame.columns)
    wanted = database.sql(catalogue.ORACLES[name])
    assert found == canonical(wanted.fetchall(), wanted.columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES) - SLOW))
def test_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).limit(1).count()


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).columns == ["node", "degree"]
    assert set(contract.oracle_sql()) <= set(contract.queries())
