"""Every catalog query against its oracle SQL in DuckDB."""

import datetime
import decimal

import duckdb
import pytest

from mnemoframe.plans import bandit, catalog, clusters, dialogue, expansion, insight, mentions, network, selection, signals, state, store, wording, writes  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 5) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    got = db.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, got.fetchall())


def test_all_have_an_oracle():
    """The greedy reranks have brute-force tests instead."""
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == {"l2_stored_memories", "o2_interference", "o3_diversified", "o6_within_shares", "r13_recall"}
