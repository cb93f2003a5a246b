"""Every query with SQL against DuckDB, and every other one for rows, at the smallest scale."""

import math

import duckdb
import pytest

from matrixweave.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    same = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v + 0.0, 6) if isinstance(v, float) else v
    return sorted((tuple(same(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    want = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert plain(map(tuple, got.select(*columns).collect())) == plain(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    """Rows, no column of nulls only, finite numbers that are not all one value, and the same result again."""
    once, again = (QUERIES[name](spark, SF).toPandas() for _ in range(2))
    assert len(once) and not once.isna().all().any()
    numbers = once.select_dtypes("number")
    assert (numbers.abs().max().dropna() < 1e15).all()
    assert len(once) == 1 or (once.nunique() > 1).any()
    assert plain(once.itertuples(index=False, name=None)) == plain(again.itertuples(index=False, name=None))


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_models_and_permutations_run_whole(spark, monkeypatch):
    import inspect

    from matrixweave.operators import nn

    seen = {}
    for name in ("classify", "importance", "encode_masked"):
        real = getattr(nn, name)

        def spy(*args, _name=name, _real=real, **more):
            own = inspect.signature(_real).bind(*args, **more)
            own.apply_defaults()
            seen[_name] = {k: own.arguments[k] for k in ("epochs", "steps") if k in own.arguments}
            return _real(*args, **more)

        monkeypatch.setattr(nn, name, spy)
    for name in ("node_classifier", "cluster_importance", "masked_embeddings"):
        QUERIES[name](spark, SF)  # built, not run again
    assert seen == {"classify": {"epochs": 120}, "importance": {"epochs": 120, "steps": 50}, "encode_masked": {"epochs": 150}}
    p = [r.p * 5001 for r in QUERIES["cooccurrence_test"](spark, SF).collect()]
    assert p and all(abs(x - round(x)) < 0.01 for x in p)
