import math
from collections import Counter
from pathlib import Path

import pytest

from foliospark.plans import catalogue, oracles

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con(folder):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, folder, con, name):
    df = catalogue.queries()[name](spark, folder)
    cols = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    sql = oracles.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    assert Counter(tuple(plain(v) for _, v in sorted(zip(names, r, strict=True))) for r in got.fetchall()) == rows


def test_every_oracle_has_its_query():
    assert set(oracles.oracle_sql()) <= set(catalogue.queries())


def test_empty_tables(spark, folder, tmp_path):
    for f in Path(folder).glob("*.parquet"):
        spark.read.parquet(str(f)).limit(0).write.parquet(str(tmp_path / f.name))
    for name, q in catalogue.queries().items():
        assert q(spark, str(tmp_path)).count() == 0, name


def test_entry(spark, folder):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_scans_are_pruned(spark, folder):
    plan = catalogue.metadata_filter(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan and "PushedFilters: [IsNotNull(metadata.page_number)" in plan
