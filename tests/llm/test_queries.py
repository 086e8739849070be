from collections import Counter
from pathlib import Path

import pytest

from foliospark.llm import queries as Q

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, folder, name):
    df = Q.queries()[name](spark, folder)
    rows = df.collect()
    assert len(rows) > 0
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)
    if name in Q.oracle_sql():
        con = duckdb.connect()
        for f in Path(folder).glob("*.parquet"):
            con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        got = con.execute(Q.oracle_sql()[name])
        assert [d[0] for d in got.description] == df.columns
        assert Counter(got.fetchall()) == Counter(map(tuple, rows))


def test_empty_tables(spark, folder, tmp_path):
    for f in Path(folder).glob("*.parquet"):
        spark.read.parquet(str(f)).limit(0).write.parquet(str(tmp_path / f.name))
    for name, q in Q.queries().items():
        assert q(spark, str(tmp_path)).count() == 0, name
