"""Every query of the engine against its SQL, on the smallest tables."""

import duckdb
import pytest

from hopweave import queries as Q

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(Q.queries()))
def test_equal_to_sql(spark, con, name, tmp_path):
    out = str(tmp_path / "out")
    Q.queries()[name](spark, SMALL).write.parquet(out)
    if name not in Q.oracle_sql():
        assert con.execute(f"select count(*) from '{out}/*.parquet'").fetchone()[0] > 0
        return
    con.execute(f"create or replace table o as {Q.oracle_sql()[name]}")
    types = {c[0]: c[1] for c in con.execute("describe o").fetchall()}
    found = {c[0]: c[1] for c in con.execute(f"describe select * from '{out}/*.parquet'").fetchall()}
    assert sorted(types) == sorted(found)
    cols = ", ".join(f'"{c}"' for c in types)
    for a, b in (("o", f"'{out}/*.parquet'"), (f"'{out}/*.parquet'", "o")):
        assert con.execute(f"select count(*) from (select {cols} from {a} except all select {cols} from {b})").fetchone() == (0,)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(Q.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
