import duckdb
import pytest

import corpus_pipeline
from hopweave import llm

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        assert 0.5 * n < out.count() <= n, name
    assert corpus_pipeline.run(spark, SMALL).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_queries_equal_their_sql(spark, name, tmp_path):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    out = str(tmp_path / "out")
    llm.queries()[name](spark, SMALL).write.parquet(out)
    con.execute(f"create table o as {llm.oracle_sql()[name]}")
    cols = ", ".join(c[0] for c in con.execute("describe o").fetchall())
    for a, b in (("o", f"'{out}/*.parquet'"), (f"'{out}/*.parquet'", "o")):
        assert con.execute(f"select count(*) from (select {cols} from {a} except all select {cols} from {b})").fetchone() == (0,)
