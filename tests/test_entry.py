"""The driver's contract."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_names_agree(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60
    for name in ("intersect", "closest", "coverage", "merge"):
        assert queries[name](spark, SF).columns


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["chrom", "start_x", "end_x", "name_x", "name_y", "dist"] and df.count() > 0


@pytest.mark.parametrize("name", ["exons", "introns", "utrs5", "utrs3", "tss"])
def test_genes_of_all_orders(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    # the twin over the whole table, whether or not it has a filter of its own
    sql = entry.oracle_sql()[name].replace("WHERE l_orderkey % 10 = 0", "")
    got = entry.queries()[name](spark, SF)
    order = lambda rows: sorted(map(repr, rows))
    assert order(map(tuple, got.collect())) == order(con.execute(sql).fetchall())
