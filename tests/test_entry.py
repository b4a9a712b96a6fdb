import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_registered():
    names, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(names) and len(names) >= 55


def test_flagship(spark):
    out = entry.entry(spark)
    assert {"id", "depth", "bytes", "included"} <= set(out.columns) and out.count() > 5


@pytest.mark.parametrize("name", ["namespace_counts", "knn_topk", "compact_first_fit", "heat_accumulate", "url_canonical", "kahn_residual"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in rel.description]
    plain = lambda rows: sorted(str(tuple(round(v, 5) if isinstance(v, float) else v for v in r)) for r in rows)
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(rel.fetchall())
