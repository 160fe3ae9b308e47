"""Every query with SQL beside it, on the smallest tables, in DuckDB and here."""

import os
import random

import pytest

import __spark_entry__ as entry
from kscreen.plans.oracles import ORACLE_SQL
from kscreen.plans.queries import QUERIES, SIZING

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE_SQL[name])
    columns, order = want.columns, sorted(got.columns)
    assert sorted(columns) == order
    pick = [columns.index(c) for c in order]
    assert sorted(repr(tuple(r)) for r in got.select(*order).collect()) == sorted(repr(tuple(r[i] for i in pick)) for r in want.fetchall())


@pytest.fixture(scope="module")
def overfull(spark, tmp_path_factory):
    """Tables whose benchmark has more k-mers than the filter of the SQL has room for, with odd texts."""
    import duckdb

    d, rng = str(tmp_path_factory.mktemp("overfull")), random.Random(7)
    text = lambda n: "".join(rng.choice("abcdefgH \u00c9\U0001f986\n") for _ in range(n))
    items = [(i, text(3000)) for i in range(10)] + [(10, None), (11, ""), (12, "short")]
    docs = [(i, text(150) + items[i][1][:100] + text(900)) for i in range(10)] + [(10, None), (11, ""), (12, "short")]
    con = duckdb.connect()
    for name, key, rows in (("benchmark", "item_id", items), ("documents", "doc_id", docs)):
        spark.createDataFrame(rows, f"{key} long, text string").write.parquet(f"{d}/{name}.parquet")
        con.sql(f"create view {name} as select * from '{d}/{name}.parquet/*.parquet'")
    assert con.sql(ORACLE_SQL["filter_info"]).fetchall()[0][-1] > SIZING.capacity
    return d, con


@pytest.mark.parametrize("name", ["bloom_membership", "bloom_words", "filter_info"])
def test_filter_equals_sql_beyond_its_capacity(spark, overfull, name):
    d, con = overfull
    got, want = QUERIES[name](spark, d), con.sql(ORACLE_SQL[name])
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())


def test_entry(spark):
    r = entry.entry(spark).first()
    assert (r.total_read_count, r.contaminated_reads, r.total_hits, r.all_k) == (4140, 7, 666, 485088)


def test_rows_only(spark):
    assert QUERIES["bloom_jenkins"](spark, SF).count() > 1000
    exact = QUERIES["kmer_spectrum"](spark, SF).count()
    assert abs(QUERIES["approx_distinct_kmers"](spark, SF).first()[0] - exact) < 0.1 * exact
