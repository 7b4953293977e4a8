"""The driver contract in __spark_entry__.py."""

import __spark_entry__ as E
from quire.plans import registry

SF = "/root/testdata/sf0.001"


def test_every_query_of_the_catalog_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert len(registry.QUERIES) >= 40
    assert set(E.oracle_sql()) <= set(E.queries()) >= set(registry.QUERIES)


def test_entry_runs_with_stable_schema(spark):
    df = E.entry(spark)
    assert df.columns == ["id", "rid", "source_api", "categories", "year", "month", "doi",
                          "citation_count", "open_access"]
    assert df.count() >= 0


def test_cheap_queries_run_on_the_smallest_tables(spark):
    q = E.queries()
    for name in ["top_categories", "ingest_keep_first", "year_floor", "next_id", "props_violations"]:
        assert q[name](spark, SF).count() >= 0
