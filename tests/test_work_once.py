"""Work on whole texts is done once, whatever Spark samples, counts or filters."""

from pyspark.sql import functions as F

from quire.functions import tagging
from quire.operators import quality, search
from quire.plans import batches as bt
from quire.plans import registry
from quire.sources import sinks

N = 40


def counted(spark, df, col):
    """``df`` with ``col`` made by a function, and how often it was called."""
    calls = spark.sparkContext.accumulator(0)

    def same(x):
        calls.add(1)
        return x

    return df.withColumn(col, F.udf(same, "string").asNondeterministic()(col)), calls


def test_search_index_splits_each_text_once(spark, tmp_dir):
    df = spark.createDataFrame([(i, f"word{i} apache", "", ["Roe"], ["c"], ["t"], "v") for i in range(N)],
                               "ord long, title string, abstract string, authors array<string>, "
                               "categories array<string>, tags array<string>, venue string")
    df, calls = counted(spark, df, "title")
    posts = search.write_index(df, f"{tmp_dir}/index")
    assert search.search_index(posts, "apache").count() == N and calls.value == N


def test_report_places_checks_each_record_once(spark):
    df = spark.createDataFrame([(i, "authors.2", "type") for i in range(N)], "ord long, path string, rule string")
    df, calls = counted(spark, df, "rule")
    got = quality.report_places(df).orderBy("place").collect()
    assert [r.ord for r in got] == list(range(N)) and calls.value == N


def test_doi_changes_are_found_once(spark, tmp_dir):
    df = spark.createDataFrame([(i, f"10.1/{i}" if i % 2 else None) for i in range(N)], "ord long, new_doi string")
    df, calls = counted(spark, df, "new_doi")
    assert sinks.write_doi_delta(df, f"{tmp_dir}/delta") == N // 2 and calls.value == N


def test_id_hits_read_no_text_after_the_status_is_known(spark, monkeypatch):
    cands = spark.createDataFrame(
        [("arxiv", 0, i, "Jailbreak", ["A"], 2024, "", "https://e.org", "10.1/x" if i else "", "", "") for i in range(3)],
        "source string, source_ord int, pos long, title string, authors array<string>, year int, abstract string, "
        "url string, doi string, arxiv_id string, semantic_scholar_id string")
    held = spark.createDataFrame([(0, "10.1/X", (None, None, None))], "ord long, doi string, "
                                 "external_ids struct<arxiv_id:string,semantic_scholar_id:string,doi:string>")
    monkeypatch.setattr(bt, "candidates", lambda *_: cands)
    monkeypatch.setattr(bt, "catalog_part", lambda *_: held)
    monkeypatch.setattr(bt, "demo_rules", lambda *_: tagging.rules_frame(spark))
    got = registry.q_catalog_id_hits(spark, "")
    assert sorted(r.rid for r in got.collect()) == [2, 3]
    assert "abstract" not in got._jdf.queryExecution().optimizedPlan().toString()
