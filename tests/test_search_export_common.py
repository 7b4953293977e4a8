"""Search scoring, exports and the hot-group primitives."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import export, search
from quire.operators.common import ordered_rank, salted_top_k

ENTRY = ("ord bigint, id string, type string, title string, abstract string, authors array<string>, "
         "categories array<string>, tags array<string>, venue string, year int, month int, "
         "citation_count bigint, reviewed boolean, doi string, url string, added_by string, source_api string, "
         "external_ids struct<arxiv_id:string,semantic_scholar_id:string,doi:string>, "
         "framework_mappings map<string,array<string>>")


def entries(spark):
    rows = [
        (0, "qc-2024-00001", "paper", "Prompt Injection Attacks", "We study injection.", ["Ann Lee", "Bo Chen"],
         ["prompt-injection"], [], "USENIX", 2024, 3, 12, True, "10.1/a", "https://x/1", None, None,
         ("2401.1", None, "10.1/a"), {"owasp_llm_top10": ["LLM01"], "mitre_atlas": []}),
        (1, "qc-2024-00002", "tool", "Federated Learning Privacy", None, ["Cy", "Di", "Ed", "Fa"],
         ["federated-learning"], ["privacy"], None, 2023, None, None, None, None, "https://x/2", "automation",
         "arxiv", (None, None, None), {}),
    ]
    return spark.createDataFrame(rows, ENTRY)


def test_query_terms():
    assert search.query_terms("  Prompt  injection, a PROMPT ") == ["prompt", "injection"]
    assert search.query_terms("a") == []


def test_search_scores_and_order(spark):
    df = entries(spark)
    hits = {r.ord: r.score for r in search.search(df, "prompt injecton").collect()}
    # title: "prompt" contained (0), "injecton" -> "injection" one edit (1/8):
    # d_title = 0.0625, a hit worth 0.4 * 0.9375. The abstract misses "prompt"
    # (d = (1 + 1/8) / 2 > 0.35); categories normalise to "promptinjection"
    # (d = (0 + 7/8) / 2 > 0.35).
    assert hits == {0: 0.375}
    page, total = search.search_or_browse(df, "privacy")
    assert [r.ord for r in page.collect()] == [1] and total.first()["total"] == 1
    page, total = search.search_or_browse(df, " ")
    assert [r.ord for r in page.collect()] == [0, 1] and total.first()["total"] == 2


def test_bibtex_and_cards(spark):
    df = entries(spark)
    b = {r.ord: r.b for r in df.select("ord", export.bibtex(df).alias("b")).collect()}
    assert b[0] == ("@article{qc202400001,\n  title = {Prompt Injection Attacks},\n  author = {Ann Lee and Bo Chen},\n"
                    "  year = {2024},\n  journal = {USENIX},\n  doi = {10.1/a},\n  url = {https://x/1},\n}")
    assert "journal" not in b[1] and "doi" not in b[1]
    c = {r.ord: r for r in export.cards(df).collect()}
    assert c[0].published == "2024-03" and c[1].published == "2023"
    assert c[1].authors_short == "Cy, Di, Ed + 1 more"
    assert c[0].citations == "12 citations" and c[1].citations is None
    assert c[0].added_by == "manual" and c[1].source == "arxiv"
    assert c[0].external_ids == "arxiv_id=2401.1;doi=10.1/a" and c[1].external_ids == ""
    assert c[0].frameworks == "owasp_llm_top10:LLM01" and c[0].show_mappings and not c[1].show_mappings


def skewed(spark):
    # one group holds a third of the rows
    rows = [(i, "hot" if i % 3 == 0 else f"g{i % 7}", (i * 37) % 101) for i in range(600)]
    return spark.createDataFrame(rows, "id bigint, g string, v int")


def test_ordered_rank_matches_window(spark):
    df = skewed(spark)
    order = [F.col("v").desc(), F.col("id").asc()]
    got = {r.id: r["rank"] for r in ordered_rank(df, ["g"], order, num_partitions=7).collect()}
    want = {r.id: r.rn for r in df.withColumn("rn", F.row_number().over(
        Window.partitionBy("g").orderBy(*order))).collect()}
    assert got == want


def test_salted_top_k_matches_window(spark):
    df = skewed(spark)
    order = [F.col("v").desc(), F.col("id").asc()]
    got = sorted((r.g, r["rank"], r.id) for r in salted_top_k(df, ["g"], order, 3, "id", salt_buckets=8).collect())
    w = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy(*order))).filter("rn <= 3")
    assert got == sorted((r.g, r.rn, r.id) for r in w.collect())


def test_stored_index_finds_what_the_scan_finds(spark, tmp_dir):
    rows = [(0, "Prompt injection", "defence of agents", ["A. Lee"], ["survey"], ["x"], "ACM"),
            (1, "Promt injecton", None, [], [], None, None), (2, "Bird song", "no match", ["B"], ["c"], [], ""),
            (3, None, "prompts and injections", None, None, None, None)]
    df = spark.createDataFrame(rows, "ord long, title string, abstract string, authors array<string>, "
                                     "categories array<string>, tags array<string>, venue string")
    index = search.write_index(df, f"{tmp_dir}/index")
    for q, hits in (("prompt injection", [0, 1, 3]), ("agents", [0]), ("injection zzzz", []), ("bird", [2])):
        want = sorted((r.ord, r.score) for r in search.search(df, q).collect())
        assert [o for o, _ in want] == hits
        assert sorted((r.ord, r.score) for r in search.search_index(index, q).collect()) == want
    assert search.search_index(index, " . ").count() == 0
