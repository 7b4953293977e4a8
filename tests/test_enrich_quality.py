"""DOI backfill, facets, analytics and schema validation on literal frames."""

import json

from pyspark.sql import functions as F

from quire.operators import analytics, enrich, quality
from quire.sources import dims

CAT = ("ord bigint, id string, type string, title string, year int, doi string, "
       "external_ids struct<arxiv_id:string,semantic_scholar_id:string,doi:string>")


def test_backfill_threshold_inclusive_and_year_band(spark):
    shared = " ".join(f"t{i}" for i in range(17))
    cat = spark.createDataFrame([
        (0, "e0", "paper", shared + " a1 a2 a3", 2024, None, (None, None, None)),   # J = 0.85 with lookup 0
        (1, "e1", "paper", "alpha beta gamma", None, "", (None, None, "")),          # null year passes
        (2, "e2", "book", "delta epsilon zeta", 2020, None, (None, None, None)),     # 2 years apart: no
        (3, "e3", "paper", "eta theta iota", 2020, None, ("2401.00001", None, None)),  # arXiv wins
        (4, "e4", "tool", "kappa", 2020, None, (None, None, None)),                   # not eligible
    ], CAT)
    lookup = spark.createDataFrame([
        (0, shared, 2023, "10.1/a"), (1, "alpha beta gamma", 2001, "10.1/b"),
        (2, "delta epsilon zeta", 2022, "10.1/c"), (3, "eta theta iota", 2020, "10.1/d"),
        (4, "eta theta iota", 2020, ""),
    ], "rank bigint, title string, year int, doi string")
    meta = spark.createDataFrame([("2401.00001", "10.2/x")], "arxiv_id string, doi string")
    got = {r.ord: (r.new_doi, r.doi_source) for r in enrich.backfill(cat, meta, lookup).collect()}
    assert got == {0: ("10.1/a", "crossref"), 1: ("10.1/b", "crossref"), 2: (None, None), 3: ("10.2/x", "arxiv")}
    counts = {r.doi_source: r.n for r in enrich.backfill_counters(enrich.backfill(cat, meta, lookup)).collect()}
    assert counts == {"crossref": 2, "arxiv": 1, "none": 1}


def entries(spark):
    rows = [(0, "a", "paper", 2024, 5, True, ["x", "y", "x"]), (1, "b", "book", 2025, None, None, ["y"]),
            (2, "c", "paper", 2025, 12, False, ["z"])]
    return spark.createDataFrame(rows, "ord bigint, id string, type string, year int, citation_count int, "
                                       "reviewed boolean, categories array<string>")


def test_reviewed_null_in_neither_facet(spark):
    df = entries(spark)
    assert {r.id for r in analytics.facet_filter(df, reviewed="true").collect()} == {"a"}
    assert {r.id for r in analytics.facet_filter(df, reviewed="false").collect()} == {"c"}


def test_catalog_order_and_top_k(spark):
    df = entries(spark)
    assert [r.id for r in analytics.most_recent(df, 2).collect()] == ["c", "b"]
    assert [r.id for r in analytics.most_cited(df, 5).collect()] == ["c", "a"]


def test_category_counts_and_listing(spark):
    df = entries(spark)
    counts = {r.category_id: r.n for r in analytics.category_counts(df).collect()}
    assert counts == {"x": 2, "y": 2, "z": 1}           # occurrences
    top = [r.category_id for r in analytics.top_categories(df, 2).collect()]
    assert top == ["x", "y"]                            # tie: first seen
    lst = analytics.category_listing(df).filter("category_id = 'x'").collect()
    assert len(lst) == 1                                 # once per entry


def test_taxonomy_dims(spark):
    tax = dims.taxonomy(spark)
    assert analytics.taxonomy_totals(tax).first().asDict() == {"n_domains": 8, "n_categories": 46}
    assert dims.frameworks(spark).count() == 55


def viol(spark, records):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "ord bigint, raw string")
    return sorted((r.ord, r.path, r.rule) for r in quality.validate_json(df, "ord", "raw", quality.entry_schema("qc")).collect())


GOOD = {"id": "qc-2024-00001", "type": "paper", "title": "T", "authors": ["A"], "year": 2024,
        "url": "not a uri but format is not checked", "categories": ["survey"], "added_date": "2024-01-01",
        "reviewed": True, "external_ids": {"doi": "10.1/x"}, "framework_mappings": {"mitre_atlas": ["AML.T0000"]}}


def test_schema_good_record_and_integer_forms(spark):
    ok_float = dict(GOOD, year=2024.0)
    assert viol(spark, [json.dumps(GOOD), json.dumps(ok_float)]) == []


def test_schema_faults(spark):
    recs = [dict(GOOD, year=True), dict(GOOD, type="poem"), dict(GOOD, id="bad"), dict(GOOD, title=""),
            dict(GOOD, authors=[]), dict(GOOD, month=13), dict(GOOD, extra=1),
            dict(GOOD, external_ids={"isbn": "1"}), dict(GOOD, framework_mappings={"other": []}),
            {k: v for k, v in GOOD.items() if k != "reviewed"}, dict(GOOD, citation_count=-1),
            dict(GOOD, authors=["A", 3])]
    got = viol(spark, [json.dumps(r) for r in recs] + ["{not json"])
    assert got == [(0, "year", "type"), (1, "type", "enum"), (2, "id", "pattern"), (3, "title", "minLength"),
                   (4, "authors", "minItems"), (5, "month", "maximum"), (6, "", "additionalProperties"),
                   (7, "external_ids", "additionalProperties"), (8, "framework_mappings", "additionalProperties"),
                   (9, "reviewed", "required"), (10, "citation_count", "minimum"), (11, "authors.1", "type"),
                   (12, "", "parse")]


def test_rules_are_independent_and_items_have_places(spark):
    recs = [dict(GOOD, type=5), dict(GOOD, year=2016.5), dict(GOOD, citation_count=-1.5),
            dict(GOOD, authors=[1, 2, "x"]), dict(GOOD, external_ids={"b": 1, "a": 2, "doi": 7}),
            dict(GOOD, categories="survey"), [1]]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(recs)], "ord bigint, raw string")
    got = sorted((r.ord, r.path, r.rule, r.value) for r in
                 quality.validate_json(df, "ord", "raw", quality.entry_schema("qc")).collect())
    assert got == [(0, "type", "enum", "5"), (0, "type", "type", "5"), (1, "year", "minimum", "2016.5"),
                   (1, "year", "type", "2016.5"), (2, "citation_count", "minimum", "-1.5"),
                   (2, "citation_count", "type", "-1.5"), (3, "authors.0", "type", "1"), (3, "authors.1", "type", "2"),
                   (4, "external_ids", "additionalProperties", "a,b"), (4, "external_ids.doi", "type", "7"),
                   (5, "categories", "type", '"survey"'), (6, "", "type", "[1]")]


def test_documents_without_their_list_are_reported(spark):
    def check(fn, doc):
        raw = spark.createDataFrame([(doc if isinstance(doc, str) else json.dumps(doc),)], "raw string")
        return sorted((r.ord, r.path, r.rule) for r in fn(raw).collect())

    tax, cat = quality.validate_taxonomy, quality.validate_catalog
    assert check(tax, {}) == [(-1, "domains", "required")]
    assert check(tax, {"domains": [], "x": 1}) == [(-1, "", "additionalProperties")]
    assert check(tax, {"domains": "no"}) == [(-1, "domains", "type")]
    assert check(tax, "{") == [(-1, "", "parse")]
    assert check(cat, {}) == [(-1, "entries", "required")]
    assert check(cat, {"entries": [GOOD, dict(GOOD, id="?")]}) == [(1, "entries.1.id", "pattern")]
    many = {"domains": [{"id": "d", "label": "D", "categories": [{"id": "c", "label": 1}]}] * 3}
    assert [r[1] for r in check(tax, many)] == [f"domains.{i}.categories.0.label" for i in range(3)]


def test_duplicate_ids_and_unknown_categories(spark):
    df = spark.createDataFrame([(0, "a", ["survey", "nope", "nope"]), (1, "a", ["book"])],
                               "ord bigint, id string, categories array<string>")
    assert [(r.id, r.n) for r in quality.duplicate_ids(df).collect()] == [("a", 2)]
    unk = quality.unknown_categories(df, dims.taxonomy(spark)).collect()
    assert len(unk) == 2                                   # duplicates kept
    v = {r.check: r.errors for r in quality.verdict(
        quality.validate_json(df.select("ord", F.lit("{}").alias("raw")), "ord", "raw", quality.category_schema()),
        quality.duplicate_ids(df), quality.unknown_categories(df, dims.taxonomy(spark))).collect()}
    assert v == {"schema": 4, "duplicate_ids": 1, "unknown_categories": 2, "passed": 3}


def test_taxonomy_validation_and_order(spark):
    doc = {"domains": [
        {"id": "d1", "label": "D1", "categories": [{"id": "c1", "label": "C1"}, {"id": "c2"}]},
        {"label": "D2", "categories": [], "colour": "red"}]}
    raw = spark.createDataFrame([(json.dumps(doc),)], "raw string")
    got = [(r.path, r.rule) for r in quality.ordered(quality.validate_taxonomy(raw)).collect()]
    assert got == [("domains.0.categories.1.label", "required"), ("domains.1", "additionalProperties"),
                   ("domains.1.id", "required")]


def test_violations_sort_by_the_steps_of_their_paths(spark):
    paths = ["authors.10", "authors.2", "authors", "", "authors.2.name", "authors.10.name", "abstract", "tags.0", "authors.9"]
    rows = [(o, p, r) for o in (1, 0) for p in paths for r in ("type", "required")]
    v = spark.createDataFrame(rows, "ord bigint, path string, rule string")
    # the upstream order: records, then paths as lists of names and numbers
    want = sorted(rows, key=lambda r: (r[0], [int(s) if s.isdigit() else s for s in r[1].split(".") if s], r[2]))
    assert [tuple(r) for r in quality.ordered(v).collect()] == want
    assert [tuple(r)[:3] for r in quality.report_places(v).orderBy("place").collect()] == want
    # many places in a document's own list
    doc = json.dumps({"domains": [{"id": f"d{i}", "label": "D", "categories": []} if i % 5 else {} for i in range(13)]})
    got = [r.path for r in quality.ordered(quality.validate_taxonomy(spark.createDataFrame([(doc,)], "raw string"))).collect()]
    assert [p.split(".")[1] for p in got[::3]] == ["0", "5", "10"]


def test_doi_update_sink_dry_run_and_write(spark, tmp_dir):
    from quire.sources import sinks

    cat = spark.createDataFrame([(0, "a", None, (None, None, None)), (1, "b", "10.1/x", (None, None, "10.1/x"))],
                                "ord bigint, id string, doi string, "
                                "external_ids struct<arxiv_id:string,semantic_scholar_id:string,doi:string>")
    found = spark.createDataFrame([(0, "10.9/new"), (1, None)], "ord bigint, new_doi string")
    assert sinks.doi_changes(found).count() == 1            # the dry run
    # an update of one DOI writes one row, whatever the catalog
    assert sinks.write_doi_delta(found, f"{tmp_dir}/d0") == 1
    deltas = [spark.read.parquet(f"{tmp_dir}/d0")]
    assert deltas[0].count() == 1

    def dois(df):
        return {r.ord: (r.doi, r.external_ids.doi) for r in df.collect()}

    out = sinks.with_doi_updates(cat, deltas)
    assert out.schema == cat.schema and dois(out) == {0: ("10.9/new", "10.9/new"), 1: ("10.1/x", "10.1/x")}
    # a later delta wins; folding gives the same rows
    assert sinks.write_doi_delta(spark.createDataFrame([(0, "10.9/newer")], "ord bigint, new_doi string"),
                                 f"{tmp_dir}/d1", 1) == 1
    deltas.append(spark.read.parquet(f"{tmp_dir}/d1"))
    sinks.fold_doi_updates(cat, deltas, f"{tmp_dir}/snap")
    assert dois(spark.read.parquet(f"{tmp_dir}/snap")) == dois(sinks.with_doi_updates(cat, deltas)) == {
        0: ("10.9/newer", "10.9/newer"), 1: ("10.1/x", "10.1/x")}
    import os
    none = spark.createDataFrame([(0, None)], "ord bigint, new_doi string")
    assert sinks.write_doi_delta(none, f"{tmp_dir}/snap2") == 0
    assert not os.path.exists(f"{tmp_dir}/snap2")


def test_a_lookup_by_id_opens_one_row_group(spark, tmp_dir):
    from quire.operators import analytics
    from quire.sources import sinks

    rows = spark.range(40_000).selectExpr("concat('qc-2024-', lpad((id * 7919) % 40000, 5, '0')) AS id", "id AS ord",
                                          "sha2(cast(id AS string), 256) AS title")
    sinks.write_by_id(rows, f"{tmp_dir}/by-id", row_group_bytes=200_000)
    stored = spark.read.parquet(f"{tmp_dir}/by-id")

    def scanned(df):
        plan = df._jdf.queryExecution().executedPlan()
        plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
        return plan.collectLeaves().head().metrics().apply("numOutputRows").value()

    one = analytics.lookup(stored, "qc-2024-00077")
    assert len(one._jdf.collectAsList()) == 1 and 0 < scanned(one) < 4_000
    none = analytics.lookup(stored, "qc-2024-00077x")      # between two ids: the Bloom filter knows
    assert len(none._jdf.collectAsList()) == 0 and scanned(none) == 0
