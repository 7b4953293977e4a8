"""Data quality.

V1/V2 check raw JSON records against declarative rules (a JSON-Schema
subset: required, type, pattern, enum, minLength, minItems, minimum,
maximum, closed objects, string items). The raw text is parsed once into a
``VARIANT``; every rule is a built-in expression over it, and each record
yields an array of violations that is exploded into rows
``(ord, path, rule, value)``. Rules are independent, as the upstream
validator has them: a value of the wrong type is still held against enum and
bounds, and every bad array item is a row of its own. ``format`` is not
enforced, matching the upstream validator, which passes no format checker.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import fixed
from quire.operators.common import ordered_rank
from quire.session import cut
from quire.sources.dims import checked_broadcast


@dataclass
class Prop:
    name: str
    type: str                      # string | integer | boolean | array | object
    pattern: str | None = None
    enum: list[str] | None = None
    min_length: int | None = None
    min_items: int | None = None
    minimum: int | None = None
    maximum: int | None = None
    items: str | None = None       # item type for arrays
    props: list["Prop"] = field(default_factory=list)   # for closed objects
    closed: bool = False
    required: list[str] = field(default_factory=list)


def entry_schema(id_prefix: str = "qc") -> Prop:
    """Catalog entry rules (fixed values in ``quire.fixed``); the id prefix
    is a parameter."""
    str_arr = dict(type="array", items="string")
    return Prop("", "object", closed=True, required=list(fixed.ENTRY_REQUIRED), props=[
        Prop("id", "string", pattern=f"^{id_prefix}-[0-9]{{4}}-[0-9]{{5}}$"),
        Prop("type", "string", enum=list(fixed.ENTRY_TYPES)),
        Prop("title", "string", min_length=1),
        Prop("authors", min_items=1, **str_arr),
        Prop("year", "integer", minimum=fixed.SCHEMA_YEAR_MIN, maximum=fixed.SCHEMA_YEAR_MAX),
        Prop("month", "integer", minimum=1, maximum=12),
        Prop("venue", "string"), Prop("abstract", "string"), Prop("url", "string"),
        Prop("doi", "string"), Prop("pdf_url", "string"),
        Prop("categories", min_items=1, **str_arr),
        Prop("framework_mappings", "object", closed=True,
             props=[Prop(k, **str_arr) for k in fixed.FRAMEWORK_KEYS]),
        Prop("tags", **str_arr),
        Prop("added_date", "string"), Prop("added_by", "string"),
        Prop("source_api", "string", enum=list(fixed.SOURCE_APIS)),
        Prop("external_ids", "object", closed=True,
             props=[Prop(k, "string") for k in fixed.EXTERNAL_ID_KEYS]),
        Prop("citation_count", "integer", minimum=0),
        Prop("open_access", "boolean"),
        Prop("reviewed", "boolean"),
    ])


def category_schema() -> Prop:
    return Prop("", "object", closed=True, required=["id", "label"], props=[
        Prop("id", "string"), Prop("label", "string"), Prop("description", "string")])


def domain_schema() -> Prop:
    """V2: one taxonomy domain (categories are checked one by one with
    ``category_schema``)."""
    return Prop("", "object", closed=True, required=["id", "label", "categories"], props=[
        Prop("id", "string"), Prop("label", "string"), Prop("description", "string"),
        Prop("categories", "array")])


def _vtype(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_type(v: Column, t: str) -> Column:
    s = _vtype(v)
    if t == "string":
        return s == "STRING"
    if t == "boolean":
        return s == "BOOLEAN"
    if t == "array":
        return s.startswith("ARRAY")
    if t == "object":
        return s.startswith("OBJECT")
    if t == "integer":
        # 2024.0 is an integer for JSON Schema, true is not
        whole = F.try_variant_get(v, "$", "double") == F.floor(F.try_variant_get(v, "$", "double"))
        return (s.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | s.rlike(r"^DECIMAL\([0-9]+,0\)$")
                | ((s.startswith("DECIMAL") | (s == "DOUBLE") | (s == "FLOAT")) & whole))
    raise ValueError(t)


def _path(parent: str, name: str) -> str:
    return name if not parent else f"{parent}.{name}"


def _is_number(v: Column) -> Column:
    s = _vtype(v)
    return s.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | s.startswith("DECIMAL")


def _violation(cond: Column, path: Column | str, rule: str, value: Column) -> Column:
    p = F.lit(path) if isinstance(path, str) else path
    return F.when(cond, F.struct(p.alias("path"), F.lit(rule).alias("rule"), value.alias("value")))


def _checks(v: Column, prop: Prop, path: str) -> tuple[list[Column], list[Column]]:
    """Violation structs (or nulls), and arrays of them, for a value ``v``
    that is present."""
    one: list[Column] = []
    many: list[Column] = []
    text, none = F.to_json(v), F.lit(None).cast("string")

    def rule(cond: Column, name: str, p: str = path, value: Column = text) -> None:
        one.append(_violation(cond, p, name, value))

    rule(~_is_type(v, prop.type), "type")
    if prop.pattern or prop.min_length is not None or prop.enum:
        is_str, sv = _is_type(v, "string"), F.try_variant_get(v, "$", "string")
        if prop.pattern:
            rule(is_str & ~sv.rlike(prop.pattern), "pattern")
        if prop.enum:
            rule(~is_str | ~sv.isin(*prop.enum), "enum")
        if prop.min_length is not None:
            rule(is_str & (F.char_length(sv) < prop.min_length), "minLength")
    if prop.minimum is not None or prop.maximum is not None:
        is_num, nv = _is_number(v), F.try_variant_get(v, "$", "double")
        if prop.minimum is not None:
            rule(is_num & (nv < prop.minimum), "minimum")
        if prop.maximum is not None:
            rule(is_num & (nv > prop.maximum), "maximum")
    if prop.type == "array":
        is_arr, items = _is_type(v, "array"), F.try_variant_get(v, "$", "array<variant>")
        if prop.min_items is not None:
            rule(is_arr & (F.size(items) < prop.min_items), "minItems")
        if prop.items:
            many.append(F.when(is_arr, F.transform(items, lambda x, i: _violation(
                ~_is_type(x, prop.items), F.concat(F.lit(f"{path}."), i.cast("string")), "type", F.to_json(x)))))
    if prop.type == "object":
        is_obj = _is_type(v, "object")
        names = [p.name for p in prop.props]
        for r in prop.required:
            rule(is_obj & F.try_variant_get(v, f"$.{r}", "variant").isNull(), "required", _path(path, r), none)
        if prop.closed:
            # key list straight from the variant (no second JSON parse)
            keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
            extra = F.array_sort(F.filter(keys, lambda k: ~k.isin(*names)) if names else keys)
            rule(is_obj & (F.size(extra) > 0), "additionalProperties", value=F.array_join(extra, ","))
        for p in prop.props:
            child = F.try_variant_get(v, f"$.{p.name}", "variant")
            sub_one, sub_many = _checks(child, p, _path(path, p.name))
            one += [F.when(child.isNotNull() & is_obj, c) for c in sub_one]
            many += [F.when(child.isNotNull() & is_obj, c) for c in sub_many]
    return one, many


def validate_json(df: DataFrame, keys: str | list[str], json_col: str, schema: Prop) -> DataFrame:
    """V1/V2: one row per violation: the key columns (a single one is called
    ``ord``), ``path``, ``rule`` and the offending ``value`` as JSON text
    (names for unknown keys, null where something is missing). Text that is
    not JSON gives one ``parse`` row."""
    names = [keys] if isinstance(keys, str) else list(keys)
    cols = [F.col(keys).alias("ord")] if isinstance(keys, str) else [F.col(k) for k in names]
    outs = ["ord"] if isinstance(keys, str) else names
    parsed = df.select(*cols, F.col(json_col).alias("_json"), F.try_parse_json(F.col(json_col)).alias("_v"))
    one, many = _checks(F.col("_v"), schema, "")
    empty = F.array().cast("array<struct<path:string,rule:string,value:string>>")
    found = F.filter(F.concat(F.array(*one), *[F.coalesce(m, empty) for m in many]), lambda x: x.isNotNull())
    broken = F.array(F.struct(F.lit("").alias("path"), F.lit("parse").alias("rule"), F.col("_json").alias("value")))
    return (parsed.select(*outs, F.explode_outer(F.when(F.col("_v").isNull(), broken).otherwise(found)).alias("x"))
            .filter(F.col("x").isNotNull()).select(*outs, "x.path", "x.rule", "x.value"))


def envelope_schema(container: str) -> Prop:
    """A whole document: one required list and no other key."""
    return Prop("", "object", closed=True, required=[container], props=[Prop(container, "array")])


def _items(raw: DataFrame, container: str) -> DataFrame:
    v = raw.select(F.try_parse_json("raw").alias("v"))
    return v.select(F.posexplode(F.try_variant_get("v", f"$.{container}", "array<variant>")).alias("i", "d"))


def _below(prefix: Column) -> Column:
    """``prefix`` with the violation's own path appended."""
    return F.concat(prefix, F.when(F.col("path") != "", F.concat(F.lit("."), F.col("path"))).otherwise(F.lit("")))


def validate_catalog(raw: DataFrame, id_prefix: str = "qc") -> DataFrame:
    """V1: a whole catalog document as JSON text in column ``raw``: its
    envelope (``ord`` -1) and every entry (``ord`` its place)."""
    top = validate_json(raw.select(F.lit(-1).cast("bigint").alias("ord"), "raw"), "ord", "raw",
                        envelope_schema("entries"))
    entries = _items(raw, "entries").select(F.col("i").cast("bigint").alias("ord"), F.to_json("d").alias("raw"))
    return top.unionByName(validate_json(entries, "ord", "raw", entry_schema(id_prefix)).withColumn(
        "path", _below(F.concat(F.lit("entries."), F.col("ord").cast("string")))))


def path_key(path: Column) -> Column:
    """Sort key of a violation's path: its steps one by one, list places as
    numbers (``authors.2`` before ``authors.10``), a path before those that
    continue it."""
    return F.transform(F.split(path, "\\."), lambda step: F.struct(
        F.when(step.rlike("^[0-9]{1,18}$"), step.cast("bigint")).otherwise(-1).alias("place"), step.alias("name")))


def ordered(violations: DataFrame) -> DataFrame:
    """V3: violations in (record, path) order, as the upstream report sorts them."""
    return violations.orderBy("ord", path_key(F.col("path")), "rule")


def report_places(violations: DataFrame) -> DataFrame:
    """V3 for a report too long for one task: each violation's ``place`` in
    (record, path) order, by a range sort."""
    # written once: range bounds come from sampling, which would check every record again
    return ordered_rank(cut(violations, "violations"), [], [F.col("ord"), path_key(F.col("path")), F.col("rule")], out="place")


def validate_taxonomy(raw: DataFrame) -> DataFrame:
    """V2: a taxonomy document ``{domains:[...]}`` as JSON text in column
    ``raw``: the envelope (``ord`` -1), every domain and every category
    against its rules; paths are ``domains.<i>`` and
    ``domains.<i>.categories.<j>``."""
    top = validate_json(raw.select(F.lit(-1).cast("bigint").alias("ord"), "raw"), "ord", "raw",
                        envelope_schema("domains"))
    doms = _items(raw, "domains")
    domain = F.concat(F.lit("domains."), F.col("i").cast("string"))
    d_viol = validate_json(doms.select("i", F.to_json("d").alias("raw")), ["i"], "raw", domain_schema())
    cats = doms.select("i", F.posexplode(F.try_variant_get("d", "$.categories", "array<variant>")).alias("j", "c"))
    c_viol = validate_json(cats.select("i", "j", F.to_json("c").alias("raw")), ["i", "j"], "raw", category_schema())
    below = [d_viol.select(F.col("i").cast("bigint").alias("ord"), _below(domain).alias("path"), "rule", "value"),
             c_viol.select(F.col("i").cast("bigint").alias("ord"),
                           _below(F.concat(domain, F.lit(".categories."), F.col("j").cast("string"))).alias("path"),
                           "rule", "value")]
    return top.unionByName(below[0]).unionByName(below[1])


def duplicate_ids(df: DataFrame) -> DataFrame:
    """A4: every id used more than once, reported once."""
    return (df.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1).select("id", "n"))


def unknown_categories(df: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """One row per occurrence of a category id missing from the taxonomy
    (duplicates kept)."""
    occ = (df.select("ord", "id", F.posexplode_outer("categories").alias("pos", "category_id"))
           .filter(F.col("category_id").isNotNull()))
    tax = checked_broadcast(taxonomy.select("category_id").distinct())
    return occ.join(tax, "category_id", "left_anti").select("ord", "id", "pos", "category_id")


def verdict(schema_violations: DataFrame, dup_ids: DataFrame, unknown: DataFrame) -> DataFrame:
    """V4: all checks run; one row per check with its error count, plus the
    overall ``passed`` row (errors = number of failing checks)."""
    parts = [
        schema_violations.agg(F.count(F.lit(1)).alias("errors")).select(F.lit(1).alias("check_ord"),
                                                                        F.lit("schema").alias("check"), "errors"),
        dup_ids.agg(F.count(F.lit(1)).alias("errors")).select(F.lit(2).alias("check_ord"),
                                                              F.lit("duplicate_ids").alias("check"), "errors"),
        unknown.agg(F.count(F.lit(1)).alias("errors")).select(F.lit(3).alias("check_ord"),
                                                              F.lit("unknown_categories").alias("check"), "errors"),
    ]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    # each check's row also counts into the total, so no check runs twice
    failed = F.struct(F.lit(0).alias("check_ord"), F.lit("passed").alias("check"),
                      (F.col("errors") > 0).cast("bigint").alias("errors"))
    rows = u.select(F.explode(F.array(F.struct("check_ord", "check", "errors"), failed)).alias("r")).select("r.*")
    return rows.groupBy("check_ord", "check").agg(F.sum("errors").alias("errors")).withColumn(
        "passed", F.col("errors") == 0)
