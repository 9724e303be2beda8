"""Asset registry, schema diffs and validators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import semver


def audit(requirements: DataFrame, assets: DataFrame) -> DataFrame:
    """consumer, asset_id, version, requirement, status: ok, incompatible, denied or missing."""
    both = requirements.join(assets, "asset_id", "left")
    denied = F.array_contains("breaking", F.col("version"))
    status = F.when(F.col("version").isNull(), "missing").when(denied, "denied").when(semver.is_compatible(F.col("version"), F.col("requirement"), F.col("band"), F.col("breaking")), "ok").otherwise("incompatible")
    return both.select("consumer", "asset_id", "version", "requirement", status.alias("status"))


def problems(audited: DataFrame) -> DataFrame:
    """consumer and a message for each row that isn't ok."""
    said = F.when(F.col("status") == "missing", F.format_string("%s is not in the registry", "asset_id")).otherwise(F.format_string("%s %s does not meet %s", "asset_id", "version", "requirement"))
    return audited.filter("status != 'ok'").select("consumer", "asset_id", said.alias("message"))


def flatten(schema: dict, prefix: str = "", definitions: bool = True) -> list[tuple[str, str, list[str], bool]]:
    """path, type, enum and whether it is required, for each field of a JSON schema; [] stands for array items. Definitions
    come under #/definitions/; $defs and $ref are not followed."""
    rows = []
    required = set(schema.get("required", []))
    for name, field in schema.get("properties", {}).items():
        path = f"{prefix}.{name}" if prefix else name
        kind = field.get("type", "")
        rows.append((path, "|".join(kind) if isinstance(kind, list) else kind, [str(e) for e in field.get("enum", [])], name in required))
        rows += flatten(field, path, False)
    if isinstance(schema.get("items"), dict):
        rows += flatten(schema["items"], f"{prefix}[]", False)
    for key in ("oneOf", "anyOf", "allOf"):
        for option in schema.get(key, []):
            rows += flatten(option, prefix, False)
    if definitions:
        for name, own in schema.get("definitions", {}).items():
            rows += flatten(own, f"#/definitions/{name}", False)
    return list(dict.fromkeys((p, t, tuple(e), r) for p, t, e, r in rows)) if definitions else rows


def fields(spark: SparkSession, schema: dict) -> DataFrame:
    return spark.createDataFrame([(p, t, list(e), r) for p, t, e, r in flatten(schema)], "path string, type string, enum array<string>, required boolean")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per field that changed: path, change, detail. Types, enums and requirements of common fields are compared."""
    o, n = old.select("path", *[F.col(c).alias(f"o_{c}") for c in ("type", "enum", "required")], F.lit(True).alias("in_old")), new.select("path", *[F.col(c).alias(f"n_{c}") for c in ("type", "enum", "required")], F.lit(True).alias("in_new"))
    both = o.join(n, "path", "full_outer")
    common = F.col("in_old").isNotNull() & F.col("in_new").isNotNull()
    gone, come = F.array_sort(F.array_except("o_enum", "n_enum")), F.array_sort(F.array_except("n_enum", "o_enum"))
    item = lambda test, change, detail: F.when(test, F.struct(F.lit(change).alias("change"), detail.alias("detail")))
    found = F.array_compact(F.array(
        item(F.col("in_old").isNull(), "added", F.col("n_type")), item(F.col("in_new").isNull(), "removed", F.col("o_type")),
        item(F.col("in_old").isNull() & F.col("n_required"), "required_added", F.lit("")),
        item(common & (F.col("o_type") != F.col("n_type")), "type_changed", F.concat_ws(" -> ", "o_type", "n_type")),
        item(common & (F.size(gone) > 0), "enum_removed", F.array_join(gone, ",")), item(common & (F.size(come) > 0), "enum_added", F.array_join(come, ",")),
        item(common & ~F.col("o_required") & F.col("n_required"), "required_added", F.lit("")), item(common & F.col("o_required") & ~F.col("n_required"), "required_removed", F.lit("")),
    ))
    return both.select("path", F.explode(found).alias("c")).select("path", "c.*")


def classify(changes: DataFrame) -> DataFrame:
    """MAJOR, MINOR or PATCH, with the number of changes."""
    major, minor = ["removed", "type_changed", "required_added", "enum_removed"], ["added", "required_removed", "enum_added"]
    return changes.agg(F.count("*").alias("n_changes"), F.when(F.max(F.col("change").isin(major).cast("int")) == 1, "MAJOR").when(F.max(F.col("change").isin(minor).cast("int")) == 1, "MINOR").otherwise("PATCH").alias("level"))


def report(changes: DataFrame) -> DataFrame:
    """The whole diff as one JSON object: n_changes, level and the changes by path."""
    rows = F.array_sort(F.collect_list(F.struct("path", "change", "detail")))
    return changes.agg(rows.alias("changes")).crossJoin(classify(changes)).select(F.to_json(F.struct("n_changes", "level", "changes")).alias("report"))  # one row each


def summary(changes: DataFrame, most: int = 30) -> DataFrame:
    """Report lines, `most` a section."""
    from pyspark.sql import Window

    numbered = changes.withColumn("line_no", F.row_number().over(Window.partitionBy("change").orderBy("path")).cast("long"))
    return numbered.filter(F.col("line_no") <= most).select("change", "line_no", F.concat_ws(" ", "path", "detail").alias("line"))


def _issue(test: Column, severity: str, rule: str, detail: Column) -> Column:
    return F.when(test, F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), detail.alias("detail")))


def validate(entries: DataFrame, required: tuple[str, ...], enums: dict[str, tuple[str, ...]], known: tuple[str, ...], json: str = "json", ord: str = "ord") -> DataFrame:
    """Issues of entries given as JSON objects: ord, severity, rule, detail.

    Missing or blank required fields and values outside an enum (null is allowed) are errors; unknown fields, and excluding
    patterns without a required count, are warnings.
    """
    keys = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    value = lambda k: F.get_json_object(json, f"$.{k}")
    blank = [_issue(F.coalesce(F.trim(value(k)), F.lit("")) == "", "error", "required", F.lit(k)) for k in required]
    outside = [_issue(value(k).isNotNull() & ~value(k).isin(*allowed), "error", "enum", F.concat(F.lit(f"{k}="), value(k))) for k, allowed in enums.items()]
    same = _issue(value("calque") == value("natural"), "warning", "same_sides", value("calque"))
    guard = _issue(F.array_contains(keys, "exclude_if_pattern") & ~F.array_contains(keys, "context_keywords_required_count"), "warning", "exclude_without_count", F.lit(""))
    unknown = F.transform(F.array_sort(F.array_except(keys, F.array(*map(F.lit, known)))), lambda k: F.struct(F.lit("warning").alias("severity"), F.lit("unknown_field").alias("rule"), k.alias("detail")))
    return entries.select(ord, F.explode(F.concat(F.array_compact(F.array(*blank, *outside, same, guard)), unknown)).alias("i")).select(ord, "i.*")


def coverage(entries: DataFrame, optional: tuple[str, ...], json: str = "json") -> DataFrame:
    """field, n_present (the key is there, even with null), n_null."""
    keys = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    rows = entries.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.array_contains(keys, k).alias("there"), F.get_json_object(json, f"$.{k}").isNull().alias("null")) for k in optional])).alias("f"))
    return rows.groupBy("f.field").agg(F.count_if("f.there").alias("n_present"), F.count_if(F.col("f.there") & F.col("f.null")).alias("n_null"))


def unknown_fields(entries: DataFrame, known: tuple[str, ...], json: str = "json") -> DataFrame:
    return entries.select(F.explode(F.json_object_keys(json)).alias("field")).filter(~F.col("field").isin(*known)).groupBy("field").agg(F.count("*").alias("n"))


def validate_tables(meta: DataFrame, rules: DataFrame, policies: tuple[str, ...]) -> DataFrame:
    """Soft checks of rule tables: table_name, message; no rows mean that all is well."""
    counted = rules.groupBy("table_name").agg(F.count("*").alias("n"), F.count_if(F.coalesce("input", F.lit("")) == "").alias("blank"))
    both = meta.join(counted, "table_name", "left")
    said = F.array_compact(F.array(
        F.when(F.coalesce("policy", F.lit("")) == "", F.lit("policy is missing")), F.when(F.col("policy").isNotNull() & (F.col("policy") != "") & ~F.col("policy").isin(*policies), F.concat(F.lit("unknown policy "), F.col("policy"))),
        F.when(F.col("probability").isNotNull() & ~F.col("probability").between(0, 1), F.lit("probability is outside 0 to 1")), F.when(F.coalesce("n", F.lit(0)) == 0, F.lit("the table is empty")), F.when(F.coalesce("blank", F.lit(0)) > 0, F.lit("a row has no input")),
    ))
    return both.select("table_name", F.explode(said).alias("message"))


def health(assets: dict[str, DataFrame | None], versions: dict[str, str] | None = None) -> DataFrame:
    """asset, status (OK, EMPTY or MISSING), n_rows, schema_version."""
    spark = next(a for a in assets.values() if a is not None).sparkSession
    made = None
    for name, frame in assets.items():
        n = frame.agg(F.count("*").alias("n_rows")) if frame is not None else spark.createDataFrame([(0,)], "n_rows long")
        status = F.lit("MISSING") if frame is None else F.when(F.col("n_rows") > 0, "OK").otherwise("EMPTY")
        row = n.select(F.lit(name).alias("asset"), status.alias("status"), "n_rows", F.lit((versions or {}).get(name, "unknown")).alias("schema_version"))
        made = row if made is None else made.unionByName(row)
    return made


def reachable(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Expected markers with a flag: observed?"""
    return expected.join(observed.select("marker", F.lit(True).alias("found")).distinct(), "marker", "left").withColumn("found", F.coalesce("found", F.lit(False)))
