"""Registry, schema diffs, validators and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import semver
from wordloom.operators import meta, trace
from wordloom.plans.inputs import Literal, table

VERSIONS = Literal("version string", [("1.0.0",), ("1.2.3",), ("1.4.0-rc1",), ("2.0.0",), ("0.9.9",), ("bad",), ("0.3.1",), (None,)])
RANGES = Literal("spec string", [("^1.0.0",), ("~1.2.0",), (">=1.2.3",), ("1.2.3",), ("^0.3.0",), (">=1.0.0, <2.0.0",), ("junk",)])
ASSETS = Literal("asset_id string, version string, band string, breaking array<string>", [("a", "1.4.0", "^1.0.0", ["1.3.0"]), ("b", "2.1.0", "^2.0.0", []), ("c", "1.3.0", "^1.0.0", ["1.3.0"]), ("d", "bad", "^1.0.0", [])])
REQUIREMENTS = Literal("consumer string, asset_id string, requirement string", [("x", "a", "^1.2.0"), ("x", "b", "^1.0.0"), ("x", "z", "^1.0.0"), ("y", "c", "^1.0.0"), ("y", "a", ""), ("y", "b", None), ("y", "d", ""), ("z", "a", "~1.3.0")])
OLD = {"properties": {"id": {"type": "string"}, "n": {"type": "integer"}, "kind": {"type": "string", "enum": ["a", "b"]}, "rows": {"type": "array", "items": {"properties": {"x": {"type": "number"}, "gone": {"type": "string"}}}}}, "required": ["id", "kind"], "$defs": {"T": {"properties": {"q": {"type": "string"}}}}}
NEW = {"properties": {"id": {"type": "string"}, "n": {"type": "number"}, "kind": {"type": "string", "enum": ["a", "c"]}, "fresh": {"type": "string"}, "rows": {"type": "array", "items": {"properties": {"x": {"type": "number"}}}}}, "required": ["id", "n"], "definitions": {"T": {"properties": {"q": {"type": ["string", "null"]}}}}}
ENTRIES = Literal("ord long, json string", [
    (0, '{"en":"x","calque":"a","natural":"b","domain":"d","confidence":"high"}'), (1, '{"en":"","calque":"a","natural":"a","domain":"d","confidence":"odd","typo":1}'),
    (2, '{"en":"y","calque":"c","natural":"d","domain":"d","confidence":"low","regional_sensitivity":null,"exclude_if_pattern":["z"]}'), (3, '{"en":"z","calque":"c","natural":" ","confidence":"medium","regional_sensitivity":"high","extra":2,"typo":3}'), (4, "{}"),
])
REQUIRED = ("en", "calque", "natural", "domain", "confidence")
ENUMS = {"confidence": ("low", "medium", "high"), "regional_sensitivity": ("low", "high")}
KNOWN = (*REQUIRED, "regional_sensitivity", "exclude_if_pattern", "context_keywords_required_count")
TABLES = Literal("table_name string, policy string, probability double", [("good", "replace", 0.5), ("odd", "guess", 1.5), ("bare", None, None), ("blank", "replace", 0.1)])
ROWS = Literal("table_name string, input string", [("good", "a"), ("odd", "b"), ("blank", ""), ("blank", "c")])
MARKERS = (Literal("marker string", [("a/SKILL.md",), ("b/run.py",), ("c/x.json",)]), Literal("marker string", [("a/SKILL.md",), ("c/x.json",), ("d",)]))
_OLD, _NEW = (Literal("path string, type string, enum array<string>, required boolean", meta.flatten(x)) for x in (OLD, NEW))
_LISTED = lambda gone, come: f"array_to_string(list_sort(list_filter({gone}.enum, lambda x: NOT list_contains({come}.enum, x))), ',')"
_GONE, _COME = _LISTED("o", "n"), _LISTED("n", "o")
CHANGES_SQL = f"""(SELECT path, unnest(c).change AS change, unnest(c).detail AS detail FROM (SELECT coalesce(o.path, n.path) AS path, list_filter([
{{'change': CASE WHEN o.path IS NULL THEN 'added' END, 'detail': n.type}}, {{'change': CASE WHEN n.path IS NULL THEN 'removed' END, 'detail': o.type}}, {{'change': CASE WHEN n.required AND NOT coalesce(o.required, false) THEN 'required_added' END, 'detail': ''}},
{{'change': CASE WHEN o.required AND NOT n.required THEN 'required_removed' END, 'detail': ''}}, {{'change': CASE WHEN o.type != n.type THEN 'type_changed' END, 'detail': o.type || ' -> ' || n.type}},
{{'change': CASE WHEN n.path IS NOT NULL AND {_GONE} != '' THEN 'enum_removed' END, 'detail': {_GONE}}}, {{'change': CASE WHEN o.path IS NOT NULL AND {_COME} != '' THEN 'enum_added' END, 'detail': {_COME}}}], lambda x: x.change IS NOT NULL) AS c
FROM {_OLD.sql()} o FULL JOIN {_NEW.sql()} n ON o.path = n.path))"""
_TEXT = lambda k: f"json_extract_string(json, '$.{k}')"
_HAS = lambda k: f"list_contains(json_keys(json), '{k}')"
ISSUES_SQL = " UNION ALL ".join([
    *[f"SELECT ord, 'error' AS severity, 'required' AS rule, '{k}' AS detail FROM {{0}} WHERE trim(coalesce({_TEXT(k)}, '')) = ''" for k in REQUIRED],
    *[f"SELECT ord, 'error', 'enum', '{k}=' || {_TEXT(k)} FROM {{0}} WHERE {_TEXT(k)} NOT IN ({', '.join(map(repr, allowed))})" for k, allowed in ENUMS.items()],
    f"SELECT ord, 'warning', 'same_sides', {_TEXT('calque')} FROM {{0}} WHERE {_TEXT('calque')} = {_TEXT('natural')}",
    f"SELECT ord, 'warning', 'exclude_without_count', '' FROM {{0}} WHERE {_HAS('exclude_if_pattern')} AND NOT {_HAS('context_keywords_required_count')}",
    f"SELECT ord, 'warning', 'unknown_field', k FROM (SELECT ord, unnest(json_keys(json)) AS k FROM {{0}}) WHERE k NOT IN ({', '.join(map(repr, KNOWN))})",
]).replace("{0}", ENTRIES.sql())


def _changes(spark: SparkSession) -> DataFrame:
    return meta.diff(_OLD.frame(spark), _NEW.frame(spark))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each version against each range: two literal tables."""
    both = VERSIONS.frame(spark).crossJoin(F.broadcast(RANGES.frame(spark)))
    return both.select("version", "spec", semver.in_range(F.col("version"), F.col("spec")).alias("fits"))


def audited(spark: SparkSession) -> DataFrame:
    return meta.audit(REQUIREMENTS.frame(spark), ASSETS.frame(spark))


def _trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.records(table(spark, sf_dir, "events"))


_TRIGGERS = ", ".join(f"'{t}'" for t in trace.TRIGGERS)
_RAW = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in trace.OF_EVENTS.items()) + " ELSE event_type END"
_TRIGGER = f"CASE WHEN {_RAW} IN ({_TRIGGERS}) THEN {_RAW} ELSE 'other' END"
TRACE_SQL = f"""(SELECT user_id AS trace_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_id, 'asset-' || (event_id % 12) AS asset_id, CASE WHEN value > 50 THEN 'rewrite' ELSE 'unspecified' END AS stage, {_TRIGGER} AS trigger, CASE WHEN {_RAW} NOT IN ({_TRIGGERS}) THEN {_RAW} END AS trigger_raw FROM events)"""
_N = "(CAST(regexp_extract(%s, '^\\s*(\\d+)\\.(\\d+)\\.(\\d+)', 1) AS INT) * 1000000 + CAST(regexp_extract(%s, '^\\s*(\\d+)\\.(\\d+)\\.(\\d+)', 2) AS INT) * 1000 + CAST(regexp_extract(%s, '^\\s*(\\d+)\\.(\\d+)\\.(\\d+)', 3) AS INT))"


def _num(c: str) -> str:
    return f"(CASE WHEN regexp_matches({c}, '^\\s*\\d+\\.\\d+\\.\\d+') THEN {_N % (c, c, c)} END)"


def _fits(version: str, spec: str) -> str:
    base = f"regexp_replace({spec}, '^(>=|[\\^~])', '')"
    low = _num(base)
    high = f"CASE WHEN starts_with({spec}, '^') THEN ({low} // 1000000 + 1) * 1000000 WHEN starts_with({spec}, '~') THEN ({low} // 1000 + 1) * 1000 WHEN starts_with({spec}, '>=') THEN 9999000000 ELSE {low} + 1 END"
    return f"coalesce({_num(version)} >= {low} AND {_num(version)} < {high}, false)"


AUDIT_SQL = f"""(SELECT consumer, r.asset_id, version, requirement, CASE WHEN version IS NULL THEN 'missing' WHEN list_contains(breaking, version) THEN 'denied' WHEN {_fits('version', "coalesce(nullif(requirement, ''), band)")} THEN 'ok' ELSE 'incompatible' END AS status
FROM {REQUIREMENTS.sql()} r LEFT JOIN {ASSETS.sql()} a ON r.asset_id = a.asset_id)"""

QUERIES = {
    "semver_range_matrix": matrix,
    "registry_compat": lambda s, d: ASSETS.frame(s).select("asset_id", semver.is_compatible(F.col("version"), F.lit(None).cast("string"), F.col("band"), F.col("breaking")).alias("compatible")),
    "consumer_audit": lambda s, d: audited(s), "consumer_problems": lambda s, d: meta.problems(audited(s)),
    "schema_diff_fields": lambda s, d: _changes(s), "schema_diff_class": lambda s, d: meta.classify(_changes(s)), "schema_diff_summary": lambda s, d: meta.summary(_changes(s)), "schema_diff_report": lambda s, d: meta.report(_changes(s)),
    "validate_entries": lambda s, d: meta.validate(ENTRIES.frame(s), REQUIRED, ENUMS, KNOWN),
    "field_coverage": lambda s, d: meta.coverage(ENTRIES.frame(s), ("regional_sensitivity", "exclude_if_pattern")),
    "unknown_fields": lambda s, d: meta.unknown_fields(ENTRIES.frame(s), KNOWN),
    "soft_validate_tables": lambda s, d: meta.validate_tables(TABLES.frame(s), ROWS.frame(s), ("replace", "insert")),
    "asset_health": lambda s, d: meta.health({"events": table(s, d, "events"), "rows": ROWS.frame(s), "none": ROWS.frame(s).limit(0), "gone": None}, {"events": "1.0.0"}),
    "marker_reachability": lambda s, d: meta.reachable(MARKERS[0].frame(s), MARKERS[1].frame(s)),
    "trace_seq": _trace, "trace_summary": lambda s, d: trace.summary(_trace(s, d)),
    "trigger_normalize": lambda s, d: table(s, d, "events").groupBy("event_type", trace.trigger(trace.raw_trigger(F.col("event_type"))).alias("trigger")).agg(F.count("*").alias("n")),
    "trace_filter": lambda s, d: trace.filter_by(_trace(s, d), stage="rewrite", trigger="lex_substitution_fired").select("trace_id", "seq", "event_id"),
    "trace_hourly": lambda s, d: trace.hourly(table(s, d, "events")).select(F.unix_timestamp("hour").alias("hour"), "trigger", "n"),
    "consecutive_failure_runs": lambda s, d: trace.failure_runs(table(s, d, "events")),
}
ORACLE_SQL = {
    "semver_range_matrix": f"SELECT version, spec, {_fits('version', 'spec')} AS fits FROM {VERSIONS.sql()} CROSS JOIN {RANGES.sql()}",
    "registry_compat": f"SELECT asset_id, NOT list_contains(breaking, version) AND {_fits('version', 'band')} AS compatible FROM {ASSETS.sql()}",
    "consumer_audit": f"SELECT * FROM {AUDIT_SQL}",
    "consumer_problems": f"SELECT consumer, asset_id, CASE status WHEN 'missing' THEN asset_id || ' is not in the registry' ELSE asset_id || ' ' || version || ' does not meet ' || coalesce(requirement, 'null') END AS message FROM {AUDIT_SQL} WHERE status != 'ok'",
    "schema_diff_fields": f"SELECT * FROM {CHANGES_SQL}",
    "schema_diff_class": f"SELECT count(*) AS n_changes, CASE WHEN bool_or(change IN ('removed', 'type_changed', 'required_added', 'enum_removed')) THEN 'MAJOR' WHEN count(*) > 0 THEN 'MINOR' ELSE 'PATCH' END AS level FROM {CHANGES_SQL}",
    "schema_diff_summary": f"SELECT change, row_number() OVER (PARTITION BY change ORDER BY path) AS line_no, path || ' ' || detail AS line FROM {CHANGES_SQL}",
    "schema_diff_report": f"SELECT CAST(to_json(struct_pack(n_changes := count(*), level := CASE WHEN bool_or(change IN ('removed', 'type_changed', 'required_added', 'enum_removed')) THEN 'MAJOR' ELSE 'MINOR' END, changes := list(struct_pack(path := path, change := change, detail := detail) ORDER BY path, change, detail))) AS VARCHAR) AS report FROM {CHANGES_SQL}",
    "validate_entries": ISSUES_SQL,
    "field_coverage": "SELECT f AS field, CAST(count_if(list_contains(json_keys(json), f)) AS BIGINT) AS n_present, CAST(count_if(list_contains(json_keys(json), f) AND json_extract_string(json, '$.' || f) IS NULL) AS BIGINT) AS n_null FROM " + ENTRIES.sql() + " CROSS JOIN (VALUES ('regional_sensitivity'), ('exclude_if_pattern')) t(f) GROUP BY 1",
    "unknown_fields": f"SELECT field, count(*) AS n FROM (SELECT unnest(json_keys(json)) AS field FROM {ENTRIES.sql()}) WHERE field NOT IN ({', '.join(repr(k) for k in KNOWN)}) GROUP BY 1",
    "soft_validate_tables": f"""WITH t AS (SELECT t.*, r.n, r.blank FROM {TABLES.sql()} t LEFT JOIN (SELECT table_name, count(*) AS n, count_if(coalesce(input, '') = '') AS blank FROM {ROWS.sql()} GROUP BY 1) r USING (table_name))
SELECT table_name, 'policy is missing' AS message FROM t WHERE coalesce(policy, '') = '' UNION ALL SELECT table_name, 'unknown policy ' || policy FROM t WHERE policy NOT IN ('', 'replace', 'insert') UNION ALL SELECT table_name, 'probability is outside 0 to 1' FROM t WHERE probability < 0 OR probability > 1
UNION ALL SELECT table_name, 'the table is empty' FROM t WHERE coalesce(n, 0) = 0 UNION ALL SELECT table_name, 'a row has no input' FROM t WHERE blank > 0""",
    "asset_health": "SELECT 'events' AS asset, 'OK' AS status, count(*) AS n_rows, '1.0.0' AS schema_version FROM events UNION ALL SELECT 'rows', 'OK', 4, 'unknown' UNION ALL SELECT 'none', 'EMPTY', 0, 'unknown' UNION ALL SELECT 'gone', 'MISSING', 0, 'unknown'",
    "marker_reachability": f"SELECT marker, marker IN (SELECT marker FROM {MARKERS[1].sql()}) AS found FROM {MARKERS[0].sql()}",
    "trace_seq": f"SELECT * FROM {TRACE_SQL}",
    "trace_summary": f"SELECT 'total' AS facet, '' AS value, count(*) AS n FROM {TRACE_SQL} UNION ALL " + " UNION ALL ".join(f"SELECT '{c}', {c}, count(*) FROM {TRACE_SQL} GROUP BY {c}" for c in ("asset_id", "stage", "trigger")),
    "trigger_normalize": f"SELECT event_type, {_TRIGGER} AS trigger, count(*) AS n FROM events GROUP BY 1, 2",
    "trace_filter": f"SELECT trace_id, seq, event_id FROM {TRACE_SQL} WHERE stage = 'rewrite' AND trigger = 'lex_substitution_fired'",
    "trace_hourly": f"SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, {_TRIGGER} AS trigger, count(*) AS n FROM events GROUP BY 1, 2",
    "consecutive_failure_runs": """SELECT user_id, arg_min(event_id, rn) AS run_start, count(*) AS run_length FROM (SELECT user_id, event_id, bad, rn, rn - row_number() OVER (PARTITION BY user_id, bad ORDER BY ts, event_id) AS island
FROM (SELECT user_id, ts, event_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)) WHERE bad GROUP BY user_id, island HAVING count(*) >= 3""",
}
