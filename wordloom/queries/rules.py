"""Rule-table queries over the transliterated documents and literal sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators import rules, statistics
from wordloom.plans.inputs import AR_SQL, Literal, ar_documents, spread, table

#: Our own small tables.
CONNECTORS = [("and", "plus"), ("the", "that"), ("of", "from"), ("und", "sowie")]
TRANSITIONS = [("first", "to begin"), ("is", "remains"), ("und", "dann")]
DESTACK = [("very very ", "very "), ("(really) (?:really )+", "{0} "), ("is is", "is")]
OPENERS = [("^(The [a-z]+) ", "Note: {0} "), ("^It ", "This ")]
FILLERS = ["indeed", "in fact", "well"]
PHRASES = {"idiot": ("abuse", "tone"), "moron": ("abuse", "tone"), "All rights": ("boilerplate", "legal"), "License": ("boilerplate", "legal")}
LINES = Literal(
    "id long, text string",
    [
        (0, "كتب text2 نص, ثم; قال? نعم% ( نص ) كتاب(ب) ."), (1, "قال — ثم ذهب، لأن الوقت ضاق ،إذ كان"), (2, "كـــتاب و كتـاب"), (3, 'قال "نعم" ثم "لا" وكتب «شيئا»'), (4, "تفاح، موز، برتقال ثم ذهب"), (5, ""), (6, 'plain and "the quoted and" the end'), (7, "خبر، لذلك عاد"), (8, "ورد، وفل، ياسمين، نرجس وقال كتاب، قلم، دفتر"), (9, 'and "open and «and» and "x" and'), (10, None),
    ],
)
ALTERNATIVES = Literal("table_name string, ord long, input string, alternatives array<string>, source_tag string", [
    ("ai_phrases", 0, "in conclusion", ["so", ""], None), ("ai_phrases", 1, "delve", ["look", "dig", "go"], "v2"), ("connectors", 0, "moreover", ["also"], "v2"), ("connectors", 1, "in conclusion", ["then"], None), ("fillers", 0, "x", [""], None),
])
_WORD = lambda w: f"(^|[^\\p{{L}}\\p{{N}}_]){w}($|[^\\p{{L}}\\p{{N}}_])"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


def _lines(transform):
    return lambda s, d: LINES.frame(s).select("id", transform(F.col("text")).alias("text"))


def _ar(transform):
    """A typographic rule over texts with Arabic and other letters next to each other."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = ar_documents(spark, sf_dir).select("doc_id", transform(F.col("text")).alias("t"))
        return made.select("doc_id", F.md5("t").alias("md5"))

    return query


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(rules.replace_gated(F.col("text"), F.col("doc_id"), CONNECTORS, 0.7)).alias("md5"))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(rules.replace_gated(F.col("text"), F.col("doc_id"), TRANSITIONS, 0.5)).alias("md5"))


def quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LINES.frame(spark).select("id", rules.outside_quotes(F.col("text"), lambda c: F.replace(c, F.lit("and"), F.lit("&"))).alias("text"))


def openers(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _docs(spark, sf_dir).select("doc_id", rules.patterns(F.col("text"), OPENERS).alias("t"))
    return made.select("doc_id", F.md5("t").alias("md5"))


def destack(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("is is very very really really "), "text").alias("text"))
    return own.select("doc_id", F.md5(rules.patterns(F.col("text"), DESTACK)).alias("md5"))


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statistics.sentence_rows(_docs(spark, sf_dir), "lang")
    return rules.fill(rows, FILLERS, 0.8).select("doc_id", "sent_no", "filled", F.md5("sentence").alias("md5"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.anti_pattern_hits(_docs(spark, sf_dir), PHRASES)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return rules.respect_score(rules.anti_pattern_hits(docs, PHRASES), docs)


def rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(rules.rotate(F.col("text"), "the", ["A", "B", "C"])).alias("md5"))


_SENT_SQL = """(SELECT doc_id, i - 1 AS sent_no, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?؟؛\\n]+'), lambda x: trim(x)), lambda x: x != '') AS s FROM documents)))"""
_HITS = lambda p: f"(length(text) - length(replace(text, '{p}', ''))) // {len(p)}"
_HITS_SQL = "(" + " UNION ALL ".join(f"SELECT doc_id, '{i}' AS pattern_id, '{c}' AS category, {_HITS(p)} AS hits FROM documents" for p, (i, c) in PHRASES.items()) + ")"
_A = "[\\x{0600}-\\x{06FF}]"
_PUNCT = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '({_A}),', '\\1،', 'g'), '({_A});', '\\1؛', 'g'), '({_A})\\?', '\\1؟', 'g'), '({_A})%', '\\1٪', 'g')"
_RULES = {
    "latin_spacing": (rules.latin_spacing, f"regexp_replace(regexp_replace(text, '({_A})([A-Za-z0-9])', '\\1 \\2', 'g'), '([A-Za-z0-9])({_A})', '\\1 \\2', 'g')"),
    "arabic_punctuation": (rules.arabic_punctuation, _PUNCT),
    "no_space_before": (rules.no_space_before, "regexp_replace(text, '[ \\t]+([،؛؟:!.])', '\\1', 'g')"),
    "paren_spacing": (rules.paren_spacing, "regexp_replace(regexp_replace(regexp_replace(text, '\\([ \\t]+', '(', 'g'), '[ \\t]+\\)', ')', 'g'), '([^\\s(])\\(', '\\1 (', 'g')"),
    "drop_kashida": (rules.drop_kashida, "replace(text, 'ـ', '')"),
    "causal_semicolon": (rules.causal_semicolon, "regexp_replace(text, '،( (?:لأن|لذلك|إذ) )', '؛\\1', 'g')"),
    "guillemets": (rules.guillemets, """regexp_replace(text, '"([^"]*)"', '«\\1»', 'g')"""),
}
_POLICY_SQL = ", ".join(f"('{r}', '{f}', {str(f in own).lower()})" for r, own in rules.POLICY.items() for f in rules.FLAGS)
_PIECES = "regexp_split_to_array(text, '\\bthe\\b')"


def _gated_sql(table: list[tuple[str, str]], share: int) -> str:
    """Words between ASCII and other letters: matches may share a boundary character, so the pattern is applied twice."""
    made = "text"
    for i, (w, new) in sorted(enumerate(table), key=lambda x: (-len(x[1][0]), x[0])):
        once = lambda t, w=w, new=new: f"regexp_replace({t}, '{_WORD(w)}', '\\1{new}\\2', 'g')"
        made = f"CASE WHEN (doc_id * 31 + {i * 17 + 7}) % 1000 < {share} THEN {once(once(made))} ELSE {made} END"
    return f"SELECT doc_id, md5({made}) AS md5 FROM documents"


QUERIES = {
    **{f"typo_{n}": _ar(f) for n, (f, _) in _RULES.items()},
    **{f"typo_{n}_lines": _lines(f) for n, (f, _) in _RULES.items()},
    "typo_dash_to_comma_lines": _lines(rules.dash_to_comma), "typo_list_conjunction_lines": _lines(rules.list_conjunction),
    "typography_news": _lines(lambda c: rules.typography(c, "news")),
    "connector_replace_gated": gated, "numbered_transitions": transitions, "quoted_bypass": quoted, "structural_openers": openers, "intensifier_destack": destack, "filler_insert": filled, "quote_verb_rotation": rotated,
    "anti_pattern_hits": hits, "respect_score": scored, "register_policy_matrix": lambda s, d: rules.policy(s),
    "register_gate": lambda s, d: rules.gated_by(_docs(s, d).select("doc_id", F.element_at(F.array(*map(F.lit, rules.POLICY)), (F.col("doc_id") % 4 + 1).cast("int")).alias("register")), "calque_dictionary"),
    "phrase_alternatives": lambda s, d: rules.alternatives(ALTERNATIVES.frame(s), "in conclusion").select("input", F.col("choice").cast("long").alias("choice"), "alternative"),
    "source_tag_counts": lambda s, d: rules.source_tags(ALTERNATIVES.frame(s)),
    "rule_priority": lambda s, d: rules.longest_table(ALTERNATIVES.frame(s)).select("table_name", "input", "priority"),
}
def _rebuilt_sql(pattern: str, free: str, found: str) -> str:
    """LINES with `free` of each x outside the pattern's places and `found` of each x that is one."""
    return f"""SELECT id, array_to_string(list_transform(range(1, len(pieces) + 1), lambda i: pieces[i] || coalesce(hits[i], '')), '') AS text
FROM (SELECT id, list_transform(string_split_regex(text, '{pattern}'), lambda x: {free}) AS pieces, list_transform(regexp_extract_all(text, '{pattern}'), lambda x: {found}) AS hits FROM {LINES.sql()})"""


ORACLE_SQL = {
    **{f"typo_{n}": f"SELECT doc_id, md5({sql}) AS md5 FROM {AR_SQL}" for n, (_, sql) in _RULES.items()},
    **{f"typo_{n}_lines": f"SELECT id, {sql} AS text FROM {LINES.sql()}" for n, (_, sql) in _RULES.items()},
    "typo_dash_to_comma_lines": f"SELECT id, regexp_replace(text, '({_A}) *— *({_A})', '\\1، \\2', 'g') AS text FROM {LINES.sql()}",
    "typo_list_conjunction_lines": _rebuilt_sql("(?:\\p{L}+، ){2,}\\p{L}+", "x", "array_to_string(list_transform(string_split(x, '، '), lambda w, i: CASE WHEN i > 1 AND NOT starts_with(w, 'و') THEN 'و' || w ELSE w END), '، ')"),
    "connector_replace_gated": _gated_sql(CONNECTORS, 700),
    "numbered_transitions": _gated_sql(TRANSITIONS, 500),
    "quoted_bypass": _rebuilt_sql('"[^"]*"|«[^»]*»', "replace(x, 'and', '&')", "x"),
    "structural_openers": "SELECT doc_id, md5(regexp_replace(regexp_replace(text, '^(The [a-z]+) ', 'Note: \\1 '), '^It ', 'This ')) AS md5 FROM documents",
    "intensifier_destack": "SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace('is is very very really really ' || text, 'very very ', 'very ', 'g'), '(really) (?:really )+', '\\1 ', 'g'), 'is is', 'is', 'g')) AS md5 FROM documents",
    "filler_insert": f"SELECT doc_id, sent_no, f AS filled, md5(CASE WHEN f THEN ['indeed', 'in fact', 'well'][(doc_id + sent_no) % 3 + 1] || ' ' || sentence ELSE sentence END) AS md5 FROM (SELECT *, (doc_id * 31 + sent_no * 17 + 7) % 1000 < 80 AND length(sentence) > 40 AND sent_no > 0 AS f FROM {_SENT_SQL})",
    "anti_pattern_hits": f"SELECT doc_id, pattern_id, category, CAST(sum(hits) AS BIGINT) AS hits FROM {_HITS_SQL} WHERE hits > 0 GROUP BY 1, 2, 3",
    "respect_score": f"SELECT doc_id, hits, 15 - least(15, 2 * hits) AS score FROM (SELECT doc_id, CAST(sum(hits) AS BIGINT) AS hits FROM {_HITS_SQL} GROUP BY 1)",
    "register_policy_matrix": f'SELECT register, flag, enabled FROM (VALUES {_POLICY_SQL}) t(register, flag, enabled)',
    "register_gate": "SELECT doc_id, register, register IN ('news', 'opinion') AS enabled FROM (SELECT doc_id, ['classical', 'news', 'opinion', 'technical'][doc_id % 4 + 1] AS register FROM documents)",
    "phrase_alternatives": f"SELECT input, CAST(i - 1 AS BIGINT) AS choice, alternatives[i] AS alternative FROM (SELECT input, alternatives, unnest(range(1, len(alternatives) + 1)) AS i FROM {ALTERNATIVES.sql()} WHERE input = 'in conclusion')",
    "source_tag_counts": f"SELECT table_name, coalesce(source_tag, 'v1_substrate') AS source_tag, count(*) AS n FROM {ALTERNATIVES.sql()} GROUP BY 1, 2",
    "rule_priority": f"SELECT table_name, input, row_number() OVER (PARTITION BY table_name ORDER BY length(input) DESC, ord) AS priority FROM {ALTERNATIVES.sql()}",
}
