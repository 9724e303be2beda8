"""Pattern and phrase matching over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import text
from wordloom.operators import matching
from wordloom.plans.inputs import spread, table

PATTERNS = ["License", "icense", "idiot", "@mail", "555-", "token", "oken "]
PHRASES = ["the and", "licensed under", "all rights reserved", "is the", "mit license", "C++", "café"]
WORDS = ["the of", "of the", "public license", "rights", "idiot", "de la", "all rights reserved", "und"]
SWAPS = {"the": "THE", "then": "<then>", "and": "&", "and the": "&the", "tion": "T", "": "never"}
GUARDS = {"License": ["under", "Public", "GNU"], "idiot": ["the"]}
EXCLUDED = {"License": "Apache"}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _list(items: list[str]) -> str:
    return ", ".join("'" + i.replace("'", "''") + "'" for i in items)


def _match_sql(patterns: list[str]) -> str:
    """Each pattern's places by the lengths between them (none of these patterns overlaps itself)."""
    return "(" + " UNION ALL ".join(
        f"""SELECT doc_id, CAST(at AS BIGINT) AS "start", CAST(at + {len(p)} AS BIGINT) AS "end", '{p}' AS pattern FROM (SELECT doc_id, unnest(list_transform(range(1, len(s)), lambda i: list_sum(list_transform(s[1:i], lambda x: length(x))) + (i - 1) * {len(p)})) AS at FROM (SELECT doc_id, string_split(text, '{p}') AS s FROM documents WHERE contains(text, '{p}')))"""
        for p in patterns
    ).replace(" at ", " place ").replace("(at ", "(place ") + ")"


MATCH_SQL = _match_sql(PATTERNS)


def match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_all(_docs(spark, sf_dir), PATTERNS)


def automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_automaton(_docs(spark, sf_dir), PATTERNS)


def first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.first_match(automaton(spark, sf_dir))


def any_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).filter(matching.has_any(F.col("text"), PATTERNS)).select("doc_id")


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.pattern_report(automaton(spark, sf_dir))


def whole_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.phrase_hits(_docs(spark, sf_dir), PHRASES)


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.phrase_join(_docs(spark, sf_dir), spark.createDataFrame([(w,) for w in WORDS], "phrase string"), longest=3)


def substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _docs(spark, sf_dir).select("doc_id", matching.substitute(F.col("text"), SWAPS).alias("t"))
    return made.select("doc_id", F.md5("t").alias("md5"), F.length("t").cast("long").alias("n_chars"))


def guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return matching.guarded(matching.match_automaton(docs, list(GUARDS)), docs, GUARDS, required=1, excluded=EXCLUDED)


def page_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' texts: tags dropped, common entities decoded, the most frequent words."""
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"))
    plain = text.unescape_common(F.regexp_replace("html", "<[^>]*>", " "))
    words = pages.select("page_id", F.explode(F.filter(F.split(F.lower(plain), r"[^\p{L}]+"), lambda w: F.length(w) >= 3)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("n_pages")).filter("n >= 5")


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entities, by Arrow batches; on these pages equal to the common ones."""
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"))
    return pages.select("page_id", F.md5(text.html_unescape(F.col("html"))).alias("md5"))


def priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.createDataFrame([(i, k) for i, k in enumerate(SWAPS) if k], "ord long, key string")
    return matching.longest_first(keys)


_BOUND = lambda p: f"regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_]){p}($|[^\\p{{L}}\\p{{N}}_])')"
_KEYS = sorted(filter(None, SWAPS), key=len, reverse=True)
_SUB = "|".join(_KEYS)
_SWAP_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SWAPS.items() if k)
_NEAR = 'substr(d.text, greatest(1, "start" + 1 - 100), "end" - "start" + least(100, "start") + 100)'
QUERIES = {
    "phrase_match_all": match_all, "phrase_match_automaton": automaton, "phrase_match_first": first, "phrase_any_match": any_match, "distinct_patterns_hit": report, "whole_word_phrase_hits": whole_words,
    "phrase_ngram_join": joined, "longest_first_substitution": substitution, "topic_guarded_matches": guarded, "html_text_extract_terms": page_terms, "html_unescape_pages": page_text, "substitution_priority": priority,
}
ORACLE_SQL = {
    "phrase_match_all": f"SELECT * FROM {MATCH_SQL}",
    "phrase_match_automaton": f"SELECT * FROM {MATCH_SQL}",
    "phrase_match_first": f"""SELECT doc_id, "start", "end", pattern FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "end", "start") AS rn FROM {MATCH_SQL}) WHERE rn = 1""",
    "phrase_any_match": "SELECT doc_id FROM documents WHERE " + " OR ".join(f"contains(text, '{p}')" for p in PATTERNS),
    "distinct_patterns_hit": f"SELECT pattern, count(*) AS n_matches, count(DISTINCT doc_id) AS n_docs FROM {MATCH_SQL} GROUP BY pattern",
    "whole_word_phrase_hits": " UNION ALL ".join(f"SELECT doc_id, CAST({i} AS BIGINT) AS pair_no, '{p}' AS phrase FROM documents WHERE {_BOUND(p.lower()) if p != 'C++' else 'regexp_matches(lower(text), ' + chr(39) + '(^|[^\\p{L}\\p{N}_])c[+][+][\\p{L}\\p{N}_]' + chr(39) + ')'}" for i, p in enumerate(PHRASES, 1)),
    "phrase_ngram_join": f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x != '') AS w FROM documents),
g AS (SELECT doc_id, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT doc_id, w, unnest([1, 2, 3]) AS n FROM w)))
SELECT DISTINCT doc_id, phrase FROM g JOIN (SELECT unnest([{_list(WORDS)}]) AS phrase) p ON g.gram = lower(p.phrase)""",
    "longest_first_substitution": f"""SELECT doc_id, md5(t) AS md5, length(t) AS n_chars FROM (SELECT doc_id, array_to_string(list_transform(range(1, len(a) + 1), lambda i: a[i] || coalesce(CASE m[i] {_SWAP_CASE} END, '')), '') AS t
FROM (SELECT doc_id, regexp_split_to_array(text, '{_SUB}') AS a, regexp_extract_all(text, '{_SUB}') AS m FROM documents))""",
    "topic_guarded_matches": f"""SELECT m.doc_id, "start", "end", pattern FROM {_match_sql(list(GUARDS))} m JOIN documents d USING (doc_id) WHERE
(pattern = 'License' AND (contains({_NEAR}, 'under') OR contains({_NEAR}, 'Public') OR contains({_NEAR}, 'GNU')) AND NOT contains({_NEAR}, 'Apache')) OR (pattern = 'idiot' AND contains({_NEAR}, 'the'))""",
    "html_text_extract_terms": """WITH t AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t FROM pages),
w AS (SELECT page_id, unnest(regexp_split_to_array(lower(t), '[^\\p{L}]+')) AS word FROM t)
SELECT word, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM w WHERE length(word) >= 3 GROUP BY word HAVING count(*) >= 5""",
    "substitution_priority": "SELECT ord, key, row_number() OVER (ORDER BY length(key) DESC, ord) AS priority FROM (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), '{k}')" for i, k in enumerate(SWAPS) if k) + ") t(ord, key)",
}
