"""Distributional statistics by language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators import statistics
from wordloom.plans.inputs import AR_SQL, ar_documents, spread, table

CONNECTORS = ["and", "that", "for", "but", "und", "oder", "aber", "et", "mais", "que", "pero", "y"]
_LIST = ", ".join(f"'{c}'" for c in CONNECTORS)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.sentence_rows(_docs(spark, sf_dir), "lang")


def _connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.connectors(_docs(spark, sf_dir), "lang", CONNECTORS)


SENT_SQL = """(SELECT category, doc_id, i - 1 AS sent_no, s[i] AS sentence, len(list_filter(string_split(s[i], ' '), lambda w: w != '')) AS n_words
FROM (SELECT category, doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT lang AS category, doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?؟؛\\n]+'), lambda x: trim(x)), lambda x: x != '') AS s FROM documents)))"""
STATS_SQL = f"""(SELECT category, n_records, n_sentences, n_tokens, round(m, 6) AS mean_sentence_length, round(s, 6) AS stddev_sentence_length, round(s / m, 6) AS cv, round((s - m) / (s + m), 6) AS burstiness
FROM (SELECT category, count(DISTINCT doc_id) AS n_records, count(*) AS n_sentences, CAST(sum(n_words) AS BIGINT) AS n_tokens, avg(n_words) AS m, stddev_pop(n_words) AS s FROM {SENT_SQL} GROUP BY category))"""
CONN_SQL = f"(SELECT lang AS category, token, count(*) AS n FROM (SELECT lang, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) AS token FROM documents) WHERE token IN ({_LIST}) GROUP BY 1, 2)"
_BINS = "CASE " + " ".join(f"WHEN n_words <= {top} THEN '{name}'" for top, name in statistics.BINS) + " ELSE '51+' END"
_MARKS = "length(regexp_replace(text, '[^\\x{064B}-\\x{0652}\\x{0670}]', '', 'g'))"
_AR = "length(regexp_replace(text, '[^\\x{0620}-\\x{064A}\\x{066E}-\\x{066F}\\x{0671}-\\x{06D3}\\x{06D5}\\x{06E5}-\\x{06E6}\\x{06EE}-\\x{06EF}\\x{06FA}-\\x{06FC}\\x{06FF}]', '', 'g'))"

#: Starters that are varied when a document repeats them, and what they are varied by.
DETECTORS, POOL = ["the", "it", "in", "and", "un", "der"], ["Besides", "Then again", "Here"]
QUERIES = {
    "sentence_length_stats": lambda s, d: statistics.length_stats(_rows(s, d)),
    "sentence_length_histogram": lambda s, d: statistics.histogram(_rows(s, d)),
    "sentence_starters_topk": lambda s, d: statistics.starters(_rows(s, d), 20),
    "connector_counts": _connectors,
    "connector_topk_global": lambda s, d: statistics.ranked(_connectors(s, d).groupBy(F.lit("*").alias("category"), "token").agg(F.sum("n").alias("n")), ["category"], ["token"], 5),
    "connector_share": lambda s, d: statistics.shares(_connectors(s, d)),
    "connector_entropy": lambda s, d: statistics.entropy(_connectors(s, d)),
    "tashkeel_ratio_by_lang": lambda s, d: statistics.mark_ratio(ar_documents(s, d), "lang"),
    "category_compare_burstiness": lambda s, d: statistics.compare(statistics.length_stats(_rows(s, d)), "burstiness"),
    "category_metrics": lambda s, d: statistics.melted(statistics.length_stats(_rows(s, d))),
    "repeat_starter_flags": lambda s, d: statistics.repeated_starters(_rows(s, d)),
    "starter_pool": lambda s, d: statistics.varied_starters(_rows(s, d), DETECTORS, POOL),
}
ORACLE_SQL = {
    "sentence_length_stats": f"SELECT * FROM {STATS_SQL}",
    "sentence_length_histogram": f"SELECT category, bin, n, round(100 * n / sum(n) OVER (PARTITION BY category), 6) AS pct FROM (SELECT category, {_BINS} AS bin, count(*) AS n FROM {SENT_SQL} GROUP BY 1, 2)",
    "sentence_starters_topk": f"SELECT * FROM (SELECT category, row_number() OVER (PARTITION BY category ORDER BY n DESC, starter) AS rank, starter, n FROM (SELECT category, lower(string_split(sentence, ' ')[1]) AS starter, count(*) AS n FROM {SENT_SQL} GROUP BY 1, 2)) WHERE rank <= 20",
    "connector_counts": f"SELECT * FROM {CONN_SQL}",
    "connector_topk_global": f"SELECT * FROM (SELECT '*' AS category, row_number() OVER (ORDER BY n DESC, token) AS rank, token, n FROM (SELECT token, CAST(sum(n) AS BIGINT) AS n FROM {CONN_SQL} GROUP BY token)) WHERE rank <= 5",
    "connector_share": f"SELECT category, token, n, round(100.0 * n / sum(n) OVER (PARTITION BY category), 6) AS pct FROM {CONN_SQL}",
    "connector_entropy": f"SELECT category, round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT category, n / sum(n) OVER (PARTITION BY category) AS p FROM {CONN_SQL}) GROUP BY category",
    "tashkeel_ratio_by_lang": f"SELECT category, round(avg(CASE WHEN letters > 0 THEN marks / letters END), 6) AS mean_tashkeel_ratio, count(*) AS n_records FROM (SELECT lang AS category, {_MARKS} AS marks, {_AR} AS letters FROM {AR_SQL}) GROUP BY category",
    "category_compare_burstiness": f"SELECT category, 'burstiness' AS metric, burstiness AS value FROM {STATS_SQL}",
    "category_metrics": " UNION ALL ".join(f"SELECT category, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {STATS_SQL}" for m in statistics.METRICS),
    "repeat_starter_flags": f"SELECT doc_id, sent_no, starter FROM (SELECT doc_id, sent_no, starter, lag(starter) OVER (PARTITION BY doc_id ORDER BY sent_no) AS before FROM (SELECT doc_id, sent_no, lower(string_split(sentence, ' ')[1]) AS starter FROM {SENT_SQL})) WHERE starter = before",
    "starter_pool": f"""SELECT doc_id, sent_no, CASE WHEN starter IN ({', '.join(map(repr, DETECTORS))}) AND nth > 1 THEN [{', '.join(map(repr, POOL))}][(nth - 2) % {len(POOL)} + 1] || substr(sentence, length(starter) + 1) ELSE sentence END AS sentence
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, starter ORDER BY sent_no) AS nth FROM (SELECT doc_id, sent_no, sentence, lower(string_split(sentence, ' ')[1]) AS starter FROM {SENT_SQL}))""",
}
