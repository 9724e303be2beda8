"""Normalization, tokens, n-grams and mining over the transliterated documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import arabic, text
from wordloom.operators import mining
from wordloom.plans.inputs import ARABIC, AR_SQL, LATIN, ar_documents, spread, table

LEAST, TOP = 5, 300
#: Stop words for the transliterated corpus: its most frequent function words.
STOPWORDS = ["the", "and", "that", "with", "this", "was", "les", "des", "dans", "und", "die", "der", "nicht", "los", "del", "para", "una", "tion"]
STOP_AR = sorted({w.translate(str.maketrans(LATIN, ARABIC)).translate(str.maketrans("", "", arabic.MINING_MARKS)) for w in STOPWORDS})
_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP_AR) + "]"


def _norm_sql(level: str, column: str = "text") -> str:
    come = {"light": "", "medium": arabic.MEDIUM[0], "aggressive": arabic.MEDIUM[0] + arabic.AGGRESSIVE[0]}[level]
    go = {"light": "", "medium": arabic.MEDIUM[1], "aggressive": arabic.MEDIUM[1] + arabic.AGGRESSIVE[1]}[level]
    return f"translate(coalesce({column}, ''), '{come}{arabic.MARKS}', '{go}')"


TOKENS_SQL = f"list_filter(regexp_extract_all(translate(text, '{arabic.MINING_MARKS}', ''), '[ء-ي]+'), lambda x: length(x) >= 3)"
GRAMS_SQL = f"""(SELECT doc_id, source, n, pos, array_to_string(k[pos:pos + n - 1], ' ') AS term
  FROM (SELECT doc_id, source, k, n, unnest(range(1, len(k) - n + 2)) AS pos
        FROM (SELECT doc_id, source, k, unnest([1, 2, 3]) AS n FROM (SELECT doc_id, source, {TOKENS_SQL} AS k FROM {AR_SQL}))))"""
FREQ_SQL = f"(SELECT n, term, count(*) AS freq, min(doc_id * {mining.STEP} + pos) AS first_seen FROM {GRAMS_SQL} GROUP BY n, term)"
_STOPPED = f"len(list_filter(string_split(term, ' '), lambda p: list_contains({_STOP_SQL}, p) OR p = 'ال' OR (starts_with(p, 'ال') AND length(p) > 2 AND list_contains({_STOP_SQL}, substr(p, 3))))) = 0"


def _top_sql(freq: str) -> str:
    return f"""SELECT row_number() OVER (ORDER BY freq DESC, n, bucket_rank) AS rank, term, freq, ['unigram', 'bigram', 'trigram'][n] AS ngram_size
FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY freq DESC, first_seen) AS bucket_rank FROM {freq} WHERE freq >= {LEAST})
WHERE bucket_rank <= {TOP // 3} ORDER BY freq DESC, n, bucket_rank LIMIT {TOP}"""


def _normalized(level: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = ar_documents(spark, sf_dir).select("doc_id", arabic.normalize(F.col("text"), level).alias("t"))
        return made.select("doc_id", F.md5("t").alias("md5"), F.length("t").cast("long").alias("n_chars"))

    return query


def _normalized_sql(level: str) -> str:
    return f"SELECT doc_id, md5(t) AS md5, length(t) AS n_chars FROM (SELECT doc_id, {_norm_sql(level)} AS t FROM {AR_SQL})"


def _digits(form: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
        source = F.translate("text", arabic.WESTERN, arabic.ARABIC_INDIC) if form == "western" else F.col("text")
        return docs.select("doc_id", F.md5(arabic.normalize(source, "light", form)).alias("md5"))

    return query


def _digits_sql(form: str) -> str:
    w, a = arabic.WESTERN, arabic.ARABIC_INDIC
    source, come, go = (f"translate(text, '{w}', '{a}')", a, w) if form == "western" else ("text", w, a)
    return f"SELECT doc_id, md5(translate(coalesce({source}, ''), '{come}{arabic.MARKS}', '{go}')) AS md5 FROM documents"


def idempotence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that a second normalization changes, by level: none."""
    docs = ar_documents(spark, sf_dir)
    once = docs.select(*[arabic.normalize(F.col("text"), v).alias(v) for v in arabic.LEVELS])
    return once.agg(*[F.count_if(arabic.normalize(F.col(v), v) != F.col(v)).alias(v) for v in arabic.LEVELS]).unpivot([], list(arabic.LEVELS), "level", "violations")


def monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts by level; a stricter level never has more."""
    made = ar_documents(spark, sf_dir).select(*[arabic.normalize(F.col("text"), v).alias(v) for v in arabic.LEVELS])
    return made.agg(*[F.countDistinct(v).alias(v) for v in arabic.LEVELS])


_BOTH_SQL = f"(SELECT doc_id, 'latin' AS script, text FROM documents UNION ALL SELECT doc_id, 'arabic', text FROM {AR_SQL} UNION ALL SELECT d.doc_id, 'mixed', d.text || a.text FROM documents d JOIN {AR_SQL} a USING (doc_id))"
_LETTERS = "length(regexp_replace(text, '[^\\p{L}]', '', 'g'))"
_AR_LETTERS = "length(regexp_replace(text, '[^\\x{0620}-\\x{064A}\\x{066E}-\\x{066F}\\x{0671}-\\x{06D3}\\x{06D5}\\x{06E5}-\\x{06E6}\\x{06EE}-\\x{06EF}\\x{06FA}-\\x{06FC}\\x{06FF}]', '', 'g'))"
_RATIO_SQL = f"CASE WHEN {_LETTERS} = 0 THEN 0.0 ELSE {_AR_LETTERS} / {_LETTERS} END"


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    from wordloom.plans.inputs import transliterate

    ar = transliterate(F.col("text"))
    kinds = F.array(*[F.struct(F.lit(k).alias("script"), t.alias("text")) for k, t in (("latin", F.col("text")), ("arabic", ar), ("mixed", F.concat("text", ar)))])
    return docs.select("doc_id", F.explode(kinds).alias("x")).select("doc_id", "x.*")


def ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir).select("doc_id", "script", F.round(arabic.arabic_char_ratio(F.col("text")), 6).alias("ratio"))


def dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir).groupBy("script").agg(F.count_if(arabic.is_arabic_dominant(F.col("text"))).alias("n_dominant"), F.count("*").alias("n_docs"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mining.tokens(ar_documents(spark, sf_dir))
    return made.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("n_distinct"))


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.totals(ar_documents(spark, sf_dir))


def _freq(n: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        tokens = mining.tokens(ar_documents(spark, sf_dir)).select("doc_id", "tokens")
        grams = tokens.select("doc_id", F.explode(text.ngrams(F.col("tokens"), (n,))).alias("g")).select("doc_id", "g.*")
        return mining.frequencies(grams).filter(F.col("freq") >= LEAST).select("term", "freq", F.col("first_seen").cast("long").alias("first_seen"))

    return query


def _frequencies(spark: SparkSession, sf_dir: str, stopwords: list[str] | None = None) -> DataFrame:
    return mining.frequencies(mining.occurrences(ar_documents(spark, sf_dir), stopwords))


def top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: frequency-ranked uni-, bi- and trigrams of one scan."""
    return mining.top_candidates(_frequencies(spark, sf_dir), TOP, LEAST)


def top_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.top_candidates(_frequencies(spark, sf_dir, STOP_AR), TOP, LEAST)


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sample contexts of each of the 50 best terms, from all documents."""
    docs = ar_documents(spark, sf_dir)
    best = mining.top_candidates(mining.frequencies(mining.occurrences(docs)), TOP, LEAST).filter("rank <= 50")
    return mining.contexts(docs, best)


def size_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mining.occurrences(ar_documents(spark, sf_dir).select("doc_id", "source", "text").withColumn("doc_id", F.struct("doc_id", "source")))
    counted = found.groupBy(F.col("doc_id.source").alias("source"), "n", "term").agg(F.count("*").alias("freq"))
    return mining.size_pivot(counted, "source", LEAST)


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.prompt_batches(top(spark, sf_dir))


QUERIES = {
    **{f"normalize_{v}": _normalized(v) for v in arabic.LEVELS},
    "normalize_digits_western": _digits("western"), "normalize_digits_arabic_indic": _digits("arabic_indic"),
    "normalize_idempotence_violations": idempotence, "normalize_monotonicity": monotone,
    "arabic_char_ratio": ratio, "arabic_dominant_docs": dominant, "token_counts": token_counts, "corpus_totals": totals,
    "unigram_freq": _freq(1), "bigram_freq": _freq(2), "trigram_freq": _freq(3),
    "mine_top_candidates": top, "mine_candidates_without_stopwords": top_filtered, "candidate_contexts": contexts, "ngram_size_by_source_pivot": size_pivot, "pairing_prompt_batches": prompts,
}
ORACLE_SQL = {
    **{f"normalize_{v}": _normalized_sql(v) for v in arabic.LEVELS},
    "normalize_digits_western": _digits_sql("western"), "normalize_digits_arabic_indic": _digits_sql("arabic_indic"),
    "normalize_idempotence_violations": " UNION ALL ".join(f"SELECT '{v}' AS level, CAST(count_if({_norm_sql(v, 't')} != t) AS BIGINT) AS violations FROM (SELECT {_norm_sql(v)} AS t FROM {AR_SQL})" for v in arabic.LEVELS),
    "normalize_monotonicity": "SELECT " + ", ".join(f"count(DISTINCT {_norm_sql(v)}) AS {v}" for v in arabic.LEVELS) + f" FROM {AR_SQL}",
    "arabic_char_ratio": f"SELECT doc_id, script, round({_RATIO_SQL}, 6) AS ratio FROM {_BOTH_SQL}",
    "arabic_dominant_docs": f"SELECT script, CAST(count_if({_RATIO_SQL} >= 0.5) AS BIGINT) AS n_dominant, count(*) AS n_docs FROM {_BOTH_SQL} GROUP BY script",
    "token_counts": f"SELECT doc_id, len(k) AS n_tokens, len(list_distinct(k)) AS n_distinct FROM (SELECT doc_id, {TOKENS_SQL} AS k FROM {AR_SQL})",
    "corpus_totals": f"SELECT CAST(count_if(text != '') AS BIGINT) AS n_articles, CAST(coalesce(sum(len({TOKENS_SQL})), 0) AS BIGINT) AS n_tokens FROM {AR_SQL}",
    **{f"{name}_freq": f"SELECT term, freq, first_seen FROM {FREQ_SQL} WHERE n = {n} AND freq >= {LEAST}" for n, name in mining.SIZE_NAMES.items()},
    "mine_top_candidates": _top_sql(FREQ_SQL),
    "mine_candidates_without_stopwords": _top_sql(f"(SELECT * FROM {FREQ_SQL} WHERE {_STOPPED})"),
    "candidate_contexts": f"""WITH best AS (SELECT term FROM ({_top_sql(FREQ_SQL)}) WHERE rank <= 50),
plain AS (SELECT doc_id, translate(text, '{arabic.MINING_MARKS}', '') AS plain FROM {AR_SQL}),
hits AS (SELECT term, doc_id, plain, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS sample_no, strpos(plain, term) AS place FROM plain JOIN best ON contains(plain, term))
SELECT term, sample_no, doc_id, trim(replace(substr(plain, greatest(1, place - 50), place - greatest(1, place - 50) + length(term) + 50), chr(10), ' ')) AS context FROM hits WHERE sample_no <= 3""",
    "ngram_size_by_source_pivot": f"""SELECT source, CAST(count_if(n = 1) AS BIGINT) AS unigram, CAST(count_if(n = 2) AS BIGINT) AS bigram, CAST(count_if(n = 3) AS BIGINT) AS trigram, count(*) AS total
FROM (SELECT source, n, term, count(*) AS freq FROM {GRAMS_SQL} GROUP BY source, n, term HAVING count(*) >= {LEAST}) GROUP BY source""",
    "pairing_prompt_batches": f"""SELECT (rank - 1) // 20 AS batch, count(*) AS n_terms, string_agg((rank - ((rank - 1) // 20) * 20) || '. ' || term || ' (freq=' || freq || ')', chr(10) ORDER BY rank) AS prompt FROM ({_top_sql(FREQ_SQL)}) GROUP BY 1""",
}
