"""Dictionary and term-pair queries: pairs derived from the documents' words, entries from literals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions import text
from wordloom.operators import terms
from wordloom.plans.inputs import ARABIC, LATIN, Literal, spread, table
from wordloom.sources import articles, exports

ENTRIES = Literal(
    "ord long, en string, calque string, natural string, domain string, confidence string, keywords_ar array<string>, keywords_en array<string>, applies_only_in_domain array<string>, corpus_hits long",
    [
        (0, "at the end of the day", "في نهاية اليوم", "في المحصلة", "general", "high", [], [], None, 4), (1, "play a role", "يلعب دورا", "يؤدي دورا", "general", "medium", ["دور"], [], None, 0),
        (2, "play a role", "يلعب دور", "له أثر", "media", "high_user_attested", [], ["actor"], ["media"], None), (3, "blank", "  ", "شيء", "general", "low", None, None, None, 1),
        (4, "same", "ذاته", " ذاته ", "general", "high", [], [], None, 2), (5, "take place", "يأخذ مكانا", "يحدث", "news", "topic-guarded", ["حدث"], ["event"], ["news", "media"], 9),
        (6, "take place", "يأخذ مكانا", "يجري", "news", "medium_consensus", [], [], None, 3), (7, "odd", "غريب\t", "عجيب", "general", "unheard", None, [], [], None), (8, "play a role", "يلعب دورا", "يسهم", "general", "high", [], [], None, 7),
    ],
)
RESPONSES = Literal(
    "batch long, response string",
    [
        (0, '[{"ar":"a","en":"one","domain":"x","confidence":"HIGH "},{"ar":"b","en":"","domain":"x","confidence":"high"}]'), (1, '```json\n[{"ar":"c","en":" three ","confidence":"medium"}]\n```'),
        (2, 'Here: [ {"ar":"d","en":"four","domain":"Y"} ] done'), (3, '{"ar":"e","en":"five"}'), (4, "no idea"), (5, ""), (6, '[{"ar":"f","en":"six","confidence":"low"}]'),
    ],
)
TIES = Literal("ar string, en string, second_alt string, third_en string", [("a", "car", "", ""), ("b", "car", " Car ", "auto"), ("c", "car", "auto", "Auto"), ("d", "car", "auto", "van"), ("e", "car", None, "van"), ("f", "car", None, None)])
PATHS = Literal("path string", [("/x/terms-legal.json",), ("/x/terms-news.json",), ("/y/terms-legal.json",), ("/x/other-a.json",), ("terms-tech.json",), ("/x/terms-bad.txt",)])
_AR = f"translate(word, '{LATIN}', '{ARABIC}')"
_CONF = "CASE ord % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE NULL END"
_SIZE = "CASE WHEN length(word) < 5 THEN 'unigram' WHEN length(word) < 8 THEN 'bigram' ELSE 'trigram' END"
_VENDOR = "CASE ord % 4 WHEN 0 THEN 'codex' WHEN 1 THEN 'gemini' WHEN 2 THEN 'kimi' ELSE 'minimax' END"
_ERA = "CASE WHEN ord % 11 = 0 THEN '1990s' WHEN ord % 11 = 1 THEN '' END"
PAIRS_SQL = f"""(SELECT ord, {_AR} AS ar, word AS en, domain, corpus_freq, {_SIZE} AS ngram_size, {_CONF} AS confidence, {_VENDOR} AS proposer, {_ERA} AS era_locked FROM
(SELECT *, row_number() OVER (PARTITION BY domain ORDER BY corpus_freq DESC, word) AS ord FROM (SELECT lang AS domain, word, count(*) AS corpus_freq FROM (SELECT lang, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS word FROM documents) WHERE length(word) >= 3 GROUP BY 1, 2) WHERE corpus_freq >= 8))"""
VOTES_SQL = f"(SELECT domain, ar, proposer, vendor, (ord * 7 + vno * 3) % 5 < 3 AS agree FROM {PAIRS_SQL} CROSS JOIN (VALUES ('codex', 0), ('gemini', 1), ('kimi', 2), ('minimax', 3)) v(vendor, vno) WHERE ord % 13 != 0)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of three letters and more, eight times or oftener in a language, as term pairs of that domain."""
    docs = spread(table(spark, sf_dir, "documents").select("lang", "text"))
    words = docs.select(F.col("lang").alias("domain"), F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).filter(F.length("word") >= 3)
    counted = words.groupBy("domain", "word").agg(F.count("*").alias("corpus_freq")).filter("corpus_freq >= 8")
    numbered = counted.withColumn("ord", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("corpus_freq"), "word")).cast("long"))
    return numbered.select("ord", F.translate("word", LATIN, ARABIC).alias("ar"), F.col("word").alias("en"), "domain", "corpus_freq", *[F.expr(e).alias(n) for e, n in ((_SIZE, "ngram_size"), (_CONF, "confidence"), (_VENDOR, "proposer"), (_ERA, "era_locked"))])


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = pairs(spark, sf_dir).filter("ord % 13 != 0")
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("vendor"), F.lit(i).alias("vno")) for i, v in enumerate(terms.VENDORS)]))
    return own.select("domain", "ar", "proposer", "ord", each.alias("v")).select("domain", "ar", "proposer", "v.vendor", ((F.col("ord") * 7 + F.col("v.vno") * 3) % 5 < 3).alias("agree"))


def _domain(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pairs(spark, sf_dir).filter(F.col("domain") == name)


#: Pairs that need escapes, stripping and defaults, as a domain of their own behind the others.
EDGES = Literal("ord long, ar string, en string, domain string, corpus_freq long, confidence string, cross_llm_agreement boolean, three_way_verdict string", [
    (1, " واحد ", "a\tb", "edge", 7, None, True, "switch"), (2, "اثنان|ثلاثة", "x & <y> | \"z\"", "edge", None, "high", False, None), (3, "  ", "blank", "edge", 9, "high", None, None), (4, "أربعة", None, "edge", 9, "high", None, None),
    (5, "خمسة", " back\\slash ", "edge", 7, "medium", None, None), (6, "ستة", "low one", "edge", 7, "low", None, None), (7, "واحد", "again", "edge", 8, "high", None, "keep"),
])


def _gathered(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = terms.export_rows(pairs(spark, sf_dir).unionByName(EDGES.frame(spark), allowMissingColumns=True))
    order = F.when(F.col("domain") == "en", 0).when(F.col("domain") == "fr", 1).when(F.col("domain") == "de", 2).when(F.col("domain") == "es", 3).otherwise(4).cast("long")
    return terms.dedup_domains(kept.withColumn("domain_ord", order))


GATHERED_SQL = f"""(SELECT *, row_number() OVER (ORDER BY corpus_freq DESC, seen) AS position FROM (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY corpus_freq DESC, domain_ord, ord) AS pick, min(domain_ord * 1000000 + ord) OVER (PARTITION BY ar) AS seen
FROM (SELECT ord, trim(ar) AS ar, trim(en) AS en, domain, coalesce(corpus_freq, 0) AS corpus_freq, coalesce(confidence, 'medium') AS confidence, cross_llm_agreement, three_way_verdict, CASE domain WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 WHEN 'es' THEN 3 ELSE 4 END AS domain_ord
FROM (SELECT ord, ar, en, domain, corpus_freq, confidence, NULL AS cross_llm_agreement, NULL AS three_way_verdict FROM {PAIRS_SQL} UNION ALL SELECT * FROM {EDGES.sql()}) WHERE coalesce(confidence, 'medium') IN ('medium', 'high') AND trim(coalesce(ar, '')) != '' AND trim(coalesce(en, '')) != '')) WHERE pick = 1)"""
_E = ENTRIES.sql()
_XML = lambda c: f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_STRIP = lambda c: f"regexp_replace(coalesce({c}, ''), '^\\s+|\\s+$', '', 'g')"
_C, _N = _STRIP("calque"), _STRIP('"natural"')
_VALID = f"""(SELECT * REPLACE ({_C} AS calque, {_N} AS "natural") FROM {_E} WHERE {_C} != '' AND {_N} != '' AND {_C} != {_N})"""
_GUARD = "(len(coalesce(keywords_ar, [])) > 0 OR len(coalesce(keywords_en, [])) > 0)"
_RANK = "CASE confidence WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'medium_consensus' THEN 2 WHEN 'topic-guarded' THEN 3 WHEN 'high' THEN 4 WHEN 'high_user_attested' THEN 5 ELSE 0 END"


def _second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second vendor's proposals: some equal, some longer, some other, some missing; later ones win."""
    own = _domain(spark, sf_dir, "en").filter("ord % 7 != 0")
    alt = F.when(F.col("ord") % 3 == 0, text.upper(F.col("en"))).when(F.col("ord") % 3 == 1, F.concat("en", F.lit(" thing"))).otherwise(F.lit("other"))
    first = own.select("ar", F.lit("draft").alias("en"), F.lit(0).cast("long").alias("ord"))
    return first.unionByName(own.select("ar", alt.alias("en"), (F.col("ord") + 1).alias("ord")))


def confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _domain(spark, sf_dir, "en").filter("era_locked is null").select("ar", "en", "confidence")
    return terms.confirm(one, _second(spark, sf_dir))


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = _domain(spark, sf_dir, "en").select(F.col("ar").alias("term"), F.col("corpus_freq").alias("freq"), "ngram_size")
    own = _domain(spark, sf_dir, "en").filter("ord % 2 = 0")
    offered = own.select("ar", F.when(F.col("ord") % 10 == 0, "").otherwise(F.concat(F.lit(" "), "en")).alias("en"), "confidence", F.upper("domain").alias("domain"), "proposer")
    return terms.accept_proposals(candidates, offered)


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = terms.proposals_of(RESPONSES.frame(spark)).select("batch", F.posexplode("proposals").alias("pos", "p"))
    return made.select("batch", F.col("pos").cast("long").alias("pos"), "p.ar", "p.en", "p.domain", "p.confidence")


_CONFIRMED_ALT = "CASE WHEN ord % 7 = 0 THEN NULL WHEN ord % 3 = 0 THEN upper(en) WHEN ord % 3 = 1 THEN en || ' thing' ELSE 'other' END"
QUERIES = {
    "valid_entries": lambda s, d: terms.valid_entries(ENTRIES.frame(s)).select("ord", "calque", "natural"),
    "entry_defaults": lambda s, d: terms.with_defaults(ENTRIES.frame(s), {"corpus_hits": 0}).select("ord", "corpus_hits"),
    "lookup_en_exact": lambda s, d: terms.find_by_en(ENTRIES.frame(s), "play a role", exact=True).select("ord", "calque"),
    "lookup_en_ci": lambda s, d: terms.find_by_en(pairs(s, d), "  THE ").select("ord", "ar", "en", "domain"),
    "lookup_ar_first": lambda s, d: terms.find_by_ar(_domain(s, d, "en"), _domain(s, d, "en").filter("ord % 5 = 0")).select("ar", "ord", "en"),
    "has_term_semi": lambda s, d: terms.has_terms(_domain(s, d, "en").select(F.col("en").alias("term")), _domain(s, d, "fr").select(F.col("en").alias("term"))),
    "domain_filter": lambda s, d: _domain(s, d, "de").select("ord", "en", "corpus_freq"),
    "confidence_threshold": lambda s, d: terms.confident(ENTRIES.frame(s), "topic-guarded").select("ord", "en", "confidence"),
    "pair_confidence_threshold": lambda s, d: terms.confident(pairs(s, d), "medium", terms.PAIR_CONFIDENCE, missing="medium").groupBy("domain", "confidence").agg(F.count("*").alias("n")),
    "canonical_entry": lambda s, d: terms.canonical(ENTRIES.frame(s)).select("en", "ord", "natural"),
    "topic_guard_stats": lambda s, d: terms.entry_stats(ENTRIES.frame(s)),
    "domain_hard_filter": lambda s, d: ENTRIES.frame(s).filter(terms.domain_allows("media")).select("ord"),
    "discover_domains": lambda s, d: articles.domains_of(PATHS.frame(s), "terms"),
    "ngram_size_filter": lambda s, d: pairs(s, d).filter(F.col("ngram_size").isin("bigram", "trigram")).groupBy("domain", "ngram_size").agg(F.count("*").alias("n")),
    "parse_proposals": parsed,
    "pair_join_proposals": proposals,
    "second_vendor_agreement": confirmed,
    "vote_tiers": lambda s, d: terms.tiers(_domain(s, d, "en").dropDuplicates(["ar"]), votes(s, d).filter("domain = 'en'").select("ar", "vendor", "agree")),
    "vendor_agreement_matrix": lambda s, d: terms.agreement_matrix(votes(s, d)),
    "tiebreak_verdict": lambda s, d: terms.tiebreak(TIES.frame(s)).select("ar", "three_way_verdict", "needs_manual_review", "final_en"),
    **{f"consensus_filter_{k}": (lambda k: lambda s, d: terms.consensus(pairs(s, d).withColumn("n_independent_agree", F.when(F.col("ord") % 9 != 0, F.col("ord") % 4)), k).groupBy("domain", "n_independent_agree").agg(F.count("*").alias("n")))(k) for k in (1, 2, 3)},
    "era_filter": lambda s, d: terms.current_era(pairs(s, d)).groupBy("domain").agg(F.count("*").alias("n")),
    "additive_merge": lambda s, d: terms.merge_additive(_domain(s, d, "en").select("ar", "en", "domain"), _domain(s, d, "fr").select("ar", "en", "domain")),
    "dedup_across_domains": lambda s, d: _gathered(s, d).select("position", "ar", "en", "domain", "corpus_freq"),
    "top_pairs": lambda s, d: terms.top_pairs(_domain(s, d, "en"), 50).select("ord", "en", "corpus_freq"),
    "domain_min_size_split": lambda s, d: terms.large_domains(pairs(s, d).withColumn("domain", F.when(F.col("ord") % 50 == 0, "other").otherwise(F.concat_ws("-", "domain", F.substring("en", 1, 1)))), None, 5).select("domain", "en", "n_in_domain"),
    "domain_distribution": lambda s, d: pairs(s, d).groupBy("domain").agg(F.count("*").alias("n")),
    "pair_stats_facets": lambda s, d: terms.pair_stats(pairs(s, d)),
    "duplicate_terms": lambda s, d: terms.duplicate_count(pairs(s, d), "ar"),
    "consumer_view_minimal": lambda s, d: terms.minimal_view(ENTRIES.frame(s)),
    "consumer_view_standard": lambda s, d: terms.standard_view(ENTRIES.frame(s)),
    "export_tsv": lambda s, d: exports.tsv(_gathered(s, d)),
    "export_json": lambda s, d: exports.json_lines(_gathered(s, d)),
    "export_tbx": lambda s, d: exports.tbx(_gathered(s, d)),
    "export_markdown": lambda s, d: exports.markdown(_gathered(s, d)),
    "export_json_array": lambda s, d: exports.json_array(EDGES.frame(s).withColumn("position", F.col("ord")), ("en", "corpus_freq", "cross_llm_agreement")),
    "view_minimal_tsv": lambda s, d: exports.view_lines(terms.minimal_view(ENTRIES.frame(s)), "minimal", "tsv"),
    "view_standard_markdown": lambda s, d: exports.view_lines(terms.standard_view(ENTRIES.frame(s)), "standard", "markdown"),
    "union_domains": lambda s, d: terms.union_domains({"de": _domain(s, d, "de").select("ord", "ar", "en"), "edge": EDGES.frame(s).select("ord", "ar", "en", "three_way_verdict")}),
    "corpus_confirmed": lambda s, d: terms.confirmed_naturals(ENTRIES.frame(s).select("ord", "natural"), ENTRIES.frame(s).filter("ord % 3 = 1").select(F.trim("natural").alias("term"))),
}
_first_en = f"(SELECT * FROM {PAIRS_SQL} WHERE domain = 'en')"
ORACLE_SQL = {
    "valid_entries": f'SELECT ord, calque, "natural" FROM {_VALID}',
    "entry_defaults": f"SELECT ord, coalesce(corpus_hits, 0) AS corpus_hits FROM {_E}",
    "lookup_en_exact": f"SELECT ord, calque FROM {_E} WHERE en = 'play a role'",
    "lookup_en_ci": f"SELECT ord, ar, en, domain FROM {PAIRS_SQL} WHERE lower(trim(en)) = 'the'",
    "lookup_ar_first": f"SELECT ar, ord, en FROM (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY ord) AS rn FROM {_first_en} WHERE ar IN (SELECT ar FROM {_first_en} WHERE ord % 5 = 0)) WHERE rn = 1",
    "has_term_semi": f"SELECT en AS term, en IN (SELECT en FROM {_first_en}) AS known FROM {PAIRS_SQL} WHERE domain = 'fr'",
    "domain_filter": f"SELECT ord, en, corpus_freq FROM {PAIRS_SQL} WHERE domain = 'de'",
    "confidence_threshold": f"SELECT ord, en, confidence FROM {_E} WHERE {_RANK} >= 3",
    "pair_confidence_threshold": f"SELECT domain, confidence, count(*) AS n FROM {PAIRS_SQL} WHERE CASE coalesce(confidence, 'medium') WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END >= 2 GROUP BY 1, 2",
    "canonical_entry": f'''SELECT en, ord, "natural" FROM (SELECT *, row_number() OVER (PARTITION BY en ORDER BY CASE confidence WHEN 'high' THEN 4 WHEN 'topic-guarded' THEN 3 WHEN 'medium' THEN 2 WHEN 'medium_consensus' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, ord) AS rn FROM {_E}) WHERE rn = 1''',
    "topic_guard_stats": f"SELECT count(*) AS n_entries, CAST(count_if(confidence = 'high') AS BIGINT) AS n_high, CAST(count_if(confidence = 'high_user_attested') AS BIGINT) AS n_attested, CAST(count_if({_GUARD}) AS BIGINT) AS n_guarded, CAST(count_if(coalesce(corpus_hits, 0) > 0) AS BIGINT) AS n_with_hits FROM {_E}",
    "domain_hard_filter": f"SELECT ord FROM {_E} WHERE applies_only_in_domain IS NULL OR list_contains(applies_only_in_domain, 'media')",
    "discover_domains": f"SELECT DISTINCT regexp_extract(path, '(?:^|/)terms-([^/]+)\\.json$', 1) AS domain FROM {PATHS.sql()} WHERE regexp_extract(path, '(?:^|/)terms-([^/]+)\\.json$', 1) != ''",
    "ngram_size_filter": f"SELECT domain, ngram_size, count(*) AS n FROM {PAIRS_SQL} WHERE ngram_size IN ('bigram', 'trigram') GROUP BY 1, 2",
    "parse_proposals": f"""SELECT batch, CAST(i - 1 AS BIGINT) AS pos, p[i] ->> 'ar' AS ar, p[i] ->> 'en' AS en, p[i] ->> 'domain' AS domain, p[i] ->> 'confidence' AS confidence
FROM (SELECT batch, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT batch, from_json(CASE WHEN starts_with(trim(response), '[') AND json_valid(response) THEN response ELSE regexp_extract(response, '(?s)\\[\\s*\\{{.*\\}}\\s*\\]') END, '["JSON"]') AS p FROM {RESPONSES.sql()} WHERE regexp_matches(response, '(?s)\\[\\s*\\{{.*\\}}\\s*\\]')))""",
    "pair_join_proposals": f"""SELECT c.ar, c.corpus_freq, c.ngram_size, trim(p.en) AS en, coalesce(p.confidence, 'medium') AS confidence, lower(p.domain) AS domain, p.proposer FROM {_first_en} c JOIN (SELECT * FROM {_first_en} WHERE ord % 2 = 0 AND ord % 10 != 0) p USING (ar) WHERE coalesce(p.confidence, 'medium') != 'low'""",
    "second_vendor_agreement": f"""WITH one AS (SELECT ar, en, confidence FROM {_first_en} WHERE era_locked IS NULL), alt AS (SELECT ar, arg_max(alt, ord) AS alt FROM (SELECT ar, ord, {_CONFIRMED_ALT} AS alt FROM {_first_en} WHERE ord % 7 != 0) GROUP BY ar),
j AS (SELECT one.*, alt.alt, coalesce(alt.alt, '') != '' AND (contains(lower(en), lower(alt.alt)) OR contains(lower(alt.alt), lower(en))) AS cross_agreement FROM one LEFT JOIN alt USING (ar))
SELECT ar, en, CASE WHEN cross_agreement THEN 'high' ELSE confidence END AS confidence, cross_agreement, CASE WHEN NOT cross_agreement AND alt IS NOT NULL THEN alt END AS disagreement_alt_en FROM j""",
    "vote_tiers": f"""SELECT ar, proposer, n_vendors_agree, n_independent_agree, CASE WHEN n_independent_agree >= 3 THEN 'strong' WHEN n_independent_agree = 2 THEN 'majority' WHEN n_independent_agree = 1 THEN 'single_vendor' ELSE 'rejected' END AS vendor_consensus
FROM (SELECT p.ar, p.proposer, CAST(count_if(coalesce(v.agree, false)) AS BIGINT) AS n_vendors_agree, CAST(count_if(coalesce(v.agree, false) AND v.vendor != p.proposer) AS BIGINT) AS n_independent_agree FROM {_first_en} p LEFT JOIN (SELECT * FROM {VOTES_SQL} WHERE domain = 'en') v ON p.ar = v.ar GROUP BY p.ar, p.proposer)""",
    "vendor_agreement_matrix": f"SELECT domain, vendor, CAST(count_if(agree) AS BIGINT) AS n, count(*) AS total, round(100.0 * count_if(agree) / count(*), 4) AS pct FROM {VOTES_SQL} GROUP BY 1, 2",
    "tiebreak_verdict": f"""SELECT ar, v AS three_way_verdict, v = 'three_way_differ' AS needs_manual_review, CASE v WHEN 'switch' THEN second_alt WHEN 'drop_consensus' THEN NULL ELSE en END AS final_en FROM
(SELECT *, CASE WHEN lower(trim(coalesce(second_alt, ''))) = '' AND lower(trim(coalesce(third_en, ''))) = '' THEN 'drop_consensus' WHEN lower(trim(coalesce(second_alt, ''))) = lower(trim(en)) THEN 'keep_original' WHEN coalesce(second_alt, '') != '' AND lower(trim(second_alt)) = lower(trim(coalesce(third_en, ''))) THEN 'switch' ELSE 'three_way_differ' END AS v FROM {TIES.sql()})""",
    **{f"consensus_filter_{k}": f"SELECT domain, n_independent_agree, count(*) AS n FROM (SELECT domain, CASE WHEN ord % 9 != 0 THEN ord % 4 END AS n_independent_agree FROM {PAIRS_SQL}) WHERE n_independent_agree IS NULL OR n_independent_agree >= {k} GROUP BY 1, 2" for k in (1, 2, 3)},
    "era_filter": f"SELECT domain, count(*) AS n FROM {PAIRS_SQL} WHERE era_locked IS NULL OR era_locked = '' GROUP BY 1",
    "additive_merge": f"SELECT ar, en, domain FROM {_first_en} UNION ALL SELECT ar, en, domain FROM {PAIRS_SQL} WHERE domain = 'fr' AND ar NOT IN (SELECT ar FROM {_first_en})",
    "dedup_across_domains": f"SELECT position, ar, en, domain, corpus_freq FROM {GATHERED_SQL}",
    "top_pairs": f"SELECT ord, en, corpus_freq FROM {_first_en} ORDER BY corpus_freq DESC, ord LIMIT 50",
    "domain_min_size_split": f"SELECT domain, en, n_in_domain FROM (SELECT domain, en, count(*) OVER (PARTITION BY domain) AS n_in_domain FROM (SELECT en, CASE WHEN ord % 50 = 0 THEN 'other' ELSE domain || '-' || substr(en, 1, 1) END AS domain FROM {PAIRS_SQL}) WHERE domain NOT IN ('geographic', 'other')) WHERE n_in_domain >= 5",
    "domain_distribution": f"SELECT domain, count(*) AS n FROM {PAIRS_SQL} GROUP BY 1",
    "pair_stats_facets": " UNION ALL ".join(f"SELECT '{c}' AS facet, {c} AS value, count(*) AS n FROM {PAIRS_SQL} GROUP BY {c}" for c in ("confidence", "ngram_size", "proposer")),
    "duplicate_terms": f"SELECT count(*) - count(DISTINCT ar) AS n_duplicates FROM {PAIRS_SQL}",
    "consumer_view_minimal": f'SELECT calque, arg_max("natural", ord) AS "natural" FROM {_VALID} GROUP BY calque',
    "consumer_view_standard": f'SELECT calque, arg_max("natural", ord) AS "natural", arg_max(domain, ord) AS domain, arg_max(confidence, ord) AS confidence, arg_max({_GUARD}, ord) AS is_topic_guarded FROM {_VALID} GROUP BY calque',
    "export_tsv": f"SELECT position, concat_ws(chr(9), replace(en, chr(9), ' '), replace(ar, chr(9), ' '), domain, corpus_freq, confidence) AS line FROM {GATHERED_SQL} UNION ALL SELECT 0, 'en' || chr(9) || 'ar' || chr(9) || 'domain' || chr(9) || 'corpus_freq' || chr(9) || 'confidence'",
    "export_json": f"SELECT position, CAST(to_json(struct_pack(en := en, ar := ar, domain := domain, corpus_freq := corpus_freq, confidence := confidence, cross_llm_agreement := cross_llm_agreement, three_way_verdict := three_way_verdict)) AS VARCHAR) AS line FROM {GATHERED_SQL}",
    "export_tbx": f"""SELECT position, '    <termEntry id="term-' || position || '">' || chr(10) || '      <descrip type="subjectField">' || domain || '</descrip>' || chr(10) || '      <descrip type="reliability">' || confidence || '</descrip>' || chr(10) || '      <descrip type="corpusFrequency">' || corpus_freq || '</descrip>' || chr(10)
|| '      <langSet xml:lang="en"><tig><term>' || {_XML('en')} || '</term></tig></langSet>' || chr(10) || '      <langSet xml:lang="ar"><tig><term>' || {_XML('ar')} || '</term></tig></langSet>' || chr(10) || '    </termEntry>' AS line FROM {GATHERED_SQL}
UNION ALL SELECT 0, '{exports.tbx_head("terminology export")}' UNION ALL SELECT {1 << 62}, '{exports.TBX_FOOT}'""",
    "export_markdown": f"SELECT position, '| ' || replace(en, '|', '\\|') || ' | ' || replace(ar, '|', '\\|') || ' | ' || domain || ' | ' || corpus_freq || ' | ' || confidence || ' |' AS line FROM {GATHERED_SQL} UNION ALL SELECT 0, '| EN | AR | Domain | Freq | Confidence |' || chr(10) || '|---|---|---|---|---|'",
    "export_json_array": f"""SELECT ord AS position, '  {{' || chr(10) || '    "en": ' || coalesce(CAST(to_json(en) AS VARCHAR), 'null') || ',' || chr(10) || '    "corpus_freq": ' || coalesce(corpus_freq::VARCHAR, 'null') || ',' || chr(10) || '    "cross_llm_agreement": ' || coalesce(cross_llm_agreement::VARCHAR, 'null') || chr(10) || '  }}' || CASE WHEN ord = 7 THEN '' ELSE ',' END AS line
FROM {EDGES.sql()} UNION ALL SELECT 0, '[' UNION ALL SELECT {1 << 62}, ']'""",
    "view_minimal_tsv": f"SELECT calque, calque || chr(9) || arg_max(\"natural\", ord) AS line FROM {_VALID} GROUP BY calque UNION ALL SELECT NULL, 'calque' || chr(9) || 'natural'",
    "view_standard_markdown": f"""SELECT calque, '| ' || calque || ' | ' || arg_max("natural", ord) || ' | ' || arg_max(domain, ord) || ' | ' || arg_max(confidence, ord) || ' | ' || CASE WHEN arg_max({_GUARD}, ord) THEN 'True' ELSE 'False' END || ' |' AS line FROM {_VALID} GROUP BY calque
UNION ALL SELECT NULL, '| Calque | Natural | Domain | Confidence | Topic-guarded |' || chr(10) || '|---|---|---|---|---|'""",
    "union_domains": f"SELECT ord, ar, en, 'de' AS source_domain, CAST(0 AS BIGINT) AS domain_ord, CAST(NULL AS VARCHAR) AS three_way_verdict FROM {PAIRS_SQL} WHERE domain = 'de' UNION ALL SELECT ord, ar, en, 'edge', 1, three_way_verdict FROM {EDGES.sql()}",
    "corpus_confirmed": f'SELECT ord, "natural", trim("natural") IN (SELECT trim("natural") FROM {_E} WHERE ord % 3 = 1) AS corpus_confirmed FROM {_E}',
}
