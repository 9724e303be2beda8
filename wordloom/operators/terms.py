"""Dictionaries and term pairs: lookups, filters, ranks, proposals, votes, merges and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.functions import text

#: Ranks of confidence; unknown ones rank 0.
CONFIDENCE = {"low": 1, "medium": 2, "medium_consensus": 2, "topic-guarded": 3, "high": 4, "high_user_attested": 5}
#: The three-level ranks of pairs; a missing confidence is medium.
PAIR_CONFIDENCE = {"low": 1, "medium": 2, "high": 3}
#: The ranks by which one entry of a term is chosen; what users attested has none here.
CANONICAL = {"low": 1, "medium": 2, "medium_consensus": 2, "topic-guarded": 3, "high": 4}
VENDORS = ("codex", "gemini", "kimi", "minimax")
PROPOSAL = "array<struct<ar:string,en:string,domain:string,confidence:string>>"


def _rank(column: Column, ranks: dict[str, int]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), column), F.lit(0))


def valid_entries(entries: DataFrame, calque: str = "calque", natural: str = "natural") -> DataFrame:
    """Both sides stripped; entries with an empty side or with equal sides are dropped."""
    made = entries.withColumns({calque: text.strip(F.coalesce(calque, F.lit(""))), natural: text.strip(F.coalesce(natural, F.lit("")))})
    return made.filter((F.col(calque) != "") & (F.col(natural) != "") & (F.col(calque) != F.col(natural)))


def with_defaults(entries: DataFrame, defaults: dict[str, object]) -> DataFrame:
    return entries.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def find_by_en(pairs: DataFrame, needle: str, exact: bool = False) -> DataFrame:
    """Pairs of an English term; unless exact, without regard to case and outer white space. An empty needle finds nothing."""
    if exact:
        return pairs.filter(F.col("en") == needle)
    wanted = needle.strip().lower()
    return pairs.filter((F.lower(text.strip(F.col("en"))) == wanted) & F.lit(wanted != ""))


def find_by_ar(pairs: DataFrame, needles: DataFrame) -> DataFrame:
    """The first pair in file order of each given term."""
    order = Window.partitionBy("ar").orderBy("ord")
    return pairs.join(needles.select("ar").distinct(), "ar", "left_semi").withColumn("first", F.row_number().over(order)).filter("first = 1").drop("first")


def has_terms(candidates: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted terms with a flag: among the candidates?"""
    known = candidates.select(F.col("term"), F.lit(True).alias("known")).distinct()
    return wanted.join(known, "term", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def confident(entries: DataFrame, least: str, ranks: dict[str, int] | None = None, missing: str | None = None) -> DataFrame:
    ranks = ranks or CONFIDENCE
    column = F.coalesce("confidence", F.lit(missing)) if missing else F.col("confidence")
    return entries.filter(_rank(column, ranks) >= ranks[least])


def topic_guard(context_ar: str = "keywords_ar", context_en: str = "keywords_en") -> Column:
    return (F.size(F.coalesce(context_ar, F.array().cast("array<string>"))) > 0) | (F.size(F.coalesce(context_en, F.array().cast("array<string>"))) > 0)


def domain_allows(domain: str, allowed: str = "applies_only_in_domain") -> Column:
    """An entry bound to domains applies in those alone."""
    return F.col(allowed).isNull() | F.array_contains(F.col(allowed), domain)


def canonical(entries: DataFrame, key: str = "en", ranks: dict[str, int] | None = None) -> DataFrame:
    """Each key's entry of best confidence, the first in file order among equals."""
    order = Window.partitionBy(key).orderBy(F.desc(_rank(F.col("confidence"), ranks or CANONICAL)), "ord")
    return entries.withColumn("pick", F.row_number().over(order)).filter("pick = 1").drop("pick")


def entry_stats(entries: DataFrame) -> DataFrame:
    """Totals of a dictionary: entries, those of high confidence, attested by users, topic-guarded, with corpus hits."""
    return entries.agg(
        F.count("*").alias("n_entries"), F.count_if(F.col("confidence") == "high").alias("n_high"), F.count_if(F.col("confidence") == "high_user_attested").alias("n_attested"),
        F.count_if(topic_guard()).alias("n_guarded"), F.count_if(F.coalesce("corpus_hits", F.lit(0)) > 0).alias("n_with_hits"),
    )


def proposals_of(responses: DataFrame, column: str = "response", retry: bool = True) -> DataFrame:
    """Proposals from response texts, tolerantly: the text as a JSON array, else the widest [{...}] within it, else none.

    Without retry, texts that parse as another JSON value give none.
    """
    trimmed = text.strip(F.col(column))
    inner = F.regexp_extract(F.col(column), r"(?s)\[\s*\{.*\}\s*\]", 0)
    direct, wide = F.from_json(F.when(F.startswith(trimmed, F.lit("[")), trimmed), PROPOSAL), F.from_json(F.when(inner != "", inner), PROPOSAL)
    found = F.coalesce(direct, wide if retry else F.when(F.try_parse_json(trimmed).isNull(), wide), F.array().cast(PROPOSAL))
    return responses.withColumn("proposals", found)


def accept_proposals(candidates: DataFrame, proposals: DataFrame, keep_low: bool = False) -> DataFrame:
    """Candidates with a proposal for just their term; empty and low ones are dropped, confidence and domain normalised."""
    cleaned = proposals.select("ar", text.strip(F.coalesce("en", F.lit(""))).alias("en"), F.lower(text.strip(F.coalesce("confidence", F.lit("medium")))).alias("confidence"), F.lower(text.strip(F.coalesce("domain", F.lit("other")))).alias("domain"), "proposer")
    kept = cleaned.filter((F.col("en") != "") & ((F.col("confidence") != "low") | F.lit(keep_low)))
    return candidates.select(F.col("term").alias("ar"), F.col("freq").alias("corpus_freq"), "ngram_size").join(kept, "ar")


def agree(a: Column, b: Column) -> Column:
    """Equal or one within the other, in lower case; an empty side never agrees."""
    x, y = F.lower(text.strip(F.coalesce(a, F.lit("")))), F.lower(text.strip(F.coalesce(b, F.lit(""))))
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def confirm(pairs: DataFrame, second: DataFrame) -> DataFrame:
    """Each pair with a second vendor's last proposal: agreement raises confidence to high, else the other reading is noted."""
    last = second.groupBy("ar").agg(F.max_by("en", "ord").alias("second_en"))
    both = pairs.join(last, "ar", "left").withColumn("cross_agreement", agree(F.col("en"), F.col("second_en")))
    return both.withColumn("confidence", F.when(F.col("cross_agreement"), "high").otherwise(F.col("confidence"))).withColumn("disagreement_alt_en", F.when(~F.col("cross_agreement") & (F.coalesce("second_en", F.lit("")) != ""), F.col("second_en"))).drop("second_en")


def tiers(pairs: DataFrame, votes: DataFrame) -> DataFrame:
    """ar, n_vendors_agree, n_independent_agree (without the proposer), vendor_consensus; one row a pair, without votes too."""
    counted = pairs.select("ar", "proposer").join(votes, "ar", "left").groupBy("ar", "proposer").agg(
        F.count_if(F.coalesce("agree", F.lit(False))).alias("n_vendors_agree"), F.count_if(F.coalesce("agree", F.lit(False)) & (F.col("vendor") != F.col("proposer"))).alias("n_independent_agree")
    )
    n = F.col("n_independent_agree")
    return counted.withColumn("vendor_consensus", F.when(n >= 3, "strong").when(n == 2, "majority").when(n == 1, "single_vendor").otherwise("rejected"))


def consensus(pairs: DataFrame, least: int, column: str = "n_independent_agree") -> DataFrame:
    """Pairs with enough independent votes; those that were never voted on pass."""
    return pairs.filter(F.col(column).isNull() | (F.col(column) >= least))


def current_era(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("era_locked").isNull() | (F.col("era_locked") == ""))


def agreement_matrix(votes: DataFrame, group: str = "domain") -> DataFrame:
    """group, vendor, n, total, pct of agreement."""
    return votes.groupBy(group, "vendor").agg(F.count_if("agree").alias("n"), F.count("*").alias("total")).withColumn("pct", F.round(100.0 * F.col("n") / F.col("total"), 4))


def tiebreak(pairs: DataFrame, proposer: str = "en", second: str = "second_alt", third: str = "third_en") -> DataFrame:
    """Three-way verdict: both others empty: drop; the second agrees with the proposer: keep; it agrees with the third: switch; else all differ and need review."""
    p, s, t = (F.lower(text.strip(F.coalesce(c, F.lit("")))) for c in (proposer, second, third))
    verdict = F.when((s == "") & (t == ""), "drop_consensus").when(s == p, "keep_original").when((s != "") & (s == t), "switch").otherwise("three_way_differ")
    made = pairs.withColumn("three_way_verdict", verdict)
    return made.withColumn("needs_manual_review", F.col("three_way_verdict") == "three_way_differ").withColumn("final_en", F.when(F.col("three_way_verdict") == "switch", F.col(second)).when(F.col("three_way_verdict") != "drop_consensus", F.col(proposer)))


def merge_additive(existing: DataFrame, new: DataFrame, key: str = "ar") -> DataFrame:
    """All existing rows, and the new ones of other keys."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti"), allowMissingColumns=True)


def vote_table(pairs: DataFrame, vendors: tuple[str, ...] = VENDORS) -> DataFrame:
    """<vendor>_agree and <vendor>_alt columns as rows: ar, vendor, agree, alt."""
    each = F.array(*[F.struct(F.lit(v).alias("vendor"), F.col(f"{v}_agree").alias("agree"), F.col(f"{v}_alt").alias("alt")) for v in vendors])
    return pairs.select("ar", F.explode(each).alias("v")).select("ar", "v.*").filter("agree is not null")


def union_domains(domains: dict[str, DataFrame]) -> DataFrame:
    """Pairs of several domains with source_domain and its place in the request."""
    made = None
    for i, (name, pairs) in enumerate(domains.items()):
        tagged = pairs.withColumn("source_domain", F.lit(name)).withColumn("domain_ord", F.lit(i).cast("long"))
        made = tagged if made is None else made.unionByName(tagged, allowMissingColumns=True)
    return made


def export_rows(pairs: DataFrame, least: str = "medium") -> DataFrame:
    """Pairs fit for export: terms stripped, those with an empty side dropped, a missing confidence medium, a missing frequency 0, and of `least` confidence."""
    clean = pairs.withColumns({**{c: text.strip(F.coalesce(c, F.lit(""))) for c in ("ar", "en")}, "confidence": F.coalesce("confidence", F.lit("medium")), "corpus_freq": F.coalesce("corpus_freq", F.lit(0).cast("long"))})
    return confident(clean.filter("ar != '' AND en != ''"), least, PAIR_CONFIDENCE)


#: Places of one domain that are numbered by one task.
PLACES = 1 << 16


def numbered(rows: DataFrame) -> DataFrame:
    """rows with position: their number by corpus_freq, highest first, then by seen, a struct of domain_ord and ord that no two rows share.

    Rows are numbered within shares of one frequency, domain and range of places; shares are counted, and each begins
    where those before it end. Only the table of frequencies is in one task: n of them need about n * n / 2 occurrences.
    """
    share = ["corpus_freq", "seen_domain", "seen_part"]
    own = rows.withColumns({"seen_domain": F.col("seen.domain_ord"), "seen_part": F.floor(F.col("seen.ord") / PLACES)})
    counted = own.groupBy(*share).agg(F.count("*").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_freq = counted.groupBy("corpus_freq").agg(F.sum("n").alias("n")).select("corpus_freq", before(Window.orderBy(F.desc("corpus_freq"))).alias("higher"))
    begins = counted.withColumn("earlier", before(Window.partitionBy("corpus_freq").orderBy("seen_domain", "seen_part"))).join(of_freq, "corpus_freq").select(*share, (F.col("higher") + F.col("earlier")).alias("begin"))
    within = F.row_number().over(Window.partitionBy(*share).orderBy("seen"))
    return own.join(begins, share).withColumn("position", (F.col("begin") + within).cast("long")).drop("seen_domain", "seen_part", "begin")


def dedup_domains(pairs: DataFrame) -> DataFrame:
    """One pair a term, that of highest frequency (then first domain, first place), numbered by frequency, then first sighting of the term."""
    best = Window.partitionBy("ar").orderBy(F.desc("corpus_freq"), "domain_ord", "ord")
    seen = F.min(F.struct("domain_ord", "ord")).over(Window.partitionBy("ar"))
    return numbered(pairs.withColumns({"pick": F.row_number().over(best), "seen": seen}).filter("pick = 1")).drop("pick", "seen")


def confirmed_naturals(entries: DataFrame, candidates: DataFrame, natural: str = "natural", term: str = "term") -> DataFrame:
    """entries with corpus_confirmed: is the natural side, stripped, a mined candidate?"""
    known = candidates.select(F.col(term).alias("known_term")).distinct()
    found = entries.join(known, text.strip(F.col(natural)) == F.col("known_term"), "left")
    return found.withColumn("corpus_confirmed", F.col("known_term").isNotNull()).drop("known_term")


def top_pairs(pairs: DataFrame, n: int, by: str = "corpus_freq") -> DataFrame:
    """Sorted only by corpus_freq; else the first n of the file."""
    return pairs.orderBy(*([F.desc("corpus_freq")] if by == "corpus_freq" else []), "ord").limit(n)


def large_domains(pairs: DataFrame, include: list[str] | None = None, least: int = 5, dropped: tuple[str, ...] = ("geographic", "other")) -> DataFrame:
    """Pairs of domains with `least` rows or more, of those to include (all but the dropped ones by default)."""
    kept = pairs.filter(F.col("domain").isin(include)) if include is not None else pairs.filter(~F.col("domain").isin(*dropped))
    return kept.withColumn("n_in_domain", F.count("*").over(Window.partitionBy("domain"))).filter(F.col("n_in_domain") >= least)


def minimal_view(entries: DataFrame) -> DataFrame:
    """calque -> natural, the last of duplicates."""
    return valid_entries(entries).groupBy("calque").agg(F.max_by("natural", "ord").alias("natural"))


def standard_view(entries: DataFrame) -> DataFrame:
    last = valid_entries(entries).groupBy("calque").agg(F.max_by(F.struct("natural", "domain", "confidence", topic_guard().alias("is_topic_guarded")), "ord").alias("v"))
    return last.select("calque", "v.*")


def pair_stats(pairs: DataFrame) -> DataFrame:
    """Counts by confidence, size and proposer in one pass: facet, value, n."""
    return pairs.groupingSets([["confidence"], ["ngram_size"], ["proposer"]], "confidence", "ngram_size", "proposer").agg(F.count("*").alias("n"), F.grouping_id().alias("g")).select(
        F.when(F.col("g") == 3, "confidence").when(F.col("g") == 5, "ngram_size").otherwise("proposer").alias("facet"), F.coalesce("confidence", "ngram_size", "proposer").alias("value"), "n"
    )


def duplicate_count(rows: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first of their key, where all missing keys are one."""
    return rows.agg((F.count("*") - F.countDistinct(key) - F.coalesce(F.max(F.col(key).isNull().cast("int")), F.lit(0))).alias("n_duplicates"))


def schema_of_pairs() -> T.StructType:
    return T.StructType.fromDDL("ord long, ar string, en string, domain string, corpus_freq long, ngram_size string, confidence string, proposer string, cross_llm_agreement boolean, confirmed_by string, disagreement_alt_en string")
