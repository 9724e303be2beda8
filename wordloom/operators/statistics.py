"""Distributional statistics by category: sentence lengths, connectors, openers, marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions import arabic, text

#: Upper ends of the sentence-length bins; what is longer is 51+.
BINS = ((5, "1-5"), (10, "6-10"), (15, "11-15"), (20, "16-20"), (30, "21-30"), (50, "31-50"))
METRICS = ("n_records", "n_sentences", "n_tokens", "mean_sentence_length", "burstiness")


def sentence_rows(docs: DataFrame, category: str, doc_id: str = "doc_id") -> DataFrame:
    """category, doc_id, sent_no (from 0), sentence, n_words."""
    rows = docs.select(F.col(category).alias("category"), doc_id, F.posexplode(text.sentences(F.col("text"))).alias("sent_no", "sentence"))
    return rows.withColumn("sent_no", F.col("sent_no").cast("long")).withColumn("n_words", text.word_count(F.col("sentence")))


def length_stats(rows: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Per category: counts, mean and standard deviation of sentence lengths, their ratio (cv), and (s - m) / (s + m)."""
    per = rows.groupBy("category").agg(F.countDistinct(doc_id).alias("n_records"), F.count("*").alias("n_sentences"), F.sum("n_words").alias("n_tokens"), F.avg("n_words").alias("m"), F.stddev_pop("n_words").alias("s"))
    return per.select("category", "n_records", "n_sentences", "n_tokens", F.round("m", 6).alias("mean_sentence_length"), F.round("s", 6).alias("stddev_sentence_length"), F.round(F.col("s") / F.col("m"), 6).alias("cv"), F.round((F.col("s") - F.col("m")) / (F.col("s") + F.col("m")), 6).alias("burstiness"))


def bin_of(n: Column) -> Column:
    made = F.when(n <= BINS[0][0], BINS[0][1])
    for top, name in BINS[1:]:
        made = made.when(n <= top, name)
    return made.otherwise("51+")


def histogram(rows: DataFrame) -> DataFrame:
    """category, bin, n, pct of its category's sentences."""
    counted = rows.groupBy("category", bin_of(F.col("n_words")).alias("bin")).agg(F.count("*").alias("n"))
    return counted.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("category")), 6))


def starters(rows: DataFrame, top: int) -> DataFrame:
    """The most frequent first words of sentences by category: category, rank, starter, n."""
    first = rows.groupBy("category", F.lower(F.split("sentence", " ")[0]).alias("starter")).agg(F.count("*").alias("n"))
    return ranked(first, ["category"], ["starter"], top)


def ranked(counted: DataFrame, groups: list[str], ties: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*groups).orderBy(F.desc("n"), *ties)
    return counted.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top).select(*groups, "rank", *ties, "n")


def connectors(docs: DataFrame, category: str, words: list[str]) -> DataFrame:
    """category, token, n: how often each of the given connectors stands as a word."""
    own = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda w: w.isin(*words))
    return docs.select(F.col(category).alias("category"), F.explode(own).alias("token")).groupBy("category", "token").agg(F.count("*").alias("n"))


def shares(counted: DataFrame) -> DataFrame:
    """Percent of the category's total, 0 where that is 0."""
    whole = F.sum("n").over(Window.partitionBy("category"))
    return counted.withColumn("pct", F.when(whole == 0, 0.0).otherwise(F.round(100.0 * F.col("n") / whole, 6)))


def entropy(counted: DataFrame) -> DataFrame:
    """Shannon entropy in bits of each category's distribution."""
    p = F.col("n") / F.sum("n").over(Window.partitionBy("category"))
    return counted.filter("n > 0").withColumn("p", p).groupBy("category").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy"))


def mark_ratio(docs: DataFrame, category: str) -> DataFrame:
    """The mean over records of marks per Arabic letter (records without such letters do not count)."""
    own = docs.select(F.col(category).alias("category"), arabic.marks_count(F.col("text")).alias("marks"), arabic.arabic_letters(F.col("text")).alias("letters"))
    return own.groupBy("category").agg(F.round(F.avg(F.when(F.col("letters") > 0, F.col("marks") / F.col("letters"))), 6).alias("mean_tashkeel_ratio"), F.count("*").alias("n_records"))


def compare(stats: DataFrame, metric: str) -> DataFrame:
    """One metric across categories; an unknown metric is an error."""
    if metric not in METRICS:
        raise ValueError(f"metric: one of {METRICS}, not {metric!r}")
    return stats.select("category", F.lit(metric).alias("metric"), F.col(metric).cast("double").alias("value"))


def melted(stats: DataFrame) -> DataFrame:
    """All metrics across categories as rows."""
    return stats.select("category", *[F.col(m).cast("double").alias(m) for m in METRICS]).unpivot("category", list(METRICS), "metric", "value")


def repeated_starters(rows: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Sentences that begin with the word that the one before them begins with: doc_id, sent_no, starter."""
    own = rows.withColumn("starter", F.lower(F.split("sentence", " ")[0]))
    before = F.lag("starter").over(Window.partitionBy(doc_id).orderBy("sent_no"))
    return own.withColumn("before", before).filter("starter = before").select(doc_id, "sent_no", "starter")


def varied_starters(rows: DataFrame, detectors: list[str], pool: list[str], doc_id: str = "doc_id") -> DataFrame:
    """Sentences that begin with a detected starter, as one before them in their document does, begin with the pool's entries in turn: doc_id, sent_no, sentence."""
    own = rows.withColumn("starter", F.lower(F.split("sentence", " ")[0]))
    detected = F.col("starter").isin(*[d.lower() for d in detectors])
    seen = F.row_number().over(Window.partitionBy(doc_id, "starter").orderBy("sent_no"))
    put = F.element_at(F.array(*map(F.lit, pool)), F.pmod(F.col("seen") - 2, F.lit(len(pool))) + 1)
    rest = F.substring(F.col("sentence"), F.length("starter") + 1, F.length("sentence"))
    return own.withColumn("seen", seen).select(doc_id, "sent_no", F.when(detected & (F.col("seen") > 1), F.concat(put, rest)).otherwise(F.col("sentence")).alias("sentence"))
