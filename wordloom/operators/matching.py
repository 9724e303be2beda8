"""Many patterns in many texts.

Whole phrases made of words are found by hash joins of token n-grams, substrings by hash joins of character n-grams: one
join for each distinct pattern length, on equality, whatever the number of patterns. Catalyst broadcasts the patterns
where they are small and shuffles both sides where they are not. With many lengths or very long texts an automaton,
built once per task, reads each text once instead (`match_automaton`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions import text


def match_all(docs: DataFrame, patterns: list[str], column: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All matches, overlapping ones too: doc_id, start, end (code points, half open), pattern. Empty patterns are skipped,
    a pattern given twice matches twice."""
    spark = docs.sparkSession
    by_length: dict[int, list[str]] = {}
    for p in filter(None, patterns):
        by_length.setdefault(len(p), []).append(p)
    if not by_length:
        return docs.select(doc_id, F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit("").alias("pattern")).limit(0)
    grams = _doubled(docs.filter(has_any(F.col(column), patterns)).select(doc_id, F.split(column, "").alias("g1")), max(by_length))
    found = None
    for length, own in sorted(by_length.items()):
        wanted = spark.createDataFrame([(p,) for p in own], "pattern string")
        rows = grams.select(doc_id, F.posexplode(_joined(length)).alias("start", "gram")).filter("gram is not null")
        hits = rows.join(wanted, F.col("gram") == F.col("pattern")).select(doc_id, F.col("start").cast("long").alias("start"), (F.col("start") + length).cast("long").alias("end"), "pattern")
        found = hits if found is None else found.unionByName(hits)
    return found


def _shifted(name: str, by: int) -> Column:
    return F.slice(name, F.lit(by + 1), F.greatest(F.size(name) - by, F.lit(0)))


def _doubled(rows: DataFrame, longest: int) -> DataFrame:
    """From the array g1 of characters, the arrays g2, g4 ... of character n-grams by place, each from the one before: linear in the text."""
    n = 1
    while 2 * n <= longest:
        rows = rows.withColumn(f"g{2 * n}", F.zip_with(f"g{n}", _shifted(f"g{n}", n), lambda a, b: F.concat(a, b)))
        n *= 2
    return rows


def _joined(length: int) -> Column:
    """The n-grams of one length, put together from those of powers of two; null where the text ends before."""
    made, done = None, 0
    for bit in reversed(range(length.bit_length())):
        if length >> bit & 1:
            part = _shifted(f"g{1 << bit}", done)
            made, done = part if made is None else F.zip_with(made, part, lambda a, b: F.concat(a, b)), done + (1 << bit)
    return made


def match_automaton(docs: DataFrame, patterns: list[str], column: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The same rows as match_all(), by one automaton per task over Arrow batches."""
    counted: dict[str, int] = {}
    for p in filter(None, patterns):
        counted[p] = counted.get(p, 0) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for p, n in counted.items():
            automaton.add_word(p, (p, n))
        if counted:
            automaton.make_automaton()
        for batch in batches:
            ids, starts, ends, found = [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for last, (p, n) in automaton.iter(t) if counted and t else ():
                    for _ in range(n):
                        ids.append(i)
                        starts.append(last + 1 - len(p))
                        ends.append(last + 1)
                        found.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(found, pa.string())], ["doc_id", "start", "end", "pattern"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), column).mapInArrow(run, "doc_id long, start long, end long, pattern string")


def has_any(column: Column, patterns: list[str]) -> Column:
    """Does the text contain a pattern at all?"""
    own = [p for p in patterns if p]
    return column.rlike("|".join(map(text.java_quote, own))) if own else F.lit(False)


def first_match(matches: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Per document the match of least end, the longest there."""
    best = F.min_by(F.struct("start", "end", "pattern"), F.struct(F.col("end"), F.col("start")))
    return matches.groupBy(doc_id).agg(best.alias("m")).select(doc_id, "m.start", "m.end", "m.pattern")


#: Single words that are tried one by one; more of them are joined.
FEW_PHRASES = 64


def pattern_list(rows: DataFrame, column: str, most: int = 100_000) -> list[str]:
    """The patterns of a table's column for match_automaton(), without empty ones, repeated ones kept; a table of more than `most` is an error."""
    found = rows.select(F.col(column).alias("pattern")).filter("pattern != ''").limit(most + 1).toArrow()["pattern"].to_pylist()
    if len(found) > most:
        raise ValueError(f"more than {most} patterns; match_all() or phrase_join() take any number")
    return found


def phrase_hits(docs: DataFrame, phrases: list[str], column: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Which phrases a text has between word boundaries, without regard to case: doc_id, pair_no (from 1), phrase; once each."""
    words = [p for p in phrases if p and p.isalpha()]
    if len(words) > FEW_PHRASES:
        spark, named = docs.sparkSession, [(i, p, p.lower()) for i, p in enumerate(phrases, 1) if p in set(words)]
        listed = spark.createDataFrame(named, "pair_no long, phrase string, lowered string")
        hits = phrase_join(docs, listed.select(F.col("lowered").alias("phrase")).distinct(), column, doc_id).withColumnRenamed("phrase", "lowered").join(listed, "lowered").select(doc_id, "pair_no", "phrase")
        others = [p if p not in set(words) else "" for p in phrases]
        return hits.unionByName(phrase_hits(docs, others, column, doc_id)) if any(others) else hits
    lowered = docs.select(doc_id, F.lower(column).alias("lowered"))
    tests = F.array(*[F.struct(F.lit(i).cast("long").alias("pair_no"), F.lit(p).alias("phrase"), F.col("lowered").rlike(text.whole_phrase(p.lower())).alias("hit")) for i, p in enumerate(phrases, 1) if p])
    return lowered.select(doc_id, F.explode(F.filter(tests, lambda x: x["hit"])).alias("x")).select(doc_id, "x.pair_no", "x.phrase")


def phrase_join(docs: DataFrame, phrases: DataFrame, column: str = "text", doc_id: str = "doc_id", phrase: str = "phrase", longest: int | None = None) -> DataFrame:
    """phrase_hits() for any number of phrases made of words: n-grams of words joined on equality. doc_id, phrase.

    n-grams have up to `longest` words, by default as many as the longest phrase; a phrase of more is an error.
    """
    n_words = F.size(F.filter(F.split(F.lower(phrase), r"[^\p{L}\p{N}_]+"), lambda w: w != ""))
    longest = longest or max(1, phrases.agg(F.max(n_words)).first()[0] or 1)
    named = F.when(n_words > longest, F.raise_error(F.concat(F.lit(f"phrase of more than {longest} words: "), phrase))).otherwise(F.col(phrase))
    words = docs.select(doc_id, F.filter(F.split(F.lower(F.col(column)), r"[^\p{L}\p{N}_]+"), lambda w: w != "").alias("words"))
    grams = words.select(doc_id, F.explode(text.ngrams(F.col("words"), tuple(range(1, longest + 1)))).alias("g")).select(doc_id, F.col("g.term").alias("gram"))
    return grams.join(phrases.select(named.alias("phrase")).distinct(), F.col("gram") == F.lower("phrase")).select(doc_id, "phrase").distinct()


def substitute(column: Column, table: dict[str, str]) -> Column:
    """Replace keys, leftmost first and the longest there, without overlap, in one pass; keys of one length in their order."""
    keys = sorted(filter(None, table), key=len, reverse=True)
    if not keys:
        return column
    pattern = "|".join(map(text.java_quote, keys))
    pieces = F.split(column, pattern, -1)
    found = F.regexp_extract_all(column, F.lit(pattern), F.lit(0))
    swap = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.array_join(F.zip_with(pieces, found, lambda a, b: F.concat(a, F.coalesce(F.element_at(swap, b), F.lit("")))), "")


def guarded(matches: DataFrame, docs: DataFrame, keywords: dict[str, list[str]], required: int = 1, width: int = 100, excluded: dict[str, str] | None = None, doc_id: str = "doc_id", column: str = "text") -> DataFrame:
    """Matches with at least `required` of their pattern's keywords within `width` characters, and without its excluding pattern there."""
    both = matches.join(docs.select(doc_id, column), doc_id)
    window = F.substring(F.col(column), F.greatest(F.lit(1), F.col("start").cast("int") + 1 - width), (F.col("end") - F.col("start")).cast("int") + F.least(F.lit(width), F.col("start").cast("int")) + width)
    passed = F.lit(False)
    for p, words in keywords.items():
        seen = sum((F.contains(F.col("near"), F.lit(w)).cast("int") for w in words), F.lit(0))
        barred = F.col("near").rlike((excluded or {})[p]) if p in (excluded or {}) else F.lit(False)
        passed = passed | ((F.col("pattern") == p) & (seen >= required) & ~barred)
    return both.withColumn("near", window).filter(passed).select(doc_id, "start", "end", "pattern")


def pattern_report(matches: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """pattern, n_matches, n_docs: distinct patterns that hit, with totals."""
    return matches.groupBy("pattern").agg(F.count("*").alias("n_matches"), F.countDistinct(doc_id).alias("n_docs"))


def longest_first(keys: DataFrame, key: str = "key", order: str = "ord") -> DataFrame:
    """Substitution priority: longer keys first, file order among equals."""
    return keys.withColumn("priority", F.row_number().over(Window.orderBy(F.desc(F.length(key)), order)).cast("long"))
