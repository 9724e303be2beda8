"""Rule tables as transforms: lexical substitutions, typography, restraint scores, register gates.

A table compiles on the driver into one Column expression. Chance becomes a gate on a hash of the document and the rule,
so that a run can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions import text
from wordloom.operators import matching

#: All flags, and those that are on by register.
FLAGS = ("applies_calque_dictionary", "applies_connector_rebalance", "preserves_borrowings", "allows_passive_voice_relaxation", "tashkeel_reduction", "applies_rhetorical_figures")
POLICY = {
    "classical": ("applies_connector_rebalance", "preserves_borrowings", "applies_rhetorical_figures"),
    "news": ("applies_calque_dictionary", "applies_connector_rebalance", "allows_passive_voice_relaxation", "tashkeel_reduction"),
    "opinion": ("applies_calque_dictionary", "applies_connector_rebalance", "allows_passive_voice_relaxation", "tashkeel_reduction"),
    "technical": ("preserves_borrowings",),
}
_ARABIC = r"[؀-ۿ]"


class UnknownRegisterError(ValueError):
    pass


def policy(spark: SparkSession) -> DataFrame:
    """register, flag, enabled."""
    return spark.createDataFrame([(r, f, f in own) for r, own in POLICY.items() for f in FLAGS], "register string, flag string, enabled boolean")


def gated_by(docs: DataFrame, transform: str, register: str = "register") -> DataFrame:
    """docs with `enabled`: does the transform apply in the document's register? An unknown register stops the query."""
    flag = transform if transform.startswith("applies_") else f"applies_{transform}"
    known = F.col(register).isin(*POLICY)
    return docs.withColumn("enabled", F.when(known, F.col(register).isin(*[r for r, own in POLICY.items() if flag in own])).otherwise(F.raise_error(F.concat(F.lit("unknown register: "), F.coalesce(register, F.lit("null"))))))


def applies(transform: str, register: str) -> bool:
    """An unknown transform never applies; an unknown register is an error. The prefix applies_ may be left out."""
    if register not in POLICY:
        raise UnknownRegisterError(f"unknown register {register!r}; known: {', '.join(sorted(POLICY))}")
    return (transform if transform.startswith("applies_") else f"applies_{transform}") in POLICY[register]


def gate(doc_id: Column, rule: int, probability: float) -> Column:
    """True for about `probability` of the documents, always the same ones."""
    return F.pmod(doc_id * 31 + rule * 17 + 7, F.lit(1000)) < int(probability * 1000)


def hashed_gate(doc_id: Column, rule: int, match: Column, probability: float) -> Column:
    """The same by a full hash, and by match too."""
    return F.pmod(F.xxhash64(doc_id, F.lit(rule), match), F.lit(1000)) < int(probability * 1000)


def alternatives(table: DataFrame, phrase: str) -> DataFrame:
    """A phrase's alternatives in order; the empty one means deletion."""
    return table.filter(F.col("input") == phrase).select("input", F.posexplode("alternatives").alias("choice", "alternative"))


def replace_gated(column: Column, doc_id: Column, table: list[tuple[str, str]], probability: float) -> Column:
    """Each word of the table is replaced where its gate is open; longer inputs first."""
    for i, (word, new) in sorted(enumerate(table), key=lambda x: (-len(x[1][0]), x[0])):
        pattern = rf"(?<![\p{{L}}\p{{N}}_]){text.java_quote(word)}(?![\p{{L}}\p{{N}}_])"
        column = F.when(gate(doc_id, i, probability), F.regexp_replace(column, pattern, new)).otherwise(column)
    return column


def patterns(column: Column, table: list[tuple[str, str]]) -> Column:
    """Regexes and replacements in order; {0} is the first group."""
    for pattern, new in table:
        column = F.regexp_replace(column, pattern, new.replace("{0}", "$1"))
    return column


def outside_quotes(column: Column, transform) -> Column:
    """Apply a transform to what is not within "..." or «...»."""
    quoted = r'"[^"]*"|«[^»]*»'
    free, kept = F.split(column, quoted, -1), F.regexp_extract_all(column, F.lit(quoted), F.lit(0))
    return F.array_join(F.zip_with(F.transform(free, transform), kept, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def rotate(column: Column, word: str, pool: list[str]) -> Column:
    """The n-th occurrence of a word becomes the n-th of the pool, round and round."""
    pattern = rf"(?<![\p{{L}}\p{{N}}_]){text.java_quote(word)}(?![\p{{L}}\p{{N}}_])"
    pieces, listed = F.split(column, pattern, -1), F.array(*map(F.lit, pool))
    return F.array_join(F.transform(pieces, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.element_at(listed, F.pmod(i - 1, F.lit(len(pool))) + 1), x))), "")


def fill(rows: DataFrame, entries: list[str], intensity: float, shortest: int = 40, doc_id: str = "doc_id") -> DataFrame:
    """Sentences (doc_id, sent_no, sentence) with a filler in front of those chosen with 0.1 x intensity, if that is over 0.4, the sentence over `shortest` characters and not the first."""
    listed = F.array(*map(F.lit, entries))
    chosen = (F.pmod(F.col(doc_id) * 31 + F.col("sent_no") * 17 + 7, F.lit(1000)) < int(100 * intensity)) & (F.length("sentence") > shortest) & (F.col("sent_no") > 0) & F.lit(intensity > 0.4)
    filler = F.element_at(listed, (F.pmod(F.col(doc_id) + F.col("sent_no"), F.lit(len(entries))) + 1).cast("int"))
    return rows.withColumn("filled", chosen).withColumn("sentence", F.when(chosen, F.concat(filler, F.lit(" "), "sentence")).otherwise(F.col("sentence")))


def latin_spacing(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, rf"({_ARABIC})([A-Za-z0-9])", "$1 $2"), rf"([A-Za-z0-9])({_ARABIC})", "$1 $2")


def arabic_punctuation(c: Column) -> Column:
    for latin, arabic in ((",", "،"), (";", "؛"), (r"\?", "؟"), ("%", "٪")):
        c = F.regexp_replace(c, f"({_ARABIC}){latin}", f"$1{arabic}")
    return c


def no_space_before(c: Column) -> Column:
    return F.regexp_replace(c, r"[ \t]+([،؛؟:!.])", "$1")


def paren_spacing(c: Column) -> Column:
    c = F.regexp_replace(c, r"\([ \t]+", "(")
    c = F.regexp_replace(c, r"[ \t]+\)", ")")
    return F.regexp_replace(c, r"([^\s(])\(", "$1 (")


def drop_kashida(c: Column) -> Column:
    return F.translate(c, "ـ", "")


def dash_to_comma(c: Column) -> Column:
    """An em dash between Arabic characters, with its spaces, becomes a comma."""
    return F.regexp_replace(c, rf"(?<={_ARABIC})[ ]*—[ ]*(?={_ARABIC})", "، ")


def causal_semicolon(c: Column, words: tuple[str, ...] = ("لأن", "لذلك", "إذ")) -> Column:
    return F.regexp_replace(c, f"،( (?:{'|'.join(words)}) )", "؛$1")


def list_conjunction(c: Column) -> Column:
    """In a run of three single words or more between commas, all but the first get the conjunction."""
    run = r"(?:[\p{L}]+، ){2,}[\p{L}]+"
    pieces, runs = F.split(c, run, -1), F.regexp_extract_all(c, F.lit(run), F.lit(0))
    joined = F.transform(runs, lambda r: F.array_join(F.transform(F.split(r, "، "), lambda w, i: F.when((i > 0) & ~F.startswith(w, F.lit("و")), F.concat(F.lit("و"), w)).otherwise(w)), "، "))
    return F.array_join(F.zip_with(pieces, joined, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def guillemets(c: Column) -> Column:
    return F.regexp_replace(c, '"([^"]*)"', "«$1»")


#: Typographic rules in order: name, transform, registers (None: all).
TYPOGRAPHY = (
    ("latin_spacing", latin_spacing, None), ("arabic_punctuation", arabic_punctuation, None), ("no_space_before", no_space_before, None), ("paren_spacing", paren_spacing, None), ("drop_kashida", drop_kashida, None),
    ("dash_to_comma", dash_to_comma, None), ("causal_semicolon", causal_semicolon, ("news", "opinion")), ("list_conjunction", list_conjunction, None), ("guillemets", guillemets, ("classical",)),
)


def typography(column: Column, register: str) -> Column:
    for _, transform, registers in TYPOGRAPHY:
        if registers is None or register in registers:
            column = transform(column)
    return column


def anti_pattern_hits(docs: DataFrame, phrases: dict[str, tuple[str, str]], doc_id: str = "doc_id") -> DataFrame:
    """Substring hits by pattern: doc_id, pattern_id, category, hits. phrases: phrase -> (pattern id, category)."""
    spark = docs.sparkSession
    named = spark.createDataFrame([(p, i, c) for p, (i, c) in phrases.items()], "pattern string, pattern_id string, category string")
    return matching.match_all(docs, list(phrases), doc_id=doc_id).join(named, "pattern").groupBy(doc_id, "pattern_id", "category").agg(F.count("*").alias("hits"))


def respect_score(hits: DataFrame, docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, hits, score: 15 less two for each hit, 0 at least; documents without hits have 15."""
    summed = hits.groupBy(doc_id).agg(F.sum("hits").alias("hits"))
    n = F.coalesce("hits", F.lit(0)).cast("long")
    return docs.select(doc_id).join(summed, doc_id, "left").select(doc_id, n.alias("hits"), (15 - F.least(F.lit(15).cast("long"), 2 * n)).alias("score"))


def source_tags(table: DataFrame, default: str = "v1_substrate") -> DataFrame:
    return table.groupBy("table_name", F.coalesce("source_tag", F.lit(default)).alias("source_tag")).agg(F.count("*").alias("n"))


def longest_table(table: DataFrame) -> DataFrame:
    return table.withColumn("priority", F.row_number().over(Window.partitionBy("table_name").orderBy(F.desc(F.length("input")), "ord")).cast("long"))
