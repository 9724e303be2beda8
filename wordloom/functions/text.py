"""Tokens, n-grams, boundaries and small text tools as Column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.functions import arabic


def strip(text: Column) -> Column:
    """Trim all Unicode white space (Spark's trim() knows the space alone)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


#: Characters that full case mapping makes several of, with their upper case as one character, or themselves.
_WIDE = {c: "ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x10000)) if len(c.upper()) > 1}


def upper(text: Column) -> Column:
    """Upper case, character by character as in SQL: ß is not SS, which lower case does not lead back from."""
    one = lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(F.translate(c, "".join(_WIDE), "".join(_WIDE.values())))
    return F.array_join(F.transform(F.split(text, ""), one), "")


def arabic_tokens(normalized: Column, least: int = 3) -> Column:
    """Runs of U+0621-064A of at least `least` letters."""
    return F.filter(F.regexp_extract_all(normalized, F.lit("[ء-ي]+"), F.lit(0)), lambda x: F.length(x) >= least)


def ngrams(tokens: Column, sizes: tuple[int, ...] = (1, 2, 3)) -> Column:
    """All n-grams of a token array as structs of n, pos (from 1) and term, so that one explode serves every size."""
    none = F.array().cast("array<struct<n:int,pos:int,term:string>>")

    def of(n: int) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.struct(F.lit(n).alias("n"), i.alias("pos"), F.array_join(F.slice(tokens, i, n), " ").alias("term")))
        return F.when(F.size(tokens) >= n, made).otherwise(none)

    return F.concat(*[of(n) for n in sizes])


def stem_is_term(part: Column, stopwords: Column) -> Column:
    """A token that may stand in a term: no stop word, not the bare article, and no stop word behind the article."""
    bare = F.when(F.startswith(part, F.lit("ال")) & (F.length(part) > 2), F.substring(part, 3, 1_000_000)).otherwise(part)
    return ~F.array_contains(stopwords, part) & (part != "ال") & ~F.array_contains(stopwords, bare)


def candidate_tokens(tokens: Column, stopwords: Column) -> Column:
    """One flag a token: n-grams are candidates where all of their parts are."""
    return F.transform(tokens, lambda x: stem_is_term(x, stopwords))


def java_quote(phrase: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", phrase)


def whole_phrase(phrase: str) -> str:
    r"""A pattern for a phrase between word boundaries, where letters, digits and _ of any script are word characters.

    At an end that is no word character itself, \b asks for one on the other side.
    """
    inner = lambda c: bool(re.match(r"\w", c))
    before = r"(?<![\p{L}\p{N}_])" if inner(phrase[0]) else r"(?<=[\p{L}\p{N}_])"
    after = r"(?![\p{L}\p{N}_])" if inner(phrase[-1]) else r"(?=[\p{L}\p{N}_])"
    return before + java_quote(phrase) + after


def sentences(text: Column) -> Column:
    """Non-empty stretches between . ! ? ؟ ؛ and line ends, trimmed of spaces."""
    return F.filter(F.transform(F.split(text, "[.!?؟؛\n]+"), lambda s: F.trim(s)), lambda s: s != "")


def word_count(sentence: Column) -> Column:
    return F.size(F.filter(F.split(sentence, " "), lambda w: w != "")).cast("long")


#: The entities that the JVM-side decoder knows; & comes last so that nothing is decoded twice.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescape_common(text: Column) -> Column:
    """The common HTML entities, JVM side."""
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


@F.pandas_udf(T.StringType())
def html_unescape(texts: pd.Series) -> pd.Series:
    """All HTML entities, by Arrow batches."""
    from html import unescape

    return texts.map(unescape, na_action="ignore")


def register(spark) -> None:
    """The public functions by name, for SQL."""
    spark.udf.register("html_unescape", html_unescape)
    for level in arabic.LEVELS:
        come = {"light": "", "medium": arabic.MEDIUM[0], "aggressive": arabic.MEDIUM[0] + arabic.AGGRESSIVE[0]}[level]
        go = {"light": "", "medium": arabic.MEDIUM[1], "aggressive": arabic.MEDIUM[1] + arabic.AGGRESSIVE[1]}[level]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION normalize_{level}(t STRING) RETURNS STRING RETURN translate(coalesce(t, ''), '{come}{arabic.MARKS}', '{go}')")
