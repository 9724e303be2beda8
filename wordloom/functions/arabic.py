"""Arabic-script normalization as Column expressions (JVM side, folded by Catalyst)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The marks that every level deletes: U+064B-0652, U+0640, U+0670, U+0655-065E.
MARKS = "".join(map(chr, [*range(0x64B, 0x653), 0x640, 0x670, *range(0x655, 0x65F)]))
#: The narrower set that mining deletes: U+064B-0652, U+0670, U+0640.
MINING_MARKS = "".join(map(chr, [*range(0x64B, 0x653), 0x670, 0x640]))
#: Alif and ya forms (medium), and ta marbuta and hamza carriers (aggressive).
MEDIUM = ("آأإٱى", "ااااي")
AGGRESSIVE = ("ةؤئ", "هوي")
WESTERN, ARABIC_INDIC = "0123456789", "".join(map(chr, range(0x660, 0x66A)))
LEVELS = ("light", "medium", "aggressive")
DIGIT_FORMS = ("preserve", "western", "arabic_indic")


def normalize(text: Column, level: str = "light", digit_form: str = "preserve") -> Column:
    """Delete marks, unify letters by level, and bring digits to one form; null is the empty text."""
    if level not in LEVELS:
        raise ValueError(f"level: one of {LEVELS}, not {level!r}")
    if digit_form not in DIGIT_FORMS:
        raise ValueError(f"digit_form: one of {DIGIT_FORMS}, not {digit_form!r}")
    come, go = "", ""
    if level != "light":
        come, go = come + MEDIUM[0], go + MEDIUM[1]
    if level == "aggressive":
        come, go = come + AGGRESSIVE[0], go + AGGRESSIVE[1]
    if digit_form == "western":
        come, go = come + ARABIC_INDIC, go + WESTERN
    elif digit_form == "arabic_indic":
        come, go = come + WESTERN, go + ARABIC_INDIC
    return F.translate(F.coalesce(text, F.lit("")), come + MARKS, go)  # characters without a partner are deleted


def mining_normalize(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), MINING_MARKS, "")


def letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{L}")).cast("long")


def arabic_letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[؀-ۿ&&[\p{L}]]")).cast("long")


def arabic_char_ratio(text: Column) -> Column:
    """Letters of U+0600-06FF among all letters; 0 without letters."""
    whole = letters(F.coalesce(text, F.lit("")))
    return F.when(whole == 0, F.lit(0.0)).otherwise(arabic_letters(text) / whole)


def is_arabic_dominant(text: Column, threshold: float = 0.5) -> Column:
    return arabic_char_ratio(text) >= threshold


def marks_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[ً-ْٰ]")).cast("long")
