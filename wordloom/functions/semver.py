"""Semantic versions as comparable structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHAPE = r"^\s*(\d+)\.(\d+)\.(\d+)"
INFINITE = 9999


def parse(version: Column) -> Column:
    """struct(major, minor, patch), which compares field by field; a suffix is ignored; null if there is no version."""
    part = lambda i: F.regexp_extract(version, _SHAPE, i).try_cast("int")
    return F.when(version.rlike(_SHAPE), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def _made(major: Column, minor: Column, patch: Column) -> Column:
    return F.struct(major.cast("int").alias("major"), minor.cast("int").alias("minor"), patch.cast("int").alias("patch"))


def bounds(spec: Column) -> tuple[Column, Column]:
    """Least version and the first one beyond: ^ to the next major, ~ to the next minor, >= without end, else just the one.

    Of a compound range only the first bound counts, as in the reference semantics.
    """
    trimmed = F.trim(spec)
    sign = F.when(F.startswith(trimmed, F.lit(">=")), ">=").when(F.substring(trimmed, 1, 1).isin("^", "~"), F.substring(trimmed, 1, 1)).otherwise("")
    low = parse(F.regexp_replace(trimmed, r"^(?:>=|[\^~])", ""))
    zero = F.lit(0)
    high = (
        F.when(sign == "^", _made(low["major"] + 1, zero, zero))
        .when(sign == "~", _made(low["major"], low["minor"] + 1, zero))
        .when(sign == ">=", _made(F.lit(INFINITE), zero, zero))
        .otherwise(_made(low["major"], low["minor"], low["patch"] + 1))
    )
    return low, high


def in_range(version: Column, spec: Column) -> Column:
    """False where the version or the range is malformed."""
    own, (low, high) = parse(version), bounds(spec)
    return F.coalesce((own >= low) & (own < high), F.lit(False))


def is_compatible(version: Column, requirement: Column, band: Column, denied: Column) -> Column:
    """Not deny-listed, and within the requirement, or the asset's own band where there is none."""
    spec = F.coalesce(F.when(requirement != "", requirement), band)
    return F.coalesce(~F.array_contains(denied, version), F.lit(True)) & F.coalesce(in_range(version, spec), F.lit(False))
