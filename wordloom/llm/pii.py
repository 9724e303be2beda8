"""Personal data, found with DataFrame functions alone.

Regular expressions propose spans, checksums (Luhn, mod 97) and digit counts confirm them, and context words before a
span raise its score; kinds without a checksum of their own need the context. Spans count code points, the end exclusive.

Patterns are anchored so that a long run of letters or digits is read once, not from each of its characters, and loops
over groups are possessive, so that they neither backtrack nor recurse. Lists are built in pieces and texts are cut from
chunks, so that the work is in proportion to a text's length however many spans it has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import carried, table, texts

_LOCAL = r"[A-Za-z0-9._%+-]"
#: An iban's pattern takes its first four characters alone, so that one candidate does not swallow the next, and looks ahead for the longest rest.
HEAD = 4
#: Kind, pattern, what a text must contain, base score, context words. The first four are the base kinds.
KINDS = (
    ("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, "ip|host|server|address"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", None, 0.8, "card|visa|credit|karte|carte|tarjeta"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, "phone|call|tel|mobile|fax"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9]))", None, 0.8, "iban|account|bank|konto"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.4, "ssn|social security|security number"),
    ("secret", r"(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])", None, 0.4, "token|key|secret|password|passwd|auth"),
)
BASE = tuple(k[0] for k in KINDS[:4])
#: Code points before a span in which context words count; what they add; the least score of a span that isn't base.
NEARBY, RAISE, ACCEPTED = 40, 0.3, 0.6
#: Entries of a list that are copied for each one appended; code points of a chunk of text.
_FEW, _CHUNK = 128, 4096
_IP = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"


def _iban(value: Column) -> Column:
    """The longest start of a candidate that ends with one of its groups, is long enough and has the right remainder; else null."""
    groups = F.split(value, r"\x20")
    starts = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(groups, 1, n), " "))
    return F.get(F.filter(starts, lambda v: (F.length(F.regexp_replace(v, r"\x20", "")) >= HEAD + 11) & _mod97(v)), F.lit(0))


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), the value made once, though a function in `of` may use it for each entry of an array."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _running(items: Column, weight: Callable[[Column], Column], join: Callable[[Column, Column], Column], made: Callable[[Column, Column], Column], kind: str) -> Column:
    """An array with made(at, x) for each item x, nothing where that is null; at: the weights of all items before it, joined (from 0).

    An aggregate copies its state in each step, so lists are made in short pieces. join must be associative.
    """
    none = F.from_json(F.lit("[]"), f"array<{kind}>")
    joined = lambda weights: F.aggregate(weights, F.lit(0), lambda at, w: join(at, w).cast("int"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct(join(acc["at"], weight(x)).cast("int").alias("at"), F.array_append(acc["found"], made(acc["at"], x)).alias("found"))

    def piece(xs: Column, at: Column) -> Column:
        return F.aggregate(xs, F.struct(at.alias("at"), none.alias("found")), step, lambda acc: F.filter(acc["found"], lambda x: x.isNotNull()))

    cuts = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _FEW).cast("int")), lambda i: F.slice(xs, i * _FEW + 1, F.lit(_FEW)))
    after = lambda pieces: F.transform(pieces, lambda xs: joined(F.transform(xs, weight)))
    whole = lambda pieces: _let(after(pieces), lambda ends: F.flatten(F.transform(pieces, lambda xs, i: piece(xs, joined(F.slice(ends, F.lit(1), i))))))
    return _let(items, lambda xs: F.when(F.size(xs) > 0, _let(cuts(xs), whole)).otherwise(none))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _apart(found: Column) -> Column:
    """Without what begins inside the one kept before it."""
    keeps = lambda acc, x: x["start"] >= acc["at"]
    step = lambda acc, x: F.struct(F.when(keeps(acc, x), x["start"] + F.length(x["value"])).otherwise(acc["at"]).alias("at"), F.concat(acc["kept"], F.when(keeps(acc, x), "1").otherwise("0")).alias("kept"))
    kept = F.aggregate(found, F.struct(F.lit(0).alias("at"), F.lit("").alias("kept")), step, lambda acc: F.split(acc["kept"], ""))
    return _let(kept, lambda flags: F.filter(found, lambda _, i: F.get(flags, i) == "1"))


def _chunks(text: Column) -> Column:
    """The text in pieces of _CHUNK code points."""
    last = F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / _CHUNK).cast("int")
    return F.when(last == 0, F.array(text)).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * _CHUNK + 1, F.lit(_CHUNK))))


def _part(chunks: Column, start: Column, length: Column) -> Column:
    """`length` code points from `start` (from 0), without reading all that stands before them."""
    first = F.floor(start / _CHUNK).cast("int")
    near = F.array_join(F.slice(chunks, first + 1, F.floor((start + length) / _CHUNK).cast("int") - first + 1), "")
    return F.substring(near, start - first * _CHUNK + 1, length)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _mod97(value: Column) -> Column:
    """The first four characters go to the end, letters count from 10; the remainder by 97 must be 1."""
    plain = F.regexp_replace(value, r"\x20", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    figure = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: F.when(c == "", acc).otherwise(F.when(c.rlike("[0-9]"), acc * 10 + figure(c)).otherwise(acc * 100 + figure(c)) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _confirmed(kind: str, value: Column) -> Column:
    digits = F.length(_digits(value))
    return {
        "ip": lambda: value.rlike(_IP),
        "card": lambda: digits.between(12, 19) & F.call_function("luhn_check", _digits(value)),
        "phone": lambda: digits.between(9, 15),
        "iban": lambda: value.isNotNull(),
    }.get(kind, lambda: F.lit(True))()


def _test(kind: str) -> Callable[[Column], Column]:
    return lambda x: _confirmed(kind, x["value"])


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


def _placed(zipped: Column, kind: str) -> Column:
    """(text before, match) pairs -> structs of start and value."""
    taken = lambda x: F.lit(HEAD) if kind == "iban" else F.length(x["value"])
    weight = lambda x: F.length(x["before"]) + taken(x)
    return _running(zipped, weight, _plus, lambda at, x: F.struct((at + F.length(x["before"])).alias("start"), x["value"].alias("value")), "struct<start:int,value:string>")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text and spans: an array of structs of start, order (of the kind), end, kind, score, base; by start, then kind;
    and the columns of docs to carry.

    A null or empty text has no spans, a text of any length is read whole. Each row of docs gives one row, repeated ones
    too, and a table without rows none; spans of different kinds may overlap.
    """
    own = texts(docs, doc_id, text, carry).withColumn("chunks", _chunks(F.col("text")))
    matches = {k: F.regexp_extract_all("text", F.lit(p), F.lit(0)) for k, p, *_ in KINDS}
    whole = F.zip_with(matches["iban"], F.regexp_extract_all("text", F.lit(dict(k[:2] for k in KINDS)["iban"]), F.lit(1)), lambda head, rest: F.concat(head, rest))
    matches["iban"] = F.transform(whole, _iban)
    own = own.withColumns({f"m_{k}": F.when(F.contains("text", F.lit(need)), matches[k]) if need else matches[k] for k, _, need, *_ in KINDS})
    own = own.withColumns({f"p_{k}": F.when(F.size(f"m_{k}") > 0, F.arrays_zip(F.slice(F.split("text", p, -1), 1, F.size(f"m_{k}")).alias("before"), F.col(f"m_{k}").alias("value"))) for k, p, *_ in KINDS})
    own = own.withColumns({f"s_{k}": F.when(F.col(f"p_{k}").isNotNull(), F.filter(_placed(F.col(f"p_{k}"), k), _test(k))) for k, *_ in KINDS})
    own = own.withColumn("s_iban", F.when(F.size("s_iban") > 0, _apart(F.col("s_iban"))))

    def scored(order: int, kind: str, least: float, words: str) -> Column:
        near = lambda x: F.lower(_part(F.col("chunks"), F.greatest(F.lit(0), x["start"] - NEARBY), F.least(F.lit(NEARBY), x["start"])))
        made = F.transform(
            F.col(f"s_{kind}"),
            lambda x: F.struct(
                x["start"].alias("start"), F.lit(order).alias("order"), (x["start"] + F.length(x["value"])).alias("end"), F.lit(kind).alias("kind"),
                F.least(F.lit(1.0), F.lit(least) + F.when(near(x).rlike(rf"(?<![a-z])(?:{words})"), RAISE).otherwise(0.0)).alias("score"), F.lit(kind in BASE).alias("base"),
            ),
        )
        return F.coalesce(made, F.array().cast("array<struct<start:int,order:int,end:int,kind:string,score:double,base:boolean>>"))

    spans = F.concat(*[scored(i, k, least, words) for i, (k, _, _, least, words) in enumerate(KINDS)])
    return own.select("doc_id", "text", F.array_sort(F.filter(spans, lambda x: x["base"] | (x["score"] >= ACCEPTED))).alias("spans"), *carried(carry))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span's kind in brackets in its place; overlapping spans go as one, under the first one's kind."""
    label = lambda x: F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))

    def clean(chunks: Column) -> Column:
        made = lambda at, x: F.when(x["start"] >= at, F.concat(_part(chunks, at, x["start"] - at), label(x)))
        parts = _running(spans, lambda x: x["end"], F.greatest, made, "string")
        return F.concat(F.array_join(parts, ""), F.substring(text, F.array_max(F.transform(spans, lambda x: x["end"])) + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(_let(_chunks(text), clean))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op6_checksum_context_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts of the base kinds, a digest of its base spans, and all spans."""
    found = find(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k, *_ in KINDS]
    return found.select("doc_id", *counts[:4], F.sha2(_listed(F.filter("spans", lambda x: x["base"])), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), *counts[4:])


QUERIES = {"op6_checksum_context_pii": op6_checksum_context_pii}
