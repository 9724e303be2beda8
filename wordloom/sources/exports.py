"""Emitters and sinks: TSV, JSON, TBX, Markdown lines as columns, and partitioned writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.operators import terms


def _replaced(column: Column, *swaps: tuple[str, str]) -> Column:
    for old, new in swaps:
        column = F.replace(column, F.lit(old), F.lit(new))
    return column


#: What a missing field of a pair is written as; others are empty.
MISSING = {"confidence": "medium", "corpus_freq": "0"}


def _string(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(MISSING.get(c, "")))


#: The fields of an exported pair.
FIELDS = ("en", "ar", "domain", "corpus_freq", "confidence")
#: Places of what stands before and behind all rows; rows of one file.
HEAD, FOOT, ROWS = 0, 1 << 62, 1_000_000


def _framed(lines: DataFrame, head: str, foot: str | None = None) -> DataFrame:
    """lines (position, line) with a head, and a foot if there is one."""
    frame = [(HEAD, head)] + ([] if foot is None else [(FOOT, foot)])
    return lines.unionByName(lines.sparkSession.createDataFrame(frame, "position long, line string"))


def _cells(pairs: DataFrame, escape, columns: tuple[str, ...]) -> list[Column]:
    return [escape(_string(c)) if c in ("en", "ar") else _string(c) for c in columns]


def tsv(pairs: DataFrame, columns: tuple[str, ...] = FIELDS, order: str = "position") -> DataFrame:
    """position and line, the header first; tabs within terms become spaces."""
    cells = _cells(pairs, lambda c: _replaced(c, ("\t", " ")), columns)
    return _framed(pairs.select(F.col(order).cast("long").alias("position"), F.concat_ws("\t", *cells).alias("line")), "\t".join(columns))


def json_lines(pairs: DataFrame, columns: tuple[str, ...] = (*FIELDS, "cross_llm_agreement", "three_way_verdict"), order: str = "position") -> DataFrame:
    """position and a JSON object with all of the columns, nulls too."""
    return pairs.select(F.col(order).cast("long").alias("position"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("line"))


def tbx(pairs: DataFrame, order: str = "position", title: str = "terminology export") -> DataFrame:
    """position and a termEntry element numbered by it, between the document's head and foot; & < > are escaped in the terms."""
    xml = lambda c: _replaced(_string(c), ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))
    described = lambda kind, c: F.concat(F.lit(f'      <descrip type="{kind}">'), _string(c), F.lit("</descrip>"))
    term = lambda lang: F.concat(F.lit(f'      <langSet xml:lang="{lang}"><tig><term>'), xml(lang), F.lit("</term></tig></langSet>"))
    entry = F.concat_ws("\n", F.concat(F.lit('    <termEntry id="term-'), F.col(order).cast("string"), F.lit('">')), described("subjectField", "domain"), described("reliability", "confidence"), described("corpusFrequency", "corpus_freq"), term("en"), term("ar"), F.lit("    </termEntry>"))
    return _framed(pairs.select(F.col(order).cast("long").alias("position"), entry.alias("line")), tbx_head(title), TBX_FOOT)


#: What stands behind the entries of a TBX file.
TBX_FOOT = "  </body></text>\n</martif>"


def tbx_head(title: str) -> str:
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<martif type="TBX-Basic" xml:lang="en">\n  <martifHeader><fileDesc><titleStmt><title>{title}</title></titleStmt></fileDesc></martifHeader>\n  <text><body>'


def markdown(pairs: DataFrame, columns: tuple[str, ...] = FIELDS, order: str = "position", names: tuple[str, ...] = ("EN", "AR", "Domain", "Freq", "Confidence")) -> DataFrame:
    """position and a table's row, its two header rows first; bars within terms are escaped."""
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *_cells(pairs, lambda c: _replaced(c, ("|", "\\|")), columns)), F.lit(" |"))
    return _framed(pairs.select(F.col(order).cast("long").alias("position"), row.alias("line")), f"| {' | '.join(names)} |\n|{'---|' * len(names)}")


#: The columns of the views and their names in a table.
VIEWS = {"minimal": (("calque", "natural"), ("Calque (AI-default)", "Natural Arabic")), "standard": (("calque", "natural", "domain", "confidence", "is_topic_guarded"), ("Calque", "Natural", "Domain", "Confidence", "Topic-guarded"))}


def view_lines(view: DataFrame, name: str, form: str) -> DataFrame:
    """calque and its line of a consumer view, as tsv or markdown; the header has no calque. The full view has neither form."""
    if name not in VIEWS or form not in ("tsv", "markdown"):
        raise ValueError(f"no {form} of the {name} view; views: {', '.join(VIEWS)}; forms: tsv, markdown")
    columns, names = VIEWS[name]
    cell = lambda c: F.when(F.col(c), "True").otherwise("False") if c == "is_topic_guarded" else _string(c)
    if form == "tsv":
        line, head = F.concat_ws("\t", *map(cell, columns)), "\t".join(columns)
    else:
        line, head = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |")), f"| {' | '.join(names)} |\n|{'---|' * len(names)}"
    return view.select("calque", line.alias("line")).unionByName(view.sparkSession.createDataFrame([(None, head)], "calque string, line string"))


def write_lines(lines: DataFrame, path: str, order: str = "position", rows: int = ROWS) -> None:
    """Text files in order (nulls first): one for up to `rows` lines, else as many as that takes, by name one after the other."""
    files = max(1, -(-lines.count() // rows))
    lines.repartitionByRange(files, order).sortWithinPartitions(order).select("line").write.mode("overwrite").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a row; other scripts' letters stay as they are."""
    rows.write.mode("overwrite").json(path)


def json_array(rows: DataFrame, columns: tuple[str, ...], order: str = "position") -> DataFrame:
    """position and line of one indented JSON array: its brackets, and an object with a line for each field (nulls too)."""
    field = lambda c: F.concat(F.lit(f'    "{c}": '), F.expr(f"substring(to_json(struct(`{c}`), map('ignoreNullFields', 'false')), {len(c) + 5})"))
    whole = F.concat(F.lit("  {\n"), F.concat_ws(",\n", *[F.regexp_replace(field(c), r"\}$", "") for c in columns]), F.lit("\n  }"))
    last = rows.agg(F.max(order)).first()[0]
    body = rows.select(F.col(order).cast("long").alias("position"), F.concat(whole, F.when(F.col(order) == last, "").otherwise(",")).alias("line"))
    return _framed(body, "[", "]") if last is not None else rows.sparkSession.createDataFrame([(HEAD, "[]")], "position long, line string")


def write_domains(pairs: DataFrame, path: str, include: list[str] | None = None, least: int = 5) -> None:
    """One folder a domain, for the domains to include (all but the dropped ones by default) that have `least` pairs."""
    terms.large_domains(pairs, include, least).drop("n_in_domain").write.mode("overwrite").partitionBy("domain").json(path)
