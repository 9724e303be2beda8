"""Readers of the statistics asset, the registry and rule tables, with the accessors that consumers use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators import matching, meta
from wordloom.sources import articles

_CATEGORY = (
    "struct<n_records:long,n_sentences:long,n_tokens:long,mean_sentence_length:double,stddev_sentence_length:double,burstiness:double,mean_tashkeel_ratio:double,"
    "sentence_length_histogram_pct:map<string,double>,top_connectors:array<array<string>>,top_sent_initial_tokens:array<array<string>>,top_sentence_starters:array<array<string>>>"
)


class StatsError(LookupError):
    pass


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def category_stats(spark: SparkSession, path: str, category: str | None = None) -> DataFrame:
    """One row a category, as the data has them; a category that is asked for and isn't there is an error."""
    rows = _whole(spark, path).select(F.explode(F.from_json("value", f"categories map<string,{_CATEGORY}>")["categories"]).alias("category", "s")).select("category", "s.*")
    if category is None:
        return rows
    found = rows.filter(F.col("category") == category)
    if not found.limit(1).count():
        raise StatsError(f"no category {category!r}; there are: {', '.join(sorted(r.category for r in rows.select('category').collect()))}")
    return found


def histogram(stats: DataFrame) -> DataFrame:
    return stats.select("category", F.explode("sentence_length_histogram_pct").alias("bin", "pct"))


def _pairs(stats: DataFrame, column: Column | str, n: int | None) -> DataFrame:
    """[token, count] lists as rows in order; malformed ones are skipped."""
    rows = stats.select("category", F.posexplode(column).alias("pos", "p")).filter(F.size("p") == 2)
    made = rows.select("category", (F.col("pos") + 1).cast("long").alias("rank"), F.element_at("p", 1).alias("token"), F.element_at("p", 2).try_cast("long").alias("n")).filter("n is not null")
    return made if n is None else made.filter(F.col("rank") <= n)


def top_connectors(stats: DataFrame, n: int | None = None) -> DataFrame:
    return _pairs(stats, "top_connectors", n)


def top_starters(stats: DataFrame, n: int | None = None) -> DataFrame:
    """Under either of the two names that the list goes by."""
    return _pairs(stats, F.coalesce("top_sent_initial_tokens", "top_sentence_starters"), n)


def registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """assets (asset_id, version, band, breaking, consumers) and requirements (consumer, asset_id, requirement)."""
    schema = "assets map<string,struct<current_version:string,compatibility:string,breaking_versions:array<string>,consumers:array<string>>>, consumer_declared_requirements map<string,struct<asset_requirements:map<string,string>>>"
    parsed = _whole(spark, path).select(F.from_json("value", schema).alias("r")).select("r.*")
    nothing = F.array().cast("array<string>")
    assets = parsed.select(F.explode("assets").alias("asset_id", "a")).select("asset_id", F.col("a.current_version").alias("version"), F.col("a.compatibility").alias("band"), F.coalesce("a.breaking_versions", nothing).alias("breaking"), F.coalesce("a.consumers", nothing).alias("consumers"))
    wanted = parsed.select(F.explode("consumer_declared_requirements").alias("consumer", "c")).select("consumer", F.explode("c.asset_requirements").alias("asset_id", "requirement"))
    return assets, wanted


def check_consumer(spark: SparkSession, path: str, consumer: str) -> DataFrame:
    assets, wanted = registry(spark, path)
    return meta.audit(wanted.filter(F.col("consumer") == consumer), assets.drop("consumers"))


def rule_tables(spark: SparkSession, path: str, schema: str = "input string, alternatives array<string>, replacement string, pattern string, source_tag string") -> DataFrame:
    """Every rule of every table: table_name, policy, probability, ord and the rule's own fields."""
    tables = f"tables map<string,struct<policy:string,probability:double,entries:array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>>>"
    rows = _whole(spark, path).select(F.explode(F.from_json("value", tables)["tables"]).alias("table_name", "t"))
    return rows.select("table_name", "t.policy", "t.probability", F.posexplode("t.entries").alias("ord", "e")).select("table_name", "policy", "probability", F.col("ord").cast("long").alias("ord"), "e.*")


class Asset:
    """One JSON file, read again when it changes: content() is its text as a table of one row."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._time, self._frame = spark, path, None, None

    def content(self) -> DataFrame:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        time = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).getModificationTime()
        if time != self._time:
            text = _whole(self.spark, self.path).first().value  # an asset is a file of some hundred kilobytes
            self._time, self._frame = time, self.spark.createDataFrame([(text,)], "value string")
        return self._frame

    def value(self, key: str, missing: str | None = None) -> str | None:
        """A field of the root by its name, as text."""
        found = self.content().select(F.expr(f"try_variant_get(parse_json(value), '$[\"{key}\"]', 'string')").alias("v")).first().v
        return missing if found is None else found

    def keys(self, field: str) -> list[str]:
        """The keys of an object in the root, in the file's order."""
        listed = F.json_object_keys(F.get_json_object("value", f"$.{field}"))
        return list(self.content().select(F.coalesce(listed, F.array().cast("array<string>")).alias("k")).first().k)

    def known(self, field: str, key: str) -> str:
        if key not in (there := self.keys(field)):
            raise KeyError(f"unknown {key!r} in {field}; known: {', '.join(sorted(there))}")
        return key


class Statistics(Asset):
    """Distributional statistics by category; a category is one of `declared`, where these are given."""

    def __init__(self, spark: SparkSession, path: str, declared: tuple[str, ...] | None = None):
        super().__init__(spark, path)
        self.declared = declared

    def metadata(self) -> dict[str, str | None]:
        return {k: self.value(k) for k in ("input", "sample_size", "skipped", "elapsed_s")}

    def category(self, name: str) -> DataFrame:
        """One row. An undeclared category is a KeyError, a declared one that the data lack a StatsError."""
        if self.declared is not None and name not in self.declared:
            raise KeyError(f"unknown category {name!r}; known: {', '.join(self.declared)}")
        if name not in self.keys("categories"):
            raise StatsError(f"category {name!r} is declared, but the data have none")
        parsed = F.from_json("value", f"categories map<string,{_CATEGORY}>")["categories"]
        return self.content().select(F.lit(name).alias("category"), F.element_at(parsed, name).alias("s")).select("category", "s.*")

    def number(self, name: str, field: str) -> float:
        """n_tokens, n_sentences, mean_sentence_length, burstiness ...: 0 where it is missing."""
        return self.category(name).select(F.coalesce(F.col(field).cast("double"), F.lit(0.0)).alias("v")).first().v


class Registry(Asset):
    """Versions of assets and what consumers require of them; unknown ids and consumers are KeyErrors."""

    def version(self) -> str:
        return self.value("$registry_version", "unknown")

    def assets(self) -> list[str]:
        return sorted(self.keys("assets"))

    def asset(self, asset_id: str) -> tuple[str, str, list[str]]:
        """Current version, compatibility band and breaking versions."""
        parsed = F.from_json("value", "assets map<string,struct<current_version:string,compatibility:string,breaking_versions:array<string>>>")["assets"]
        row = self.content().select(F.element_at(parsed, self.known("assets", asset_id)).alias("a")).select("a.*").first()
        return row.current_version, row.compatibility, list(row.breaking_versions or [])

    def required_for(self, consumer: str) -> dict[str, str]:
        self.known("consumer_declared_requirements", consumer)
        return {r.asset_id: r.requirement for r in registry(self.spark, self.path)[1].filter(F.col("consumer") == consumer).collect()}


class RuleTables(Asset):
    """Lexical tables by name; an unknown one is a KeyError."""

    def schema_version(self) -> str | None:
        return self.value("$schema_version")

    def names(self) -> list[str]:
        return self.keys("tables")

    def table(self, name: str, schema: str = "input string, alternatives array<string>, replacement string, pattern string, source_tag string") -> DataFrame:
        return rule_tables(self.spark, self.path, schema).filter(F.col("table_name") == self.known("tables", name))

    def replacements(self, name: str) -> list[tuple[str, str]]:
        """input and replacement in order, as connectors and numbered transitions have them."""
        return [(r.input, r.replacement) for r in self.table(name).filter("input is not null and replacement is not null").orderBy("ord").collect()]

    def listed(self, name: str, field: str) -> list[str]:
        """A list of plain strings in a table: detectors and replacements of starters, entries of fillers."""
        parsed = F.from_json(F.get_json_object("value", f"$.tables.{self.known('tables', name)}.{field}"), "array<string>")
        return list(self.content().select(F.coalesce(parsed, F.array().cast("array<string>")).alias("x")).first().x)


class Entries(Asset):
    """A dictionary, candidates or pairs: a bare list, or an object with entries, candidates or pairs."""

    def rows(self, schema: str) -> DataFrame:
        return articles.read_entries(self.spark, self.path, schema)

    def count(self) -> int:
        return self.rows("ar string").count()

    def patterns(self, side: str) -> list[str]:
        """The values of a field for the matcher, in order, empty ones left out."""
        return matching.pattern_list(self.rows(f"{side} string").orderBy("ord"), side)


def health_report(spark: SparkSession, files: dict[str, str], lists: dict[str, str] | None = None, vendors: tuple[str, ...] = (), probe: Callable[[str], bool] | None = None) -> DataFrame:
    """asset, path, status (OK, UNREADABLE or MISSING), size_bytes, n_items and schema_version of each file; and a row for each vendor that probe() is asked about (OK or UNREACHABLE).

    lists: the field of an asset that holds its items. Missing and unreadable files are rows, not errors; so is a probe that raises.
    """
    rows = []
    for name, path in files.items():
        asset, size, n_items, version = Asset(spark, path), None, None, None
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if store.exists(where):
            size, field = store.getFileStatus(where).getLen(), (lists or {}).get(name)
            root = asset.content().select(F.try_parse_json("value").isNotNull().alias("good"), F.json_array_length(F.get_json_object("value", f"$.{field}")).alias("n") if field else F.lit(None).cast("int").alias("n")).first()
            status, n_items = ("OK", root.n) if root.good else ("UNREADABLE", None)
            version = asset.value("$schema_version") if root.good else None
        else:
            status = "MISSING"
        rows.append((name, path, status, size, n_items, version))
    for vendor in vendors if probe else ():
        try:
            reached = probe(vendor)
        except Exception:  # the row says so
            reached = False
        rows.append((vendor, None, "OK" if reached else "UNREACHABLE", None, None, None))
    return spark.createDataFrame(rows, "asset string, path string, status string, size_bytes long, n_items long, schema_version string")


def scan_files(spark: SparkSession, path: str, patterns: list[str]) -> DataFrame:
    """Matches in whole text files: path, start, end, pattern."""
    files = spark.read.text(path, wholetext=True).select(F.xxhash64("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return matching.match_automaton(files, patterns).join(files.select("doc_id", "path"), "doc_id").drop("doc_id")
