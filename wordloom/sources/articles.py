"""Readers of JSON articles and assets, of whatever scale their folder has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import text


def read_articles(spark: SparkSession, folder: str, first: int | None = None) -> DataFrame:
    """path, doc_id (by path order where `first` is given, else a hash of the path) and text: title, description and content
    joined by spaces, entities decoded. Bad JSON, other roots and values that aren't strings count as nothing."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v"))
    part = lambda k: F.when(F.schema_of_variant(F.expr(f"try_variant_get(v, '$.{k}')")) == "STRING", F.expr(f"try_variant_get(v, '$.{k}', 'string')"))
    made = raw.select("path", text.html_unescape(F.concat_ws(" ", part("title"), part("description"), part("content"))).alias("text"))
    if first is not None:
        made = made.orderBy("path").limit(first)
    return made.withColumn("doc_id", F.xxhash64("path"))


def read_entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Entries of an asset, which is a bare list or an object with `entries`, `pairs` or `candidates`; ord is the file order."""
    raw = spark.read.text(path, wholetext=True)
    keys = ("entries", "pairs", "candidates")
    envelope = F.from_json("value", ", ".join(f"{k} array<struct<{schema}>>" for k in keys))
    bare = F.from_json(F.when(F.ltrim("value").startswith("["), F.col("value")), f"array<struct<{schema}>>")
    rows = raw.select(F.coalesce(bare, *[envelope[k] for k in keys]).alias("rows"))
    return rows.select(F.posexplode("rows").alias("ord", "e")).select(F.col("ord").cast("long").alias("ord"), "e.*")


def discover(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """The domains of files named <prefix>-<domain>.json, sorted."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}-*.json").load(folder)
    return domains_of(files.select("path"), prefix)


def domains_of(paths: DataFrame, prefix: str) -> DataFrame:
    return paths.select(F.regexp_extract("path", rf"(?:^|/){prefix}-([^/]+)\.json$", 1).alias("domain")).filter("domain != ''").distinct().orderBy("domain")


def read_or_empty(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """A strict reader fails on a missing asset and says what there is; a lenient one has no rows."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(hadoop):
        return read_entries(spark, path, schema)
    if strict:
        parent = hadoop.getParent()
        there = [s.getPath().getName() for s in store.listStatus(parent)] if parent and store.exists(parent) else []
        raise FileNotFoundError(f"{path}; the folder has: {', '.join(sorted(there)) or 'nothing'}")
    return spark.createDataFrame([], f"ord long, {schema}")
