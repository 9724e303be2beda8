"""The transliterated view of documents, literal tables for both engines, and input spreading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LATIN = "abcdefghijklmnopqrstuvwxyzéèêëñóíúáüößäçà"
ARABIC = "ابتثجحخدذرزسشصضطظعغفقكلمنهَُِّةأإآىؤئءـًٌ"
AR_SQL = f"(SELECT doc_id, source, lang, translate(lower(text), '{LATIN}', '{ARABIC}') AS text FROM documents)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal few input partitions out to all cores before heavy per-row work; large inputs, which have many, are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def transliterate(text: Column) -> Column:
    return F.translate(F.lower(text), LATIN, ARABIC)


def ar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in Arabic letters, marks and hamza forms included."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    return docs.withColumn("text", transliterate(F.col("text")))


class Literal:
    """A small table for both engines. schema: name -> Spark type; rows: tuples (lists for arrays)."""

    DUCK = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}

    def __init__(self, schema: str, rows: list[tuple]):
        self.fields = [tuple(f.split(" ")) for f in schema.split(", ")]
        self.schema, self.rows = schema, rows

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @staticmethod
    def _quoted(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return str(value).lower()
        if isinstance(value, (list, tuple)):
            return "[" + ", ".join(map(Literal._quoted, value)) + "]"
        return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)

    def sql(self) -> str:
        """A DuckDB subquery with the same rows and types."""
        names = ", ".join(f'"{n}"' for n, _ in self.fields)
        casts = ", ".join(f'CAST("{n}" AS {self.DUCK[t]}) AS "{n}"' for n, t in self.fields)
        rows = ", ".join("(" + ", ".join(map(self._quoted, r)) + ")" for r in self.rows)
        return f"(SELECT {casts} FROM (VALUES {rows}) AS raw({names}))"
