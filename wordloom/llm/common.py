"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The two columns that an operator reads, under fixed names; a null text is empty. Other columns are dropped, but for
    those to carry, which go by names of their own so that they clash with none of the operator's."""
    others = [docs[c].alias(f"carried_{i}") for i, c in enumerate(carry)]
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"), *others)


def carried(carry: tuple[str, ...]) -> list:
    """The carried columns under their own names again."""
    return [F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)]


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, from the session's own setting.

    Where none is set, a local master (tests, one machine) gets a temporary one; on a cluster that would be a folder of
    one machine, so it is an error.
    """
    context = spark.sparkContext
    if not (where := context.getCheckpointDir()):
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            where = tempfile.mkdtemp(prefix="wordloom-")
        context.setCheckpointDir(where)
    return where


class Scratch:
    """Tables of one job, written to the shared checkpoint folder: lineage ends there, and drop() frees the room.

    A query that writes a table also gives up its shuffle files when it is done, as nothing reads them again.
    """

    _CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.number = spark, f"{checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}", 0
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def put(self, df: DataFrame) -> DataFrame:
        path, self.number = f"{self.folder}/{self.number:04d}", self.number + 1
        before = self.spark.conf.get(self._CLEAN, None)
        self.spark.conf.set(self._CLEAN, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(self._CLEAN) if before is None else self.spark.conf.set(self._CLEAN, before)
        made = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(made)] = made, path
        return made

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that put() gave; what is computed from them must have been written before."""
        context = self.spark.sparkContext
        for made in tables:
            where = context._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(made))[1])
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and go on from there: later stages do not compute them again."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions, which the cluster sizes to its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece has about `most` bytes of text at the most, or a single row."""
    ends = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
    start, before = 0, 0
    for i in range(len(ends)):
        if ends[i] - before > most and i > start:
            yield batch.slice(start, i - start)
            start, before = i, ends[i - 1]
    if start < len(ends):
        yield batch.slice(start)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, column: str | None = None) -> DataFrame:
    """df.mapInArrow with a function that each task builds once by make(); with `column`, in slices of bounded text size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for part in slices(batch, column) if column else (batch,):
                yield function(part)

    return df.mapInArrow(run, schema)
