"""Harmonic packing of tokenized documents into training sequences.

Lengths fall into reciprocal-capacity classes: class j holds the lengths in (C/(j+1), C/j], and each of its bins takes
exactly j pieces, so a worker fills bins from its own stream of documents without looking at others. Documents may be
cut: whole sequences first, then the reciprocal lengths C/2, C/4 ... down to `least` that the rest contains (they fill
their bins without a gap), and one tail shorter than `least`. What a worker's bins hold when its documents end is
strung together and cut into whole sequences and, at the end, sequences whose length is a power of two, which need no
padding.

No shuffle. A worker holds, per class, fewer pieces than one bin has. Sequence ids carry the partition's number, so a
task that runs again makes the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.byte_bpe import gpt_bytes
from wordloom.llm.common import slices, table, texts

CAPACITY, LEAST, END = 2048, 64, 1
_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long"

Piece = tuple[int, int, int, bytes, int]  # document, start, length, ids, the document's length


def cuts(n: int, capacity: int = CAPACITY, least: int = LEAST) -> Iterator[int]:
    """The lengths of a document's pieces, in order."""
    for _ in range(n // capacity):
        yield capacity
    n %= capacity
    size = capacity // 2
    while size >= least:
        if n >= size:
            yield size
            n -= size
        size //= 2
    if n:
        yield n


class Bins:
    """One worker's open bins."""

    def __init__(self, number: int, capacity: int):
        self.capacity, self.next = capacity, number << 40
        self.open: dict[int, list[Piece]] = {}
        self.rows: list[tuple] = []

    def close(self, pieces: list[Piece]) -> None:
        total, at = sum(p[2] for p in pieces), 0
        for doc, start, length, ids, tokens in pieces:
            self.rows.append((doc, start, length, ids, tokens, self.next, at, total))
            at += length
        self.next += 1

    def add(self, piece: Piece) -> None:
        count = self.capacity // piece[2]
        if count == 1:
            self.close([piece])
            return
        pieces = self.open.setdefault(count, [])
        pieces.append(piece)
        if len(pieces) == count:
            self.close(self.open.pop(count))

    def finish(self) -> None:
        """String what is left together: whole sequences, then lengths that are powers of two."""
        left = [p for count in sorted(self.open) for p in self.open[count]]
        total = sum(p[2] for p in left)
        sizes = [self.capacity] * (total // self.capacity) + [1 << b for b in range(self.capacity.bit_length() - 1, -1, -1) if total % self.capacity >> b & 1]
        left.reverse()
        for size in sizes:
            pieces, room = [], size
            while room:
                doc, start, length, ids, tokens = left.pop()
                taken = min(room, length)
                pieces.append((doc, start, taken, ids[: 4 * taken], tokens))
                if taken < length:
                    left.append((doc, start + taken, length - taken, ids[4 * taken :], tokens))
                room -= taken
            self.close(pieces)
        self.open.clear()

    def batch(self) -> pa.RecordBatch:
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_length"]
        types = [pa.binary() if n == "ids" else pa.int64() for n in names]
        columns = list(zip(*self.rows, strict=True)) or [[]] * len(names)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def pack(docs: DataFrame, encode: Callable[[], Callable[[str], bytes]] | None = None, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, least: int = LEAST, end: int = END) -> DataFrame:
    """Pack every document (a null or empty text is the end id alone) into sequences of at most `capacity` tokens.

    encode: builds, once a task, a function from a text to its ids, four little-endian bytes each. capacity and least are
    powers of two. Equal documents are packed one by one; an empty table gives no rows. One row per piece with its ids.
    """
    if capacity & (capacity - 1) or least & (least - 1) or not 1 <= least <= capacity:
        raise ValueError("capacity and least must be powers of two, least no more than capacity")
    make = encode or (lambda: gpt_bytes().ids)
    last = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, bins = make(), Bins(TaskContext.get().partitionId(), capacity)
        for whole in batches:
            for batch in slices(whole, "text"):
                for doc, string in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids, start = ids_of(string) + last, 0
                    tokens = len(ids) // 4
                    for length in cuts(tokens, capacity, least):
                        bins.add((doc, start, length, ids[4 * start : 4 * (start + length)], tokens))
                        start += length
                if bins.rows:
                    yield bins.batch()
        bins.finish()
        yield bins.batch()

    return texts(docs, doc_id, text).mapInArrow(run, _SCHEMA)


def op3_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, with a checksum of their ids."""
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length")


QUERIES = {"op3_harmonic_packing": op3_harmonic_packing}
