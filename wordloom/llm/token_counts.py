"""Token counts by section from one encoding of each whole document.

A document is encoded once, whole. Its tokens' spans and its sections' spans are both intervals of its bytes, in order,
so one merge of the two joins them. A token that crosses a boundary belongs to the section that holds its first byte;
every token so belongs to exactly one section, and the sections' counts add up to the document's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wordloom.llm import kernel
from wordloom.llm.byte_bpe import gpt_bytes
from wordloom.llm.common import map_batches, table, texts

_SCHEMA = "doc_id long, section long, start long, end long, n_tokens long, n_crossing long, doc_tokens long"


def attribute(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and section; a section is a line with the \\n that ends it, and a text that ends in \\n has no empty one behind it.

    start and end: the section's code points, the end exclusive. n_tokens: tokens that begin in it; n_crossing: those of
    them that reach into the next one. A null or empty text has one empty section without tokens. Repeated rows of docs
    give their sections again.
    """

    def make():
        bpe = gpt_bytes()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = batch.column("text")
            data, ends = kernel.buffers(column)
            edge = np.zeros(len(data) + 1, bool)
            edge[np.flatnonzero(data == 10) + 1] = True
            edge[ends] = True
            begin = np.flatnonzero(edge[:-1])
            empty = ends[:-1][np.diff(ends) == 0]
            begin = np.sort(np.concatenate((begin, empty)), kind="stable")
            #: Empty documents have a section of their own, in front of the one that starts at the same byte.
            doc_start = ends[:-1]
            first = np.concatenate((np.searchsorted(begin, doc_start, "left"), [len(begin)]))
            seen = np.arange(len(doc_start)) - np.searchsorted(doc_start, doc_start, "left")
            first[:-1] += seen
            n_sections = np.diff(first)
            doc = np.repeat(np.arange(len(doc_start)), n_sections)
            end = np.where(np.arange(len(begin)) + 1 < first[doc + 1], np.concatenate((begin[1:], [len(data)])), ends[doc + 1])
            chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            ids = [bpe.array(t) for t in column.to_pylist()]
            doc_tokens = np.array([len(x) for x in ids], np.int64)
            lengths = bpe.byte_lengths[np.concatenate(ids)] if ids else np.zeros(0, np.int64)
            token_end = np.cumsum(lengths)
            token_start = token_end - lengths
            #: The last section that begins at the token's first byte or before; empty ones begin there too but come earlier.
            owner = np.searchsorted(begin, token_start, "right") - 1
            n_tokens = np.bincount(owner, minlength=len(begin))
            crossing = np.bincount(owner[token_end > end[owner]], minlength=len(begin)) if len(owner) else n_tokens
            base = chars[ends[:-1]][doc]
            columns = [batch.column("doc_id").take(pa.array(doc)), np.arange(len(begin)) - first[:-1][doc], chars[begin] - base, chars[end] - base, n_tokens, crossing, doc_tokens[doc]]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.astype(np.int64)) for c in columns], ["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"])

        return run

    return map_batches(texts(docs, doc_id, text), make, _SCHEMA, "text")


def op9_offset_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every section of every document with its tokens."""
    return attribute(table(spark, sf_dir, "documents"))


QUERIES = {"op9_offset_attribution": op9_offset_attribution}
