"""Quality rules: simple text statistics, and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into a fixed number of buckets. Over all documents their counts make the raw-corpus
multinomial; over the trusted documents, the target's. A document's score is the mean, over its n-grams, of the log ratio
of the two, so that length does not matter; documents below a threshold are rejected, each by the same rule. A bucket's
ratio shrinks to 0 where few trusted n-grams are to be expected, and a document's mean where it has few n-grams.

The trusted documents and the labelled ones that place the threshold are a sample of at most `labelled` rows of the
labels (those of smallest hash), the one bounded part; the raw counts cover every document, in every run. Every other
good one of the sample is held out from the target, so that the threshold is placed by documents the model has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import kernel
from wordloom.llm.common import map_batches, slices, table, texts

BITS, LABELLED = 16, 20_000
#: Pseudo-counts: of n-grams in a bucket, and of neutral n-grams in a document.
SMOOTHING, SHORT = 5.0, 32
#: Of the labelled good documents, this share may score below the threshold.
GOOD_LOST = 0.0005
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_WHITE = " \t\n\v\f\r"


@dataclass
class Model:
    """ratio: log target / raw by bucket (None: nothing to compare with, and all scores are 0); threshold: the least score kept."""

    ratio: np.ndarray | None
    threshold: float


def _features(w: kernel.Words, hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every word and word pair, and its document."""
    pairs, begin = w.windows(hashes, 2)
    shift = np.uint64(64 - bits)
    return np.concatenate((hashes >> shift, pairs >> shift)).astype(np.int64), np.concatenate((w.doc, w.doc[begin]))


def _scores(w: kernel.Words, hashes: np.ndarray, ratio: np.ndarray | None, bits: int) -> np.ndarray:
    docs = len(w.ends) - 1
    if ratio is None:
        return np.zeros(docs)
    bucket, doc = _features(w, hashes, bits)
    return np.bincount(doc, ratio[bucket], docs) / (np.bincount(doc, minlength=docs) + SHORT)


def counts(docs: DataFrame, trusted: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The counts of all n-grams over all documents by bucket, and over those whose ids are in the sorted array `trusted`.

    Each task adds its own documents up and sends a row per bucket, so what is shuffled is bounded by tasks times buckets.
    """
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                w = kernel.words(batch.column("text"))
                bucket, doc = _features(w, w.hashes(), bits)
                raw += np.bincount(bucket, minlength=size)
                is_trusted = np.isin(batch.column("doc_id").to_numpy(zero_copy_only=False), trusted)
                target += np.bincount(bucket[is_trusted[doc]], minlength=size)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], ["bucket", "raw", "target"])

    found = docs.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(size), np.zeros(size)
    at = found["bucket"].to_numpy()
    raw[at], target[at] = found["raw"].to_numpy(), found["target"].to_numpy()
    return raw, target


def fit(docs: DataFrame, labels: DataFrame | None, bits: int = BITS, labelled: int = LABELLED, good_lost: float = GOOD_LOST, smoothing: float = SMOOTHING) -> Model:
    """docs: doc_id and text; labels: doc_id and quality (1: good). Without a good label every score is 0 and is kept.

    A document with several labels is good if all are; labels without an id or a quality count for nothing.
    """
    if labels is None:
        return Model(None, -np.inf)
    sample = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).toArrow()
    ids, good = sample["doc_id"].to_numpy(), sample["quality"].to_numpy() == 1
    if not good.any():
        return Model(None, -np.inf)
    trusted = np.unique(ids[good])[::2]
    raw, target = counts(docs, trusted, bits)
    if not target.any():
        return Model(None, -np.inf)
    ratio = np.log((target + smoothing) / (raw * (target.sum() / raw.sum()) + smoothing))
    wanted = docs.join(F.broadcast(docs.sparkSession.createDataFrame(sample.select(["doc_id"])).distinct()), "doc_id", "left_semi")
    known = score(wanted, Model(ratio, -np.inf), bits).select("doc_id", "score", "n_words").toArrow()
    quality = dict(zip(ids.tolist(), good.tolist(), strict=True))
    is_good = np.array([quality[i] for i in known["doc_id"].to_pylist()], bool)
    scores, n = known["score"].to_numpy(), known["n_words"].to_numpy()
    seen = np.isin(known["doc_id"].to_numpy(), trusted)
    of_good, of_bad = np.sort(scores[is_good & ~seen & (n >= 10)]), np.sort(scores[~is_good & (n >= 10)])
    if not len(of_good):
        return Model(ratio, -np.inf)
    #: Half way between the good documents' lower end and the nearest rejected one below it.
    low = of_good[int(good_lost * len(of_good))]
    below = of_bad[of_bad < low]
    return Model(ratio, float(low if not len(below) else (low + below[-1]) / 2))


def _judged(column: pa.Array, ratio: np.ndarray | None, threshold: float, bits: int) -> dict[str, np.ndarray]:
    w = kernel.words(column)
    hashes = w.hashes()
    n_words = np.diff(w.first)

    def total(of_bytes: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(of_bytes)))
        return sums[w.ends[1:]] - sums[w.ends[:-1]]

    lines = np.zeros(len(column), np.int64)
    for i, text in enumerate(column.to_pylist()):
        full = [x for x in text.split("\n") if x.strip(_WHITE)]
        lines[i] = len(full) - len(set(full))
    value, begin = w.windows(hashes, 5)
    value = kernel.mix(value + w.doc[begin].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(value, kind="stable")
    same = value[order][1:] == value[order][:-1]
    again = begin[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]] if len(order) else begin
    begins = np.bincount(again, minlength=len(hashes) + 5)
    cover = begins - np.concatenate((np.zeros(5, np.int64), begins[:-5]))
    repeated = w.per_doc(np.cumsum(cover[: len(hashes)]) > 0).astype(np.int64)
    scores = _scores(w, hashes, ratio, bits)
    failed = (n_words < 10) | (100 * repeated > 20 * n_words)
    chars = total(~kernel._SPACE[w.data] & ((w.data & 0xC0) != 0x80))
    return {"n_words": n_words, "word_chars": chars, "n_symbols": total(_SYMBOL[w.data]), "n_dup_lines": lines, "n_repeat_words": repeated, "base_failed": failed, "score": scores, "kept": ~failed & (scores >= threshold)}


def score(docs: DataFrame, model: Model, bits: int = BITS) -> DataFrame:
    """Statistics, score and verdicts of every row of docs (doc_id, text): a text without words has zeros and fails the base rules."""

    def make():
        ratio, threshold = model.ratio, model.threshold

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = {"doc_id": batch.column("doc_id")} | _judged(batch.column("text"), ratio, threshold, bits)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))

        return run

    return map_batches(docs, make, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean", "text")


def quality_rules(docs: DataFrame, labels: DataFrame | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fit on the documents and their labels, then judge every document. Null texts count as empty, texts of any length are read whole; repeated rows are judged each, and a table without rows has no verdicts."""
    own = texts(docs, doc_id, text)
    return score(own, fit(own, labels))


def keep(docs: DataFrame, labels: DataFrame | None, doc_id: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """The rows of docs, with all their columns, that the rules and the model keep: one more pass, no shuffle."""
    model = fit(texts(docs, doc_id, text), labels, bits)

    def make():
        ratio, threshold = model.ratio, model.threshold

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array(_judged(pc.fill_null(batch.column(text), ""), ratio, threshold, bits)["kept"]))

        return run

    return map_batches(docs, make, docs.schema, text)


def op8_hashed_llr_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's statistics and verdicts."""
    found = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


QUERIES = {"op8_hashed_llr_quality": op8_hashed_llr_quality}
