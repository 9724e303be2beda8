"""Term pairing end to end: candidates in batches to a vendor, proposals from its answers, a second vendor's agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.operators import mining, remote, terms


def proposals(candidates: DataFrame, vendor: str, transport: remote.Transport, size: int = 20, **options) -> DataFrame:
    """candidates (rank, term, freq) -> ar, en, domain, confidence and proposer, from one remote call for each batch; a batch whose call fails gives none."""
    requests = mining.prompt_batches(candidates, size).select(F.col("batch").alias("id"), F.lit(vendor).alias("vendor"), F.col("prompt").alias("payload"))
    answers = remote.call_all(requests, transport, **options).filter("ok")
    found = terms.proposals_of(answers, "payload").select(F.explode("proposals").alias("p")).select("p.*")
    return found.withColumn("proposer", F.lit(vendor))


def pair(candidates: DataFrame, vendor: str, transport: remote.Transport, second: str | None = None, size: int = 20, keep_low: bool = False, most: int | None = None, **options) -> DataFrame:
    """Candidates (rank, term, freq, ngram_size) with the vendor's proposal; with a second vendor, with its agreement or its own proposal too.

    most: only the candidates of the best ranks so far are asked about (default: all). Calls are made once for each use of the result: write it before going on.
    """
    if most is not None:
        candidates = candidates.filter(F.col("rank") <= most)
    pairs = terms.accept_proposals(candidates, proposals(candidates, vendor, transport, size, **options), keep_low)
    if second is None:
        return pairs
    others = proposals(candidates, second, transport, size, **options)
    return terms.confirm(pairs, others.select("ar", "en", F.monotonically_increasing_id().alias("ord")))
