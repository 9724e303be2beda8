"""Influence traces: append-only records, their numbering, filters and summaries; runs of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What may have triggered a record; anything else is `other`, with the raw value kept.
TRIGGERS = (
    "term_hint_injected", "calque_correction_applied", "lex_substitution_fired", "intensifier_destacked", "typography_normalized", "anti_pattern_detected", "terminology_confirmed", "cross_vendor_correction",
    "humanizer_gate_decision", "language_check_failed", "compatibility_refused", "other",
)
#: The triggers that event types stand for.
OF_EVENTS = {"view": "term_hint_injected", "click": "lex_substitution_fired", "purchase": "terminology_confirmed"}


def raw_trigger(event_type: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in OF_EVENTS.items() for x in kv]), event_type), event_type)


def trigger(column: Column) -> Column:
    return F.when(column.isin(*TRIGGERS), column).otherwise("other")


def records(events: DataFrame) -> DataFrame:
    """Events as trace records: trace_id, seq (from 0, by time), asset_id, stage, trigger, trigger_raw (of others alone)."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    raw = raw_trigger(F.col("event_type"))
    return events.select(
        F.col("user_id").alias("trace_id"), (F.row_number().over(order) - 1).cast("long").alias("seq"), "event_id", F.concat(F.lit("asset-"), (F.col("event_id") % 12).cast("string")).alias("asset_id"),
        F.when(F.col("value") > 50, "rewrite").otherwise("unspecified").alias("stage"), trigger(raw).alias("trigger"), F.when(~raw.isin(*TRIGGERS), raw).alias("trigger_raw"),
    )


def filter_by(trace: DataFrame, **equal) -> DataFrame:
    for name, value in equal.items():
        trace = trace.filter(F.col(name) == value)
    return trace


def summary(trace: DataFrame) -> DataFrame:
    """facet (total, asset_id, stage, trigger), value and n, in one pass."""
    made = trace.groupingSets([[], ["asset_id"], ["stage"], ["trigger"]], "asset_id", "stage", "trigger").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    facet = F.when(F.col("g") == 7, "total").when(F.col("g") == 3, "asset_id").when(F.col("g") == 5, "stage").otherwise("trigger")
    return made.select(facet.alias("facet"), F.coalesce("asset_id", "stage", "trigger", F.lit("")).alias("value"), "n")


def hourly(events: DataFrame) -> DataFrame:
    """hour, trigger, n."""
    return events.groupBy(F.window("ts", "1 hour").alias("w"), trigger(raw_trigger(F.col("event_type"))).alias("trigger")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "trigger", "n")


def failure_runs(events: DataFrame, least: int = 3, failed: str = "error") -> DataFrame:
    """Runs of `least` failures or more in a row per vendor (user): user_id, run_start (event_id), run_length. A breaker opens at each."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    numbered = events.select("user_id", "ts", "event_id", (F.col("event_type") == failed).alias("bad")).withColumn("rn", F.row_number().over(order))
    kind = Window.partitionBy("user_id", "bad").orderBy("ts", "event_id")
    islands = numbered.withColumn("island", F.col("rn") - F.row_number().over(kind)).filter("bad")
    return islands.groupBy("user_id", "island").agg(F.min_by("event_id", "rn").alias("run_start"), F.count("*").alias("run_length")).filter(F.col("run_length") >= least).drop("island")


def as_json(trace: DataFrame) -> DataFrame:
    return trace.select("trace_id", F.to_json(F.struct(*trace.columns)).alias("json"))


def from_json(lines: DataFrame, schema: str) -> DataFrame:
    """Records read back, numbered anew."""
    parsed = lines.select(F.from_json("json", schema).alias("r")).select("r.*")
    return parsed.withColumn("seq", (F.row_number().over(Window.partitionBy("trace_id").orderBy("seq")) - 1).cast("long"))
