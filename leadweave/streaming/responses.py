"""Response streams: deduplication, windowed counts, alerts for responses that nobody answered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def response_stream(events: DataFrame, leads: DataFrame, late: str = "2 hours") -> DataFrame:
    """Responses deduplicated by id within the watermark and joined to their lead (a static table)."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]).join(leads.select("campaign_id", "lead_id", "dealer_id"), "lead_id")


def response_counts(stream: DataFrame, every: str = "1 hour") -> DataFrame:
    """Responses per window, campaign, dealer and type; a window closes when the watermark passes it."""
    counted = stream.groupBy(F.window("ts", every), "campaign_id", "dealer_id", "response_type").agg(F.count("*").alias("responses"))
    return counted.select(F.col("window.start").alias("window_start"), "campaign_id", "dealer_id", "response_type", "responses")


def unanswered_alerts(responses: DataFrame, outcomes: DataFrame, within: str = "24 hours", late: str = "2 hours") -> DataFrame:
    """Responses without an outcome of their lead inside the interval; they come out once the watermark has passed it."""
    r = responses.withWatermark("ts", late)
    o = outcomes.select(F.col("lead_id").alias("o_lead"), "outcome_id", "outcome_ts").withWatermark("outcome_ts", late)
    met = r.join(o, F.expr(f"lead_id = o_lead and outcome_ts >= ts and outcome_ts <= ts + interval {within}"), "leftOuter")
    return met.where("outcome_id is null").select("event_id", "lead_id", "ts")


def run_to_table(stream: DataFrame, name: str, folder: str) -> DataFrame:
    """All that is available of a stream, in append mode, as a Parquet table with a checkpoint."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/{name}")
