"""Registered queries that run a stream over the given tables to its end.

Ordered ones run twice over the same state: over what is there, and over the marker
that closes the log, which brings out what still waits for the watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexfold.plans.bindings import bind, bind_stream
from codexfold.streaming import gates, sources, stateful

LATENESS = "40 days"  # a table of the past comes in any order


def to_table(spark: SparkSession, build: Callable[[SparkSession, str], DataFrame], name: str, mode: str, ordered: bool = True) -> DataFrame:
    """Run the stream that ``build`` makes, given a folder for markers, over what is there,
    then over the closing marker, and return the table it wrote."""
    own = sources.stream_session(spark)
    folder = sources.shared_folder(spark, name)
    stream = build(own, f"{folder}/marks")
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])
    for closing in (False, True) if ordered else (False,):
        if closing:
            sources.close_log(own, f"{folder}/marks")
            stream = build(own, f"{folder}/marks")
        sources.write_updates(stream, f"{folder}/table", f"{folder}/state", mode).awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/table")


def _closing(spark: SparkSession, sf: str, binding: str, marks: str) -> DataFrame:
    return sources.with_close(bind_stream(spark, sf, binding), marks)


def _appended(name: str, binding: str, build: Callable[[DataFrame], DataFrame]):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return to_table(spark, lambda own, marks: build(_closing(own, sf, binding, marks)), name, "append").drop("batch_id")

    return run


def _updated(name: str, keys: list[str], build: Callable[[SparkSession, str, str], DataFrame], ordered: bool):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return sources.latest(to_table(spark, lambda own, marks: build(own, sf, marks), name, "update", ordered), keys)

    return run


def _events(build: Callable[[DataFrame], DataFrame], binding: str = "event_log"):
    return lambda spark, sf, marks: build(bind_stream(spark, sf, binding))


def _segments(spark: SparkSession, sf: str, marks: str) -> DataFrame:
    return stateful.segments_stream(_closing(spark, sf, "event_log", marks), LATENESS)


def _pending(spark: SparkSession, sf: str, marks: str) -> DataFrame:
    return gates.pending_review_stream(bind_stream(spark, sf, "ready"), bind_stream(spark, sf, "confirms"))


def live_event_route(spark: SparkSession, sf: str) -> DataFrame:
    def build(own: SparkSession, marks: str) -> DataFrame:
        return stateful.route_stream(_closing(own, sf, "event_log", marks), bind(own, sf, "sessions"), LATENESS)

    return to_table(spark, build, "live_event_route", "append").drop("batch_id")


def live_review_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews of documents that were stored before."""

    def build(own: SparkSession, marks: str) -> DataFrame:
        stored = bind(own, sf, "sessions").select("session_id", F.lit("brd").alias("stage"), F.col("source_code").alias("value"))
        return stateful.review_stream(_closing(own, sf, "reviews", marks), stored=stored, lateness=LATENESS)

    return to_table(spark, build, "live_review_deltas", "append").drop("batch_id")


def live_context_before_gate(spark: SparkSession, sf: str) -> DataFrame:
    def build(own: SparkSession, marks: str) -> DataFrame:
        confirms = bind_stream(own, sf, "reviews").where((F.col("stage") == "brd") & F.col("tech").isNotNull())
        return gates.context_gate_stream(_closing(own, sf, "context_files", marks), confirms, bind(own, sf, "sessions"), LATENESS)

    return to_table(spark, build, "live_context_before_gate", "append").drop("batch_id")


LIVE = {
    "live_status_reduce": _updated("live_status_reduce", ["session_id"], _events(stateful.status_stream), False),
    "live_state_fold": _updated("live_state_fold", ["session_id", "key"], _events(stateful.fold_stream, "deltas"), False),
    "live_pending_review": _updated("live_pending_review", ["session_id", "stage"], _pending, False),
    "live_stream_segments": _updated("live_stream_segments", ["session_id", "segment", "run"], _segments, True),
    "live_stream_progress": _appended("live_stream_progress", "event_log", lambda e: stateful.progress_stream(e, LATENESS)),
    "live_idle_heartbeat": _appended("live_idle_heartbeat", "event_log", lambda e: stateful.heartbeat_stream(e, lateness=LATENESS)),
    "live_event_route": live_event_route,
    "live_review_deltas": live_review_deltas,
    "live_context_before_gate": live_context_before_gate,
}
