"""Event log of a session, batch form. ``codexfold.streaming`` has the same
operators for unbounded input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexfold import constants as K
from codexfold.functions.clock import micros
from codexfold.functions.prefix import PART_CHARS, ordered_text, prefix
from codexfold.functions.skew import HOT_ROWS, hot_keys, lookup_join
from codexfold.functions.text import lookup

EVENT_TYPE = (
    "type string, step string, content string, brd string, technical_spec string, progress int, message string, "
    "files array<struct<path:string,content:string,language:string>>, session_id string, seq bigint"
)


def event_encode(events: DataFrame) -> DataFrame:
    """One JSON object per event; absent fields are left out."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("line"))


def event_decode(lines: DataFrame, schema: str = EVENT_TYPE) -> DataFrame:
    """Parse ``line``; ``valid`` is false for text that is not a JSON value. Session
    ids are text, as numbers are too once they are decoded.

    Readers drop such lines silently: filter on ``valid`` for the events,
    aggregate it for the number of drops.
    """
    return lines.withColumn("valid", F.expr("try_parse_json(line) IS NOT NULL")).withColumn(
        "event", F.when(F.col("valid"), F.from_json("line", schema))
    )


def ready_text(events: DataFrame) -> Column:
    """A ready event's own text: its field by type, '' where the type has none."""
    own = None
    for kind, field in K.READY_TEXT.items():
        value = F.col(field) if field in events.columns else F.lit(None).cast("string")
        own = F.when(F.col("type") == kind, value) if own is None else own.when(F.col("type") == kind, value)
    return own.otherwise(F.lit(""))


def is_terminal() -> Column:
    return F.col("type").isin(*K.TERMINAL_STEP)


def step_set_by() -> Column:
    """Step an event sets, NULL when it sets none."""
    return (
        F.when(F.col("type") == "step-change", F.nullif(F.col("step"), F.lit("")))
        .otherwise(lookup(F.col("type"), {**K.READY_STEP, **K.TERMINAL_STEP}))
    )


def event_route(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Events of known sessions up to and including the first terminal event."""
    ends = (
        sessions.select("session_id", F.lit(True).alias("_known"), F.lit(None).cast("bigint").alias("seq"))
        .unionByName(
            events.where(is_terminal()).select("session_id", F.lit(None).cast("boolean").alias("_known"), "seq")
        )
        .groupBy("session_id")
        .agg(F.max("_known").alias("_known"), F.min("seq").alias("_end"))
        .where("_known")
        .drop("_known")
    )
    return (
        lookup_join(events, ends, ["session_id"], F.col("seq"), "inner")
        .where(F.col("_end").isNull() | (F.col("seq") <= F.col("_end")))
        .drop("_end")
    )


def _starts_segment() -> Column:
    return (F.col("type") == "step-change") & (F.col("step") != "")


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("bigint")


def stream_segments(
    events: DataFrame, part_chars: int = PART_CHARS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Streamed text per session, segment and run.

    ``step-change`` opens a segment; ``step-change`` and ``*-ready`` both end
    the current run of stream chunks. A run's text is its chunks in order; a
    ``*-ready`` replaces it by its own text unless that is NULL: the document of
    ``brd-ready``, the content of ``plan-ready``, nothing for ``code-ready``. Rows:
    (session_id, segment, run, part, step, closed_by, text); the open run has
    closed_by NULL, runs without chunks or ready event have no row, and events
    after the first terminal one do not count.
    """
    starts, ready = _starts_segment(), F.col("type").isin(*K.READY_TYPES)
    chunk = F.col("type").isin(*K.STREAM_TYPES)
    chars = F.when(chunk, F.length(F.coalesce("content", F.lit("")))).otherwise(0).cast("bigint")
    used = events.where(
        F.col("session_id").isNotNull() & (starts | ready | chunk | is_terminal())
    ).select("session_id", "seq", "type", "step", "content", ready_text(events).alias("_own_text"))
    log = prefix(
        used,
        ["session_id"],
        "seq",
        {
            "_ended": ("sum", _flag(is_terminal())),
            "segment": ("sum", _flag(starts)),
            "run": ("sum", _flag(starts | ready)),
            "_chars": ("sum", chars),
            "_step": ("max", F.when(step_set_by().isNotNull(), F.struct("seq", step_set_by().alias("step")))),
        },
        hot_rows,
    ).where((F.col("_ended") == 0) & ~is_terminal())

    part = F.floor(F.col("_chars") / part_chars)
    # Empty chunks add no characters, so they must not be gathered either.
    parts = log.groupBy("session_id", "segment", "run", part.alias("part")).agg(
        F.expr(
            "listagg(CASE WHEN type LIKE '%-stream' AND content <> '' THEN content END, '') WITHIN GROUP (ORDER BY seq)"
        ).alias("_text"),
        F.count_if(chunk).alias("_chunks"),
        F.max("_step.step").alias("step"),
    )
    # One event closes a run and lies in its last part. It takes every column of
    # the log, and of step changes only those with a step are left, so that both
    # sides read one exchange.
    closing = log.where((F.col("type") == "step-change") | ready).select(
        "session_id", "segment", "run", F.col("type").alias("closed_by"), F.col("_step.step").alias("_closing_step"),
        F.when(ready, F.col("_own_text")).alias("_own"), part.alias("_last"),
    )
    own = F.col("_own").isNotNull()
    return (
        parts.join(closing, ["session_id", "segment", "run"], "left")
        .where((F.col("_chunks") > 0) | F.col("closed_by").isin(*K.READY_TYPES))
        .where(~own | (F.col("part") == F.col("_last")))
        .select(
            "session_id", "segment", "run", "part", F.coalesce("step", "_closing_step").alias("step"), "closed_by",
            F.when(own, F.col("_own")).otherwise(F.coalesce("_text", F.lit(""))).alias("text"),
        )
    )


def stream_progress(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Progress after each event that changes it: the k-th non-empty chunk of a
    segment gives min(5 + 3k, 92), a step change 0, a ready event 100."""
    starts, ready = _starts_segment(), F.col("type").isin(*K.READY_TYPES)
    chunk = F.col("type").isin(*K.STREAM_TYPES) & (F.col("content") != "")
    used = events.where(starts | ready | chunk | is_terminal()).select(
        "session_id", "seq", "type", _flag(chunk).alias("_chunk"), _flag(starts).alias("_starts")
    )
    hot = hot_keys(used, ["session_id"], hot_rows)
    log = prefix(
        used, ["session_id"], "seq",
        {"_ended": ("sum", _flag(is_terminal())), "_segment": ("sum", F.col("_starts"))}, hot_rows, hot,
    ).where((F.col("_ended") == 0) & ~is_terminal())
    counted = prefix(log, ["session_id", "_segment"], "seq", {"_chunks": ("sum", F.col("_chunk"))}, hot_rows, hot)
    streamed = F.least(
        F.lit(K.PROGRESS_START) + F.lit(K.PROGRESS_STEP) * (F.col("_chunks") + 1), F.lit(K.PROGRESS_CAP)
    )
    return counted.select(
        "session_id",
        "seq",
        "type",
        F.when(F.col("_starts") == 1, 0)
        .when(F.col("_chunk") == 1, streamed)
        .otherwise(K.PROGRESS_READY)
        .cast("bigint")
        .alias("progress"),
    )


def status_aggregates() -> list[Column]:
    """Aggregates from which the status follows; the same in batch and stream.

    The first terminal event decides if there is one (nothing applies after
    it), otherwise the last event that sets a step.
    """
    step = F.when(~is_terminal(), step_set_by())
    return [
        F.min_by(F.struct("type", "message"), F.when(is_terminal(), F.col("seq"))).alias("_end"),
        F.max_by(step, F.when(step.isNotNull(), F.col("seq"))).alias("_step"),
    ]


def status_columns() -> list[Column]:
    failed = F.col("_end.type") == "error"
    return [
        F.coalesce(lookup(F.col("_end.type"), K.TERMINAL_STEP), "_step", F.lit("upload")).alias("step"),
        F.when(failed, F.coalesce("_end.message", F.lit(K.DEFAULT_ERROR))).alias("error"),
    ]


def status_reduce(events: DataFrame) -> DataFrame:
    """Current step and error of each session(session_id, seq, type, step, message)."""
    return events.groupBy("session_id").agg(*status_aggregates()).select("session_id", *status_columns())


def idle_heartbeat(
    events: DataFrame, idle_seconds: int = K.HEARTBEAT_SECONDS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Gaps of at least ``idle_seconds`` before an event, with the number of
    heartbeats a reader got meanwhile; after the first terminal event none is sent.
    Events without a ``type`` column have no terminal one."""
    ends = _flag(is_terminal()) if "type" in events.columns else F.lit(0).cast("bigint")
    arrivals = events.select("session_id", "seq", micros(events, "ts").alias("_us"), ends.alias("_end"))
    measures = {"_last": ("max", F.struct("seq", "_us")), "_ended": ("sum", F.col("_end"))}
    log = prefix(arrivals, ["session_id"], "seq", measures, hot_rows)
    return (
        log.where(F.col("_ended") == 0).withColumn("gap_us", F.col("_us") - F.col("_last._us"))
        .withColumn("heartbeats", F.floor(F.col("gap_us") / (idle_seconds * 1_000_000)))
        .where(F.col("heartbeats") > 0)
        .select("session_id", "seq", "gap_us", "heartbeats")
    )


def step_flags(status: DataFrame) -> DataFrame:
    """Seven rows per session: complete, current or pending per step."""
    last = len(K.STEP_ORDER) - 1
    position = F.coalesce(
        F.nullif(F.array_position(F.array(*[F.lit(s) for s in K.STEP_ORDER]), F.col("step")), F.lit(0)) - 1,
        F.lit(-1),
    )
    steps = F.array(
        *[F.struct(F.lit(s).alias("flag_step"), F.lit(i).alias("idx")) for i, s in enumerate(K.STEP_ORDER)]
    )
    here = F.col("idx") == F.col("current_idx")
    return (
        status.select("session_id", position.cast("int").alias("current_idx"), F.inline(steps))
        .select(
            "session_id",
            F.col("flag_step").alias("step"),
            "idx",
            ((F.col("idx") < F.col("current_idx")) | (here & (F.col("idx") == last))).alias("is_complete"),
            (here & (F.col("idx") != last)).alias("is_current"),
            (F.col("idx") > F.col("current_idx")).alias("is_pending"),
        )
    )


def step_funnel(status: DataFrame) -> DataFrame:
    """Sessions that completed, are at, or have yet to reach each step."""
    return step_flags(status).groupBy("step", "idx").agg(
        F.count_if("is_complete").alias("completed"),
        F.count_if("is_current").alias("current"),
        F.count_if("is_pending").alias("pending"),
    )
