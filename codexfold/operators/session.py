"""Session state: append-only deltas folded by key, review patches, as-of reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexfold.constants import FEEDBACK_LEAD, SESSION_DEFAULTS
from codexfold.functions.clock import micros
from codexfold.functions.prefix import PART_CHARS, ordered_text, prefix
from codexfold.functions.skew import HOT_ROWS, hot_keys, lookup_join
from codexfold.functions.text import nonempty

STATE_KEYS = tuple(SESSION_DEFAULTS)
STAGES = ("plan", "code")
FILES_TYPE = "array<struct<path:string,content:string,language:string>>"


def _default(key: str) -> Column:
    return F.col(key) if SESSION_DEFAULTS[key] is None else F.lit(SESSION_DEFAULTS[key])


def state_defaults(sessions: DataFrame) -> DataFrame:
    """The ten initial deltas (seq 0) of sessions(session_id, pattern, source_code)."""
    rows = F.array(
        *[F.struct(F.lit(k).alias("key"), _default(k).alias("value")) for k in STATE_KEYS]
    )
    return sessions.select(
        "session_id", F.lit(0).cast("bigint").alias("seq"), F.inline(rows)
    )


def state_fold(deltas: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row per known session, one column per key, the last delta winning.

    Sessions join the aggregate as marker rows, so unknown sessions drop out
    without a join and every hot session is reduced on the map side.
    """
    initial = [k for k in STATE_KEYS if SESSION_DEFAULTS[k] is None]
    marked = sessions.select(
        "session_id",
        F.lit(True).alias("_known"),
        *[F.col(k).alias(f"_{k}") for k in initial],
    )
    log = deltas.select("session_id", "seq", "key", "value")
    folded = (
        log.unionByName(marked, allowMissingColumns=True)
        .groupBy("session_id")
        .agg(
            F.max("_known").alias("_known"),
            *[F.max(f"_{k}").alias(f"_{k}") for k in initial],
            *[F.max_by("value", F.when(F.col("key") == k, F.col("seq"))).alias(k) for k in STATE_KEYS],
        )
        .where("_known")
    )
    return folded.select(
        "session_id",
        *[
            F.coalesce(k, F.col(f"_{k}") if k in initial else F.lit(SESSION_DEFAULTS[k])).alias(k)
            for k in STATE_KEYS
        ],
    )


def _has_feedback() -> Column:
    return F.coalesce(F.col("feedback") != "", F.lit(False))


def review_deltas(reviews: DataFrame, keep_edit: bool = False) -> DataFrame:
    """What each confirmation does: (session_id, stage, seq, key, op, text).

    ``set`` replaces a document, ``append`` adds to it. Content sets; non-empty
    feedback appends to the document *stored before this request*, so an edit
    sent along with feedback is lost (``keep_edit=True`` keeps it). The first
    stage's specification edit is a ``set`` of its own and survives feedback.
    Appends keep the log linear: no delta repeats the whole document.
    """
    note = F.when(_has_feedback(), F.concat(F.lit(FEEDBACK_LEAD), F.col("feedback")))
    edited = F.col("content").isNotNull()
    edits = edited if keep_edit else edited & ~_has_feedback()
    text = F.concat(F.when(edits, F.col("content")).otherwise(""), F.coalesce(note, F.lit("")))
    rows = F.array(
        F.struct(
            F.col("stage").alias("key"),
            F.when(edits, "set").when(_has_feedback(), "append").alias("op"),
            text.alias("text"),
        ),
        F.struct(
            F.lit("technical_spec").alias("key"),
            F.when((F.col("stage") == "brd") & F.col("tech").isNotNull(), "set").alias("op"),
            F.col("tech").alias("text"),
        ),
    )
    return reviews.select("session_id", "stage", "seq", F.inline(rows)).where(F.col("op").isNotNull())


def review_patch(
    reviews: DataFrame,
    stored: DataFrame | None = None,
    keep_edit: bool = False,
    part_chars: int = PART_CHARS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Documents after all reviews: (session_id, stage, part, value).

    A session's deltas fold into "last set, then every later append in order",
    so no loop per session is needed: the last set is a maximum, everything
    before it is dropped, the rest is concatenated. ``stored`` (session_id,
    stage, value) is the document before the first review; values longer than
    ``part_chars`` continue in further parts.
    """
    pieces = review_deltas(reviews, keep_edit).where(F.col("key") == F.col("stage")).drop("key")
    if stored is not None:
        pieces = pieces.unionByName(
            stored.select(
                "session_id", "stage", F.lit(-1).cast("bigint").alias("seq"),
                F.lit("set").alias("op"), F.col("value").alias("text"),
            )
        )
    last = pieces.where(F.col("op") == "set").groupBy("session_id", "stage").agg(F.max("seq").alias("_from"))
    live = (
        lookup_join(pieces, last, ["session_id", "stage"], F.col("seq"), hot_rows=hot_rows)
        .where(F.col("_from").isNull() | (F.col("seq") >= F.col("_from")))
        .drop("_from")
    )
    placed = prefix(
        live, ["session_id", "stage"], "seq", {"_before": ("sum", F.length("text").cast("bigint"))},
        hot=hot_keys(reviews, ["session_id", "stage"], hot_rows), hot_rows=hot_rows,
    )
    return placed.groupBy(
        "session_id", "stage", F.floor(F.col("_before") / part_chars).alias("part")
    ).agg(ordered_text("seq", "text").alias("value"))


def review_writes(
    reviews: DataFrame, log: DataFrame | None = None, keep_edit: bool = False, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The deltas that reviews write: (session_id, stage, seq, key, value), every value a whole document.

    ``log`` (session_id, seq, key, value) has the other writes to the documents, such as
    the stored ones and the answers reviewed; of the same ``seq``, they come first. A
    document is what was set last with all later appends, so its rows fall into runs that
    start with a set, and a value is the concatenation of its run up to its own row. The
    starts of runs are a running maximum that splits hot sessions; only runs are sorted whole.
    """
    ops = review_deltas(reviews, keep_edit)
    pieces = ops.where(F.col("key") == F.col("stage")).select(
        "session_id", "stage", (2 * F.col("seq") + 1).alias("_at"), "op", "text", F.lit(True).alias("_review")
    )
    if log is not None:
        reviewed = F.col("key").isin("brd", "plan")
        pieces = pieces.unionByName(log.where(reviewed).select(
            "session_id", F.col("key").alias("stage"), (2 * F.col("seq")).alias("_at"), F.lit("set").alias("op"),
            F.coalesce("value", F.lit("")).alias("text"), F.lit(False).alias("_review"),
        ))
    start = F.when(F.col("op") == "set", F.col("_at"))
    placed = prefix(pieces, ["session_id", "stage"], "_at", {"_before": ("max", start)}, hot_rows).withColumn("_run", F.coalesce(start, "_before"))
    so_far = Window.partitionBy("session_id", "stage", "_run").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    documents = placed.withColumn("value", F.array_join(F.collect_list("text").over(so_far), "")).where("_review").select(
        "session_id", "stage", ((F.col("_at") - 1) / 2).cast("bigint").alias("seq"), F.col("stage").alias("key"), "value"
    )
    others = ops.where(F.col("key") != F.col("stage")).select("session_id", "stage", "seq", "key", F.col("text").alias("value"))
    return documents.unionByName(others)


def review_spec(reviews: DataFrame) -> DataFrame:
    """Last non-NULL specification edit of the first review stage."""
    return (
        reviews.where((F.col("stage") == "brd") & F.col("tech").isNotNull())
        .groupBy("session_id")
        .agg(F.max_by("tech", "seq").alias("technical_spec"))
    )


def state_as_of(deltas: DataFrame, stage_starts: DataFrame) -> DataFrame:
    """State each stage reads: last value per key with ``seq`` up to its start.

    A session starts each of its two reading stages once, so starts become two
    columns; deltas meet them in a salted lookup and one conditional aggregate
    gives all stages at once, without a pair per (delta, stage).
    """
    starts = stage_starts.groupBy("session_id").agg(
        *[F.min(F.when(F.col("stage") == s, F.col("seq"))).alias(f"_{s}") for s in STAGES]
    )
    seen = lookup_join(
        deltas.select("session_id", "seq", "key", "value"), starts, ["session_id"], F.col("seq"), "inner"
    )
    wide = seen.groupBy("session_id", "key").agg(
        *[
            F.max_by(F.struct("value"), F.when(F.col("seq") <= F.col(f"_{s}"), F.col("seq"))).alias(s)
            for s in STAGES
        ]
    )
    rows = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("_seen")) for s in STAGES])
    return (
        wide.select("session_id", "key", F.inline(rows))
        .where(F.col("_seen").isNotNull())
        .select("session_id", "stage", "key", F.col("_seen.value").alias("value"))
    )


def pending_review(ready: DataFrame, confirms: DataFrame) -> DataFrame:
    """Per (session, stage) that became ready: waiting or waited seconds.

    Both logs have (session_id, stage, ts). Gates are one-shot, so only the
    first of each counts; a union and one aggregate replace the join.
    """
    none = F.lit(None).cast("bigint")
    log = ready.select(
        "session_id", "stage", micros(ready, "ts").alias("_ready"), none.alias("_confirm")
    ).unionByName(
        confirms.select("session_id", "stage", none.alias("_ready"), micros(confirms, "ts").alias("_confirm"))
    )
    gate = log.groupBy("session_id", "stage").agg(
        F.min("_ready").alias("_ready"), F.min("_confirm").alias("_confirm")
    )
    # A gate set before the session reaches it lets it through at once.
    waited = F.greatest(F.col("_confirm") - F.col("_ready"), F.lit(0))
    return gate.where(F.col("_ready").isNotNull()).select(
        "session_id",
        "stage",
        F.when(F.col("_confirm").isNull(), "waiting").otherwise("confirmed").alias("status"),
        F.when(F.col("_confirm").isNotNull(), waited).alias("waited_us"),
    )


def session_snapshot(state: DataFrame) -> DataFrame:
    """pattern, brd or NULL, plan or NULL, parsed files of each session."""
    return state.select(
        "session_id",
        "pattern",
        nonempty(F.col("brd")).alias("brd"),
        nonempty(F.col("plan")).alias("plan"),
        F.from_json("generated_files_json", FILES_TYPE).alias("generated_files"),
    )
