"""The whole way from uploads to generated files, as batch steps over many
sessions. The model that answers the messages is outside: messages leave as a
table, answers come back as a table (session_id, seq, text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexfold.constants import EMPTY_DIGEST, PACK_BUDGET
from codexfold.functions.text import is_blank, lossy_utf8
from codexfold.operators import context, documents, intake, packing, session
from codexfold.sources.archives import pack_archives


def upload_sessions(uploads: DataFrame, budget: int = PACK_BUDGET) -> DataFrame:
    """Sessions of uploads(upload_id, name, pattern, content BINARY).

    Columns: session_id, pattern, target_lang, source_code, files_found, reason;
    ``reason`` is NULL for accepted uploads. Archives never leave their task
    whole: the reader emits the packed entries only, and one shuffle by archive
    concatenates them.
    """
    checked = intake.loose_file_intake(intake.pattern_validate(uploads))
    archives = checked.where((F.col("kind") == "archive") & F.col("valid")).select(
        F.col("upload_id").cast("string").alias("repo_id"), "content"
    )
    packed = pack_archives(archives, budget).withColumn("content", lossy_utf8(F.col("content")))
    digests = packing.marker_count(packing.repo_digest(packed)).select(
        F.col("repo_id").cast("bigint").alias("upload_id"), "digest", F.col("files_found").alias("_found")
    )
    source = F.coalesce("text", "digest", F.lit(EMPTY_DIGEST))
    return (
        checked.drop("content").join(digests, "upload_id", "left")
        .withColumn("source_code", source)
        .select(
            F.col("upload_id").alias("session_id"),
            "pattern",
            "target_lang",
            "source_code",
            F.coalesce("files_found", "_found", F.lit(0)).alias("files_found"),
            F.when(~F.col("valid"), "unknown pattern")
            .when(is_blank(F.col("source_code")) | (F.col("source_code") == EMPTY_DIGEST), "no readable source files")
            .alias("reason"),
        )
    )


def analysis_messages(sessions: DataFrame) -> DataFrame:
    accepted = sessions.where(F.col("reason").isNull()).withColumn("digest", F.col("source_code"))
    return packing.analysis_message(accepted).select("session_id", "pattern", "message")


def analysis_deltas(answers: DataFrame) -> DataFrame:
    """The answer itself under ``analysis``, then its brd and technical_spec."""
    parts = documents.section_split(answers, ["session_id", "seq"]).where(F.col("section") != "analysis")
    raw = answers.select("session_id", "seq", F.lit("analysis").alias("key"), F.col("text").alias("value"))
    return raw.unionByName(
        parts.select("session_id", "seq", F.col("section").alias("key"), F.col("text").alias("value"))
    )


def answer_deltas(answers: DataFrame, key: str) -> DataFrame:
    """Deltas of a plan (key ``plan``) or code (``generated_code_raw``) answer."""
    return answers.select("session_id", "seq", F.lit(key).alias("key"), F.col("text").alias("value"))


def context_deltas(context_files: DataFrame, confirms: DataFrame, sessions: DataFrame) -> DataFrame:
    """``additional_context`` of each session from the uploads accepted before its first
    confirmation, at the number of the last of them. The first part of the text is
    enough: messages read far less of it."""
    accepted = context.context_before_gate(context_files, confirms, sessions).where("accepted")
    texts = context.context_text(accepted.drop("accepted", "reason"))
    last = texts.where(~is_blank(F.col("text"))).groupBy("session_id").agg(F.max("seq").alias("seq"))  # blank ones write nothing
    whole = context.context_accumulate(texts).where("part = 0").select("session_id", "additional_context")
    return whole.join(last, "session_id").select(
        "session_id", "seq", F.lit("additional_context").alias("key"), F.col("additional_context").alias("value")
    )


def reviewed_deltas(deltas: DataFrame, reviews: DataFrame, keep_edit: bool = False) -> DataFrame:
    """``deltas`` and what the reviews of their documents write."""
    log = deltas.select("session_id", "seq", "key", "value")
    writes = session.review_writes(reviews, log, keep_edit)
    return log.unionByName(writes.drop("stage"))


def stage_messages(
    sessions: DataFrame, deltas: DataFrame, stage_starts: DataFrame, stage: str
) -> DataFrame:
    """Messages of the ``plan`` or ``code`` stage from the state as of its start."""
    started = stage_starts.where(F.col("stage") == stage)
    seen = session.state_as_of(deltas, started).select(
        "session_id", F.lit(0).cast("bigint").alias("seq"), "key", "value"
    )
    begun = sessions.join(started.select("session_id").distinct(), "session_id", "left_semi")
    state = session.state_fold(seen, begun)
    build = packing.plan_message if stage == "plan" else packing.code_message
    return build(state).select("session_id", "message")


def generated_files(answers: DataFrame, sessions: DataFrame) -> DataFrame:
    """Files of the code answers (one per session), with the session's pattern."""
    docs = answers.join(sessions.select("session_id", "pattern", "target_lang"), "session_id")
    return documents.fenced_files(docs, ["session_id", "pattern"])
