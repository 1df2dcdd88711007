"""Framing, budgeted packing and the stage messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexfold import constants as K
from codexfold.functions.prefix import BLOCK_ROWS, block_of, ordered_text
from codexfold.functions.text import head, is_blank

FILTER_WORDS = 1 << 18  # 2 MB of bits


def frame(path: Column, content: Column) -> Column:
    return F.concat(F.lit(K.FRAME_HEAD), path, F.lit(K.FRAME_TAIL), content)


def frame_length(path: Column, content_chars: Column) -> Column:
    fixed = len(K.FRAME_HEAD) + len(K.FRAME_TAIL)
    return (F.length(path) + content_chars + F.lit(fixed)).cast("bigint")


def file_frame(files: DataFrame) -> DataFrame:
    return files.withColumn("chunk", frame(F.col("path"), F.col("content")))


def pack_budget(
    files: DataFrame,
    budget: int = K.PACK_BUDGET,
    block: int = BLOCK_ROWS,
    chars: str | None = None,
    filter_words: int = FILTER_WORDS,
) -> DataFrame:
    """Files kept while the running framed length stays within ``budget``.

    Stopping at the first overflow equals ``running total <= budget`` because
    every chunk has a positive length; ``ord`` is unique within a repository. The
    cut is made on numbers alone: lengths are added up per block of consecutive
    ``ord`` (combined on the map side), blocks that start at or beyond the budget
    are dropped, and the rest are windowed row by row. Only then does the text
    move, and only of rows that a Bloom filter over the kept (repository, ord)
    lets through: ``filter_words`` rows of 64 bits at most, whatever the corpus,
    so it is sent to every task. What it lets through by mistake the exact join
    removes; once far more files are kept than it has bits it lets everything
    through, and a larger ``filter_words`` is worth its memory. ``chars`` names a
    stored column equal to ``length(content)``: with it the cut does not read the
    text at all.
    """
    content_chars = F.length("content") if chars is None else F.col(chars)
    sized = files.select(
        "repo_id", "ord", block_of("ord", block).alias("_block"),
        frame_length(F.col("path"), content_chars).alias("chunk_chars"),
    )

    before = (
        Window.partitionBy("repo_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    live = (
        sized.groupBy("repo_id", "_block").agg(F.sum("chunk_chars").alias("_chars"))
        .withColumn("_before", F.coalesce(F.sum("_chars").over(before), F.lit(0)))
        .where(F.col("_before") < budget)
        .select("repo_id", "_block", "_before")
    )

    within = (
        Window.partitionBy("repo_id", "_block").orderBy("ord")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    cut = (
        sized.join(live, ["repo_id", "_block"])
        .withColumn("running_chars", F.col("_before") + F.sum("chunk_chars").over(within))
        .where(F.col("running_chars") <= budget)
        .select("repo_id", "ord", "chunk_chars", "running_chars")
    )

    name = F.xxhash64("repo_id", "ord")
    word, bit = F.pmod(F.shiftrightunsigned(name, 6), F.lit(filter_words)), name.bitwiseAND(63).cast("int")
    words = (
        cut.groupBy(word.alias("_word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("_bits"))
    )
    marked = files.withColumns({"_word": word, "_bit": bit})
    likely = (
        marked.join(F.broadcast(words), "_word")
        .where(F.call_function("getbit", F.col("_bits"), F.col("_bit")) == 1)
        .drop("_word", "_bits", "_bit")
    )
    return likely.join(cut, ["repo_id", "ord"])


def repo_digest(packed: DataFrame) -> DataFrame:
    """One digest per repository; a group is bounded by the packing budget."""
    return (
        file_frame(packed)
        .groupBy("repo_id")
        .agg(ordered_text("ord", "chunk").alias("digest"), F.count(F.lit(1)).alias("files_packed"))
    )


def marker_count(digests: DataFrame) -> DataFrame:
    """Reported file count: markers in the digest, which over-counts when a
    file's own text holds the marker."""
    return digests.withColumn(
        "files_found", F.regexp_count("digest", F.lit(K.FRAME_MARKER)).cast("bigint")
    )


def analysis_message(digests: DataFrame) -> DataFrame:
    """Reverse-engineering message from the column ``digest``."""
    return digests.withColumn(
        "message",
        F.concat(F.lit(K.ANALYSIS_LEAD), head(F.col("digest"), K.ANALYSIS_SOURCE_CHARS)),
    )


def _optional(lead: str, text: Column, chars: int) -> Column:
    """Lead and slice when the text is not blank, else NULL."""
    return F.when(~is_blank(text), F.concat(F.lit(lead), head(text, chars)))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def plan_message(state: DataFrame) -> DataFrame:
    """Plan message from brd, technical_spec and additional_context."""
    return state.withColumn(
        "message",
        F.concat(
            F.lit(K.PLAN_LEAD),
            head(_text("brd"), K.PLAN_BRD_CHARS),
            F.coalesce(
                _optional(K.PLAN_SPEC_LEAD, _text("technical_spec"), K.PLAN_SPEC_CHARS), F.lit("")
            ),
            F.coalesce(
                _optional(K.PLAN_CONTEXT_LEAD, _text("additional_context"), K.PLAN_CONTEXT_CHARS),
                F.lit(""),
            ),
        ),
    )


def code_message(state: DataFrame) -> DataFrame:
    """Code message; brd, specification and context only when not blank, plan
    and source always (``concat_ws`` skips the NULL ones)."""
    return state.withColumn(
        "message",
        F.concat_ws(
            "\n\n",
            F.lit(K.CODE_LEAD),
            _optional(K.CODE_BRD_LEAD, _text("brd"), K.CODE_BRD_CHARS),
            _optional(K.CODE_SPEC_LEAD, _text("technical_spec"), K.CODE_SPEC_CHARS),
            _optional(K.CODE_CONTEXT_LEAD, _text("additional_context"), K.CODE_CONTEXT_CHARS),
            F.concat(F.lit(K.CODE_PLAN_LEAD), head(_text("plan"), K.CODE_PLAN_CHARS)),
            F.concat(F.lit(K.CODE_SOURCE_LEAD), head(_text("source_code"), K.CODE_SOURCE_CHARS)),
        ),
    )
