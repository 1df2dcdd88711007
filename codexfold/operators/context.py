"""Context documents attached to a session before its first review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexfold.constants import CONTEXT_HEAD, CONTEXT_TAIL
from codexfold.functions.prefix import PART_CHARS, ordered_text, prefix
from codexfold.functions.skew import HOT_ROWS, hot_keys, lookup_join
from codexfold.functions.text import is_blank, lossy_utf8, suffix

DECODER_SUFFIXES = (".pdf", ".docx", ".doc")


def _json_indented(name: Column, text: Column) -> Column:
    """Re-serialise JSON with key order kept and non-ASCII escaped.

    ``to_json(parse_json())`` sorts keys, so this goes through an Arrow UDF;
    only ``.json`` rows reach it.
    """

    @F.pandas_udf(T.StringType())
    def indented(names, texts):
        import json

        import pandas as pd

        def one(file_name, raw):
            if raw is None:
                return None
            try:
                # ensure_ascii leaves lone surrogates as escapes, so the text stays valid
                return json.dumps(json.loads(raw), indent=2)
            except Exception as problem:
                return f"[Could not extract text from {file_name}: {problem}]"

        return pd.Series([one(n, t) for n, t in zip(names, texts)], dtype=object)

    return indented(name, text)


def context_text(context_files: DataFrame) -> DataFrame:
    """Text and status per context file (name, content BINARY, ...).

    ``.json`` is parsed and re-serialised, PDF and Word rows get the status
    ``needs_decoder`` and no text, everything else (images too) is decoded
    lossily. A failed parse is text itself, with status ``failed``.
    """
    kind, decoded = suffix(F.col("name")), lossy_utf8(F.col("content"))
    keyed = context_files.withColumn("suffix", kind)
    json_text = F.when(kind == ".json", decoded)
    return (
        keyed.withColumn("_json", _json_indented(F.col("name"), json_text))
        .withColumn(
            "text",
            F.when(F.col("suffix").isin(*DECODER_SUFFIXES), F.lit(None).cast("string"))
            .when(F.col("suffix") == ".json", F.col("_json"))
            .otherwise(decoded),
        )
        .withColumn(
            "status",
            F.when(F.col("suffix").isin(*DECODER_SUFFIXES), "needs_decoder")
            .when(
                (F.col("suffix") == ".json")
                & F.startswith(
                    F.col("_json"),
                    F.concat(F.lit("[Could not extract text from "), F.col("name"), F.lit(": ")),
                ),
                "failed",
            )
            .otherwise("extracted"),
        )
        .drop("_json", "content")
    )


def context_status_report(texts: DataFrame) -> DataFrame:
    return texts.groupBy("suffix", "status").agg(F.count(F.lit(1)).alias("files"))


def context_accumulate(
    texts: DataFrame, part_chars: int = PART_CHARS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Additional context per session in arrival order.

    Blank texts are skipped. A session whose context exceeds ``part_chars``
    continues in further rows (``part`` 0, 1, ...), so no task ever holds an
    unbounded group and nothing is cut; the parts concatenate to the value.
    """
    kept = texts.where(~is_blank(F.col("text"))).withColumn(
        "_piece", F.concat(F.lit(CONTEXT_HEAD), F.col("name"), F.lit(CONTEXT_TAIL), F.col("text"))
    )
    placed = prefix(
        kept, ["session_id"], "seq", {"_before": ("sum", F.length("_piece").cast("bigint"))},
        hot=hot_keys(texts, ["session_id"], hot_rows), hot_rows=hot_rows,
    )
    return (
        placed.groupBy("session_id", F.floor(F.col("_before") / part_chars).alias("part"))
        .agg(
            ordered_text("seq", "_piece").alias("additional_context"),
            F.count(F.lit(1)).alias("files_added"),
            F.expr("listagg(name, ',') WITHIN GROUP (ORDER BY seq)").alias("filenames"),
        )
    )


def context_before_gate(
    context_files: DataFrame, confirms: DataFrame, sessions: DataFrame
) -> DataFrame:
    """Accept a context upload only for a known session whose first
    confirmation (confirms: session_id, seq) has not happened yet."""
    gates = (
        sessions.select("session_id", F.lit(True).alias("_known"), F.lit(None).cast("bigint").alias("seq"))
        .unionByName(confirms.select("session_id", F.lit(None).cast("boolean").alias("_known"), "seq"))
        .groupBy("session_id")
        .agg(F.max("_known").alias("_known"), F.min("seq").alias("_gate"))
    )
    reason = (
        F.when(F.col("_known").isNull(), "unknown session")
        .when(F.col("_gate") < F.col("seq"), "already confirmed")
    )
    return (
        lookup_join(context_files, gates, ["session_id"], F.col("seq"))
        .withColumn("reason", reason)
        .withColumn("accepted", F.col("reason").isNull())
        .drop("_known", "_gate")
    )
