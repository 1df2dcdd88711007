"""Review gates of sessions that may wait for any time.

State is kept per gate, not per interval: a confirmation counts however late it comes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexfold.operators import session
from codexfold.streaming.stateful import LATENESS, ContextGate, in_order


def pending_review_stream(ready: DataFrame, confirms: DataFrame) -> DataFrame:
    """``session.pending_review`` in update mode: a gate's row comes when it opens and
    again when it is confirmed. A union and one aggregate; two numbers of state a gate."""
    return session.pending_review(ready, confirms)


def context_gate_stream(
    context_files: DataFrame, confirms: DataFrame, sessions: DataFrame, lateness: str = LATENESS, **settings
) -> DataFrame:
    """Context uploads (session_id, seq, name, ts) with whether their session is known (a
    static table) and not confirmed before them: confirms(session_id, seq, ts). Once
    confirmed, a session's gate stays closed."""
    none = F.lit(None)
    uploads = context_files.select("session_id", "seq", "ts", F.lit("context").alias("type"), "name").join(
        sessions.select("session_id", F.lit(True).alias("known")), "session_id", "left"
    )
    closing = confirms.select(
        "session_id", "seq", "ts", F.lit("confirm").alias("type"), none.cast("string").alias("name"), none.cast("boolean").alias("known")
    )
    return in_order(uploads.unionByName(closing), ContextGate(**settings), lateness=lateness)
