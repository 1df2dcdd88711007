"""Sinks: markdown artifacts and code archives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexfold.functions.prefix import prefix
from codexfold.functions.skew import HOT_ROWS
from codexfold.functions.text import head

ARTIFACT_KINDS = ("brd", "plan")
ARCHIVE_PART_BYTES = 256 * 1024 * 1024
EMIT_BYTES = 16 * 1024 * 1024
ENTRY_BYTES = 76  # fixed part of an entry's two headers, so empty files count too


def artifact_export(state: DataFrame) -> DataFrame:
    """One markdown artifact per session and kind; empty ones are left out."""
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("content")) for k in ARTIFACT_KINDS])
    return (
        state.select("session_id", F.inline(rows))
        .where(F.col("content") != "")
        .select(
            "session_id",
            "kind",
            F.concat("kind", F.lit("-"), head(F.col("session_id").cast("string"), 8), F.lit(".md")).alias("filename"),
            "content",
        )
    )


def write_artifacts(artifacts: DataFrame, location: str) -> None:
    artifacts.write.mode("overwrite").partitionBy("kind").parquet(location)


def code_archive_export(
    files: DataFrame, part_bytes: int = ARCHIVE_PART_BYTES, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Deflated ZIP of each session's files (session_id, pattern, ord, path, content).

    Paths and duplicates are kept in order. A session with more than
    ``part_bytes`` of text continues in further archives (part 1, 2, ...), so a
    task builds one bounded archive at a time and no file is left out. Session ids
    keep the type they come with.
    """
    size = (F.octet_length("content") + 2 * F.octet_length("path") + ENTRY_BYTES).cast("bigint")
    placed = prefix(files, ["session_id"], "ord", {"_before": ("sum", size)}, hot_rows).withColumn(
        "part", F.floor(F.col("_before") / part_bytes)
    )

    columns = ["session_id", "part", "pattern", "path", "content"]

    emit_bytes, id_kind = EMIT_BYTES, dict(files.dtypes)["session_id"]

    def build(batches):
        """Rows arrive sorted, so one archive at a time is open; finished ones
        leave in batches of bounded size."""
        import io
        import zipfile

        import pyarrow as pa

        rest = [("part", pa.int64()), ("filename", pa.string()), ("files", pa.int64()), ("zip", pa.binary())]
        key, done, size = None, [], 0

        def close():
            archive.close()
            ending = "-migrated.zip" if key[1] == 0 else f"-migrated.{key[1]}.zip"
            done.append((*key, slug + ending, count, buffer.getvalue()))
            return len(done[-1][-1])

        def flush():
            schema = pa.schema([("session_id", id_type), *rest])
            columns = [pa.array(c, f.type) for c, f in zip(zip(*done), schema)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            id_type = batch.column("session_id").type
            rows = zip(*(batch.column(c).to_pylist() for c in columns))
            for session_id, part, pattern, path, content in rows:
                if (session_id, part) != key:
                    if key is not None:
                        size += close()
                        if size >= emit_bytes:
                            yield flush()
                            size = 0
                    key, slug, count = (session_id, part), pattern.replace("/", "-"), 0
                    buffer = io.BytesIO()
                    archive = zipfile.ZipFile(buffer, "w")
                archive.writestr(zipfile.ZipInfo(path), content, zipfile.ZIP_DEFLATED)
                count += 1
        if key is not None:
            close()
            yield flush()

    return (
        placed.withColumn("pattern", F.coalesce("pattern", F.lit("migration")))
        .repartition("session_id", "part")
        .sortWithinPartitions("session_id", "part", "ord")
        .select(*columns)
        .mapInArrow(build, f"session_id {id_kind}, part bigint, filename string, files bigint, zip binary")
    )
