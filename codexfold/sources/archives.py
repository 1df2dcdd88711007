"""Archive source: one ZIP per row in, one row per entry out.

Spark distributes the archives (``binaryFile`` packs at most
``spark.sql.files.maxPartitionBytes`` of them into a task); only the ZIP codec
runs in Python, one archive at a time, and rows leave as they are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codexfold.constants import FRAME_HEAD, FRAME_TAIL, PACK_BUDGET, SOURCE_SUFFIXES, VENDORED_DIRS

ENTRY_SCHEMA = "repo_id string, ord bigint, path string, content binary"
EMIT_BYTES = 16 * 1024 * 1024
INFLATE_BYTES = 1024 * 1024


def read_archives(spark: SparkSession, location: str) -> DataFrame:
    """``binaryFile`` scan of a folder of ZIP files: repo_id, content."""
    scan = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(location)
    return scan.selectExpr("path AS repo_id", "content")


def archive_explode(
    archives: DataFrame,
    source_only: bool = False,
    budget: int | None = None,
) -> DataFrame:
    """Entries of each archive (repo_id, content) in archive order.

    Directories are left out. An entry that cannot be read is skipped and the
    others go on; an archive that is no ZIP gives no rows, so it shows up among
    the rejected repositories. ``source_only`` applies the suffix and folder
    filters before an entry is inflated. With ``budget`` the reader stops at
    the first entry whose framed text overflows it, the same rule as
    ``pack_budget``, so the rest of a huge archive is never inflated; an entry is
    inflated in chunks of ``INFLATE_BYTES`` and held up to the budget only.
    """
    suffixes, vendored = frozenset(SOURCE_SUFFIXES), frozenset(VENDORED_DIRS)
    frame = len(FRAME_HEAD) + len(FRAME_TAIL)
    emit_bytes, inflate_bytes = EMIT_BYTES, INFLATE_BYTES

    def wanted(name):
        from pathlib import PurePosixPath

        path = PurePosixPath(name)
        return path.suffix.lower() in suffixes and not vendored.intersection(path.parts)

    def entries(blob):
        import io
        import zipfile

        try:
            archive = zipfile.ZipFile(io.BytesIO(blob))
        except Exception:
            return
        used = 0
        with archive:
            for position, info in enumerate(archive.infolist()):
                if info.is_dir() or (source_only and not wanted(info.filename)):
                    continue
                left = None if budget is None else budget - used - frame - len(info.filename)
                try:
                    data, chars = inflated(archive, info, left)
                except Exception:
                    continue
                if data is None:
                    return
                used += frame + len(info.filename) + chars
                yield position, info.filename, data

    def inflated(archive, info, left):
        """Bytes and characters of an entry, (None, 0) if it has more than ``left``
        characters: then no more than these are held, and the rest is only read
        through, since an entry that turns out damaged does not end the archive."""
        import codecs

        pieces, chars, decoder = [], 0, codecs.getincrementaldecoder("utf-8")("replace")
        with archive.open(info) as entry:
            while piece := entry.read(inflate_bytes):
                if left is not None:
                    chars += len(decoder.decode(piece))
                    if chars > left:
                        pieces = None
                if pieces is not None:
                    pieces.append(piece)
        if left is not None:
            chars += len(decoder.decode(b"", True))
            if chars > left:
                pieces = None
        return (None, 0) if pieces is None else (b"".join(pieces), chars)

    def explode(batches):
        import pyarrow as pa

        names = ["repo_id", "ord", "path", "content"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.binary()]

        def flush(rows):
            columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            repos, blobs = batch.column("repo_id"), batch.column("content")
            rows, size = [], 0
            for i in range(batch.num_rows):
                if not blobs[i].is_valid:
                    continue
                for position, name, data in entries(blobs[i].as_py()):
                    rows.append((repos[i].as_py(), position, name, data))
                    size += len(data)
                    if size >= emit_bytes:
                        yield flush(rows)
                        rows, size = [], 0
            if rows:
                yield flush(rows)

    return archives.select("repo_id", "content").mapInArrow(explode, ENTRY_SCHEMA)


def pack_archives(archives: DataFrame, budget: int = PACK_BUDGET) -> DataFrame:
    """Source entries that make up each archive's digest (see ``archive_explode``)."""
    return archive_explode(archives, source_only=True, budget=budget)
