"""Intake predicates over uploads and files; all narrow except the counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexfold.constants import (
    EMPTY_DIGEST, SOURCE_SUFFIXES, TARGET_LANGUAGE, UPLOAD_SUFFIXES, VENDORED_DIRS,
)
from codexfold.functions.text import is_blank, lookup, lossy_utf8, suffix


def loose_file_intake(uploads: DataFrame) -> DataFrame:
    """Split uploads(upload_id, name, content): a name ending in exact-case
    ``.zip`` is an archive, everything else is one decoded file of its own."""
    archive = F.coalesce(F.col("name").endswith(".zip"), F.lit(False))
    return uploads.select(
        "*",
        F.when(archive, "archive").otherwise("file").alias("kind"),
        F.when(~archive, lossy_utf8(F.col("content"))).alias("text"),
        F.when(~archive, F.lit(1)).cast("bigint").alias("files_found"),
    )


def has_source_suffix(path: Column) -> Column:
    return suffix(path).isin(*SOURCE_SUFFIXES)


def is_vendored(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in VENDORED_DIRS]))


def extension_filter(files: DataFrame) -> DataFrame:
    return files.where(has_source_suffix(F.col("path")))


def vendored_dir_filter(files: DataFrame) -> DataFrame:
    return files.where(~is_vendored(F.col("path")))


def source_files(files: DataFrame) -> DataFrame:
    """Both path filters, before any content is touched."""
    return vendored_dir_filter(extension_filter(files))


def lossy_utf8_decode(files: DataFrame) -> DataFrame:
    return files.withColumn("content", lossy_utf8(F.col("content")))


def form_accepts(name: Column) -> Column:
    return name.endswith(".zip") | name.rlike(r"\.(" + "|".join(UPLOAD_SUFFIXES) + r")\z")


def upload_gate(uploads: DataFrame) -> DataFrame:
    """Verdict of the upload form per row, and whether the archive filter would
    have judged the same name differently."""
    accepted = form_accepts(F.col("name"))
    server = F.col("name").endswith(".zip") | has_source_suffix(F.col("name"))
    return uploads.select(
        "*",
        F.when(accepted, "accepted").otherwise("rejected").alias("verdict"),
        (accepted != server).alias("gates_disagree"),
    )


def upload_gate_report(uploads: DataFrame) -> DataFrame:
    return (
        upload_gate(uploads)
        .groupBy("verdict", "gates_disagree")
        .agg(F.count(F.lit(1)).alias("uploads"))
    )


def empty_repo_rejects(repos: DataFrame, digests: DataFrame) -> DataFrame:
    """Repositories whose digest is missing, blank or the empty-repository text.

    Both sides have one row per repository, so the join has no hot key.
    """
    digest = F.coalesce("digest", F.lit(EMPTY_DIGEST))
    return (
        repos.select("repo_id").join(digests.select("repo_id", "digest"), "repo_id", "left")
        .withColumn("digest", digest)
        .where(is_blank(F.col("digest")) | (F.col("digest") == EMPTY_DIGEST))
    )


def pattern_validate(uploads: DataFrame) -> DataFrame:
    """Attach the target language; ``valid`` is false for an unknown pattern."""
    language = lookup(F.col("pattern"), TARGET_LANGUAGE)
    return uploads.select("*", language.alias("target_lang"), language.isNotNull().alias("valid"))
