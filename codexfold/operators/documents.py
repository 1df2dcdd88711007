"""Structure of generated markdown: sections, fenced files, diagrams, merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexfold.constants import DISPLAY_LANGUAGE, FALLBACK_SUFFIX, FALLBACK_SUFFIX_OTHER
from codexfold.functions.prefix import prefix
from codexfold.functions.skew import HOT_ROWS, hot_keys
from codexfold.functions.text import basename, dirname, lookup, nonempty, strip

# Python's \s is Unicode white space plus U+001C to U+001F, and
# its IGNORECASE folds by Unicode. Flags on the word only keep the scan for
# "<!--" cheap.
_SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*"
_MARKER = rf"<!--{_SPACE}(?iu:SECTION:){_SPACE}(?iu:{{}}){_SPACE}-->"

# Fixed value: a fence is three backticks, an optional word, an optional
# colon and path, a newline, anything, three backticks.
FENCE = r"(?sU)```(\w+)?(?::([^\n]+))?\n(.*?)```"


def section_split(docs: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Long table (keys, section, text, rule) of analysis, brd, technical_spec.

    Offsets come from ``split(text, marker, 2)``: the first piece's length is
    the start of the first match, the remainder's length gives its end. Both
    count code points, which ``regexp_instr`` would not.
    """
    text, size = F.col("text"), F.length("text")
    found = docs.select(
        *keys,
        "text",
        *[
            F.split("text", _MARKER.format(word), 2).alias(f"_{tag}")
            for tag, word in
            (("a", "ANALYSIS"), ("b", "BRD"), ("t", "TECHNICAL_SPECIFICATION"), ("e", "END"))
        ],
    )
    spots = found.select(
        *keys,
        "text",
        *[F.when(F.size(f"_{t}") == 2, F.length(F.col(f"_{t}")[0])).alias(f"{t}0") for t in "abte"],
        *[F.when(F.size(f"_{t}") == 2, size - F.length(F.col(f"_{t}")[1])).alias(f"{t}1") for t in "abte"],
    )

    def between(start: str, end: Column) -> Column:
        return strip(F.substring(text, F.col(start) + 1, end - F.col(start)))

    has = {tag: F.col(f"{tag}0").isNotNull() for tag in "abte"}
    brd = (
        F.when(has["b"] & has["t"], between("b1", F.col("t0")))
        .when(has["b"], between("b1", size))
        .otherwise(text)
    )
    brd_rule = (
        F.when(has["b"] & (brd == ""), "blank_whole")
        .when(has["b"] & has["t"], "between")
        .when(has["b"], "to_end")
        .otherwise("whole")
    )
    rows = F.array(
        F.struct(
            F.lit("analysis").alias("section"),
            F.when(has["a"] & has["b"], between("a1", F.col("b0"))).otherwise(text).alias("text"),
            F.when(has["a"] & has["b"], "between").otherwise("whole").alias("rule"),
        ),
        F.struct(
            F.lit("brd").alias("section"),
            F.when(brd == "", text).otherwise(brd).alias("text"),
            brd_rule.alias("rule"),
        ),
        F.struct(
            F.lit("technical_spec").alias("section"),
            F.when(has["t"], between("t1", F.coalesce("e0", size))).otherwise("").alias("text"),
            F.when(has["t"] & has["e"], "between").when(has["t"], "to_end").otherwise("absent").alias("rule"),
        ),
    )
    return spots.select(*keys, F.inline(rows))


def section_rule_report(sections: DataFrame) -> DataFrame:
    return sections.groupBy("section", "rule").agg(F.count(F.lit(1)).alias("docs"))


def _fences(text: Column) -> Column:
    """Fenced blocks of a text: struct(language, path, body), raw groups.

    The text is scanned once for whole blocks; language and path are then read
    off each block's first line, the body lies between it and the fence.
    """
    def parts(block: Column) -> Column:
        header = F.substring_index(block, "\n", 1)
        return F.struct(
            nonempty(F.regexp_extract(header, r"(?sU)\A```(\w+)?(?::(.+))?\z", 1)).alias("language"),
            nonempty(F.regexp_extract(header, r"(?sU)\A```(\w+)?(?::(.+))?\z", 2)).alias("path"),
            F.substring(
                block, F.length(header) + 2, F.length(block) - F.length(header) - 4
            ).alias("body"),
        )

    return F.transform(F.regexp_extract_all(text, F.lit(FENCE), F.lit(0)), parts)


def fence_fallback(text: Column, target: Column) -> Column:
    """The single file of a text without any block."""
    lower = F.lower(target)
    ending = F.coalesce(lookup(lower, FALLBACK_SUFFIX), F.lit(FALLBACK_SUFFIX_OTHER))
    return F.struct(
        F.concat(F.lit("output."), ending).alias("path"),
        strip(text).alias("content"),
        lower.alias("language"),
    )


def fenced_files(
    docs: DataFrame, keys: Sequence[str] = ("doc_id",), fallback: bool = True
) -> DataFrame:
    """Generated files (keys, ord, path, content, language) of docs(keys, text,
    target_lang), in block order. A fence whose info string holds anything else
    is no opener, so its closing fence opens the next block: kept on purpose."""
    target = F.col("target_lang")

    def named(block: Column) -> Column:
        language = F.coalesce(block["language"], target)
        return F.struct(
            strip(F.coalesce(block["path"], F.concat(F.lit("output."), language))).alias("path"),
            strip(block["body"]).alias("content"),
            strip(language).alias("language"),
        )

    files = F.transform(F.col("_blocks"), named)
    if fallback:
        files = F.when(
            F.size("_blocks") == 0, F.array(fence_fallback(F.col("text"), target))
        ).otherwise(files)
    return (
        docs.withColumn("_blocks", _fences(F.col("text")))
        .select(*keys, F.posexplode(files).alias("ord", "_file"))
        .select(*keys, F.col("ord").cast("bigint"), "_file.path", "_file.content", "_file.language")
    )


def fallback_files(docs: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Only the documents without a block, as their one fallback file."""
    return (
        docs.where(~F.col("text").rlike(FENCE))
        .select(*keys, fence_fallback(F.col("text"), F.col("target_lang")).alias("_file"))
        .select(*keys, F.lit(0).cast("bigint").alias("ord"), "_file.*")
    )


def diagram_blocks(docs: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Mermaid blocks (keys, ord, kind, body); one trailing newline removed."""
    return (
        docs.select(*keys, F.posexplode(_fences(F.col("text"))).alias("ord", "_block"))
        .where((F.col("_block.language") == "mermaid") & F.col("_block.path").isNull())
        .withColumn("body", F.regexp_replace("_block.body", r"\n\z", ""))
        .select(
            *keys,
            F.col("ord").cast("bigint"),
            F.regexp_extract("body", r"(?U)\A\s*(\w+)", 1).alias("kind"),
            "body",
        )
    )


def language_normalise(files: DataFrame) -> DataFrame:
    lower = F.lower("language")
    return files.withColumn("language", F.coalesce(lookup(lower, DISPLAY_LANGUAGE), lower))


def path_split(files: DataFrame) -> DataFrame:
    return files.select("*", dirname(F.col("path")).alias("dir"), basename(F.col("path")).alias("name"))


def directory_rollup(files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return path_split(files).groupBy(*keys, "dir").agg(F.count(F.lit(1)).alias("files"))


def is_test_file(path: Column, language: Column) -> Column:
    lower = F.lower(path)
    return F.when(language == "go", lower.endswith("_test.go")).otherwise(
        lower.contains("src/test/") | lower.endswith("test.java")
    )


def test_file_flag(files: DataFrame) -> DataFrame:
    return files.withColumn("is_test", is_test_file(F.col("path"), F.col("language")))


def test_ratio(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    return test_file_flag(files).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if("is_test").alias("test_files"),
        F.round(F.avg(F.col("is_test").cast("double")), 6).alias("test_ratio"),
    )


def merge_by_path(original: DataFrame, fixes: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Upsert fixes into original, both (repo_id, ord, path, content).

    The last writer of a path gives its content, the first its position; new
    paths come last. One map-side combined aggregate per (repo, path), then the
    dense position is counted over blocks of keys, so a repository with most of
    the rows is never sorted in one task.
    """
    columns = ["repo_id", "ord", "path", "content"]
    rows = original.select(*columns, F.lit(0).alias("src")).unionByName(
        fixes.select(*columns, F.lit(1).alias("src"))
    )
    merged = rows.groupBy("repo_id", "path").agg(
        F.max_by("content", F.struct("src", "ord")).alias("content")
    )
    # Rank the keys only and join the content back.
    keys = rows.groupBy("repo_id", "path").agg(F.min(F.struct("src", "ord")).alias("_first")).select(
        "repo_id", "path", F.col("_first.src").alias("_src"), F.col("_first.ord").alias("_ord")
    )
    ranked = prefix(
        keys, ["repo_id"], ["_src", "_ord"], {"ord": ("sum", F.lit(1).cast("bigint"))},
        hot_rows, hot_keys(rows, ["repo_id"], hot_rows),
    )
    return merged.join(ranked.drop("_src", "_ord"), ["repo_id", "path"]).select(
        "repo_id", "ord", "path", "content"
    )
