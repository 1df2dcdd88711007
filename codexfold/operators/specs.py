"""Analyses of generated specifications, plans and code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexfold.constants import REQUIRED_OUTPUTS
from codexfold.functions.settings import yaml_entries
from codexfold.functions.text import is_blank, strip
from codexfold.operators.documents import diagram_blocks

EFFORTS = ("S", "M", "L")
MANIFEST_HEADING = "File Change Manifest"


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def _cells(line: Column) -> Column:
    """Trimmed cells of a table row, outer bars removed."""
    inner = F.regexp_replace(strip(line), r"\A\||\|\z", "")
    return F.transform(F.split(inner, r"\|"), strip)


def impact_rows(specs: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Rows (keys, subject, change_type, effort) of each impact table.

    A table is a block of consecutive lines that start with ``|``; it counts
    when one of its header cells starts with ``Effort``. Columns are found by
    header name, because they differ per pattern: ``subject`` is the first
    column, ``change_type`` is NULL when there is no such column.
    """
    # Lines outside a table become a mark, and the text is cut at the marks: no
    # expression runs over several lines.
    marked = F.transform(lines(F.col("text")), lambda l: F.when(l.rlike(r"\A[ \t]*\|"), l).otherwise("\u0002"))
    table = F.col("_table")
    header = F.transform(_cells(table[0]), F.lower)

    def at(cells: Column, position: Column) -> Column:
        return F.when(position > 0, F.try_element_at(cells, position))

    effort = F.array_position(F.transform(header, lambda h: F.startswith(h, F.lit("effort"))), True).cast("int")
    change = F.array_position(header, F.lit("change type")).cast("int")
    return (
        specs.select(*keys, F.explode(F.split(F.array_join(marked, "\n"), "\u0002")).alias("_block"))
        .where(F.contains(F.lower("_block"), F.lit("effort")))
        .select(*keys, F.filter(lines(F.col("_block")), lambda l: ~is_blank(l)).alias("_table"))
        .select(*keys, "_table", effort.alias("_effort"), change.alias("_change"))
        .where(F.col("_effort") > 0)
        .select(*keys, "_effort", "_change", F.explode(F.slice("_table", 2, 1_000_000_000)).alias("_line"))
        .where(~F.col("_line").rlike(r"\A[\s|:-]*\z"))
        .withColumn("_cell", _cells(F.col("_line")))
        .select(
            *keys,
            F.col("_cell")[0].alias("subject"),
            at(F.col("_cell"), F.col("_change")).alias("change_type"),
            at(F.col("_cell"), F.col("_effort")).alias("effort"),
        )
    )


def impact_matrix(specs: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Rollup of impact rows by change type and effort; ``level`` is 0 for the
    pair, 1 for the change type, 3 for the total. Another effort value than
    S, M or L stays a row of its own with ``valid_effort`` false."""
    rows = impact_rows(specs, keys).select(
        F.coalesce("change_type", F.lit("(none)")).alias("change_type"),
        F.coalesce("effort", F.lit("")).alias("effort"),
    )
    return (
        rows.rollup("change_type", "effort")
        .agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("items"))
        .withColumn("valid_effort", F.when(F.col("level") == 0, F.col("effort").isin(*EFFORTS)))
    )


def plan_items(plans: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Task lines (keys, ord, phase, done, item) under their ``## `` heading.

    The text is cut at its headings first, so a heading reaches its tasks
    inside the row and no window is needed. ``ord`` is the section number times
    2^32 plus the line number. Tasks before any heading have phase ''.
    """
    section = F.col("_section")
    task = r"\A\s*[-*] \[([ xX])\]\s*(.*?)\s*\z"
    phase = F.when(F.startswith(section, F.lit("## ")), strip(F.substring(F.substring_index(section, "\n", 1), 4, 2_000_000_000))).otherwise("")
    return (
        plans.select(*keys, F.posexplode(F.split("text", r"(?m)(?=^## )")).alias("_s", "_section"))
        .select(*keys, "_s", phase.alias("phase"), F.posexplode(lines(section)).alias("_l", "_line"))
        .where(F.col("_line").rlike(task))
        .select(
            *keys,
            (F.col("_s").cast("bigint") * F.lit(4294967296) + F.col("_l")).alias("ord"),
            "phase",
            (F.regexp_extract("_line", task, 1) != " ").alias("done"),
            F.regexp_extract("_line", task, 2).alias("item"),
        )
    )


def plan_tasks(plans: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Open and done tasks per phase."""
    return plan_items(plans, keys).groupBy(*keys, "phase").agg(
        F.count_if(~F.col("done")).alias("open"), F.count_if("done").alias("done")
    )


def manifest_paths(plans: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Paths named by the tasks under the manifest heading: right of an arrow if there
    is one, the first back-ticked word, else the first word with a suffix or a slash."""
    item = F.col("item")
    target = F.when(item.rlike("→|->"), F.regexp_extract(item, r"(?:→|->)(?!.*(?:→|->))[ \t]*(.*)", 1)).otherwise(item)
    ticked, named = F.regexp_extract(target, r"`([^`\s]+)`", 1), F.regexp_extract(target, r"(?:\A|\s)`?([\w.@/-]*[\w@-](?:\.\w+|/[\w.@/-]+))(?![\w/])", 1)
    return (
        plan_items(plans, keys).where(F.startswith("phase", F.lit(MANIFEST_HEADING)))
        .select(*keys, F.when(ticked != "", ticked).otherwise(named).alias("path"))
        .where(F.col("path") != "")
    )


def manifest_coverage(plans: DataFrame, files: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Per (keys, path): matched, missing (planned only) or extra (generated
    only). One union and aggregate stand in for the full outer join, so repeats
    combine on the map side."""
    both = manifest_paths(plans, keys).select(*keys, "path", F.lit(1).alias("m"), F.lit(0).alias("g")).unionByName(
        files.select(*keys, "path", F.lit(0).alias("m"), F.lit(1).alias("g"))
    )
    return (
        both.groupBy(*keys, "path").agg(F.max("m").alias("m"), F.max("g").alias("g"))
        .select(
            *keys,
            "path",
            F.when((F.col("m") == 1) & (F.col("g") == 1), "matched").when(F.col("m") == 1, "missing").otherwise("extra").alias("status"),
        )
    )


def required_outputs(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """Required paths (session_id, pattern, path) that were not generated."""
    needed = F.filter(
        F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(path).alias("path")) for p, path in REQUIRED_OUTPUTS]),
        lambda r: r["pattern"] == F.col("_pattern"),
    )
    paths = sorted({path for _, path in REQUIRED_OUTPUTS})
    wanted = sessions.select("session_id", F.col("pattern").alias("_pattern")).select("session_id", F.inline(needed))
    present = files.where(F.col("path").isin(*paths)).select("session_id", "path", F.lit(None).cast("string").alias("pattern"))
    return (
        wanted.select("session_id", "path", "pattern", F.lit(0).alias("_has"))
        .unionByName(present.withColumn("_has", F.lit(1)))
        .groupBy("session_id", "path")
        .agg(F.max("pattern").alias("pattern"), F.max("_has").alias("_has"))
        .where(F.col("pattern").isNotNull() & (F.col("_has") == 0))
        .drop("_has")
    )


MIGRATED = r"// MIGRATED( FROM)?:[ \t]*([^\n\r]*)"


def migrated_markers(files: DataFrame) -> DataFrame:
    """Markers (repo_id, path, kind, reason) left on migrated lines."""
    hit = F.col("_hit")
    return (
        files.select("repo_id", "path", F.explode(F.regexp_extract_all("content", F.lit(MIGRATED), F.lit(0))).alias("_hit"))
        .select(
            "repo_id",
            "path",
            F.when(F.regexp_extract(hit, MIGRATED, 1) == "", "reason").otherwise("from").alias("kind"),
            strip(F.regexp_extract(hit, MIGRATED, 2)).alias("reason"),
        )
    )


def top_reasons(files: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent markers per repository and kind (ties by text)."""
    counted = migrated_markers(files).groupBy("repo_id", "kind", "reason").agg(F.count(F.lit(1)).alias("occurrences"))
    best = Window.partitionBy("repo_id", "kind").orderBy(F.desc("occurrences"), "reason")
    return counted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


HTTP_VERBS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def openapi_endpoints(documents: DataFrame) -> DataFrame:
    """(repo_id, verb, route) of OpenAPI documents(repo_id, text), JSON or YAML; the
    other keys of a path item (parameters, servers, ...) are no verbs."""
    is_json = F.startswith(F.ltrim("text"), F.lit("{"))
    of_json = (
        documents.where(is_json)
        .select("repo_id", F.from_json("text", "struct<paths: map<string, map<string, string>>>")["paths"].alias("_paths"))
        .select("repo_id", F.explode("_paths").alias("route", "_verbs"))
        .select("repo_id", "route", F.explode(F.map_keys("_verbs")).alias("verb"))
    )
    path = F.col("_e.path")
    of_yaml = (
        documents.where(~is_json).select("repo_id", F.explode(yaml_entries(F.col("text"))).alias("_e"))
        .where(F.col("_e.read") & (F.get(path, F.lit(0)) == "paths") & (F.size(path) > 2))
        .select("repo_id", F.get(path, F.lit(1)).alias("route"), F.get(path, F.lit(2)).alias("verb")).distinct()
    )
    return of_json.unionByName(of_yaml).where(F.lower("verb").isin(*HTTP_VERBS)).select("repo_id", F.upper("verb").alias("verb"), "route")


def endpoint_drift(documents: DataFrame, code: DataFrame) -> DataFrame:
    """Endpoints only in the contract, only in the code, or in both; ``code``
    is (repo_id, verb, route)."""
    both = openapi_endpoints(documents).select("repo_id", "verb", "route", F.lit(1).alias("s"), F.lit(0).alias("c")).unionByName(
        code.select("repo_id", "verb", "route", F.lit(0).alias("s"), F.lit(1).alias("c"))
    )
    return (
        both.groupBy("repo_id", "verb", "route").agg(F.max("s").alias("s"), F.max("c").alias("c"))
        .select(
            "repo_id", "verb", "route",
            F.when((F.col("s") == 1) & (F.col("c") == 1), "both").when(F.col("s") == 1, "only_in_spec").otherwise("only_in_code").alias("status"),
        )
    )


ARROW = r"-->[ \t]*(?:\|[^|\n]*\|)?"
# a node's name may hold dots and single hyphens; a label makes it declared, at any place
NAME = r"[\w.]+(?:-(?!-)[\w.]+){0,20}"
NODE = rf"(?U)(?<![\w.-])({NAME})[\[({{]"


def diagram_edges(docs: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Edges (keys, source, target, occurrences) of graph and flowchart blocks.

    A line is cut at its arrows; each piece's first word is a node, and
    neighbours are edges, so a chain ``A --> B --> C`` gives two.
    """
    node = F.transform(F.split("_line", ARROW), lambda p: F.regexp_extract(p, rf"(?U)({NAME})", 1))
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("_nodes") - 1),
        lambda i: F.struct(F.get("_nodes", i - 1).alias("source"), F.get("_nodes", i).alias("target")),
    )
    return (
        diagram_blocks(docs, keys).where(F.col("kind").isin("graph", "flowchart"))
        .select(*keys, F.explode(lines(F.col("body"))).alias("_line"))
        .where(F.contains("_line", F.lit("-->")))
        .select(*keys, node.alias("_nodes"))
        .select(*keys, F.inline(pairs))
        .where((F.col("source") != "") & (F.col("target") != ""))
        .groupBy(*keys, "source", "target")
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )


def diagram_nodes(docs: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Degree per node and whether the diagram declares it (``node[label]``)."""
    ends = F.array(
        F.struct(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.lit(0).alias("d")),
        F.struct(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(0).alias("d")),
    )
    declared = (
        diagram_blocks(docs, keys).where(F.col("kind").isin("graph", "flowchart"))
        .select(*keys, F.explode(F.regexp_extract_all(F.regexp_replace("body", r"\[[^\]\n]*\]", "[]"), F.lit(NODE), F.lit(1))).alias("node"))
        .select(*keys, "node", F.lit(0).alias("o"), F.lit(0).alias("i"), F.lit(1).alias("d"))
    )
    return (
        diagram_edges(docs, keys).select(*keys, F.inline(ends)).unionByName(declared)
        .groupBy(*keys, "node")
        .agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), (F.max("d") == 1).alias("declared"))
    )


def diagram_against_code(edges: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Compare drawn edges with extracted ones, both (repo_id, source, target)."""
    both = edges.select("repo_id", "source", "target", F.lit(1).alias("d"), F.lit(0).alias("c")).unionByName(
        dependencies.select("repo_id", "source", "target", F.lit(0).alias("d"), F.lit(1).alias("c"))
    )
    return (
        both.groupBy("repo_id", "source", "target").agg(F.max("d").alias("d"), F.max("c").alias("c"))
        .select(
            "repo_id", "source", "target",
            F.when((F.col("d") == 1) & (F.col("c") == 1), "both").when(F.col("d") == 1, "only_in_diagram").otherwise("only_in_code").alias("status"),
        )
    )
