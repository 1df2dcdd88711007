"""Fleet-wide analyses of source files(repo_id, path, content).

The extraction rules are this package's own and stated per operator. Each one
selects the files it needs, extracts inside the row, and aggregates with
map-side combining.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexfold.functions.java import java_declarations, java_routes, java_types
from codexfold.functions.processes import process_items
from codexfold.functions.settings import key_of, properties_entries, resolved, yaml_entries
from codexfold.functions.skew import lookup_join
from codexfold.functions.text import basename, nonempty, strip, suffix

JAVA = (".java",)
# No pattern repeats a group over lines or starts with white space that may run
# over line ends: on hostile text the first overflows the stack, the second is quadratic.
PACKAGE = r"(?m)^[ \t]*package[ \t]+([\w.]+)"
IMPORT = r"(?m)^[ \t]*import[ \t]+((?:static[ \t]+)?[\w.]+)"
# kind, name, rest of the header up to the brace (4,000 characters at most); before
# the kind the line may hold modifiers and annotations without strings
TYPE_DECLARATION = r"(?m)^[\w@.() \t-]*?(?<![\w.@-])(class|interface|enum|record)[ \t]+(\w+)([^{;]{0,4000})\{"
SPRING_VERBS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH"}
JAXRS_VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
RELATIONS = ("OneToMany", "ManyToOne", "OneToOne", "ManyToMany")
ANNOTATION = r"@(\w+)"
HOT_PARENTS = 100_000


def of_suffix(files: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    return files.where(suffix(F.col("path")).isin(*suffixes))


def all_matches(text: Column, pattern: str, groups: Sequence[int]) -> Column:
    """Array of structs g<i>: one scan for the matches, groups read per match."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda hit: F.struct(*[F.regexp_extract(hit, pattern, g).alias(f"g{g}") for g in groups]),
    )


def package_of(content: Column) -> Column:
    return nonempty(F.regexp_extract(content, PACKAGE, 1))


def tech_stack_profile(files: DataFrame) -> DataFrame:
    """Files, bytes and lines per repository and suffix, with the share of the
    repository's bytes. A text of n newlines has n + 1 lines."""
    newlines = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))
    per_suffix = (
        files.select("repo_id", suffix(F.col("path")).alias("suffix"),
                     F.octet_length("content").cast("bigint").alias("_bytes"),
                     (newlines + 1).cast("bigint").alias("_lines"))
        .groupBy("repo_id", "suffix")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("_bytes").alias("bytes"), F.sum("_lines").alias("lines"))
    )
    total = F.sum("bytes").over(Window.partitionBy("repo_id"))
    return per_suffix.withColumn("share", F.round(F.col("bytes") / total, 6))


def package_inventory(files: DataFrame) -> DataFrame:
    """Files and declared types per package; a file's package is its first
    ``package`` line."""
    return (
        of_suffix(files, JAVA)
        .select(
            "repo_id",
            package_of(F.col("content")).alias("package"),
            F.regexp_count("content", F.lit(TYPE_DECLARATION)).cast("bigint").alias("_types"),
        )
        .where(F.col("package").isNotNull())
        .groupBy("repo_id", "package")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("_types").alias("types"))
    )


def dependency_edges(files: DataFrame) -> DataFrame:
    """Package-to-package edges of the import lines.

    The target is the import without its last component, of a static import without
    its last two (member and type). ``weight`` counts
    import lines; ``internal`` says that a file of the same repository declares
    the target package. Imports of the own package are left out.
    """
    def outer(name: Column) -> Column:
        return F.regexp_replace(name, r"\.?[^.]*\z", "")

    static = F.startswith("_import", F.lit("static"))
    imported = outer(F.regexp_replace("_import", r"\Astatic[ \t]+", ""))
    imported = F.when(static, outer(imported)).otherwise(imported)
    # Both sides of the lookup below come out of this one aggregate, whose
    # exchange Spark reuses, so the text is scanned once; the filters read
    # aggregate results so that they stay above it. The repository is a struct,
    # never NULL itself: of a plain column the join would infer a NULL test for one
    # side, and push it below the exchange, which the sides then could not share.
    pairs = (
        of_suffix(files, JAVA)
        .select(
            F.struct("repo_id").alias("_repo"),
            package_of(F.col("content")).alias("source"),
            F.explode_outer(F.regexp_extract_all("content", F.lit(IMPORT), F.lit(1))).alias("_import"),
        )
        .where(F.col("source").isNotNull())
        .withColumn("target", F.coalesce(imported, F.lit("")))
        .groupBy("_repo", "source", "target")
        .agg(
            F.count(F.lit(1)).alias("weight"),
            F.max((F.col("target") != "") & (F.col("target") != F.col("source"))).alias("_edge"),
        )
    )
    edges = pairs.where(F.col("_edge") & (F.col("weight") > 0)).drop("_edge")
    declared = (
        pairs.where((F.col("weight") > 0) & F.col("_edge").isNotNull())
        .select("_repo", F.col("source").alias("target")).distinct().withColumn("internal", F.lit(True))
    )
    found = lookup_join(edges, declared, ["_repo", "target"], F.col("source"))
    known = F.coalesce("internal", F.lit(False)) & F.col("_repo.repo_id").isNotNull()
    return found.select("_repo.repo_id", "target", "source", "weight", known.alias("internal"))


def dependency_degrees(edges: DataFrame) -> DataFrame:
    """Fan-out and fan-in per package of distinct edges, by one union and
    aggregate instead of a join of two."""
    ends = F.array(
        F.struct(F.col("source").alias("package"), F.lit(1).alias("out"), F.lit(0).alias("in")),
        F.struct(F.col("target").alias("package"), F.lit(0).alias("out"), F.lit(1).alias("in")),
    )
    return (
        edges.select("repo_id", F.inline(ends))
        .groupBy("repo_id", "package")
        .agg(F.sum("out").alias("fan_out"), F.sum("in").alias("fan_in"))
    )


def _java_types(files: DataFrame) -> DataFrame:
    """(repo_id, path, _t): one row per type, read by the lexer, with annotations and members."""
    return of_suffix(files, JAVA).select("repo_id", "path", F.explode(java_types(F.col("content"))).alias("_t"))


def type_declarations(files: DataFrame) -> DataFrame:
    """(repo_id, path, kind, type, parents[relation, parent]) per declaration: comments and
    strings do not count, parents stand without their type arguments."""
    return of_suffix(files, JAVA).select("repo_id", "path", F.inline(java_declarations(F.col("content"))))


def _names(files: DataFrame) -> DataFrame:
    """(repo_id, kind, type, relation, parent): the edges of each declaration and, without
    a relation, the type itself as ``parent``; those of one type in one partition.

    All uses below read all columns of the array and so share this exchange; the NULL test
    that joins would infer for one side only stands here for all."""
    itself = F.array(F.struct(F.lit(None).cast("string").alias("relation"), F.col("type").alias("parent")))
    return (
        type_declarations(files).where(F.col("repo_id").isNotNull() & F.col("type").isNotNull())
        .repartition("repo_id", "type")
        .select("repo_id", "kind", "type", F.inline(F.concat(itself, F.col("parents"))))
    )


def _hierarchy(names: DataFrame, columns: Sequence[str], hot_rows: int) -> DataFrame:
    """Distinct edges with ``parent_declared``.

    One aggregate tells of every name how many edges go to it and whether it is declared.
    Edges to a parent that more than ``hot_rows`` name are answered where they are, by the
    list of these parents, which has at most one row per ``hot_rows`` edges; the others
    go to the answer of their parent.
    """
    on = ["repo_id", "parent"]
    # the kind is read so that this shares the exchange with the edges
    edge = F.col("relation").isNotNull() & (F.col("kind").isNotNull() if "kind" in columns else F.lit(True))
    answers = names.groupBy(*on).agg(F.count_if(edge).alias("_asked"), F.max(F.col("relation").isNull()).alias("_declared"))
    hot = F.broadcast(answers.where(F.col("_asked") > hot_rows).select(*on, F.col("_declared").alias("_hot")))
    told = names.where(F.col("relation").isNotNull()).select(*columns).join(hot, on, "left")
    rest = told.where(F.col("_hot").isNull()).select(*columns).distinct()
    cold = answers.where((F.col("_asked") > 0) & (F.col("_asked") <= hot_rows)).select(*on, F.col("_declared").alias("parent_declared"))
    at_once = told.where(F.col("_hot").isNotNull()).select(*columns, F.col("_hot").alias("parent_declared")).distinct()
    return rest.join(cold, on).select(*columns, "parent_declared").unionByName(at_once)


def type_hierarchy(files: DataFrame, hot_rows: int = HOT_PARENTS) -> DataFrame:
    """Distinct edges (repo_id, kind, type, relation, parent) and whether the
    parent is declared in the same repository."""
    return _hierarchy(_names(files), ("repo_id", "parent", "kind", "type", "relation"), hot_rows)


def hierarchy_roots(files: DataFrame, hot_rows: int = HOT_PARENTS) -> DataFrame:
    """Declared types without a parent declared in the same repository."""
    names = _names(files)
    types = names.where(F.col("relation").isNull()).select("repo_id", "type").distinct()
    children = _hierarchy(names, ("repo_id", "parent", "type"), hot_rows).where("parent_declared").select("repo_id", "type")
    return types.join(children, ["repo_id", "type"], "left_anti")


def _annotated(annotations: Column, *names: str) -> Column:
    return F.filter(annotations, lambda a: a["name"].isin(*names))


def _argument(annotation: Column, *keys: str) -> Column:
    """Values of the arguments with one of ``keys``; '' is the key of one without a name."""
    return F.flatten(F.transform(F.filter(annotation["arguments"], lambda x: x["key"].isin(*keys)), lambda x: x["values"]))


def _or_empty(values: Column) -> Column:
    return F.when(F.size(values) > 0, values).otherwise(F.array(F.lit("")))


def _paths(annotations: Column) -> Column:
    """Paths of annotations: ``value``, ``path`` or the argument without a name."""
    return F.flatten(F.transform(annotations, lambda a: _argument(a, "", "value", "path")))


def endpoints(files: DataFrame) -> DataFrame:
    """Distinct (repo_id, path, verb, route) of each file.

    Spring: the verb mappings, and ``@RequestMapping`` of a method with the verbs of
    its ``method`` (``ANY`` without one). JAX-RS: a verb and ``@Path`` of one method,
    in any order. The type around a method gives the prefixes of its routes. A path that
    is no string stands as ``${its name}``, so that it is seen to be unresolved.
    """
    mapped = of_suffix(files.where(F.col("content").rlike(r"Mapping\b|@(?:" + "|".join(JAXRS_VERBS) + r")\b")), JAVA)
    routes = java_routes(F.col("content"), SPRING_VERBS, JAXRS_VERBS)
    return mapped.select("repo_id", "path", F.inline(routes)).distinct()


def endpoint_inventory(files: DataFrame) -> DataFrame:
    """Files per (repo_id, verb, route); ``duplicated`` when more than one."""
    return (
        endpoints(files).groupBy("repo_id", "verb", "route")
        .agg(F.count(F.lit(1)).alias("files"))
        .withColumn("duplicated", F.col("files") > 1)
    )


# XML is read by its tags, not through a parser: one malformed document would
# make XPath fail the whole job. Rules: comments and CDATA are removed first, a
# tag runs from its name to the next '>', prefixes do not count, and the five
# named entities are resolved.
XML_NOISE = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>"
VARIABLE = r"(?s)<(?:[\w.-]+:)?globalVariable\b[^<>]*>.*?</(?:[\w.-]+:)?globalVariable\s*>"
XML_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def _resolved(text: Column) -> Column:
    for entity, char in XML_ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def _tags(content: Column, names: str) -> Column:
    """Opening tags with one of ``names`` (a|b)."""
    clean = F.regexp_replace(content, XML_NOISE, "")
    return F.regexp_extract_all(clean, F.lit(rf"<(?:[\w.-]+:)?(?:{names})(?=[\s/>])[^<>]*>"), F.lit(0))


def _attribute(tag: Column, name: str) -> Column:
    """Attribute value, NULL when it is absent or empty."""
    return nonempty(_resolved(F.regexp_extract(tag, rf"\s{name}\s*=\s*([\"'])(.*?)\1", 2)))


def _is_tag(tag: Column, name: str) -> Column:
    return tag.rlike(rf"\A<(?:[\w.-]+:)?{name}[\s/>]")


def _element(block: Column, name: str) -> Column:
    """Text of the first child ``name`` ('' when it is empty or absent)."""
    return _resolved(F.regexp_extract(block, rf"(?s)<(?:[\w.-]+:)?{name}(?:\s[^<>]*)?>([^<]*)</", 1))


def _config_rows(files: DataFrame) -> DataFrame:
    """(repo_id, path, entry) of properties and YAML files, unread lines included."""
    def rows(suffixes: Sequence[str], reader) -> DataFrame:
        return of_suffix(files, suffixes).select("repo_id", "path", F.explode(reader(F.col("content"))).alias("entry"))

    return rows((".properties",), properties_entries).unionByName(rows((".yml", ".yaml"), yaml_entries))


def config_unread(files: DataFrame) -> DataFrame:
    """(repo_id, path, line, text) of the lines that ``config_entries`` could not read."""
    return _config_rows(files).where(~F.col("entry.read")).select("repo_id", "path", "entry.line", F.col("entry.value").alias("text"))


def config_entries(files: DataFrame) -> DataFrame:
    """(repo_id, path, profile, key, value) rows.

    ``.properties``: logical lines with continuations and escapes; the key ends at ``=``,
    ``:`` or white space. ``.yml`` and ``.yaml``: every scalar, its key ``a.b[0].c``.
    ``.substvar``: name and value of every ``globalVariable``. The profile is the one a
    YAML document is for, or the part of the file name after ``-``, or ``default``.
    """
    entry = F.col("entry")
    read = _config_rows(files).where(entry["read"]).select(
        "repo_id", "path", entry["document"].alias("_document"), key_of(entry["path"]).alias("key"), entry["value"].alias("value")
    )
    # One block per variable, so an empty value stays with its own name.
    block = F.col("_block")
    clean = F.regexp_replace("content", XML_NOISE, "")
    variables = (
        of_suffix(files, (".substvar",))
        .select("repo_id", "path", F.explode(F.regexp_extract_all(clean, F.lit(VARIABLE), F.lit(0))).alias("_block"))
        .select("repo_id", "path", F.lit(0).alias("_document"), _element(block, "name").alias("key"), _element(block, "value").alias("value"))
        .where(F.col("key") != "")
    )
    of_name = nonempty(F.regexp_extract(basename(F.col("path")), r"-([^-.]+)\.[^.]+\z", 1))
    named = F.when(F.col("key").isin("spring.config.activate.on-profile", "spring.profiles") & suffix(F.col("path")).isin(".yml", ".yaml"), F.col("value"))
    document = Window.partitionBy("repo_id", "path", "_document")
    rows = read.unionByName(variables)
    # only YAML has profiles inside; the other files need no exchange
    inside = rows.where(suffix(F.col("path")).isin(".yml", ".yaml")).withColumn("profile", F.coalesce(F.max(named).over(document), of_name, F.lit("default")))
    others = rows.where(~suffix(F.col("path")).isin(".yml", ".yaml")).withColumn("profile", F.coalesce(of_name, F.lit("default")))
    return inside.unionByName(others).drop("_document")


def config_inventory(files: DataFrame) -> DataFrame:
    """One row per key and profile; ``conflicting`` when values differ."""
    return (
        config_entries(files).groupBy("repo_id", "profile", "key")
        .agg(
            F.count(F.lit(1)).alias("entries"),
            F.min("value").alias("lowest"),
            F.max("value").alias("highest"),
        )
        .withColumn("conflicting", F.col("lowest") != F.col("highest"))
    )


POM_DEPENDENCY = r"(?s)<dependency>.*?</dependency>"
# configuration, then group:artifact[:version], also inside platform(..); or named parts
GRADLE_DEPENDENCY = (
    r"(?m)^[ \t]*(?:[a-z]\w*(?:[iI]mplementation|Api|Only|Processor|Classpath|ompile|untime)|implementation|api|compile|runtime|kapt|ksp|classpath)"
    r"[ \t]*\(?[ \t]*(?:(?:enforcedP|p)latform[ \t]*\([ \t]*)?[\"']([^:\"'\s]+):([^:\"'\s]+)(?::([^:\"'@\s]+))?[^\"'\n]*[\"']"
)
GRADLE_NAMED = r"""(?m)^[ \t]*[a-z]\w*[ \t]*\(?[ \t]*group[ \t]*[:=][ \t]*["']([^"'\n]+)["'][ \t]*,[ \t]*name[ \t]*[:=][ \t]*["']([^"'\n]+)["'](?:[ \t]*,[ \t]*version[ \t]*[:=][ \t]*["']([^"'\n]+)["'])?"""
GRADLE_VALUE = r"""(?m)^[ \t]*(?:def[ \t]+|val[ \t]+|ext\.|extra\[")?(\w[\w.]*)(?:"\])?[ \t]*=[ \t]*["']([^"'\n]*)["'][ \t]*;?[ \t]*$"""
CODE_NOISE = r"(?s)/\*.*?(?:\*/|\z)|(?<![:\"'])//[^\n]*"
BUILD_NAMES = ("pom.xml", "gradle.properties")


def _build_files(files: DataFrame) -> DataFrame:
    """(repo_id, path, dir, kind, content) of build files, without comments."""
    name = basename(F.col("path"))
    kind = F.when(name == "pom.xml", "pom").when(name == "gradle.properties", "properties").when(
        name.endswith(".gradle") | name.endswith(".gradle.kts"), "gradle"
    )
    clean = F.when(kind == "pom", F.regexp_replace("content", XML_NOISE, "")).when(kind == "gradle", F.regexp_replace("content", CODE_NOISE, "")).otherwise(F.col("content"))
    return files.where(kind.isNotNull()).select(
        "repo_id", "path", F.regexp_replace("path", r"/?[^/]*\z", "").alias("dir"), kind.alias("kind"), clean.alias("content")
    )


def _tag(block: Column, name: str) -> Column:
    return strip(F.regexp_extract(block, rf"(?s)<{name}>(.*?)</{name}>", 1))


def build_definitions(files: DataFrame) -> DataFrame:
    """(repo_id, dir, name, value): what a build file gives a name to. ``<properties>`` and the
    project's own version of a ``pom.xml``, strings assigned in Gradle files, and
    ``gradle.properties``."""
    built = _build_files(files)
    body = F.regexp_extract("content", r"(?s)<properties>(.*?)</properties>", 1)
    pairs = all_matches(body, r"(?s)<([\w.-]+)>([^<]*)</", (1, 2))
    head = F.regexp_replace("content", r"(?s)<(parent|dependencies|dependencyManagement|dependency|build|profiles|properties)>.*?</\1>", "")
    own = F.array(F.struct(F.lit("project.version").alias("g1"), F.coalesce(nonempty(_tag(head, "version")), _tag(F.col("content"), "version")).alias("g2")))
    gradle = all_matches(F.col("content"), GRADLE_VALUE, (1, 2))
    found = F.when(F.col("kind") == "pom", F.concat(pairs, own)).when(F.col("kind") == "gradle", gradle)
    rows = built.where("kind != 'properties'").select("repo_id", "dir", F.explode(found).alias("_p")).select(
        "repo_id", "dir", F.regexp_replace("_p.g1", r"\Aext\.", "").alias("name"), strip(F.col("_p.g2")).alias("value")
    )
    entry = F.col("_e")
    listed = built.where("kind = 'properties'").select("repo_id", "dir", F.explode(properties_entries(F.col("content"))).alias("_e"))
    return rows.unionByName(listed.where(entry["read"]).select("repo_id", "dir", key_of(entry["path"]).alias("name"), entry["value"].alias("value"))).where("value != ''")


def libraries(files: DataFrame) -> DataFrame:
    """(repo_id, path, group_id, artifact_id, version) from ``pom.xml`` and Gradle files; a
    missing version is ''. Dependencies of every configuration count, platforms and
    processors too. Names in a version are resolved by the definitions of the file's folder
    and then of the folders above it, and definitions by definitions; unknown names stay."""
    built = _build_files(files).where("kind != 'properties'")
    pom = F.transform(
        F.regexp_extract_all("content", F.lit(POM_DEPENDENCY), F.lit(0)),
        lambda b: F.struct(_tag(b, "groupId").alias("group_id"), _tag(b, "artifactId").alias("artifact_id"), _tag(b, "version").alias("version")),
    )
    gradle = F.transform(
        F.concat(all_matches(F.col("content"), GRADLE_DEPENDENCY, (1, 2, 3)), all_matches(F.col("content"), GRADLE_NAMED, (1, 2, 3))),
        lambda m: F.struct(m["g1"].alias("group_id"), m["g2"].alias("artifact_id"), m["g3"].alias("version")),
    )
    used = built.select("repo_id", "path", "dir", F.inline(F.when(F.col("kind") == "pom", pom).otherwise(gradle)))
    named = F.concat_ws(" ", "group_id", "artifact_id", "version").contains("$")
    # only the few rows with a name in them meet the definitions
    folders = used.where(named).select("repo_id", "dir").distinct()
    parts = F.split("dir", "/")
    above = folders.select("repo_id", "dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("_above")).distinct()
    known = above.join(build_definitions(files).withColumnRenamed("dir", "_above"), ["repo_id", "_above"]).groupBy("repo_id", "dir").agg(
        F.sort_array(F.collect_set(F.struct((-F.length("_above")).alias("far"), "name", "value"))).alias("_known")
    )
    names = ("group_id", "artifact_id", "version")
    open_rows = used.where(named).join(known, ["repo_id", "dir"], "left").select("repo_id", "path", *(resolved(F.col(c), F.col("_known")).alias(c) for c in names))
    return used.where(~named).select("repo_id", "path", *names).unionByName(open_rows)


def library_inventory(files: DataFrame, replacements: DataFrame | None = None) -> DataFrame:
    """Versions and repositories per library over the fleet.

    ``replacements`` (group_id, artifact_id, replacement; unique per library)
    is the user's mapping table; unmapped libraries get NULL.
    """
    # Distinct pairs first, so a library used everywhere is combined per task.
    used = libraries(files).select("group_id", "artifact_id", "version", "repo_id").distinct()
    per_version = used.groupBy("group_id", "artifact_id", "version").agg(F.count(F.lit(1)).alias("_uses"))
    per_repo = used.select("group_id", "artifact_id", "repo_id").distinct()
    counts = per_version.select("group_id", "artifact_id", F.lit(1).alias("v"), F.lit(0).alias("r")).unionByName(
        per_repo.select("group_id", "artifact_id", F.lit(0).alias("v"), F.lit(1).alias("r"))
    )
    inventory = (
        counts.groupBy("group_id", "artifact_id")
        .agg(F.sum("v").alias("versions"), F.sum("r").alias("repositories"))
        .withColumn("conflicting", F.col("versions") > 1)
    )
    if replacements is None:
        return inventory
    return inventory.join(replacements, ["group_id", "artifact_id"], "left")


def feature_markers(files: DataFrame, markers: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Occurrences per file of a marker table [(marker, regex, target)].

    The table is a small parameter, so it becomes literals of one projection:
    the text is neither joined nor copied per marker.
    """
    counts = F.array(
        *[
            F.struct(
                F.lit(name).alias("marker"),
                F.lit(target).alias("target"),
                F.regexp_count("content", F.lit(pattern)).cast("bigint").alias("occurrences"),
            )
            for name, pattern, target in markers
        ]
    )
    return of_suffix(files, JAVA).select("repo_id", "path", F.inline(counts)).where(F.col("occurrences") > 0)


def unmapped_annotations(files: DataFrame, mapped: Sequence[str]) -> DataFrame:
    """Annotations (without @) that the user's mapping does not cover."""
    return (
        of_suffix(files, JAVA)
        .select("repo_id", F.explode(F.regexp_extract_all("content", F.lit(ANNOTATION), F.lit(1))).alias("annotation"))
        .where(~F.col("annotation").isin(*mapped))
        .groupBy("repo_id", "annotation")
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )


def entity_model(files: DataFrame) -> DataFrame:
    """Rows (repo_id, path, item, name, detail): every entity with its table name
    (or ''), its relations with their target, and the named elements and complex types
    of schemas. The table's name is the ``name`` of ``@Table`` itself; a relation's
    target is the type of its field or getter, or that type's last type argument.
    """
    own = F.col("_t")
    table = F.flatten(F.transform(_annotated(own["annotations"], "Table"), lambda a: _argument(a, "name")))
    relations = F.flatten(F.transform(own["members"], lambda m: F.transform(
        _annotated(m["annotations"], *RELATIONS), lambda a: F.struct(a["name"].alias("item"), own["type"].alias("name"), m["target"].alias("detail"))
    )))
    entity = F.struct(F.lit("entity").alias("item"), own["type"].alias("name"), F.coalesce(F.get(table, F.lit(0)), F.lit("")).alias("detail"))
    java = (
        _java_types(files.where(F.col("content").rlike(r"@(?:[\w.]+\.)?Entity\b")))
        .where(own["kind"].isin("class", "record") & (F.size(_annotated(own["annotations"], "Entity")) > 0))
        .select("repo_id", "path", F.inline(F.concat(F.array(entity), relations)))
    )

    tag = F.col("_tag")
    schemas = (
        of_suffix(files, (".xsd",))
        .select("repo_id", "path", F.explode(_tags(F.col("content"), "element|complexType")).alias("_tag"))
        .select(
            "repo_id",
            "path",
            F.when(_is_tag(tag, "element"), "element").otherwise("complexType").alias("item"),
            _attribute(tag, "name").alias("name"),
            F.lit("").alias("detail"),
        )
        .where(F.col("name").isNotNull())
    )
    return java.unionByName(schemas)


def process_parts(files: DataFrame) -> DataFrame:
    """Rows (repo_id, path, process, item, name, detail) of process files in both forms.

    Items: ``activity`` and ``starter`` with their type ('' without one), ``transition``
    from name to detail (links of the executable form are joined source to target), and
    ``call`` of a process, by the base name of its path.
    """
    return of_suffix(files, (".bwp", ".process")).select(
        "repo_id", "path", F.regexp_replace(basename(F.col("path")), r"\.[^.]+\z", "").alias("process"), F.inline(process_items(F.col("content")))
    )


def bw_process_inventory(files: DataFrame) -> DataFrame:
    """Activities (starters too), transitions, calls and callers (fan-in) per process."""
    parts = process_parts(files)
    own = F.struct(
        F.col("process"),
        F.col("item").isin("activity", "starter").cast("int").alias("a"),
        (F.col("item") == "transition").cast("int").alias("t"),
        (F.col("item") == "call").cast("int").alias("c"),
        F.lit(0).alias("f"),
    )
    called = F.struct(
        F.when(F.col("item") == "call", F.col("name")).alias("process"),
        F.lit(0).alias("a"), F.lit(0).alias("t"), F.lit(0).alias("c"), F.lit(1).alias("f"),
    )
    return (
        parts.select("repo_id", F.inline(F.array(own, called)))
        .where(F.col("process").isNotNull())
        .groupBy("repo_id", "process")
        .agg(
            F.sum("a").alias("activities"), F.sum("t").alias("transitions"),
            F.sum("c").alias("calls"), F.sum("f").alias("fan_in"),
        )
    )


def activity_types(files: DataFrame) -> DataFrame:
    return (
        process_parts(files).where(F.col("item").isin("activity", "starter"))
        .groupBy("repo_id", F.col("detail").alias("activity_type"))
        .agg(F.count(F.lit(1)).alias("activities"))
    )
