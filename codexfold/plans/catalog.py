"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexfold.constants import EMPTY_DIGEST
from codexfold.functions.text import lossy_utf8
from codexfold.operators import context, corpus, documents, events, exports, intake, packing, session, specs
from codexfold.plans import flow
from codexfold.plans.bindings import bind
from codexfold.sources.archives import archive_explode

MARKERS = (
    ("controller", r"@RestController\b", "@Path"),
    ("get_mapping", r"@GetMapping\b", "@GET"),
    ("entity", r"@Entity\b", "PanacheEntity"),
    ("list_field", r"\bjava\.util\.List<", "List"),
)
MAPPED_ANNOTATIONS = ("RestController", "GetMapping", "PostMapping")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _kept(spark: SparkSession, sf: str) -> DataFrame:
    return intake.source_files(bind(spark, sf, "files"))


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_budget(_kept(spark, sf), chars="n_chars")


def _digests(spark: SparkSession, sf: str) -> DataFrame:
    return packing.repo_digest(_packed(spark, sf))


def _generated(spark: SparkSession, sf: str, **options) -> DataFrame:
    return documents.fenced_files(
        bind(spark, sf, "fenced_docs"), ["doc_id", "repo_id", "pattern"], **options
    )


def _state(spark: SparkSession, sf: str) -> DataFrame:
    return session.state_fold(bind(spark, sf, "deltas"), bind(spark, sf, "sessions"))


def _session_files(spark: SparkSession, sf: str) -> DataFrame:
    return _generated(spark, sf).withColumnRenamed("doc_id", "session_id")


# -- intake ------------------------------------------------------------------


@query
def archive_explode_roundtrip(spark, sf):
    """Archives written by the export, read back entry by entry."""
    archives = exports.code_archive_export(_session_files(spark, sf)).select(
        F.col("session_id").cast("string").alias("repo_id"), F.col("zip").alias("content")
    )
    return archive_explode(archives).withColumn("content", lossy_utf8(F.col("content")))


@query
def loose_file_intake(spark, sf):
    uploads = bind(spark, sf, "uploads").withColumn("content", F.col("content").cast("binary"))
    return intake.loose_file_intake(uploads).select("upload_id", "name", "kind", "files_found", "text")


@query
def extension_filter(spark, sf):
    return intake.extension_filter(bind(spark, sf, "files")).select("repo_id", "ord", "path")


@query
def vendored_dir_filter(spark, sf):
    return intake.vendored_dir_filter(bind(spark, sf, "files")).select("repo_id", "ord", "path")


@query
def lossy_utf8_decode(spark, sf):
    """Every text with a stray byte in front and a cut sequence at its end."""
    broken = bind(spark, sf, "files").withColumn(
        "content",
        F.concat(F.unhex(F.lit("FF")), F.col("content").cast("binary"), F.unhex(F.lit("E282"))),
    )
    return intake.lossy_utf8_decode(broken).select("repo_id", "ord", "path", "content")


@query
def upload_gate(spark, sf):
    return intake.upload_gate_report(bind(spark, sf, "uploads"))


@query
def empty_repo_rejects(spark, sf):
    """Customers as repositories, most of them without any packed file."""
    repos = bind(spark, sf, "sessions").select(F.concat(F.lit("src"), "session_id").alias("repo_id"))
    return intake.empty_repo_rejects(repos, _digests(spark, sf))


@query
def pattern_validate(spark, sf):
    return intake.pattern_validate(bind(spark, sf, "uploads")).select("upload_id", "pattern", "target_lang", "valid")


# -- packing and messages ----------------------------------------------------


@query
def file_frame(spark, sf):
    return packing.file_frame(_kept(spark, sf)).select("repo_id", "ord", "chunk")


@query
def pack_budget(spark, sf):
    return _packed(spark, sf).select("repo_id", "ord", "path", "running_chars")


@query
def repo_digest(spark, sf):
    return _digests(spark, sf)


@query
def marker_count(spark, sf):
    return packing.marker_count(_digests(spark, sf)).select("repo_id", "files_found", "files_packed")


@query
def analysis_message(spark, sf):
    return packing.analysis_message(_digests(spark, sf)).select("repo_id", "message")


@query
def plan_message(spark, sf):
    return packing.plan_message(_state(spark, sf)).select("session_id", "message")


@query
def code_message(spark, sf):
    return packing.code_message(_state(spark, sf)).select("session_id", "message")


# -- context -----------------------------------------------------------------


def _context_text(spark, sf):
    raw = bind(spark, sf, "context_files").withColumn("content", F.col("content").cast("binary"))
    return context.context_text(raw)


@query
def context_text(spark, sf):
    return _context_text(spark, sf).select("session_id", "seq", "name", "suffix", "status", "text")


@query
def context_status(spark, sf):
    return context.context_status_report(_context_text(spark, sf))


@query
def context_accumulate(spark, sf):
    return context.context_accumulate(_context_text(spark, sf), part_chars=2_000)


@query
def context_before_gate(spark, sf):
    confirms = bind(spark, sf, "reviews").where((F.col("stage") == "brd") & F.col("tech").isNotNull())
    return context.context_before_gate(
        bind(spark, sf, "context_files"), confirms, bind(spark, sf, "sessions")
    ).select("session_id", "seq", "name", "reason", "accepted")


# -- documents ---------------------------------------------------------------


@query
def section_split(spark, sf):
    return documents.section_split(bind(spark, sf, "section_docs"))


@query
def section_rules(spark, sf):
    return documents.section_rule_report(documents.section_split(bind(spark, sf, "section_docs")))


@query
def fenced_files(spark, sf):
    return _generated(spark, sf)


@query
def fence_fallback(spark, sf):
    return documents.fallback_files(bind(spark, sf, "fenced_docs"))


@query
def diagram_blocks(spark, sf):
    return documents.diagram_blocks(bind(spark, sf, "fenced_docs"))


@query
def language_normalise(spark, sf):
    return documents.language_normalise(_generated(spark, sf)).groupBy("language").agg(F.count(F.lit(1)).alias("files"))


@query
def path_split(spark, sf):
    return documents.directory_rollup(_generated(spark, sf), ["repo_id"])


@query
def test_file_flag(spark, sf):
    return documents.test_ratio(_generated(spark, sf), ["repo_id"])


@query
def merge_by_path(spark, sf):
    """Files of each source merged with the rewritten files of its neighbour."""
    files = _generated(spark, sf).withColumn("ord", F.col("doc_id") * 1000 + F.col("ord"))
    fixes = files.withColumn("content", F.concat(F.lit("fix:"), "content")).withColumn(
        "repo_id", F.concat(F.lit("src"), (F.substring("repo_id", 4, 9).cast("bigint") + 1) % 20)
    )
    return documents.merge_by_path(files, fixes)


# -- session state -----------------------------------------------------------


@query
def state_fold(spark, sf):
    return _state(spark, sf)


@query
def state_defaults(spark, sf):
    return session.state_defaults(bind(spark, sf, "sessions"))


def _stored(spark, sf):
    return bind(spark, sf, "sessions").select("session_id", F.lit("brd").alias("stage"), F.col("source_code").alias("value"))


@query
def review_deltas(spark, sf):
    return session.review_deltas(bind(spark, sf, "reviews"))


@query
def review_patch(spark, sf):
    return session.review_patch(bind(spark, sf, "reviews"), _stored(spark, sf))


@query
def review_patch_keep_edit(spark, sf):
    return session.review_patch(bind(spark, sf, "reviews"), keep_edit=True)


@query
def review_writes(spark, sf):
    """Reviews of documents that were stored before."""
    stored = _stored(spark, sf).select("session_id", F.lit(-1).cast("bigint").alias("seq"), F.col("stage").alias("key"), "value")
    return session.review_writes(bind(spark, sf, "reviews"), stored)


@query
def reviewed_code_message(spark, sf):
    """Answers, their reviews and the context uploads folded as of the start of the code stage."""
    sessions, reviews = bind(spark, sf, "sessions"), bind(spark, sf, "reviews").drop("ts")
    apart = lambda df, step: df.withColumn("seq", 4 * F.col("seq") + step)  # noqa: E731, events make several rows
    deltas = apart(bind(spark, sf, "deltas").drop("ts"), 0).where("key != 'additional_context'")
    files = apart(bind(spark, sf, "context_files").withColumn("content", F.col("content").cast("binary")), 1)
    confirms = apart(reviews, 2).where((F.col("stage") == "plan") & (F.col("seq") % 7 == 0))
    log = flow.reviewed_deltas(deltas, apart(reviews, 2)).unionByName(flow.context_deltas(files, confirms, sessions))
    return flow.stage_messages(sessions, log, apart(bind(spark, sf, "stage_starts"), 3), "code")


@query
def review_spec(spark, sf):
    return session.review_spec(bind(spark, sf, "reviews"))


@query
def state_as_of(spark, sf):
    return session.state_as_of(bind(spark, sf, "deltas"), bind(spark, sf, "stage_starts"))


@query
def pending_review(spark, sf):
    return session.pending_review(bind(spark, sf, "ready"), bind(spark, sf, "confirms"))


@query
def session_snapshot(spark, sf):
    """State whose file list is the JSON text of the files generated for it."""
    files = (
        _session_files(spark, sf)
        .groupBy("session_id")
        .agg(F.to_json(F.sort_array(F.collect_list(F.struct("ord", "path", "content", "language")))).alias("value"))
        .select("session_id", F.lit(1_000_000_000_000).alias("seq"), F.lit("generated_files_json").alias("key"), "value")
    )
    deltas = bind(spark, sf, "deltas").drop("ts").unionByName(files)
    snapshot = session.session_snapshot(session.state_fold(deltas, bind(spark, sf, "sessions")))
    return snapshot.select(
        "session_id", "pattern", "brd", "plan",
        F.size("generated_files").cast("bigint").alias("files"),
        F.array_join(F.transform("generated_files", lambda f: f["path"]), ",").alias("paths"),
    )


# -- events ------------------------------------------------------------------


@query
def event_envelope(spark, sf):
    return events.event_decode(bind(spark, sf, "lines"), "k bigint").select("seq", "valid", "event.k")


@query
def event_encode(spark, sf):
    log = bind(spark, sf, "event_log").select("type", "session_id", "seq", "step", "message")
    return events.event_encode(log)


@query
def event_route(spark, sf):
    return events.event_route(bind(spark, sf, "event_log"), bind(spark, sf, "sessions")).select("session_id", "seq", "type")


@query
def stream_segments(spark, sf):
    return events.stream_segments(bind(spark, sf, "event_log"))


@query
def stream_segments_chat(spark, sf):
    return events.stream_segments(bind(spark, sf, "chat_log"), part_chars=2_000)


@query
def stream_progress(spark, sf):
    return events.stream_progress(bind(spark, sf, "event_log"))


@query
def status_reduce(spark, sf):
    return events.status_reduce(bind(spark, sf, "event_log"))


@query
def idle_heartbeat(spark, sf):
    return events.idle_heartbeat(bind(spark, sf, "event_log"))


@query
def step_flags(spark, sf):
    return events.step_flags(events.status_reduce(bind(spark, sf, "event_log"))).withColumn("idx", F.col("idx").cast("bigint"))


@query
def step_funnel(spark, sf):
    return events.step_funnel(events.status_reduce(bind(spark, sf, "event_log"))).withColumn("idx", F.col("idx").cast("bigint"))


# -- sinks -------------------------------------------------------------------


@query
def artifact_export(spark, sf):
    return exports.artifact_export(_state(spark, sf))


@query
def code_archive_export(spark, sf):
    return exports.code_archive_export(_session_files(spark, sf)).drop("zip")


# -- corpus analyses ---------------------------------------------------------


@query
def tech_stack_profile(spark, sf):
    return corpus.tech_stack_profile(bind(spark, sf, "files"))


@query
def package_inventory(spark, sf):
    return corpus.package_inventory(bind(spark, sf, "java_files"))


@query
def dependency_edges(spark, sf):
    return corpus.dependency_edges(bind(spark, sf, "java_files"))


@query
def dependency_degrees(spark, sf):
    return corpus.dependency_degrees(corpus.dependency_edges(bind(spark, sf, "java_files")))


@query
def type_hierarchy(spark, sf):
    return corpus.type_hierarchy(bind(spark, sf, "java_files"))


@query
def hierarchy_roots(spark, sf):
    return corpus.hierarchy_roots(bind(spark, sf, "java_files"))


@query
def endpoint_inventory(spark, sf):
    return corpus.endpoint_inventory(bind(spark, sf, "java_files"))


@query
def config_inventory(spark, sf):
    return corpus.config_inventory(bind(spark, sf, "config_files"))


@query
def library_inventory(spark, sf):
    return corpus.library_inventory(bind(spark, sf, "pom_files"))


@query
def library_replacements(spark, sf):
    """The inventory with what each library is to be replaced by."""
    return corpus.library_inventory(bind(spark, sf, "pom_files"), bind(spark, sf, "replacements"))


@query
def config_unread(spark, sf):
    """Lines of settings that could not be read: every file with a reference at its end."""
    broken = bind(spark, sf, "config_files").where("path LIKE '%.y%ml'").withColumn("content", F.concat("content", F.lit("\nref: *other")))
    return corpus.config_unread(broken)


@query
def feature_markers(spark, sf):
    return corpus.feature_markers(bind(spark, sf, "java_files"), MARKERS)


@query
def unmapped_annotations(spark, sf):
    return corpus.unmapped_annotations(bind(spark, sf, "java_files"), MAPPED_ANNOTATIONS)


@query
def entity_model(spark, sf):
    return corpus.entity_model(bind(spark, sf, "java_files"))


@query
def bw_process_inventory(spark, sf):
    return corpus.bw_process_inventory(bind(spark, sf, "process_files"))


@query
def bw_activity_types(spark, sf):
    return corpus.activity_types(bind(spark, sf, "process_files"))


# -- specifications, plans and generated code ---------------------------------


@query
def impact_matrix(spark, sf):
    return specs.impact_matrix(bind(spark, sf, "impact_docs")).withColumn("level", F.col("level").cast("bigint"))


@query
def plan_tasks(spark, sf):
    return specs.plan_tasks(bind(spark, sf, "plan_docs"))


@query
def manifest_coverage(spark, sf):
    return specs.manifest_coverage(bind(spark, sf, "manifest_docs"), bind(spark, sf, "generated_files"))


@query
def required_outputs(spark, sf):
    sessions = bind(spark, sf, "fenced_docs").select(F.col("doc_id").alias("session_id"), "pattern")
    return specs.required_outputs(sessions, _session_files(spark, sf))


@query
def migrated_markers(spark, sf):
    return specs.migrated_markers(bind(spark, sf, "java_files"))


@query
def top_reasons(spark, sf):
    return specs.top_reasons(bind(spark, sf, "java_files"), 3).withColumn("rank", F.col("rank").cast("bigint"))


@query
def endpoint_drift(spark, sf):
    code = corpus.endpoint_inventory(bind(spark, sf, "java_files"))
    return specs.endpoint_drift(bind(spark, sf, "openapi_docs"), code)


@query
def diagram_edges(spark, sf):
    return specs.diagram_edges(bind(spark, sf, "fenced_docs"))


@query
def diagram_nodes(spark, sf):
    return specs.diagram_nodes(bind(spark, sf, "fenced_docs"), ["repo_id"])


@query
def diagram_against_code(spark, sf):
    drawn = specs.diagram_edges(bind(spark, sf, "fenced_docs"), ["repo_id"])
    code = corpus.dependency_edges(bind(spark, sf, "java_files"))
    return specs.diagram_against_code(drawn, code)
