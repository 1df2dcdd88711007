"""From uploads to files over several sessions at once."""

import io
import zipfile

from codexfold import constants as K
from codexfold.operators import exports
from codexfold.plans import flow
from test_archives import ENTRIES, archive

ANSWER = "session_id bigint, seq bigint, text string"


def test_flow(spark):
    uploads = spark.createDataFrame(
        [
            (1, "a.zip", "java-to-go", bytearray(archive(ENTRIES))), (2, "B.java", "java17-to-java25", bytearray(b"class B {\xff}")),
            (3, "c.zip", "java-to-go", bytearray(archive([("x.md", b"y")]))), (4, "d.java", "none", bytearray(b"d")),
            (5, "e.java", "java-to-go", bytearray(b" \n")), (6, "f.zip", "java-to-go", bytearray(b"no zip")),
        ],
        "upload_id bigint, name string, pattern string, content binary",
    )
    everything = flow.upload_sessions(uploads)
    rows = {r.session_id: r for r in everything.collect()}
    assert {k: r.reason for k, r in rows.items()} == {
        1: None, 2: None, 3: "no readable source files", 4: "unknown pattern",
        5: "no readable source files", 6: "no readable source files",
    }
    assert (rows[1].files_found, rows[2].files_found) == (3, 1)
    assert rows[2].source_code == "class B {�}"
    sessions = everything.where("reason IS NULL")
    messages = {r.session_id: r.message for r in flow.analysis_messages(everything).collect()}
    assert messages[2] == K.ANALYSIS_LEAD + "class B {�}" and set(messages) == {1, 2}

    text = "<!-- SECTION: ANALYSIS -->a<!-- SECTION: BRD -->brd1<!-- SECTION: TECHNICAL_SPECIFICATION -->spec1<!-- SECTION: END -->"
    deltas = flow.analysis_deltas(spark.createDataFrame([(1, 10, text), (2, 10, "whole")], ANSWER))
    reviews = spark.createDataFrame([(1, 20, "brd", "lost", None, "note")], "session_id bigint, seq bigint, stage string, content string, tech string, feedback string")
    deltas = flow.reviewed_deltas(deltas, reviews).unionByName(flow.answer_deltas(spark.createDataFrame([(1, 40, "the plan")], ANSWER), "plan"))
    files = spark.createDataFrame(
        [(1, 12, "a.md", bytearray(b"first")), (1, 13, "b.json", bytearray(b"[1]")), (1, 25, "late.md", bytearray(b"x")), (7, 1, "n.md", bytearray(b"y"))],
        "session_id bigint, seq bigint, name string, content binary",
    )
    added = flow.context_deltas(files, reviews, sessions)
    assert [tuple(r) for r in added.collect()] == [
        (1, 13, "additional_context", f"{K.CONTEXT_HEAD}a.md{K.CONTEXT_TAIL}first{K.CONTEXT_HEAD}b.json{K.CONTEXT_TAIL}[\n  1\n]")
    ]
    deltas = deltas.unionByName(added)
    starts = spark.createDataFrame([(1, 15, "plan"), (1, 50, "code"), (2, 30, "plan")], "session_id bigint, seq bigint, stage string")
    plan = {r.session_id: r.message for r in flow.stage_messages(sessions, deltas, starts, "plan").collect()}
    assert plan[1].startswith(K.PLAN_LEAD + "brd1" + K.PLAN_SPEC_LEAD + "spec1" + K.PLAN_CONTEXT_LEAD) and "first" in plan[1] and "late" not in plan[1]
    assert plan[2] == K.PLAN_LEAD + "whole" and set(plan) == {1, 2}
    code = {r.session_id: r.message for r in flow.stage_messages(sessions, deltas, starts, "code").collect()}
    assert set(code) == {1}
    assert K.CODE_BRD_LEAD + "brd1" + K.FEEDBACK_LEAD + "note" in code[1] and K.CODE_PLAN_LEAD + "the plan" in code[1]

    answers = spark.createDataFrame([(1, 60, "```go:go.mod\nmodule m\n```\n```\nx\n```"), (2, 60, "no block")], ANSWER)
    files = flow.generated_files(answers, sessions)
    archives = {r.session_id: r for r in exports.code_archive_export(files).collect()}
    assert archives[1].filename == "java-to-go-migrated.zip"
    with zipfile.ZipFile(io.BytesIO(bytes(archives[1].zip))) as z:
        assert z.namelist() == ["go.mod", "output.go"]
    assert archives[2].files == 1
