import random

import pytest
from pyspark.sql import functions as F

from codexfold import constants as K
from codexfold.operators import events as V

LOG = "session_id bigint, seq bigint, type string, step string, content string, message string, brd string"
TYPES = ["step-change", "plan-stream", "code-stream", "re-stream", "brd-ready", "plan-ready", "code-ready", "step-start", "connected"]


def random_log(seed, sessions=8, n=400):
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        kind = rng.choice(TYPES) if rng.random() < 0.985 else rng.choice(["error", "workflow-complete"])
        out.append(
            (rng.randrange(sessions), seq, kind,
             rng.choice(["", "plan-generation", "code-generation", "odd", None]) if kind == "step-change" else None,
             rng.choice([None, "", f"c{seq} ", "😀"]), rng.choice([None, "boom"]), rng.choice([None, f"b{seq}"]))
        )
    return out


def frame(spark, log):
    return spark.createDataFrame(random.sample(log, len(log)), LOG).repartition(7)


def reduce_model(log):
    """Fold of one event after the other, as a reader of the stream does it."""
    views = {}
    for sid, seq, kind, step, content, message, brd in sorted(log, key=lambda e: e[1]):
        v = views.setdefault(
            sid, dict(step="upload", error=None, text="", chunks=0, segment=0, run=0, runs=[], progress=[], k=0, over=False)
        )
        if v["over"]:
            continue
        step_before = v["step_set"] if "step_set" in v else None
        if kind in K.STREAM_TYPES:
            v["text"] += content or ""
            v["chunks"] += 1
            if content:
                v["k"] += 1
                v["progress"].append((seq, min(5 + 3 * v["k"], 92)))
        elif kind in K.READY_TYPES or (kind == "step-change" and step):
            ready = kind in K.READY_TYPES
            if v["chunks"] or ready:
                own = {"brd-ready": brd, "plan-ready": content}.get(kind, "") if ready else None
                text = v["text"] if own is None else own
                v["runs"].append((v["segment"], v["run"], step_before, kind, text))
            v["text"], v["chunks"] = "", 0
            v["run"] += 1
            if ready:
                v["progress"].append((seq, 100))
                if kind in K.READY_STEP:
                    v["step"] = v["step_set"] = K.READY_STEP[kind]
            else:
                v["segment"] += 1
                v["k"] = 0
                v["progress"].append((seq, 0))
                v["step"] = v["step_set"] = step
        elif kind in K.TERMINAL_STEP:
            v["over"] = True
            v["step"] = K.TERMINAL_STEP[kind]
            if kind == "error":
                v["error"] = message if message is not None else K.DEFAULT_ERROR
    for v in views.values():
        v["closed"] = list(v["runs"])
        if v["chunks"]:
            v["runs"].append((v["segment"], v["run"], v.get("step_set"), None, v["text"]))
    return views


@pytest.mark.parametrize("seed,hot_rows,part_chars", [(1, 10**6, 1 << 24), (2, 3, 1 << 24), (3, 50, 6)])
def test_segments_and_progress_equal_fold(spark, seed, hot_rows, part_chars):
    log = random_log(seed)
    df, views = frame(spark, log), reduce_model(log)
    runs = {}
    for r in V.stream_segments(df, part_chars, hot_rows).orderBy("part").collect():
        key = (r.session_id, r.segment, r.run, r.step, r.closed_by)
        runs[key] = runs.get(key, "") + r.text
    assert runs == {(sid, *run[:4]): run[4] for sid, v in views.items() for run in v["runs"]}
    progress = {(r.session_id, r.seq): r.progress for r in V.stream_progress(df, hot_rows).collect()}
    assert progress == {(sid, seq): p for sid, v in views.items() for seq, p in v["progress"]}


@pytest.mark.parametrize("seed", [4, 5])
def test_status_equals_fold(spark, seed):
    log = random_log(seed)
    got = {r.session_id: (r.step, r.error) for r in V.status_reduce(frame(spark, log)).collect()}
    assert got == {sid: (v["step"], v["error"]) for sid, v in reduce_model(log).items()}


def test_route(spark):
    log = random_log(6)
    sessions = spark.createDataFrame([(s,) for s in range(0, 8, 2)], "session_id bigint")
    got = {(r.session_id, r.seq) for r in V.event_route(frame(spark, log), sessions).collect()}
    end = {}
    for sid, seq, kind, *_ in log:
        if kind in K.TERMINAL_STEP:
            end.setdefault(sid, seq)
    assert got == {(s, q) for s, q, *_ in log if s % 2 == 0 and q <= end.get(s, 10**9)}


@pytest.mark.parametrize("hot_rows", [2, 10**6])
def test_heartbeats(spark, hot_rows):
    rows = [(1, 0, 0), (1, 1, 29_999_999), (1, 2, 60_000_000), (1, 3, 155_000_000), (2, 0, 0), (1, 9, 185_000_000)]
    df = spark.createDataFrame(rows, "session_id bigint, seq bigint, us bigint").selectExpr("session_id", "seq", "timestamp_micros(us) AS ts")
    got = {(r.seq, r.gap_us, r.heartbeats) for r in V.idle_heartbeat(df, hot_rows=hot_rows).collect()}
    assert got == {(2, 30_000_001, 1), (3, 95_000_000, 3), (9, 30_000_000, 1)}
    ntz = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert {(r.seq, r.gap_us, r.heartbeats) for r in V.idle_heartbeat(ntz, hot_rows=hot_rows).collect()} == got


def test_envelope_round_trip(spark):
    df = spark.createDataFrame([("plan-stream", 1, "a\n\"é😀"), ("error", 2, None)], "type string, session_id bigint, content string")
    lines = V.event_encode(df).collect()
    assert lines[1].line == '{"type":"error","session_id":2}'
    bad = spark.createDataFrame([(r.line,) for r in lines] + [("{oops",), ("",)], "line string")
    back = V.event_decode(bad).collect()
    assert [r.valid for r in back] == [True, True, False, False]
    assert (back[0].event.content, back[1].event.content) == ("a\n\"é😀", None)


def test_step_flags(spark):
    status = spark.createDataFrame([(1, "plan-review"), (2, "complete"), (3, "error"), (4, "brd-generation"), (5, "upload")], "session_id int, step string")
    rows = {}
    for r in V.step_flags(status).orderBy("idx").collect():
        rows.setdefault(r.session_id, []).append("C" if r.is_complete else "x" if r.is_current else "p" if r.is_pending else "?")
    assert {k: "".join(v) for k, v in rows.items()} == {1: "CCCCxpp", 2: "CCCCCCC", 3: "ppppppp", 4: "ppppppp", 5: "xpppppp"}
