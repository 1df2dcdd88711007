"""A stream fed in 1, 2 and many micro-batches ends where the batch operator does."""

import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexfold.operators import events, session
from codexfold.streaming import gates, sources, stateful
from test_events import LOG, random_log, reduce_model
from test_session import REVIEW, patch_model, random_reviews


def run(spark, tmp_path, rows, schema, batches, build, mode="append", shuffled=True, closed=True):
    """Deal rows to ``batches`` files, stream one file per trigger, then close the log.

    Rows have a time: their own ``ts``, or one second per number. With
    ``shuffled`` a session's events are spread over all files in no order.
    """
    own = sources.stream_session(spark)
    feed, marks = tmp_path / "feed", str(tmp_path / "marks")
    rows = random.sample(rows, len(rows)) if shuffled else rows
    size = -(-len(rows) // batches)
    for i in range(batches):
        piece = spark.createDataFrame(rows[i * size: (i + 1) * size], schema)
        if "ts" not in piece.columns:
            piece = piece.withColumn("ts", F.timestamp_seconds(F.col("seq") + 10**9))
        piece.coalesce(1).write.mode("append").parquet(str(feed))
    schema = spark.read.parquet(str(feed)).schema
    for closing in (False, True) if closed else (False,):
        source = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(feed))
        stream = build(sources.with_close(source, marks) if closed else source)
        if closing:
            sources.close_log(own, marks)
        sources.write_updates(stream, str(tmp_path / "out"), str(tmp_path / "state"), mode).awaitTermination()
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])).parquet(str(tmp_path / "out"))


LONG = "30 days"
BATCHES = [1, 4]


@pytest.mark.parametrize("batches", BATCHES)
def test_segments(spark, tmp_path, batches):
    log = random_log(11, 6, 250)
    table = run(spark, tmp_path, log, LOG, batches, lambda e: stateful.segments_stream(e, LONG), "update")
    rows = sources.latest(table, ["session_id", "segment", "run"]).collect()
    got = {(r.session_id, r.segment, r.run, r.step, r.closed_by, r.text) for r in rows}
    assert got == {(s, *x) for s, v in reduce_model(log).items() for x in v["runs"]}


@pytest.mark.parametrize("batches", BATCHES)
def test_progress(spark, tmp_path, batches):
    log = random_log(12, 6, 250)
    table = run(spark, tmp_path, log, LOG, batches, lambda e: stateful.progress_stream(e, LONG))
    got = {(r.session_id, r.seq, r.progress) for r in table.collect()}
    assert got == {(s, q, p) for s, v in reduce_model(log).items() for q, p in v["progress"]}


@pytest.mark.parametrize("batches", BATCHES)
def test_status(spark, tmp_path, batches):
    log = random_log(13, 6, 250)
    table = run(spark, tmp_path, log, LOG, batches, stateful.status_stream, "update", closed=False)
    got = {r.session_id: (r.step, r.error) for r in sources.latest(table, ["session_id"]).collect()}
    assert got == {s: (v["step"], v["error"]) for s, v in reduce_model(log).items()}


@pytest.mark.parametrize("batches", [1, 3])
def test_fold(spark, tmp_path, batches):
    rng = random.Random(14)
    deltas = [(rng.randrange(4), q, rng.choice("ab"), f"v{q}") for q in range(90)]
    schema = "session_id bigint, seq bigint, key string, value string"
    table = run(spark, tmp_path, deltas, schema, batches, stateful.fold_stream, "update", closed=False)
    got = {(r.session_id, r.key): r.value for r in sources.latest(table, ["session_id", "key"]).collect()}
    assert got == {(s, k): v for s, _, k, v in deltas}


@pytest.mark.parametrize("keep_edit", [False, True])
def test_reviews_of_stored_documents(spark, tmp_path, keep_edit):
    """Every write as the batch operator gives it, and the last one as a loop does."""
    reviews = random_reviews(15)
    before = {(s, st): f"stored{s}" for s in range(3) for st in ("brd", "plan")}
    stored = spark.createDataFrame([(s, st, v) for (s, st), v in before.items()], "session_id bigint, stage string, value string")
    table = run(spark, tmp_path, reviews, REVIEW, 3, lambda r: stateful.review_stream(r, keep_edit, stored, LONG))
    last = dict(before)
    for r in table.where("key = stage").orderBy("seq").collect():
        last[r.session_id, r.stage] = r.value
    assert last == patch_model(reviews, before, keep_edit)
    log = stored.selectExpr("session_id", "-1L AS seq", "stage AS key", "value")
    batch = session.review_writes(spark.createDataFrame(reviews, REVIEW), log, keep_edit)
    assert sorted(map(repr, table.drop("batch_id").collect())) == sorted(map(repr, batch.collect()))


def test_route(spark, tmp_path):
    log = random_log(16, 6, 250)
    sessions = spark.createDataFrame([(s,) for s in (0, 2, 4)], "session_id bigint")
    table = run(spark, tmp_path, log, LOG, 3, lambda e: stateful.route_stream(e, sessions, LONG))
    batch = events.event_route(spark.createDataFrame(log, LOG), sessions)
    assert sorted((r.session_id, r.seq) for r in table.collect()) == sorted((r.session_id, r.seq) for r in batch.collect())


def test_heartbeats(spark, tmp_path):
    rng = random.Random(17)
    kinds = {40: "error", 61: "workflow-complete"}
    rows = [(rng.randrange(3), q, datetime.fromtimestamp(q * 13 + rng.random(), UTC), kinds.get(q, "re-stream")) for q in range(80)]
    schema = "session_id bigint, seq bigint, ts timestamp, type string"
    table = run(spark, tmp_path, rows, schema, 3, lambda e: stateful.heartbeat_stream(e, lateness=LONG))
    batch = events.idle_heartbeat(spark.createDataFrame(rows, schema))
    ends = {r[0]: r[1] for r in reversed(rows) if r[3] != "re-stream"}
    assert all(r.seq <= ends.get(r.session_id, 80) for r in batch.collect())
    assert sorted(map(tuple, table.drop("batch_id").collect())) == sorted(map(tuple, batch.collect()))


def test_numbers_without_gaps_need_no_clock(spark, tmp_path):
    log, n = [], {}
    for sid, _, *rest in random_log(18, 5, 200):
        n[sid] = n.get(sid, -1) + 1
        log.append((sid, n[sid], *rest))
    again = log + log[::9]  # delivered twice
    table = run(spark, tmp_path, again, LOG, 5, lambda e: stateful.progress_stream(e.drop("ts"), dense_from=0), closed=False)
    got = {(r.session_id, r.seq, r.progress) for r in table.collect()}
    assert got >= {(s, q, p) for s, v in reduce_model(log).items() for q, p in v["progress"]}
    assert len({(s, q) for s, q, _ in got}) == len(got)


def test_what_is_within_the_lateness_waits(spark, tmp_path):
    """Events come out as the watermark passes them, in order, the last ones when the log is closed."""
    rows = [(1, 3, "code-ready"), (1, 1, "plan-ready"), (1, 2, "code-ready"), (1, 5_000, "code-ready"), (1, 4_000, "plan-ready"), (1, 9_000, "code-ready")]
    table = run(spark, tmp_path, rows, "session_id bigint, seq bigint, type string", 6, lambda e: stateful.progress_stream(e, "1 hour"), shuffled=False)
    batches = [r.seq for r in table.orderBy("batch_id", "seq").collect()]
    assert batches == [1, 2, 3, 4_000, 5_000, 9_000]
    assert table.where("seq <= 3").select("batch_id").first()[0] < table.where("seq = 9000").select("batch_id").first()[0]


def test_the_flag_of_an_ended_session_goes(spark, tmp_path):
    day = 86_400
    rows = [(1, 10, "error"), (1, 20, "code-ready"), (2, 40 * day, "code-ready"), (1, 50 * day, "plan-ready")]
    table = run(spark, tmp_path, rows, "session_id bigint, seq bigint, type string", 4, lambda e: stateful.progress_stream(e, "1 hour", keep_days=30), shuffled=False)
    assert sorted((r.session_id, r.seq) for r in table.collect()) == [(1, 50 * day), (2, 40 * day)]


def test_events_need_a_time_or_dense_numbers(spark):
    with pytest.raises(ValueError, match="dense_from"):
        stateful.progress_stream(spark.range(1).selectExpr("id AS session_id", "id AS seq", "'x' AS type"))


def test_settings_of_the_caller_stay(spark):
    before = dict(spark.conf.getAll.items())
    own = sources.stream_session(spark)
    assert dict(spark.conf.getAll.items()) == before
    assert own.conf.get("spark.sql.streaming.stateStore.providerClass") == sources.ROCKSDB
    assert own.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")


def test_live_heartbeats_come_during_silence(spark, tmp_path):
    own = sources.stream_session(spark)
    feed = tmp_path / "feed"
    schema = "session_id bigint, seq bigint, ts timestamp"
    spark.sql("SELECT 1L AS session_id, 1L AS seq, current_timestamp() AS ts").coalesce(1).write.parquet(str(feed))
    stream = stateful.heartbeat_stream(own.readStream.schema(schema).parquet(str(feed)), idle_seconds=1, live=True)
    query = (
        stream.writeStream.format("memory").queryName("beats").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()
    )
    try:
        for _ in range(60):
            query.awaitTermination(1)
            if own.table("beats").count() >= 2:
                break
        rows = own.table("beats").collect()
    finally:
        query.stop()
    assert len(rows) >= 2 and {(r.session_id, r.seq, r.heartbeats) for r in rows} == {(1, None, 1)}


def test_event_lines_drop_invalid(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"type":"error","session_id":1,"seq":4}\n{oops\n{"type":"brd-ready","session_id":1,"seq":2}\n')
    stream = sources.read_event_lines(spark, str(tmp_path / "in")).select("session_id", "seq", "type")
    sources.write_updates(stream, str(tmp_path / "out"), str(tmp_path / "state"), "append").awaitTermination()
    assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 4]


def _gate_inputs(spark, tmp_path, left, right, left_schema, right_schema):
    own, frames = sources.stream_session(spark), []
    for name, batches, schema in (("l", left, left_schema), ("r", right, right_schema)):
        folder = tmp_path / name
        for piece in batches:
            spark.createDataFrame(piece, schema).coalesce(1).write.mode("append").parquet(str(folder))
        frames.append(
            own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
            .withColumn("ts", F.expr("timestamp_seconds(s)")).drop("s")
        )
    return frames


def test_a_gate_waits_for_any_time(spark, tmp_path):
    day = 86_400
    ready, confirms = _gate_inputs(
        spark, tmp_path,
        [[(1, "brd", 10), (2, "brd", 20), (4, "plan", 5)], [(9, "brd", 30 * day)], [(10, "brd", 60 * day), (1, "brd", 60 * day)]],
        [[(1, "brd", 8 * day)], [(2, "brd", 400 * day), (9, "plan", 1)], [(1, "brd", 500 * day), (10, "brd", 50 * day)]],
        "session_id int, stage string, s bigint", "session_id int, stage string, s bigint",
    )
    sources.write_updates(gates.pending_review_stream(ready, confirms), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    rows = sources.latest(spark.read.parquet(str(tmp_path / "out")), ["session_id", "stage"]).collect()
    assert {r.session_id: (r.status, r.waited_us) for r in rows} == {
        1: ("confirmed", (8 * day - 10) * 10**6), 2: ("confirmed", (400 * day - 20) * 10**6), 4: ("waiting", None), 9: ("waiting", None), 10: ("confirmed", 0)
    }


def test_context_after_a_gate_of_long_ago(spark, tmp_path):
    day = 86_400
    uploads = [(1, 5, "a", 10), (1, 9, "b", 90), (2, 3, "c", 20), (1, 200, "late", 300 * day), (9, 99, "z", 30 * day), (7, 1, "d", 9)]
    confirms = [(1, 7, 50), (8, 98, 30 * day), (1, 150, 100 * day)]
    schema = "session_id int, seq bigint, name string, s bigint"
    sessions = spark.createDataFrame([(1,), (2,), (9,)], "session_id int")
    marks = str(tmp_path / "marks")
    for closing in (False, True):
        files, closed = _gate_inputs(
            spark, tmp_path, [] if closing else [uploads[3:], uploads[:3]], [] if closing else [confirms[1:], confirms[:1]], schema,
            "session_id int, seq bigint, s bigint",
        )
        out = gates.context_gate_stream(sources.with_close(files, marks), closed, sessions, "1000 days")
        if closing:
            sources.close_log(files.sparkSession, marks)
        sources.write_updates(out, str(tmp_path / "out"), str(tmp_path / "state"), "append").awaitTermination()
    rows = {r.name: (r.accepted, r.reason) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {
        "a": (True, None), "b": (False, "already confirmed"), "c": (True, None), "late": (False, "already confirmed"), "z": (True, None), "d": (False, "unknown session")
    }


class Counted:
    """State of one key, with the values it holds and how often it was asked."""

    def __init__(self):
        self.values, self.calls, self.timers = {}, 0, []

    def getListState(self, name, schema):
        return CountedState(self, name)

    getValueState = getListState

    def registerTimer(self, ms):
        self.timers.append(ms)

    def getCurrentWatermarkInMs(self):
        return self.now


class CountedState:
    def __init__(self, of, name):
        self.of, self.name = of, name

    def _do(self, values=None):
        self.of.calls += 1
        if values is not None:
            self.of.values[self.name] = values
        return self.of.values.get(self.name)

    def get(self):
        return self._do() or ([] if self.name in ("waiting", "texts") else None)

    def exists(self):
        return self._do() is not None

    def update(self, value):
        self._do(value)

    def put(self, values):
        self._do(list(values))

    def appendList(self, values):
        self._do([*self.of.values.get(self.name, []), *values])

    def clear(self):
        self._do()
        self.of.values.pop(self.name, None)


def test_state_is_asked_per_session_not_per_event():
    kinds = ["code-stream", "code-ready", "step-change"]
    log = [(q, q * 1000, kinds[q % 3], "plan-generation", f"t{q}", None) for q in range(900)]
    handle, one = Counted(), stateful.Segments()
    one.init(handle)
    handle.now = 0
    assert not list(one.work((1,), log[1:], handle))
    assert len(handle.values["waiting"]) == 1 and handle.timers == [2] and handle.calls < 5
    handle.now = 10**6
    out = list(one.work((1,), [], handle))
    assert len(out) >= 300 and handle.calls < 20
    assert "waiting" not in handle.values


def test_stored_documents_without_reviews_stay_out_of_the_state(spark):
    """They are joined in the JVM; an initial state hands each of them to Python."""
    stored = spark.createDataFrame([(1, "brd", "v"), (1, "brd", "v"), (2, "brd", None)], "session_id bigint, stage string, value string")
    feed = spark.readStream.format("rate").load().selectExpr("value AS session_id", "'brd' AS stage", "value AS seq", "timestamp AS ts", "'c' AS content")
    plan = stateful.review_stream(feed, stored=stored)._jdf.queryExecution().analyzed()
    assert "Join LeftOuter" in plan.toString() and "max(value" in plan.toString()
