import random

import pytest

from codexfold import constants as K
from codexfold.operators import session as S

REVIEW = "session_id bigint, seq bigint, stage string, content string, tech string, feedback string"


def random_reviews(seed):
    rng = random.Random(seed)
    pick = lambda *options: rng.choice(options)
    return [
        (rng.randrange(6), seq, pick("brd", "plan"), pick(None, "", f"edit{seq}"), pick(None, f"t{seq}"), pick(None, "", f"f{seq}"))
        for seq in range(120)
    ]


def patch_model(reviews, stored, keep_edit):
    docs = dict(stored)
    for sid, _, stage, content, _, feedback in sorted(reviews, key=lambda r: r[1]):
        before = docs.get((sid, stage), "")
        if content is not None:
            docs[sid, stage] = content
        if feedback:
            base = content if keep_edit and content is not None else before
            docs[sid, stage] = base + K.FEEDBACK_LEAD + feedback
    return docs


@pytest.mark.parametrize("keep_edit", [False, True])
@pytest.mark.parametrize("seed", range(3))
def test_patch_equals_loop(spark, seed, keep_edit):
    reviews = random_reviews(seed)
    stored = {(s, st): f"stored{s}" for s in range(3) for st in ("brd", "plan")}
    df = spark.createDataFrame(random.sample(reviews, len(reviews)), REVIEW).repartition(7)
    base = spark.createDataFrame([(s, st, v) for (s, st), v in stored.items()], "session_id bigint, stage string, value string")
    rows = S.review_patch(df, base, keep_edit, part_chars=30, hot_rows=2).orderBy("part").collect()
    got = {}
    for r in rows:
        got[r.session_id, r.stage] = got.get((r.session_id, r.stage), "") + r.value
    assert got == patch_model(reviews, stored, keep_edit)


def test_edit_with_feedback_is_lost(spark):
    df = spark.createDataFrame([(1, 1, "brd", "edit", "spec", "note")], REVIEW)
    base = spark.createDataFrame([(1, "brd", "old")], "session_id bigint, stage string, value string")
    assert S.review_patch(df, base).first().value == "old" + K.FEEDBACK_LEAD + "note"
    assert S.review_patch(df, base, keep_edit=True).first().value == "edit" + K.FEEDBACK_LEAD + "note"
    assert S.review_spec(df).first().technical_spec == "spec"


def writes_model(reviews, log, keep_edit):
    """Every write in order, as the session's handler does it."""
    docs, out = {}, []
    steps = [(q, 0, s, k, v) for s, q, k, v in log] + [(r[1], 1, r) for r in reviews]
    for step in sorted(steps, key=lambda x: x[:2]):
        if step[1] == 0:
            docs[step[2], step[3]] = step[4] or ""
            continue
        sid, seq, stage, content, tech, feedback = step[2]
        before = docs.get((sid, stage), "")
        value = content
        if feedback:
            value = (content if keep_edit and content is not None else before) + K.FEEDBACK_LEAD + feedback
        if value is not None:
            docs[sid, stage] = value
            out.append((sid, stage, seq, stage, value))
        if stage == "brd" and tech is not None:
            out.append((sid, stage, seq, "technical_spec", tech))
    return sorted(out)


@pytest.mark.parametrize("keep_edit", [False, True])
@pytest.mark.parametrize("hot_rows", [2, 10**6])
def test_writes_fold_to_the_document(spark, keep_edit, hot_rows):
    rng = random.Random(8)
    reviews = random_reviews(8)
    log = [(s, q, k, rng.choice([None, "", f"answer{q}"])) for s in range(4) for k in ("brd", "plan", "analysis") for q in (-1, 30, 31, 77)]
    df = spark.createDataFrame(random.sample(reviews, len(reviews)), REVIEW).repartition(7)
    deltas = spark.createDataFrame(log, "session_id bigint, seq bigint, key string, value string")
    writes = S.review_writes(df, deltas, keep_edit, hot_rows)
    assert sorted(map(tuple, writes.collect())) == writes_model(reviews, log, keep_edit)
    alone = S.review_writes(df, keep_edit=keep_edit)
    assert sorted(map(tuple, alone.collect())) == writes_model(reviews, [], keep_edit)


def test_feedback_on_a_stored_document_folds_to_both(spark):
    df = spark.createDataFrame([(1, 5, "brd", None, None, "note")], REVIEW)
    log = spark.createDataFrame([(1, 0, "brd", "ORIGINAL")], "session_id bigint, seq bigint, key string, value string")
    sessions = spark.createDataFrame([(1, "java-to-go", "src")], "session_id bigint, pattern string, source_code string")
    state = S.state_fold(log.unionByName(S.review_writes(df, log).drop("stage")), sessions).first()
    assert state.brd == "ORIGINAL" + K.FEEDBACK_LEAD + "note"


def test_fold_and_defaults(spark):
    sessions = spark.createDataFrame([(1, "java-to-go", "src"), (2, None, "s2")], "session_id bigint, pattern string, source_code string")
    deltas = spark.createDataFrame(
        [(1, 5, "brd", "new"), (1, 2, "brd", "old"), (1, 9, "plan", ""), (3, 1, "brd", "unknown")],
        "session_id bigint, seq bigint, key string, value string",
    )
    state = {r.session_id: r for r in S.state_fold(deltas, sessions).collect()}
    assert set(state) == {1, 2}
    assert (state[1].brd, state[1].plan, state[1].generated_files_json, state[1].workflow_step) == ("new", "", "[]", "upload")
    assert (state[2].brd, state[2].source_code, state[2].pattern) == ("", "s2", None)
    assert S.state_defaults(sessions).count() == 20
    snapshot = {r.session_id: r for r in S.session_snapshot(S.state_fold(deltas, sessions)).collect()}
    assert (snapshot[1].brd, snapshot[1].plan, snapshot[1].generated_files) == ("new", None, [])


def test_as_of_equals_loop(spark):
    rng = random.Random(5)
    deltas = [(rng.randrange(4), q, rng.choice(["brd", "plan"]), None if q % 9 == 0 else f"v{q}") for q in range(200)]
    starts = [(s, q, st) for s in range(3) for st in ("plan", "code") for q in rng.sample(range(200), 2)]
    got = S.state_as_of(
        spark.createDataFrame(deltas, "session_id bigint, seq bigint, key string, value string"),
        spark.createDataFrame(starts, "session_id bigint, seq bigint, stage string"),
    )
    first = {}
    for s, q, st in starts:
        first[s, st] = min(q, first.get((s, st), q))
    expected = {}
    for (s, st), start in first.items():
        for sid, q, key, value in deltas:
            if sid == s and q <= start:
                expected[s, st, key] = value
    assert {(r.session_id, r.stage, r.key): r.value for r in got.collect()} == expected


def test_pending(spark):
    ready = spark.createDataFrame([(1, "brd", 10), (2, "brd", 10), (3, "plan", 10)], "session_id int, stage string, s int")
    confirms = spark.createDataFrame([(1, "brd", 25), (1, "brd", 99), (3, "plan", 4)], "session_id int, stage string, s int")
    at = lambda df: df.selectExpr("session_id", "stage", "timestamp_seconds(s) AS ts")
    rows = {r.session_id: (r.status, r.waited_us) for r in S.pending_review(at(ready), at(confirms)).collect()}
    assert rows == {1: ("confirmed", 15_000_000), 2: ("waiting", None), 3: ("confirmed", 0)}
