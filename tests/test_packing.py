import random

import pytest
from pyspark.sql import functions as F

from codexfold import constants as K
from codexfold.operators import intake, packing


def chunk(path, content):
    return f"\n\n// === FILE: {path} ===\n{content}"


def model(files, budget):
    kept = {}
    for repo, _, path, content in sorted(files):
        state = kept.setdefault(repo, [[], 0, False])
        piece = chunk(path, content)
        if state[2] or state[1] + len(piece) > budget:
            state[2] = True
            continue
        state[0].append(piece)
        state[1] += len(piece)
    return {repo: "".join(s[0]) for repo, s in kept.items() if s[0]}


@pytest.mark.parametrize("block", [1, 3, 4096])
@pytest.mark.parametrize("budget", [60, 400, 100_000])
def test_pack_equals_loop(spark, block, budget):
    rng = random.Random(block * budget)
    files = [
        (f"r{r}", o, f"f{o}.java", "😀x\n" * rng.choice([0, 1, 2, 5, 40]))
        for r in range(6)
        for o in rng.sample(range(200), 30 if r else 120)
    ]
    rng.shuffle(files)
    df = spark.createDataFrame(files, "repo_id string, ord bigint, path string, content string").repartition(7)
    digests = packing.repo_digest(packing.pack_budget(df, budget, block)).collect()
    assert {r.repo_id: r.digest for r in digests} == model(files, budget)


def test_marker_count_over_counts(spark):
    df = spark.createDataFrame([("r", 0, "a", "x // === FILE: y")], "repo_id string, ord bigint, path string, content string")
    row = packing.marker_count(packing.repo_digest(df)).first()
    assert (row.files_found, row.files_packed) == (2, 1)


def test_path_filters(spark):
    paths = ["build.gradle", "x/build/y.java", "Build/y.java", ".gradle", "a/.git/x.xml", "a.KTS", "README.md", "target"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path for r in intake.source_files(df).collect()} == {"build.gradle", "Build/y.java", "a.KTS"}


def test_upload_gate(spark):
    names = ["a.zip", "a.ZIP", "a.java", "a.JAVA", "a.kts", "a.json", "a.yml", "a.java\n", "b.md"]
    rows = intake.upload_gate(spark.createDataFrame([(n,) for n in names], "name string")).collect()
    verdicts = {r.name: (r.verdict, r.gates_disagree) for r in rows}
    assert verdicts["a.zip"] == ("accepted", False)
    assert verdicts["a.JAVA"] == ("rejected", True)
    assert verdicts["a.kts"] == ("rejected", True)
    assert verdicts["a.java\n"] == ("rejected", False)
    assert verdicts["b.md"] == ("rejected", False)


def test_rejects(spark):
    repos = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "repo_id string")
    digests = spark.createDataFrame([("a", "x"), ("b", " \n　"), ("c", K.EMPTY_DIGEST)], "repo_id string, digest string")
    assert {r.repo_id for r in intake.empty_repo_rejects(repos, digests).collect()} == {"b", "c", "d"}


def test_messages(spark):
    state = spark.createDataFrame(
        [(1, "B" * 20_000, " \n", "C" * 30_000, "P" * 9_000, "S" * 50_000), (2, " ", "T", "", "", "")],
        "session_id int, brd string, technical_spec string, additional_context string, plan string, source_code string",
    )
    plan = {r.session_id: r.message for r in packing.plan_message(state).collect()}
    assert plan[1] == K.PLAN_LEAD + "B" * 15_000 + K.PLAN_CONTEXT_LEAD + "C" * 25_000
    assert plan[2] == K.PLAN_LEAD + " " + K.PLAN_SPEC_LEAD + "T"
    code = {r.session_id: r.message for r in packing.code_message(state).collect()}
    assert code[1] == "\n\n".join(
        [K.CODE_LEAD, K.CODE_BRD_LEAD + "B" * 8_000, K.CODE_CONTEXT_LEAD + "C" * 15_000,
         K.CODE_PLAN_LEAD + "P" * 8_000, K.CODE_SOURCE_LEAD + "S" * 45_000]
    )
    assert code[2] == "\n\n".join([K.CODE_LEAD, K.CODE_SPEC_LEAD + "T", K.CODE_PLAN_LEAD, K.CODE_SOURCE_LEAD])
    lead = packing.analysis_message(spark.createDataFrame([("x" * 70_000,)], "digest string")).first().message
    assert lead == K.ANALYSIS_LEAD + "x" * 60_000


def test_text_waits_for_the_cut(spark):
    """With no broadcast of tables, exchanges below the cut carry numbers, and only
    rows that pass the filter of kept files reach the exchange of the text."""
    content = F.lpad(F.col("id").cast("string"), 200, "x")
    files = spark.range(5_000).select(
        F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("repo_id"), F.col("id").alias("ord"),
        F.lit("a.java").alias("path"), content.alias("content"),
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        packed = packing.pack_budget(files, 5_000)
        assert packed.count() == 3 * (5_000 // len(chunk("a.java", "x" * 200)))
        plan = packed._jdf.queryExecution().executedPlan()
        carrying, below = [], [plan]
        while below:
            node = below.pop()
            below += [node.children().apply(i) for i in range(node.children().size())]
            if node.nodeName() == "Exchange" and "content#" in node.output().toString():
                carrying.append(node.toString())
        assert len(carrying) == 1 and "Broadcast" in carrying[0] and "getbit" in carrying[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
