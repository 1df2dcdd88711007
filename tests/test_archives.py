import io
import zipfile

from pyspark.sql import functions as F

from codexfold.functions.text import lossy_utf8
from codexfold.operators import exports, intake, packing
from codexfold.sources.archives import archive_explode, pack_archives, read_archives


def archive(entries):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(name, data)
    return buffer.getvalue()


def damaged(entries, victim):
    data = bytearray(archive(entries))
    with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
        info = z.getinfo(victim)
    start = info.header_offset + 30 + len(victim.encode())
    for i in range(start, start + info.compress_size):
        data[i] ^= 0xFF
    return bytes(data)


ENTRIES = [
    ("src/", b""), ("src/B.java", b"class B { \xff }" * 3), ("a/build/x.java", b"no"), ("README.md", b"readme" * 20),
    ("A.XML", "é😀".encode()), ("z.go", b"package z" * 10),
]


def frame(spark, blobs):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in blobs.items()], "repo_id string, content binary")


def test_entries_in_order_and_damage_skipped(spark):
    df = frame(spark, {"ok": archive(ENTRIES), "bad": damaged(ENTRIES, "README.md"), "junk": b"no zip"})
    rows = archive_explode(df).orderBy("repo_id", "ord").collect()
    paths = {}
    for r in rows:
        paths.setdefault(r.repo_id, []).append(r.path)
    names = [n for n, _ in ENTRIES if not n.endswith("/")]
    assert paths == {"ok": names, "bad": [n for n in names if n != "README.md"]}


def test_filters_and_budget_equal_the_batch_rule(spark):
    df = frame(spark, {"ok": archive(ENTRIES), "bad": damaged(ENTRIES, "A.XML")})
    loose = archive_explode(df).withColumn("content", lossy_utf8(F.col("content")))
    for budget in (10, 80, 160, 100_000):
        expected = packing.pack_budget(intake.source_files(loose), budget).select("repo_id", "ord", "path")
        got = pack_archives(df, budget).select("repo_id", "ord", "path")
        assert sorted(got.collect()) == sorted(expected.collect())


def test_binary_file_scan(spark, tmp_path):
    (tmp_path / "one.zip").write_bytes(archive(ENTRIES))
    (tmp_path / "note.txt").write_text("x")
    files = intake.source_files(archive_explode(read_archives(spark, str(tmp_path))))
    assert [r.path for r in files.orderBy("ord").collect()] == ["src/B.java", "A.XML", "z.go"]


def test_export_keeps_duplicates_and_splits_large_sessions(spark):
    files = spark.createDataFrame(
        [(1, "a/b", i, f"d/f{i % 2}.txt", "é" * 100) for i in range(5)] + [(2, None, 0, "x", "y")],
        "session_id bigint, pattern string, ord bigint, path string, content string",
    )
    whole = exports.code_archive_export(files).orderBy("session_id").collect()
    assert [(r.filename, r.files) for r in whole] == [("a-b-migrated.zip", 5), ("migration-migrated.zip", 1)]
    with zipfile.ZipFile(io.BytesIO(bytes(whole[0].zip))) as z:
        assert z.namelist() == [f"d/f{i % 2}.txt" for i in range(5)]
        assert z.read(z.infolist()[0]).decode() == "é" * 100
    parts = exports.code_archive_export(files.where("session_id = 1"), part_bytes=560).orderBy("part").collect()
    assert [(r.part, r.filename, r.files) for r in parts] == [
        (0, "a-b-migrated.zip", 2), (1, "a-b-migrated.1.zip", 2), (2, "a-b-migrated.2.zip", 1)
    ]


def test_artifacts(spark, tmp_path):
    state = spark.createDataFrame([("0123456789", "b", ""), ("x", "", "p")], "session_id string, brd string, plan string")
    artifacts = exports.artifact_export(state)
    assert {(r.filename, r.content) for r in artifacts.collect()} == {("brd-01234567.md", "b"), ("plan-x.md", "p")}
    exports.write_artifacts(artifacts, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_archives_of_text_sessions(spark):
    files = spark.createDataFrame([("s-1", "p", 0, "a", "x"), ("s-2", "p", 0, "b", "y"), (None, "p", 0, "c", "z")],
        "session_id string, pattern string, ord bigint, path string, content string")
    found = {r.session_id: r for r in exports.code_archive_export(files).collect()}
    assert {k: r.files for k, r in found.items()} == {"s-1": 1, "s-2": 1, None: 1}
    with zipfile.ZipFile(io.BytesIO(bytes(found["s-2"].zip))) as z:
        assert z.read("b") == b"y"


def test_long_entries_are_held_up_to_the_budget(spark):
    """Characters split over chunks count once; a damaged long entry does not end the archive."""
    long = [("a.java", "é😀".encode() * 700_000), ("b.java", b"class B {}"), ("c.java", b"\xe9" * 50)]
    size = 2 * 700_000 + len("\n\n// === FILE: a.java ===\n")
    df = frame(spark, {"ok": archive(long), "bad": damaged(long, "a.java")})
    for budget, kept in ((size, ["a.java"]), (size - 1, []), (size + 36, ["a.java", "b.java"]), (size * 2, ["a.java", "b.java", "c.java"])):
        rows = pack_archives(df, budget).select("repo_id", "path").collect()
        assert sorted(r.path for r in rows if r.repo_id == "ok") == kept
        assert sorted(r.path for r in rows if r.repo_id == "bad") == ["b.java", "c.java"]
