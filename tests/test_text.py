import random
from pathlib import PurePosixPath

from pyspark.sql import functions as F

from codexfold.functions import text as X


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_strip_equals_python(spark):
    rng = random.Random(1)
    alphabet = list(X.WHITESPACE) + list("ab​😀é\x00")
    values = ["".join(rng.choices(alphabet, k=rng.randrange(9))) for _ in range(600)]
    assert column(spark, values, X.strip) == [v.strip() for v in values]
    assert column(spark, values, X.is_blank) == [not v.strip() for v in values]


def test_suffix_equals_pathlib(spark):
    names = [
        "a.java", ".java", "..java", "a.", "a.tar.gz", "A.XML", "dir.d/file", "dir/.gitignore", "x/y.Kts",
        "a b.go", "build.gradle", "a..go", "é.JSON", "",
    ]
    assert column(spark, names, X.suffix) == [PurePosixPath(n).suffix.lower() for n in names]


def test_lossy_decode_equals_python(spark):
    rng = random.Random(2)
    pieces = [b"a", b"\xff", b"\xc3", b"\xa9", b"\xe2\x82", b"\xac", b"\xf0\x9f\x98\x80", b"\xed\xa0\x80", b"\xf5"]
    values = [bytearray(b"".join(rng.choices(pieces, k=rng.randrange(8)))) for _ in range(800)]
    expected = [bytes(v).decode("utf-8", "replace") for v in values]
    assert column(spark, values, X.lossy_utf8, "binary") == expected


def test_head_counts_code_points(spark):
    values = ["😀😀ab", "", "é"]
    assert column(spark, values, lambda c: X.head(c, 2)) == [v[:2] for v in values]


def test_dirname_basename(spark):
    paths = ["a/b/c.go", "c.go", "a/", "/c", "a//b"]
    assert column(spark, paths, X.basename) == [p.split("/")[-1] for p in paths]
    assert column(spark, paths, X.dirname) == ["a/b", "", "a", "", "a/"]
