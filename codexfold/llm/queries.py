"""The registered queries of this package over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexfold.llm.decontaminate import contained_items
from codexfold.llm.fill_in_middle import fill_in_middle, restored
from codexfold.llm.image_copies import image_copies, pictures
from codexfold.llm.jaccard_forest import jaccard_components
from codexfold.llm.packing import best_fit_packing
from codexfold.llm.pii import pseudonymised
from codexfold.llm.quality import quality
from codexfold.llm.sentence_spans import without_repeated_spans
from codexfold.llm.sharding import uniform_shards
from codexfold.llm.source_divergence import source_divergence
from codexfold.llm.suffix_buckets import without_repeats
from codexfold.llm.toxicity import toxicity
from codexfold.llm.warc import archive_round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op1_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_spans(table(spark, sf_dir, "documents"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_replaced")


def op4_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    digest = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32")
    )
    return uniform_shards(digest, 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op5_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op6_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_copies(pictures(table(spark, sf_dir, "embeddings")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), with_ids=False)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_suffix_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


LLM_QUERIES = {
    f.__name__: f
    for f in (
        op1_sentence_spans, op2_pii_surrogates, op3_jaccard_join, op4_hypergeometric_shards, op5_warc_normaliser,
        op6_image_copies, op7_toxicity, op8_best_fit_packing, op9_decontamination, op10_suffix_buckets,
        op11_source_divergence, op12_fill_in_middle, op13_quality,
    )
}

_TERMS = r"""
d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (
    SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
    FROM d
),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
lv AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS t FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS t FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL)
"""
LLM_ORACLES: dict[str, str] = {
    "op11_source_divergence": f"""
WITH {_TERMS},
p AS (
    SELECT g.lang, g.source, k.term, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.t + lv.v) AS p
    FROM g JOIN k USING (lang) JOIN lv USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
s AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
pair AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (k.n + 1) // (lv.t + lv.v) AS q FROM k JOIN lv USING (lang)),
term AS (
    SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value
    FROM c JOIN p USING (lang, source, term) JOIN q USING (lang, term) WHERE p > q
)
SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
    FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
) WHERE part = 'pair' OR rank <= 200
""",
    "op12_fill_in_middle": """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
),
e AS (
    SELECT doc_id, t, n, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b,
        ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS s
    FROM d
),
f AS (
    SELECT *, least(a, b) AS i, greatest(a, b) AS j,
        CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN s < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM e
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN i END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END::BIGINT AS middle_chars,
    sha256(CASE form
        WHEN 'plain' THEN t
        WHEN 'psm' THEN '<P>' || substr(t, 1, i) || '<S>' || substr(t, j + 1) || '<M>' || substr(t, i + 1, j - i)
        ELSE '<S>' || substr(t, j + 1) || '<P>' || substr(t, 1, i) || '<M>' || substr(t, i + 1, j - i)
    END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM f
""",
}
