"""Every stage on its own input, and the whole."""

import zlib

import corpus_pipeline

from codexfold.llm.queries import LLM_QUERIES
from test_jaccard_forest import brute as brute_components


def test_the_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "decontamination", "pii", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None
    assert len(LLM_QUERIES) == 13 and all(n.startswith("op") for n in LLM_QUERIES)


def test_near_duplicates(spark, tables_dir, small_docs):
    rows, table = small_docs
    kept = corpus_pipeline.near_duplicates(spark, table, tables_dir)
    assert kept.columns == table.columns
    components = brute_components(rows)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, n, c in components if d == c or not n)


def test_near_duplicates_edge_cases(spark, tables_dir, docs_of):
    rows = [(None, None), (None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (3, ""), (4, ""), (4, ""), (5, "lone text of five words"), (None, "a b c d e f")]
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs_of(rows), tables_dir).collect()]
    assert sorted(kept, key=repr) == sorted([(None, None), (None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (3, ""), (4, ""), (4, ""), (5, "lone text of five words")], key=repr)


def test_filters_keep_rows_and_columns(spark, tables_dir, small_docs):
    rows, table = small_docs
    toxic = corpus_pipeline.not_toxic(spark, table, tables_dir)
    clean = corpus_pipeline.decontaminated(spark, table, tables_dir)
    named = corpus_pipeline.pseudonymous(spark, table, tables_dir)
    assert toxic.columns == clean.columns == named.columns == table.columns
    assert 0 < toxic.count() <= len(rows) and 0.5 * len(rows) < clean.count() < len(rows) and named.count() == len(rows)


def test_empty_documents(spark, tables_dir, docs_of):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs_of([]).limit(0), tables_dir).collect() == []


def test_run(spark, tables_dir):
    found = corpus_pipeline.run(spark, tables_dir).collect()
    assert found and all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and 0 < r.length <= 4096 for r in found)
    assert len({(r.sequence_id, r.offset) for r in found}) == len(found)
