"""Archives: exact round trips."""

import gzip
import hashlib
import io
import uuid

import pytest

from codexfold.llm.common import shared_dir
from codexfold.llm.queries import op5_warc_normaliser
from codexfold.llm.warc import archive_round_trip, deflated, inflated, normalise, opened, read_indexed, records, revisits, warc_record, write_archives

PAGES = "page_id long, url string, html string, digest string, latest long"
ROWS = [
    (1, "http://a/%0A\n%", "x" * 1500), (2, None, "x" * 1500), (2, None, "x" * 1500), (None, "u", "x" * 1500), (5, "u", None), (6, "u", ""), (7, "u", "short"), (8, "u", "short"),
    (None, "v", "y" * 1200), (None, "v", "y" * 1200), (9, "é" * 10, "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 99), (10, "w", "z" * 1000), (11, "w", "z" * 1000), (12, "w", "🙂" * 200_000),
]


def expected(rows):
    latest = {}
    for page, html in rows:
        body = (html or "").encode()
        if len(body) >= 1000 and page is not None:
            latest[body] = max(latest.get(body, page), page)
    out = []
    for page, html in rows:
        body = (html or "").encode()
        home = latest.get(body)
        again = home is not None and page != home
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", home if again else None))
    return sorted(out, key=repr)


def test_query(spark, tables_dir):
    pages = spark.read.parquet(f"{tables_dir}/pages.parquet").collect()
    found = op5_warc_normaliser(spark, tables_dir).collect()
    assert sorted((tuple(r) for r in found), key=repr) == expected([(p.page_id, p.html) for p in pages])


def test_edge_cases(spark):
    table = spark.createDataFrame([(*r, "d", 1) for r in ROWS], PAGES)
    assert sorted((tuple(r) for r in archive_round_trip(table).collect()), key=repr) == expected([(p, h) for p, _, h in ROWS])
    assert archive_round_trip(table.limit(0)).collect() == []


def test_files_and_sidecar(spark):
    table = spark.createDataFrame([(*r, "d", 1) for r in ROWS], PAGES)
    place = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    written = write_archives(revisits(table), place, archive_bytes=4_000)
    done = normalise(written, place)
    assert sum(r.records for r in written.collect()) == sum(r.records for r in done.collect()) == len(ROWS)
    store, _ = opened(place)
    members = 0
    for r in done.collect():
        body = store.open_input_stream(r["archive"], compression=None).read()
        for line in store.open_input_stream(r["index"], compression=None).read().decode().splitlines():
            offset, length, kind, name = line.split(" ", 3)
            record = gzip.decompress(body[int(offset) : int(offset) + int(length)])
            assert record.startswith(b"WARC/1.1\r\nWARC-Type: " + kind.encode()) and record.endswith(b"\r\n\r\n") and name.encode() in record
            members += 1
        assert len(list(records(iter([gzip.decompress(body)])))) == r["records"]
    assert members == len(ROWS)
    back = {(r.page_id, r.url, bytes(r.payload) if r.payload is not None else None) for r in read_indexed(done, place).collect()}
    assert (1, "http://a/%0A\n%", None) in back and (12, "w", ("🙂" * 200_000).encode()) in back


def test_streams_in_small_pieces():
    whole = b"".join(warc_record(k, "u", "response", None, "d", b"p" * k * 1000) for k in range(5))
    for packed in (gzip.compress(whole), b"".join(deflated(r, 6) for _, r in records(iter([whole])))):
        pieces = list(inflated(io.BytesIO(packed)))
        assert b"".join(pieces) == whole
    assert [f["warc-record-id"] for f, _ in records(whole[k : k + 7] for k in range(0, len(whole), 7))] == [f"<urn:page:{k}>" for k in range(5)]
    with pytest.raises(ValueError):
        list(records(iter([whole[:-10]])))
