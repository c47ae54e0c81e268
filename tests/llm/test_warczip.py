import base64
import hashlib
import io
import zipfile

import pytest

from locusforge.llm import entry, warczip


def b32(raw):
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_query_equals_plain_grouping(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    last = {}
    for r in rows:
        last[r.html] = max(last.get(r.html, -1), r.page_id)
    got = {r.page_id: tuple(r)[1:] for r in entry.op8_warc_packages(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r in rows:
        raw, first = (r.html or "").encode(), last[r.html] == r.page_id
        assert got[r.page_id] == (len(raw), b32(raw), "response" if first else "revisit", None if first else last[r.html])


def test_copies_nulls_and_odd_urls(spark, monkeypatch):
    rows = [(1, "http://a/é ?x\r\nWARC-Type: evil", "same"), (5, None, "same"), (3, "", "same"), (7, "u", None), (9, "u", ""), (None, "u", "same"), (10, "u", "x\r\n\r\ny" * 5000), (5, "u", "same")]
    want = {(1, "revisit", 5), (5, "response", None), (3, "revisit", 5), (7, "revisit", 9), (9, "response", None), (None, "revisit", 5), (10, "response", None)}
    for bits, hot in ((warczip.shared.SIEVE_BITS, warczip.shared.HOT_KEYS), (4, 2)):
        monkeypatch.setattr(warczip.shared, "SIEVE_BITS", bits)
        monkeypatch.setattr(warczip.shared, "HOT_KEYS", hot)
        out = warczip.archive_report(pages(spark, rows)).collect()
        assert len(out) == len(rows) and {(r.page_id, r.record_type, r.refers_to) for r in out} == want
    few = warczip.write_archives(pages(spark, rows), min_bytes=5).read(spark)
    assert few.where("record_type = 'revisit'").count() == 0
    assert warczip.archive_report(pages(spark, rows).limit(0)).count() == 0
    assert warczip.archive_report(pages(spark, [(None, "u", "a"), (None, "u", "a")])).where("record_type = 'response'").count() == 2


def package(n=50):
    out = io.BytesIO()
    warczip.write_package(out, ((i, f"http://x/{i}", f"text {i}".encode() * i, None if i % 5 else 0) for i in range(1, n)), "2024-01-01T00:00:00Z")
    return out.getvalue()


def test_packages_are_sound_zip_files(monkeypatch):
    monkeypatch.setattr(warczip, "MEMBER_BYTES", 2000)
    monkeypatch.setattr(warczip, "RANGE_BYTES", 700)
    raw = package()
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and len(z.namelist()) > 3
        assert {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
    got = list(warczip.read_package(io.BytesIO(raw)))
    assert [(w["warc-record-id"], len(p)) for w, _, p in got] == [(f"<urn:page:{i}>", len(f"text {i}") * i if i % 5 else 0) for i in range(1, 50)]
    assert got[4][0]["warc-refers-to"] == "<urn:page:0>"


@pytest.mark.parametrize("big", [False, True])
def test_reader_takes_packages_of_the_standard_library(big):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name in ("archive/a", "b"):
            with z.open(name, "w", force_zip64=big) as f:
                f.write(name.encode() * 1000)
        z.comment = b"PK\x05\x06 in a comment"[5:] * 3
    r = warczip.ZipReader(io.BytesIO(out.getvalue()))
    assert r.read("archive/a") == b"archive/a" * 1000 and r.read("b") == b"b" * 1000


def test_damage_and_compressed_members_raise():
    raw = package()
    for bad in (raw[:-30], b"", raw[:100]):
        with pytest.raises(ValueError):
            list(warczip.read_package(io.BytesIO(bad)))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "x" * 1000)
    with pytest.raises(ValueError, match="isn't stored"):
        warczip.ZipReader(io.BytesIO(out.getvalue()))
    rec = warczip.record(1, "u", b"abc", warczip.base32_sha1(b"abd"), None, "2024-01-01T00:00:00Z")
    with pytest.raises(ValueError, match="digest"):
        warczip.parse(rec)


def test_records_are_found_by_page(monkeypatch):
    monkeypatch.setattr(warczip, "MEMBER_BYTES", 2000)
    raw = io.BytesIO(package())
    (warc, http, payload), *rest = warczip.find_records(raw, 17)
    assert warc["warc-record-id"] == "<urn:page:17>" and payload == b"text 17" * 17 and not rest and http["content-length"] == str(7 * 17)
    assert warczip.find_records(raw, 1) and not warczip.find_records(raw, 1000)


def test_long_payloads_and_clashing_names(spark):
    long = "é" * 3_000_000
    d = pages(spark, [(1, "u", long), (2, "u", long), (3, "u", "x")]).selectExpr("*", "1 as digest", "'p' as path", "2 as refers_to", "'q' as payload")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warczip.archive_report(d).collect()}
    raw = long.encode()
    assert got == {1: (len(raw), b32(raw), "revisit", 2), 2: (len(raw), b32(raw), "response", None), 3: (1, b32(b"x"), "response", None)}
