import gzip
import hashlib

import pytest
from voxtide.llm import archives as A

SCHEMA = "page_id long, url string, html string, digest string"
PAGES = [(1, "http://a/x y", "é" * 60), (2, "http://b", "é" * 60), (2, "http://b", "é" * 60), (3, None, None), (4, "u", "small"), (5, "u", "small"), (6, "http://c", "WARC/1.1\r\n\r\nfiledesc://x 0 1\n" * 30), (7, "http://d", "x" * 300_000), (None, "http://e", "é" * 60)]


def test_round_trip(spark):
    df = spark.createDataFrame([(i, u, h, "d") for i, u, h in PAGES], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in A.archive_round_trip(df).collect()), key=str)
    want = []
    for i, _, h in PAGES:
        data = (h or "").encode()
        same = sorted(k for k, _, x in PAGES if (x or "") == (h or "") and k is not None)
        again = len(data) >= 100 and i != same[0]
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", same[0] if again else None))
    assert got == sorted(want, key=str)


def test_files_are_cut_by_bytes(spark, tmp_path, monkeypatch):
    """Small pages share rows and files however large one page is; no file holds more than its bytes or one page."""
    monkeypatch.setattr(A, "FILE_BYTES", 1 << 20)
    monkeypatch.setattr(A, "ROW_BYTES", 1 << 17)
    pages = [(i, f"http://a/{i}", f"{i} " * 300) for i in range(3000)] + [(9000, "http://big", "b" * 900_000), (9001, "http://big", "b" * 900_000)]
    df = spark.createDataFrame([(i, u, h, "d") for i, u, h in pages], SCHEMA).coalesce(1)
    A.write_arc(df, str(tmp_path / "arc"))
    A.convert_arc(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    for kind, least in (("arc", 4), ("warc", 4)):
        sizes = [len(A.unpacked(p.read_bytes())) for p in (tmp_path / kind).glob("part-*")]
        assert max(sizes) <= 1.2 * (1 << 20) and least <= len(sizes) <= 60, (kind, sizes)
    got = {r["page_id"]: r for r in A.archive_round_trip(df).collect()}
    assert len(got) == len(pages) and got[9001]["record_type"] == "revisit" and got[9001]["refers_to"] == 9000 and got[9001]["payload_bytes"] == 900_000
    assert all(got[i]["payload_digest"] == hashlib.sha256(h.encode()).hexdigest() for i, _, h in pages)


def test_no_rows(spark):
    assert A.archive_round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


V1 = b"filedesc://a.arc 127.0.0.1 19970101000000 text/plain 71\n1 0 Org\nURL IP-address Archive-date Content-type Archive-length\n"
V1 = b"filedesc://a.arc 127.0.0.1 19970101000000 text/plain %d\n" % len(V1.split(b"\n", 1)[1]) + V1.split(b"\n", 1)[1]


def test_versions_and_lengths():
    body = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\nfirst\nhttp://fake 1.2.3.4 19970102 text/html 5\n"
    data = V1 + b"\nhttp://a/b c 10.0.0.1 199701020304 text/html %d\n" % len(body) + body + b"\ndns:x 10.0.0.2 19970103 text/dns 4\nabcd\n"
    two = b"2 0 Org\n" + A.FIELDS[2].encode() + b"\n"
    data += b"filedesc://b.arc 0.0.0.0 19980101000000 text/plain %d\n" % len(two) + two
    data += b"\nhttp://v2/ 10.0.0.3 19980102030405 text/plain 404 sum - 99 b.arc 3\nxyz\n"
    for packed in (data, gzip.compress(data), gzip.compress(data[: len(V1)]) + gzip.compress(data[len(V1) :])):
        got = [r for r in A.arc_records(A.unpacked(packed)) if not r.url.startswith("filedesc")]
        assert [(r.version, r.url, r.date, r.body) for r in got] == [(1, "http://a/b c", "199701020304", body), (1, "dns:x", "19970103", b"abcd"), (2, "http://v2/", "19980102030405", b"xyz")]
    assert got[2].extra["Result-code"] == "404"
    record = A.converted(got[0], "a.arc") + b"\r\n"
    [(fields, block)] = A.warc_records(record)
    assert block == body and fields["warc-type"] == "response" and fields["warc-date"] == "1997-01-02T03:04:00Z" and fields["warc-ip-address"] == "10.0.0.1"
    assert fields["warc-payload-digest"] == "sha256:" + hashlib.sha256(A.http_parts(body)[1]).hexdigest()
    assert next(A.warc_records(A.converted(got[1], "a.arc")))[0]["warc-type"] == "resource"
    assert A.record_id("a.arc", 5) == A.record_id("a.arc", 5) != A.record_id("a.arc", 6)


def test_broken_lines_are_errors():
    with pytest.raises(ValueError):
        list(A.arc_records(V1 + b"\nhttp://a 1.2.3.4 1997 text/html many\n"))
    with pytest.raises(ValueError):
        list(A.arc_records(V1 + b"\nhttp://a 1.2.3.4 1997 text/html 50\nshort"))
