import hashlib

import pytest

from geocurate.llm import warc
from geocurate.runtime import new_path

BIG, ODD = "é" * 600, "x\r\n\r\nWARC/1.1\r\ny" * 80
ROWS = [
    (1, "http://a/1", BIG), (4, "http://a/2", BIG), (3, None, BIG), (2, "http://b/\r\nX: y", "small"), (9, "http://c/ü", "small"),
    (5, "u", None), (6, "u", ""), (7, "u", ODD), (None, "u", BIG), (None, "u", "tiny"), (8, "u", "z" * 999), (10, "u", "z" * 999),
]


@pytest.fixture(scope="module")
def archive(spark):
    path = new_path(spark, "warc_test")
    warc.write_archive(spark.createDataFrame(ROWS, "page_id long, url string, html string"), path)
    return path


def test_pages_come_back(spark, archive):
    told = warc.describe(warc.parse_records(warc.read_records(spark, archive))).collect()
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in told)
    want = []
    for page, _, html in ROWS:
        body = (html or "").encode()
        revisit = html == BIG and page != 4
        want.append((str(page), len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", 4 if revisit else None))
    assert got == sorted(want, key=lambda r: r[:4])


def test_records_are_warc_and_payloads_are_stored_once(spark, archive):
    assert spark.read.parquet(f"{archive}/payloads").count() == len({h or "" for _, _, h in ROWS})
    records = {r.id: bytes(r.record) for r in warc.read_records(spark, archive).collect() if r.id is not None}
    head, rest = records[2].split(b"\r\n\r\n", 1)
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    assert head.startswith(b"WARC/1.1\r\n") and fields[b"WARC-Target-URI"] == b"http://b/%0D%0AX: y"
    assert len(rest) == int(fields[b"Content-Length"]) + 4 and rest.endswith(b"small\r\n\r\n")
    assert b"WARC-Refers-To: <urn:page:4>" in records[1] and BIG.encode() not in records[1]
    parsed = {r.page_id: r for r in warc.parse_records(warc.read_records(spark, archive)).collect()}
    assert bytes(parsed[7].payload).decode() == ODD and parsed[9].uri == "http://c/ü" and parsed[3].uri is None


def test_damage_is_noticed(spark, archive):
    records = warc.read_records(spark, archive).filter("id = 2")
    broken = records.selectExpr("id", "encode(replace(decode(record, 'UTF-8'), 'small', 'SMALL'), 'UTF-8') AS record")
    with pytest.raises(Exception, match="digest is wrong"):
        warc.parse_records(broken).collect()
    short = records.selectExpr("id", "encode(replace(decode(record, 'UTF-8'), 'small', 'smal'), 'UTF-8') AS record")
    with pytest.raises(Exception, match="length is wrong"):
        warc.parse_records(short).collect()


def test_empty_table(spark):
    path = new_path(spark, "warc_empty")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.describe(warc.parse_records(warc.read_records(spark, path))).count() == 0
