import hashlib
import io
import struct

import duckdb
import pytest
import zstandard

from inkledger.llm import warc
from inkledger.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def test_query_equals_its_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    got = QUERIES["op7_warc"](spark, SF)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, con.execute(ORACLES["op7_warc"]).fetchall()))


def archive(records):
    out = io.BytesIO()
    warc.write_archive(out, iter(records))
    return out.getvalue()


def page(k, payload, refers=None, url="http://x/"):
    return warc.record(k, url, payload, hashlib.sha256(payload).hexdigest(), refers)


def test_archive_round_trip_with_a_dictionary(monkeypatch):
    payloads = [(f"<html><p>common words in every page {i} and some more of them</p></html>" * 4).encode() for i in range(200)]
    data = archive([page(i, p) for i, p in enumerate(payloads)])
    assert struct.unpack_from("<I", data)[0] == 0x184D2A5D
    for chunk in (1 << 20, 37):
        monkeypatch.setattr(warc, "CHUNK", chunk)
        assert [r["payload"] for r in warc.read_archive(io.BytesIO(data))] == payloads
    assert len(data) < len(archive([page(0, p) for p in payloads[:1]])) * 200 / 2
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(io.BytesIO(data[:-5])))


@pytest.mark.parametrize("old,new", [(b"WARC/1.1", b"WARC/9.1"), (b"WARC-Type", b"WARC-Tipe"), (b"Content-Length: 3\r\n\r\nabc", b"Content-Length: 4\r\n\r\nabc"), (b"abc\r\n", b"abd\r\n"), (b"abc\r\n\r\n", b"abcx\r\n\r\n"), (b"<urn:page:1>", b"<urn:page:x>")])
def test_broken_records_are_refused(old, new):
    good = page(1, b"abc")
    assert warc.parse(good)["payload"] == b"abc" and old in good
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(io.BytesIO(zstandard.compress(good.replace(old, new)))))


def test_edge_rows(spark):
    big = "é" * 60
    rows = [(5, "http://a/ b\n", big), (3, None, big), (9, "u", big), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (None, "u", big), (7, "u", "w " * 500000), (3, "v", big)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted((tuple(r)[:5] for r in warc.warc_round_trip(pages).collect()), key=str)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(i, len((t or "").encode()), digest(t), "revisit" if t == big and i != 3 else "response", 3 if t == big and i != 3 else None) for i, _, t in rows]
    assert got == sorted(want, key=str)
    assert warc.warc_round_trip(pages.limit(0)).count() == 0
