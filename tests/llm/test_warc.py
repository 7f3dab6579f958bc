import gzip
import hashlib
import io
import uuid

import pytest

from complexa.llm import warc as W


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, payload string")


def test_round_trip(spark):
    big, small = "<p>" + "é" * 100, "tiny"
    rows = [(3, "http://a/ b\r\nX: y", big), (1, None, big), (2, "u", small), (4, "u", small), (5, "u", None), (None, "u", big), (7, "u", "x" * 200_000)]
    got = {r.page_id: r for r in W.warc_round_trip(spark, pages(spark, rows)).collect()}
    assert len(got) == 7
    for i, _, h in rows:
        data = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        kind = "revisit" if i in (3, None) else "response"
        assert (got[i].record_type, got[i].refers_to) == (kind, 1 if kind == "revisit" else None)
        assert got[i].payload == (None if kind == "revisit" else data)


def test_repeated_rows_and_empty_table(spark):
    text = "y" * 150
    got = sorted((r.page_id, r.record_type) for r in W.warc_round_trip(spark, pages(spark, [(1, "u", text), (1, "u", text), (2, "u", text)])).collect())
    assert got == [(1, "response"), (1, "response"), (2, "revisit")]
    assert W.warc_round_trip(spark, pages(spark, [])).count() == 0


def member(payload=b"hello", **change):
    data = W.record_bytes(1, "u", payload, change.get("digest", hashlib.sha256(payload).hexdigest()), "response", None)
    return W.gzip_member(data)


def test_one_member_per_record_and_streaming():
    raw = member(b"a" * 300_000) + member(b"")
    assert gzip.decompress(raw).count(b"WARC/1.1") == 2
    got = list(W.read_records(io.BytesIO(raw)))
    assert [r["payload_bytes"] for r in got] == [300_000, 0]


@pytest.mark.parametrize("raw", [
    member()[:-3], member(digest="0" * 64), W.gzip_member(gzip.decompress(member()) + b"more"), b"not gzip",
    W.gzip_member(gzip.decompress(member()).replace(b"hello", b"hellp")), W.gzip_member(b"HTTP/1.1 200 OK\r\n\r\n")])
def test_broken_archives_are_refused(raw):
    with pytest.raises(W.WarcError):
        list(W.read_records(io.BytesIO(raw)))


def test_archives_roll(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 1)
    folder = f"file://{tmp_path}/{uuid.uuid4().hex}"
    records = W.plan_records(pages(spark, [(i, "u", f"text {i}" * 50) for i in range(6)]))
    manifest = W.write_archives(records, folder)
    assert manifest.count() >= 1 and manifest.selectExpr("sum(n_records)").first()[0] == 6
    assert W.read_archives(manifest, folder).count() == 6


def test_a_header_of_any_length_is_read_back(spark):
    urls = {1: "http://x/" + "é" * 500_000, 2: "http://y/" + "q" * 3_000_000, 3: None}
    got = {r.page_id: r for r in W.warc_round_trip(spark, pages(spark, [(i, u, "<p>" + "t" * 200) for i, u in urls.items()])).collect()}
    assert set(got) == {1, 2, 3} and [got[i].record_type for i in (1, 2, 3)] == ["response", "revisit", "revisit"]
