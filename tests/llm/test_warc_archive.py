import base64
import hashlib

import pytest

from condensa.llm.warc_archive import read_archive, reconstruct, write_archive


def pages(spark):
    rows = [(5, "http://a/é", "same", 1), (3, "http://b\r\nX: y", "same", 2), (9, None, "same", 3), (1, "u", None, 4), (2, "u", "", 5), (7, "u", "ünï " * 5000, 6), (None, "n", "same", 7), (None, "n", "alone", 8), (8, "u", "twice", 9), (8, "u", "twice", 9)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, digest int")


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark, tmp_path):
    rows, df = pages(spark)
    out = f"file://{tmp_path}/w"
    write_archive(df, out)
    got = read_archive(spark, out).collect()
    assert len(got) == len(rows)
    first = {"same": 3, "": 1, "ünï " * 5000: 7, "twice": 8, "alone": None}
    want = sorted(((i, len((t or "").encode()), digest(t), "response" if i == first[t or ""] else "revisit", None if i == first[t or ""] else first[t or ""]) for i, _, t, _ in rows), key=str)
    assert sorted(((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want
    assert all(r.header_digest == f"sha1:{r.payload_digest}" for r in got)
    assert spark.read.parquet(f"{out}/payloads").count() == 5
    back = reconstruct(spark, out).collect()
    assert sorted((r.record_id, bytes(r.payload).decode()) for r in back if r.record_id) == sorted((i, t or "") for i, _, t, _ in rows if i)
    for r in back:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        length = int(head.rpartition(b"Content-Length: ")[2])
        assert head.startswith(b"WARC/1.1\r\n") and rest[length:] == b"\r\n\r\n"
        assert b"\r\nX: y" not in head


def test_small_payloads_are_responses(spark, tmp_path):
    _, df = pages(spark)
    write_archive(df, f"file://{tmp_path}/w", min_bytes=5)
    got = read_archive(spark, f"file://{tmp_path}/w")
    assert {r.record_type for r in got.filter("payload_bytes < 5").collect()} == {"response"}


def test_damage_is_found(spark, tmp_path):
    _, df = pages(spark)
    out = f"file://{tmp_path}/w"
    write_archive(df, out)
    spark.read.parquet(f"{out}/payloads").selectExpr("digest", "cast(concat(cast(payload as string), '!') as binary) payload").write.parquet(f"{out}/other")
    (tmp_path / "w/payloads").rename(tmp_path / "w/old")
    (tmp_path / "w/other").rename(tmp_path / "w/payloads")
    with pytest.raises(Exception, match="payload damaged"):
        read_archive(spark, out).collect()


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    write_archive(df, f"file://{tmp_path}/w")
    assert read_archive(spark, f"file://{tmp_path}/w").collect() == []


def test_an_address_starts_no_header_line(spark, tmp_path):
    for i, end in enumerate(["\u2028", "\u0085", "\u2029", "\r", "\n"]):
        out = f"{tmp_path}/{i}"
        df = spark.createDataFrame([(1, f"http://x/{end}WARC-Refers-To: <urn:x-record:5>", "a")], "page_id long, url string, html string")
        write_archive(df, out)
        assert read_archive(spark, out).first().refers_to is None
