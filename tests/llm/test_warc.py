import hashlib

import pytest

from clearwell.functions.storage import fresh_path
from clearwell.llm import warc

ROWS = [
    (1, "http://a", "x" * 1000), (2, "http://b", "x" * 1000), (5, None, "x" * 1000), (5, "http://again", "x" * 1000),
    (3, "http://c", "y" * 999), (4, "http://d", "y" * 999), (6, "http://e\r\nX: y", "é" * 500), (7, "http://f", "é" * 500),
    (8, "http://g", None), (9, "http://h", ""), (None, "http://i", "x" * 1000), (10, "http://j", "WARC/1.1\r\n\r\n\r\nabc" * 100),
    (-3, "http://k", "z" * 200_000),
]


def pages(spark, rows):
    return spark.createDataFrame(
        [(*r, 1, "p", "d", "s") for r in rows], "page_id bigint, url string, html string, id int, payload string, digest string, size string")


def plain(rows):
    keep = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            keep[b] = max(keep.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = i is not None and b in keep and keep[b] != i
        out.append((repr(i), len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", keep[b] if again else None))
    return sorted(out, key=repr)


def test_archive_reads_back(spark):
    at = fresh_path(spark, "warc")
    warc.write_archive(pages(spark, ROWS), at)
    got = warc.read_records(spark, at).collect()
    assert sorted(((repr(r["id"]), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == plain(ROWS)
    stored = spark.read.parquet(f"{at}/payloads").collect()
    assert len(stored) == len({(h or "") for _, _, h in ROWS})
    records = [bytes(r["record"]) for r in warc.original_records(spark, at).collect()]
    assert len(records) == len(ROWS)
    for record in records:
        head, _, rest = record.partition(b"\r\n\r\n")
        length = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
        assert head.startswith(b"WARC/1.1\r\n") and rest[length:] == b"\r\n\r\n"


def test_damage_is_noticed(spark):
    at = fresh_path(spark, "warc")
    warc.write_archive(pages(spark, ROWS[:3]), at)
    bad = spark.read.parquet(f"{at}/payloads").selectExpr("digest", "encode(concat(decode(payload, 'UTF-8'), '!'), 'UTF-8') payload").collect()
    spark.createDataFrame(bad, "digest string, payload binary").write.mode("overwrite").parquet(f"{at}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_records(spark, at).collect()


def test_empty_table(spark):
    at = fresh_path(spark, "warc")
    warc.write_archive(pages(spark, []), at)
    assert warc.read_records(spark, at).count() == 0 and warc.original_records(spark, at).count() == 0
