import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from strataweave.llm import warc
from strataweave.llm.common import new_folder

RECORD = {"record_id": "urn:x:1", "record_type": "response", "target_uri": "http://a/\nb", "payload_digest": warc.sha1_base32(b"abc"), "refers_to": None, "payload": b"abc"}


def stored(spark, rows, **options):
    warc.register(spark)
    folder = new_folder(spark, "warc-test")
    df = spark.createDataFrame([(k, f"urn:x-page:{k}", u, None if p is None else bytearray(p)) for k, u, p in rows], "record_key long, record_id string, target_uri string, payload binary")
    df = df.withColumn("payload", F.coalesce("payload", F.lit(b"").cast("binary")))
    warc.with_revisits(df).write.format("warc").mode("append").options(**options).save(folder)
    return folder


def test_pages_come_back_with_revisits(spark):
    rows = [(1, "http://a/1", b"same"), (5, "http://a/5", b"same"), (3, None, b""), (4, "http://a/4", None), (9, "http://a/9", "ünï\r\n\r\nx".encode() * 9000), (5, "http://a/5", b"same")]
    found = spark.read.format("warc").load(stored(spark, rows, file_mb=0.0001)).collect()
    assert sorted((r.record_id, r.record_type, r.refers_to) for r in found) == sorted(
        [("urn:x-page:1", "revisit", "urn:x-page:5"), ("urn:x-page:5", "response", None), ("urn:x-page:5", "response", None), ("urn:x-page:3", "revisit", "urn:x-page:4"), ("urn:x-page:4", "response", None), ("urn:x-page:9", "response", None)]
    )
    payloads = {f"urn:x-page:{k}": p or b"" for k, _, p in rows}
    for r in found:
        payload = payloads[r.record_id]
        assert r.payload_bytes == len(payload)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == payload


def test_small_payloads_stay_responses(spark, rows):
    df = spark.createDataFrame([(1, "a", "u", bytearray(b"xy")), (2, "b", "u", bytearray(b"xy"))], "record_key long, record_id string, target_uri string, payload binary")
    assert rows(warc.with_revisits(df, min_bytes=3), "record_type") == [("response",), ("response",)]


def test_predicates_are_pushed_down_and_payloads_skipped(spark):
    folder = stored(spark, [(1, "http://a/1", b"same"), (2, "http://a/2", b"same"), (3, "http://a/3", b"else")])
    read = spark.read.format("warc").load(folder)
    assert [r.record_id for r in read.where("record_type = 'revisit'").collect()] == ["urn:x-page:1"]
    assert [r.record_id for r in read.where("target_uri in ('http://a/3', 'nowhere')").collect()] == ["urn:x-page:3"]
    plan = read.where("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "PythonScan" in plan or "BatchScan" in plan
    bare = spark.read.format("warc").option("payload", "false").load(folder).collect()
    assert len(bare) == 3 and all(r.payload is None for r in bare)


def test_excluded_records_are_not_decoded():
    data = b"".join(warc.member(warc.record_bytes({**RECORD, "record_id": f"urn:{n}", "record_type": t, "payload": bytes(range(256)) * 2000})) for n, t in enumerate(["response", "revisit", "response"]))
    stream = warc._Stream(io.BytesIO(data), {"WARC-Type": {"revisit"}}, True)
    assert [r["record_id"] for r in stream] == ["urn:1"]
    assert stream.decoded == 1
    assert gzip.decompress(data).count(b"WARC/1.1") == 3


def test_plain_archives_and_damage():
    one = warc.record_bytes(RECORD)
    for data in (one * 3, b"".join([warc.member(one)] * 3)):
        found = list(warc._Stream(io.BytesIO(data), {}, True))
        assert [r["payload"] for r in found] == [b"abc"] * 3
        assert found[0]["target_uri"] == "http://a/\nb"
        with pytest.raises(ValueError):
            list(warc._Stream(io.BytesIO(data[:-30]), {}, True))
    with pytest.raises(ValueError):
        list(warc._Stream(io.BytesIO(b"HTTP/1.1 200 OK\r\n\r\n"), {}, True))


def test_empty_table(spark):
    assert spark.read.format("warc").load(stored(spark, [])).collect() == []


def test_headers_longer_than_a_piece_of_the_member(spark):
    url = "data:," + base64.b64encode(b"".join(hashlib.sha256(b"%d" % i).digest() for i in range(4700))).decode()
    assert len(url) > 200_000
    found = spark.read.format("warc").load(stored(spark, [(1, url, b"abc"), (2, "http://a/2", b"def" * 50000)]))
    assert sorted((r.target_uri, bytes(r.payload)) for r in found.collect()) == [(url, b"abc"), ("http://a/2", b"def" * 50000)]
    assert [r.record_id for r in found.where(F.col("target_uri") == url).collect()] == ["urn:x-page:1"]


def test_members_without_the_end_of_headers_are_refused():
    whole = warc.record_bytes(RECORD)
    with pytest.raises(ValueError):
        list(warc._Stream(io.BytesIO(warc.member(whole[: whole.index(b"Content-Length")])), {}, True))


def test_archives_of_other_writers():
    """Members without lengths, with a name in their header, of many records, and one after the other."""
    records = [warc.record_bytes({**RECORD, "record_id": f"urn:{n}", "record_type": t, "payload": bytes(range(256)) * 3000}) for n, t in enumerate(["response", "revisit", "response", "response"])]
    named = io.BytesIO()
    with gzip.GzipFile(filename="x.warc", mode="wb", fileobj=named) as f:
        f.write(records[2])
    each = b"".join(gzip.compress(r) for r in records)
    for data in (each, gzip.compress(b"".join(records)), gzip.compress(records[0]) + records[1] + named.getvalue() + warc.member(records[3])):
        found = list(warc._Stream(io.BytesIO(data), {}, True))
        assert [(r["record_id"], r["record_type"]) for r in found] == [("urn:0", "response"), ("urn:1", "revisit"), ("urn:2", "response"), ("urn:3", "response")]
        assert [r["payload"] for r in found] == [bytes(range(256)) * 3000, None, bytes(range(256)) * 3000, bytes(range(256)) * 3000]
        stream = warc._Stream(io.BytesIO(data), {"WARC-Type": {"revisit"}}, True)
        assert [r["record_id"] for r in stream] == ["urn:1"] and stream.decoded == 1
        assert all(r["payload"] is None for r in warc._Stream(io.BytesIO(data), {}, False))
        with pytest.raises(ValueError):
            list(warc._Stream(io.BytesIO(data[:-40]), {}, True))
    for data in (each, b"".join(map(warc.member, records))):
        damaged = bytearray(data)
        damaged[-6] ^= 1  # in the last member's CRC
        with pytest.raises(ValueError):
            list(warc._Stream(io.BytesIO(bytes(damaged)), {}, True))


def test_targets_come_back_as_they_were():
    targets = ["http://a/%0Ab", "http://a/\nb", "http://a/%250A\tb\x7f", "http://a/%zz", "", None]
    lines = [warc.record_bytes({**RECORD, "target_uri": t}) for t in targets]
    assert len(set(lines)) == len(targets)
    assert [r["target_uri"] for r in warc._Stream(io.BytesIO(b"".join(map(warc.member, lines))), {}, True)] == targets
    wanted = warc._Stream(io.BytesIO(b"".join(map(warc.member, lines))), {"WARC-Target-URI": {"http://a/\nb"}}, True)
    assert [r["target_uri"] for r in wanted] == ["http://a/\nb"]


def test_columns_of_clashing_names_and_pushed_ids(spark):
    warc.register(spark)
    df = spark.createDataFrame([(n, f"urn:x-page:{n}", "u", bytearray(b"same"), "l", "s", 1) for n in (1, 2)], "record_key long, record_id string, target_uri string, payload binary, last string, sha1 string, copies int")
    folder = new_folder(spark, "warc-clash")
    warc.with_revisits(df).write.format("warc").mode("append").save(folder)
    read = spark.read.format("warc").load(folder)
    assert [r.record_type for r in read.where("record_id = 'urn:x-page:2'").collect()] == ["response"]
    assert [r.record_id for r in read.where("refers_to = 'urn:x-page:2'").collect()] == ["urn:x-page:1"]
