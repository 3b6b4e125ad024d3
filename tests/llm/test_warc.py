import gzip
import hashlib
import base64
from collections import defaultdict

import pytest

from tabloom.llm import warc
from tabloom.llm.common import shared_filesystem

PAGES = "page_id long, url string, html string, digest string, payload string, row long"


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "d", "p", 0) for r in rows], PAGES)


ROWS = [(1, "http://a", "<p>same</p>"), (2, "http://b", "<p>same</p>"), (9, None, "<p>same</p>"), (3, "http://c\r\nX: y", "é" * 50_000),
        (4, "http://d", None), (5, "http://e", ""), (6, "http://f", "one"), (7, "http://g", "two"), (7, "http://g", "two"),
        (None, "http://n", "three"), (8, "http://h", "three")]


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[2] or "").encode()].append(r[0])
    out = []
    for payload, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i))
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        top = ids.pop()
        out.append((top, len(payload), digest, "response", None))
        out += [(i, len(payload), digest, "revisit", top) for i in ids]
    return sorted(out, key=str)


def test_round_trip(spark):
    index = warc.write_archive(_pages(spark, ROWS))
    got = warc.read_records(index).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.digest, r.record_type, r.refers_to) for r in got], key=str) == brute(ROWS)
    payloads = {warc.payload_digest(bytes(r.payload)): len(r.payload) for r in got if r.record_type == "response"}
    assert payloads == {r.digest: r.payload_bytes for r in got if r.record_type == "response"}
    assert all(r.payload is None for r in got if r.record_type == "revisit")
    full = warc.read_records(warc.resolve(index)).collect()
    assert len(full) == len(ROWS) and all(warc.payload_digest(bytes(r.payload)) == r.digest for r in full)


def test_selection_and_file_format(spark):
    index = warc.write_archive(_pages(spark, ROWS))
    some = warc.read_records(index.where("page_id in (3, 6)"), gap=0).collect()
    assert {r.page_id for r in some} == {3, 6} and {bytes(r.payload).decode() for r in some} == {"é" * 50_000, "one"}
    name = index.first().file
    fs, path = shared_filesystem(name)
    text = gzip.decompress(fs.open_input_file(path).read())
    assert text.startswith(b"WARC/1.0\r\n") and text.endswith(b"\r\n\r\n") and b"\r\nX: y" not in text


def test_smaller_payloads_never_revisit(spark):
    got = warc.read_records(warc.write_archive(_pages(spark, ROWS), min_payload=5)).collect()
    assert {r.record_type for r in got if r.payload_bytes < 5} == {"response"}
    assert sum(r.record_type == "revisit" for r in got) == 3


def test_hot_payload_and_empty(spark):
    many = [(i, "u", "hot" if i % 3 else f"own {i}") for i in range(3000)]
    got = warc.read_records(warc.write_archive(_pages(spark, many))).select("page_id", "payload_bytes", "digest", "record_type", "refers_to")
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(many)
    assert warc.read_records(warc.write_archive(_pages(spark, []))).count() == 0


@pytest.mark.parametrize("payload", [b"", b"a", bytes(range(256))])
def test_base32(spark, payload):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(payload,)], "p binary")
    assert df.select(warc._base32_of_hex(F.sha1("p"))).first()[0] == warc.payload_digest(payload)
