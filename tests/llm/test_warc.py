"""Archives: exact round trips, ranges that fall anywhere, bytes that look like records."""

import gzip
import hashlib

import pytest

from wavetally.llm import warc
from wavetally.llm.shared import shared_dir

SCHEMA = "page_id long, url string, html string, record_type string"


def pages(spark):
    big = "x" * 300_000
    rows = [(1, "http://a/ b\r\n", "p" * 150, "e"), (5, None, "p" * 150, "e"), (3, "u", "p" * 150, None), (4, "u", "short", "e"), (7, "u", "short", "e"), (8, "u", None, "e"), (9, "u", "", "e"), (10, "u", big, "e"), (11, "ü", "é" * 60, "e"), (12, "u", "é" * 60, "e"), (1, "u", "p" * 150, "e")]
    return spark.createDataFrame([*rows, (None, "u", "p" * 150, "e")], SCHEMA).repartition(3)


@pytest.mark.parametrize("split", [97, 4096, 64 << 20])
def test_round_trip(spark, split):
    df = pages(spark)
    want = []
    rows = [(r.page_id, (r.html or "").encode()) for r in df.collect()]
    for i, p in rows:
        same = [j for j, q in rows if q == p and j is not None]
        first = min(same) if len(p) >= 100 else i
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "response" if first == i else "revisit", None if first == i else first))
    got = [tuple(None if v != v else v for v in r) for r in warc.warc_round_trip(df, split_bytes=split).drop("uri").toPandas().astype(object).where(lambda x: x.notna(), None).itertuples(index=False)]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_payloads_come_back(spark):
    df = spark.createDataFrame([(i, "u", f"<p>{i}</p>\r\n\r\nWARC/1.1 é") for i in range(40)], "page_id long, url string, html string")
    files = warc.write_warc(df, shared_dir(spark) + "-w")
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read_warc(spark, files, 500).collect()}
    assert got == {i: f"<p>{i}</p>\r\n\r\nWARC/1.1 é" for i in range(40)}


def test_empty_table(spark):
    assert warc.warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_every_range_owns_what_starts_in_it():
    members = [warc.record(i, "u", bytes([i]) * 50, "d") for i in range(20)]
    junk = b"\x1f\x8b\x08 no record" + gzip.compress(b"no record either")
    data = members[0] + junk + b"".join(members[1:]) + b"\x1f\x8b"
    read = lambda pos, n: data[pos : pos + n]
    whole = [at for at, _ in warc.records_in(read, len(data), 0, len(data))]
    assert len(whole) == 20
    for step in (1, 13, 200, 1000):
        parts = [at for s in range(0, len(data), step) for at, _ in warc.records_in(read, len(data), s, min(s + step, len(data)), 64)]
        assert parts == whole
