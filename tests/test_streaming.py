"""Streaming alarms, fed by files and read from memory."""

import datetime as dt
import random

import pytest

from wavetally.streaming.alarms import alarm_sessions, arming_stream, sliding_rates
from wavetally.streaming.ordered import ordered_arming_stream

SCHEMA = "record string, w long, ts timestamp, score double"


def stream(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def drain(spark, df, name, tmp_path, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.sql(f"select * from {name}").collect()


def at(w):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=2.5 * w)


def test_arming_carries_over_batches(spark, tmp_path):
    s = stream(spark, tmp_path, [[("a", w, at(w), 1.0) for w in range(2)] + [("b", 0, at(0), 1.0)], [("a", 2, at(2), 1.0), ("a", 3, at(3), -1.0), ("b", 1, at(1), -1.0), ("b", 2, at(2), 1.0)]])
    got = drain(spark, arming_stream(s), "armed", tmp_path)
    assert [(r.record, r.w) for r in got if r.record == "a"] in ([("a", 2)], [])  # files may come in either order; a late one is dropped
    assert not [r for r in got if r.record == "b"]


def test_arming_in_one_batch(spark, tmp_path):
    s = stream(spark, tmp_path, [[("a", w, at(w), 1.0 if w != 4 else -1.0) for w in range(9)]])
    assert sorted(r.w for r in drain(spark, arming_stream(s), "armed_once", tmp_path)) == [2, 7]


def test_sessions_and_rates(spark, tmp_path):
    rows = [("a", w, at(w * 10), 1.0) for w in (0, 1, 2, 10, 11)]
    s = stream(spark, tmp_path, [rows])
    got = drain(spark, alarm_sessions(s), "sessions", tmp_path, "complete")
    assert sorted(r.n for r in got) == [2, 3]
    assert sum(r.n for r in drain(spark, sliding_rates(s), "rates", tmp_path, "complete")) == 2 * len(rows)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def plain_arming(rows, k):
    out = set()
    for record in {r[0] for r in rows}:
        last, run = -1, 0
        for _, w, ts, score in sorted(r for r in rows if r[0] == record):
            run = (run if w == last + 1 else 0) + 1 if score >= 0 else 0
            last = w
            if run == k:
                out.add((record, w, ts))
    return out


def test_shuffled_windows_give_the_ordered_result(spark, tmp_path, rocks):
    r = random.Random(4)
    rows = [(name, w, at(w), r.choice([1.0, 1.0, 1.0, -1.0])) for name in "ab" for w in range(60) if r.random() > 0.1]
    end = [("z", 0, at(100_000), -1.0)]
    mixed = sorted(rows, key=lambda x: x[1] + r.random() * 12)
    s = stream(spark, tmp_path, [mixed[:40], mixed[40:70], mixed[70:], end, [("z", 1, at(200_000), -1.0)]])
    got = drain(spark, ordered_arming_stream(s, k=3, late="60 seconds", idle_s=100.0), "ordered", tmp_path)
    assert len(got) == len(set(got)) and {(x.record, x.w, x.armed_at) for x in got} == plain_arming(rows, 3)


def test_the_state_of_ended_records_goes(spark, tmp_path, rocks):
    s = stream(spark, tmp_path, [[("a", w, at(w), 1.0) for w in range(3)], [("b", 0, at(50_000), 1.0)], [("c", 0, at(100_000), 1.0)], [("a", w, at(100_000 + w), 1.0) for w in range(3)]])
    name = "ended"
    q = ordered_arming_stream(s, k=3, late="10 seconds", idle_s=60.0).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    try:
        q.processAllAvailable()
        got = spark.sql(f"select * from {name}").collect()
    finally:
        q.stop()
    # a record that comes again after its end starts anew
    assert sorted((x.record, x.w, x.armed_at) for x in got) == [("a", 2, at(2)), ("a", 2, at(100_002))]
