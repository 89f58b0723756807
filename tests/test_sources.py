"""Summary texts, EDF files, lists and CSV tables."""

import struct

import pytest

from wavetally.operators.models import fold_scores
from wavetally.operators.sampling import budgeted_training, fold_training
from wavetally.config import Config
from wavetally.sources import edf as ed, recordings as rc, summaries as sm

TEXT = """Header
File Name: ab01_01.edf
Number of Events: 0
File Name: ab01_02+.edf
Number of Events: 2
Event 1 Start Time: 10 seconds
Event 1 End Time: 20 seconds
Event 2 Start Time: 30 seconds
Event 2 End Time: 44 seconds
Event 3 Start Time: 99 seconds
File Name: ab01a_03.edf
Event Start Time: 5 seconds
Event End Time: 8 seconds
File Name: notes.txt
File Name: odd-name.edf
Event Start Time: 1 seconds
Event End Time: 2 seconds
File Name: ab01_01.edf
Event Start Time: 7 seconds
Event End Time: 9 seconds
"""


def test_summaries(spark, tmp_path):
    (tmp_path / "s.txt").write_bytes(TEXT.encode("latin-1"))
    got = sm.parse_summaries(sm.read_summaries(spark, str(tmp_path)), "Event").collect()
    assert sorted((r.file, r.start_sec, r.end_sec) for r in got) == [("ab01_01.edf", 7, 9), ("ab01_02+.edf", 10, 20), ("ab01_02+.edf", 30, 44), ("ab01a_03.edf", 5, 8), ("odd-name.edf", 1, 2)]


def test_odd_summaries(spark):
    """Numbers without blanks around them; starts with numbers but ends without; a file's own times are no event's."""
    texts = [
        ("a", "File Name: ab01_01.edf\nFile Start Time: 11:42:54\nFile End Time: 12:42:54\nSeizure1 Start Time: 10 seconds\nSeizure1End Time: 20\nSeizure 2Start Time:\n30\nseizure 2 End Time: 40"),
        ("b", "File Name: ab01_02.edf\nSeizure 1 Start Time: 7\nSeizure Start Time: 8\nSeizure End Time: 9"),
        ("c", "File Name: ab01_03.edf\nFile Start Time: 11:42:54\nFile End Time: 12:42:54"),
    ]
    got = sm.parse_summaries(spark.createDataFrame(texts, "path string, value string")).collect()
    assert sorted(((r.path, r.start_sec, r.end_sec) for r in got), key=str) == [("a", 10, 20), ("a", 30, 40), ("b", 8, 9), ("c", None, None)]


def test_feature_sink(spark, tmp_path):
    rows = spark.createDataFrame([("p1", 0, [1.0, 2.0]), ("p2", 0, [3.0, 4.0])], "patient string, w long, features array<double>")
    rc.write_features(rows, str(tmp_path), order=5, bands=["a", "b"])
    rc.write_features(rows.where("patient = 'p2'").withColumn("w", rows.w + 9), str(tmp_path), order=5, bands=["a", "b"])
    got, parameters = rc.read_features(spark, str(tmp_path))
    assert {(r.patient, r.w, tuple(r.features)) for r in got.collect()} == {("p1", 0, (1.0, 2.0)), ("p2", 9, (3.0, 4.0))} and parameters == {"order": 5, "bands": ["a", "b"]}


def edf(labels, rows, fs=4):
    n = len(labels)
    field = lambda v, size: str(v).ljust(size).encode()[:size]
    head = field("0", 8) + field("", 160) + field("", 16) + field(256 * (n + 1), 8) + field("", 44) + field(len(rows[0]) // fs, 8) + field(1, 8) + field(n, 4)
    for values, size in ((labels, 16), ([""] * n, 80), (["uV"] * n, 8), ([-100] * n, 8), ([100] * n, 8), ([-1000] * n, 8), ([1000] * n, 8), ([""] * n, 80), ([fs] * n, 8), ([""] * n, 32)):
        head += b"".join(field(v, size) for v in values)
    body = b"".join(struct.pack(f"<{fs}h", *r[i : i + fs]) for i in range(0, len(rows[0]), fs) for r in rows)
    return head + body


def test_edf(spark, tmp_path):
    (tmp_path / "a_01.edf").write_bytes(edf(["C3 -1", "C4"], [list(range(8)), list(range(0, 80, 10))]))
    (tmp_path / "b_01.edf").write_bytes(b"broken")
    rows = {(r.record, r.channel_idx): r for r in rc.read_edf(spark, str(tmp_path)).collect()}
    assert rows["a_01", 0].sampling_rate == 4.0 and rows["a_01", 1].samples == pytest.approx([0.1 * x for x in range(0, 80, 10)], abs=1e-5)
    assert rows["b_01", -1].error
    good = rc.read_edf(spark, str(tmp_path)).where("error is null")
    blocks = rc.to_blocks(good, 3)
    assert blocks.count() == 6
    assert {r.channel_idx: r.samples for r in rc.from_blocks(blocks, ["record", "channel_idx"]).collect()}[1] == rows["a_01", 1].samples
    got, missing = rc.montage(good, spark.createDataFrame([(1, "C3"), (2, "CZ")], "pos int, name string"), ["record"])
    assert got.count() == 0 and missing.first().missing == ["CZ"]
    listing = rc.discover(spark, str(tmp_path), "*.edf")
    report = rc.conversion_report(spark.createDataFrame([("a_01.edf",), ("z.edf",)], "file string"), listing)
    assert {r.file: r.missing for r in report.collect()} == {"a_01.edf": False, "z.edf": True}


@pytest.mark.parametrize("size", [20, 100, 1 << 20])
def test_edf_by_ranges(spark, tmp_path, size):
    """Tasks that read a few data records each give what reading whole files gives."""
    series = {"a_01": [list(range(k, 400 + k)) for k in (0, 50, 7)], "b_02": [list(range(0, 120))]}
    (tmp_path / "sub").mkdir()
    for name, rows in series.items():
        (tmp_path / "sub" / f"{name}.edf").write_bytes(edf([f"C{k}" for k in range(len(rows))], rows))
    whole = edf(["C0"], [list(range(40))])
    (tmp_path / "cut.edf").write_bytes(whole[:-3])
    (tmp_path / "bad.edf").write_bytes(b"broken")
    (tmp_path / "empty.edf").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(whole)
    got = ed.read_ranges(spark, str(tmp_path), size)
    rows = got.where("error is null").collect()
    assert len(rows) == 5 if size == 1 << 20 else len(rows) > 8
    seen = {}
    for r in sorted(rows, key=lambda r: r.start):
        at = seen.setdefault((r.record, r.channel_idx), [])
        assert r.start == len(at) and r.sampling_rate == 4.0 and r.channel == f"C{r.channel_idx}"
        at.extend(r.samples)
    want = {(n, k): [0.1 * v for v in x] for n, xs in series.items() for k, x in enumerate(xs)} | {("cut", 0): [0.1 * v for v in range(36)]}
    assert seen.keys() == want.keys() and all(seen[k] == pytest.approx(v, abs=1e-5) for k, v in want.items())
    assert sorted(r.record for r in got.where("error is not null").collect()) == ["bad", "empty"]
    blocks = {}
    for r in ed.to_blocks(got, 17).orderBy("block").collect():
        blocks.setdefault((r.record, r.channel), []).append(r.samples)
    assert all(sum(b, []) == pytest.approx(want[k], abs=1e-5) and {len(x) for x in b[:-1]} <= {17} for k, b in blocks.items()) and blocks.keys() == want.keys()


def test_montage_is_stored_and_read(spark, tmp_path):
    rows = [("p1", "a", 0, "C3 -1", [1.0, 2.0, 3.0]), ("p1", "a", 1, "c4", [4.0, 5.0, 6.0]), ("p1", "a", 2, "C4", [9.0]), ("p1", "b", 0, "C3", [7.0]), ("p2", "c", 5, "C4", [1.5]), ("p2", "c", 6, "c3", [2.5])]
    channels = spark.createDataFrame([(*r[:4], 4.0, r[4]) for r in rows], "patient string, record string, channel_idx int, channel string, sampling_rate double, samples array<float>")
    wanted = spark.createDataFrame([(0, "C4"), (1, "C3")], "pos int, name string")
    missing = rc.write_montage(channels, wanted, str(tmp_path / "m"), 2)
    assert [(r.record, r.missing) for r in missing.collect()] == [("b", ["C4"])]
    got = {(r.patient, r.record, r.channel, r.name, r.block): r.samples for r in rc.read_recordings(spark, str(tmp_path / "m")).collect()}
    assert got == {("p1", "a", 0, "C4", 0): [4.0, 5.0], ("p1", "a", 0, "C4", 1): [6.0], ("p1", "a", 1, "C3", 0): [1.0, 2.0], ("p1", "a", 1, "C3", 1): [3.0], ("p2", "c", 0, "C4", 0): [1.5], ("p2", "c", 1, "C3", 0): [2.5]}


def test_windows_are_loaded_past_broken_files(spark, tmp_path):
    one = lambda *v: [(x, 0.0) for x in v]
    rows = [("p1", "a", [0, 1, 1, 1], [one(1.0), one(2.0)]), ("p1", "b", [0], [one(3.0), [(4.0, 0.5)], one(5.0)]), ("p2", "c", [1], [one(6.0)])]
    df = spark.createDataFrame(rows, "patient string, record string, labels array<int>, windows array<array<struct<real:double,imag:double>>>")
    df.write.partitionBy("patient").parquet(str(tmp_path / "f"))
    (tmp_path / "f" / "patient=p1" / "part-broken.parquet").write_bytes(b"PAR1 nothing of the kind")
    got = rc.load_windows(spark, str(tmp_path / "f"), ["p1"]).collect()
    assert {(r.record, r.w, r.label, r.features[0], r.record_class) for r in got} == {("a", 0, 0, 1.0, 1), ("a", 1, 1, 2.0, 1), ("b", 0, 0, 3.0, 0), ("b", 2, 0, 5.0, 0)}


def test_tables(spark, tmp_path):
    p = tmp_path / "fp.csv"
    p.write_text("patient,record,fp_start,fp_duration_s\na,a_1,1.5,nan\na,a_2,,20\n")
    rows = rc.read_table_csv(spark, str(p), rc.FALSE_POSITIVE).orderBy("record").collect()
    assert (rows[0].fp_start, rows[0].fp_duration_s, rows[1].fp_start) == (1.5, None, None)
    (tmp_path / "list.txt").write_text(" a_1.h5 \n\nb_2.h5\n")
    names = rc.read_list(spark, str(tmp_path / "list.txt"))
    assert sorted(r.record for r in names.collect()) == ["a_1", "b_2"]
    rc.write_list(names, str(tmp_path / "out"))
    assert rc.read_list(spark, str(tmp_path / "out")).count() == 2
    rc.write_table_csv(spark.createDataFrame([("a", 1.0)], "k string, v double"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().k == "a"


def test_recordings_replace_only_their_patient(spark, tmp_path):
    row = lambda p, v: spark.createDataFrame([(p, "r", 0, 0, [v])], "patient string, record string, channel_idx int, block_idx int, samples array<float>")
    rc.write_recordings(row("a", 1.0), str(tmp_path / "rec"))
    rc.write_recordings(row("b", 2.0), str(tmp_path / "rec"))
    rc.write_recordings(row("a", 3.0), str(tmp_path / "rec"))
    assert {r.patient: r.samples[0] for r in spark.read.parquet(str(tmp_path / "rec")).collect()} == {"a": 3.0, "b": 2.0}


def test_budget(spark):
    rows = [(f"r{i % 3}", i // 3, int(i % 50 == 0)) for i in range(900)]
    df = spark.createDataFrame(rows, "record string, w long, y int")
    got = budgeted_training(df, Config(budget=108, strata=10)).collect()
    assert sum(r.y for r in got) == 18 and len(got) == 108
    assert budgeted_training(df, Config(budget=5000)).count() == 900
    assert budgeted_training(df, Config(budget=10)).count() == 18


def test_each_fold_has_both_classes_within_its_budget(spark):
    rows = [(i % 4, i // 4, int(i % 10 > 0), i % 4) for i in range(2000)]
    df = spark.createDataFrame(rows, "record long, w long, y int, own long")
    got = fold_training(df, Config(budget=100, strata=7)).collect()
    for task in range(4):
        own = [r for r in got if r.task == task]
        assert all(r.own != task for r in own) and len({(r.record, r.w) for r in own}) == len(own)
        assert abs(sum(r.y == 1 for r in own) - 90) <= 2 and abs(sum(r.y == 0 for r in own) - 10) <= 2  # shares are rounded
    assert fold_training(df, Config(budget=5000)).count() == 3 * 2000
    few = df.where("y = 0 or w < 3")
    assert {r["count"] for r in fold_training(few, Config(budget=50)).groupBy("task", "y").count().where("y = 1").collect()} <= {6, 7, 8, 9}
    scored = fold_scores(df.selectExpr("record", "w", "y", "array(y + w % 3, w % 5) as features", "own as fold"), "fold", Config(budget=100, strata=7))
    assert scored.count() == 2000 and scored.where("score is null").count() == 0
