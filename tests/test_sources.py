import os

import pytest

from timberline.operators.incremental import continue_ids, unseen_lines
from timberline.operators.normalize import normalize
from timberline.operators.scoring import score_stateless
from timberline.sources import corpus as CO
from timberline.sources import parquet as PQ
from timberline.sources import text as TX
from timberline.streaming import jobs as J


def test_numbering_over_many_splits(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    expected, line_no, number = [], 0, 0
    for part in range(3):
        with open(folder / f"p{part}.log", "wb") as out:
            for i in range(200):
                line_no += 1
                blank = i % 7 == 0
                out.write(b"   \n" if blank else f"line {part} {i} ".encode() + (b"\xff\xfe" if i == 5 else b"") + b"\r\n")
                if not blank:
                    number += 1
                    expected.append((number, line_no, f"line {part} {i} "))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        rows = TX.number_lines(TX.scan_text(spark, str(folder), "d")).collect()
        assert sorted((r.id, r.source_line, r.line) for r in rows) == expected
        capped = TX.load_file(spark, str(folder), max_lines=10, dataset="d").collect()
        assert sorted(r.source_line for r in capped) == [n for _, n, _ in expected if n <= 10]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(FileNotFoundError):
        TX.scan_text(spark, str(tmp_path / "missing"))


def test_store_append_scan_and_slice(spark, to_lines, tmp_path):
    path = str(tmp_path / "store")
    lines = to_lines([f"2024-01-01 00:00:{n:02d} {'ERROR' if n % 5 == 0 else 'INFO'} api: step {n}" for n in range(1, 41)])
    events = score_stateless(normalize(lines, "dialect", 2024))
    PQ.save_events(events.filter("id <= 10"), path)
    PQ.append_events(events, path)
    PQ.append_events(events, path)
    assert PQ.read_events(spark, path).count() == 40
    assert [tuple(r) for r in PQ.flag_scan(spark, path).collect()] == [("generic", 40, 8)]
    assert [r.id for r in PQ.read_slice(spark, path, 35, 50).collect()] == [36, 37, 38, 39, 40]
    assert PQ.read_slice(spark, path, 99, 5).count() == 0
    assert PQ.read_slice(spark, str(tmp_path / "none")).count() == 0
    stats = PQ.storage_stats(TX.raw_bytes(events), spark, path).first()
    assert stats.compression_ratio_pct >= 0 and stats.row_count == 40


def test_bad_entities_decode_to_nothing(spark):
    df = spark.createDataFrame([("{bad",), ('{"user":"u1"}',)], "entities_json string")
    assert [r.entities.user for r in PQ.parse_entities(df).collect()] == [None, "u1"]


def test_slices_keep_ids_and_positions(spark, to_lines):
    first = normalize(to_lines(["2024-01-01 00:00:01 ERROR a", "2024-01-01 00:00:02 ERROR b"]), "dialect", 2024)
    again = to_lines(["2024-01-01 00:00:01 ERROR a", "2024-01-01 00:00:02 ERROR b", "2024-01-01 00:00:03 ERROR c"])
    fresh = unseen_lines(again, first)
    high = first.groupBy("dataset").agg({"id": "max"}).withColumnRenamed("max(id)", "last_id")
    rows = continue_ids(fresh, high).collect()
    assert [(r.id, r.source_line) for r in rows] == [(3, 3)]
    assert unseen_lines(again.filter("id <= 2"), first).count() == 0


def test_text_stream_restarts_without_repeats(spark, tmp_path):
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    os.makedirs(folder)

    def land(name, lines):
        with open(os.path.join(folder, name), "w") as f:
            f.write("\n".join(lines) + "\n")

    def run():
        J.start_text_ingest(spark, folder, "linux", "syslog", out, mark, 2005).awaitTermination()

    make = lambda a, b: [
        f"Jun 14 15:{n % 60:02d}:01 combo sshd[{n}]: {'ERROR authentication failure for root' if n % 15 == 0 else 'session opened'}"
        for n in range(a, b)
    ]
    land("a.log", make(0, 80))
    run()
    land("b.log", make(80, 120))
    run()
    rows = PQ.read_events(spark, out).collect()
    assert sorted(r.id for r in rows) == list(range(1, 121))
    assert sum(r.is_anomaly for r in rows) == 8
    assert max(r.source_line for r in rows) == 80


def test_corpora_and_truth(spark, tmp_path):
    short, full = tmp_path / "short.log", tmp_path / "full.log"
    short.write_text("a\n\nb\n")
    assert [(r.dataset, r.id, r.source_line, r.line) for r in CO.read_raw(spark, "x", str(short), other_paths=(str(full),)).orderBy("id").collect()] == [
        ("x", 1, 1, "a"), ("x", 2, 3, "b")]
    full.write_text("c\n")
    assert [r.line for r in CO.read_raw(spark, "x", str(short), other_paths=(str(full),)).collect()] == ["c"]
    with pytest.raises(FileNotFoundError):
        CO.read_raw(spark, "x", str(tmp_path / "none.log"))
    assert CO.read_structured(spark, str(tmp_path / "no.csv")).columns == ["LineId", "Time", "Level", "Content", "EventTemplate"]


def test_conditions_reach_the_scan(spark, tmp_path):
    """``where`` prunes folders and pushes the id filter into the scan."""
    from timberline.operators.normalize import normalize

    rows = [(d, "generic", d, n, n, f"2024-01-01 00:00:00 INFO svc: line {n}") for d in ("a", "b") for n in range(1, 40)]
    lines = spark.createDataFrame(rows, "dataset string, dialect string, source_id string, source_line long, id long, line string")
    lines.write.partitionBy("dataset").parquet(str(tmp_path / "lines"))
    events = normalize(spark.read.parquet(str(tmp_path / "lines")), where="dataset = 'a' AND id < 10")
    plan = events._jdf.queryExecution().executedPlan().toString()
    assert "dataset" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "LessThan(id,10)" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert events.count() == 9
