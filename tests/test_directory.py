import pytest
from pyspark.sql import functions as F

from timberline.sources import directory as D
from timberline.sources import parquet as PQ

EVENT = ("dataset string, id long, source_id string, source_line long, event_id string, timestamp string, timestamp_epoch double, level string, "
         "service string, host string, pid string, message string, template_id string, template string, params array<string>, "
         "entities struct<block_id:string>, anomaly_score double, is_anomaly boolean")


def events(spark, dataset, source, lines, ids=None, identity=None):
    rows = spark.createDataFrame([(n, i) for n, i in zip(lines, ids or lines, strict=True)], "source_line long, id long")
    made = F.sha2(F.concat(F.lit(source), F.col("source_line").cast("string")), 256)
    blank = [F.lit("").alias(c) for c in ("timestamp", "service", "host", "pid", "template_id", "template")]
    return rows.coalesce(1).select(
        F.lit(dataset).alias("dataset"), "id", F.lit(source).alias("source_id"), "source_line",
        (F.lit(identity) if identity else made).alias("event_id"), F.lit("INFO").alias("level"), F.concat(F.lit("m"), F.col("id")).alias("message"),
        F.array().cast("array<string>").alias("params"), F.lit(None).cast("struct<block_id:string>").alias("entities"),
        F.lit(0.0).alias("timestamp_epoch"), F.lit(0.1).alias("anomaly_score"), F.lit(False).alias("is_anomaly"), *blank,
    )


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path / "a store")
    for k in range(5):
        PQ.append_events(events(spark, "d e", "s", range(100 * k + 1, 100 * k + 101)), path)
    PQ.append_events(events(spark, "other", "t", range(1, 51)), path)
    return path


def test_an_append_reads_only_files_that_may_hold_a_line(spark, store):
    assert len(D.files_that_may_hold(spark, store, events(spark, "d e", "new", range(1, 500)))) == 0
    assert len(D.files_that_may_hold(spark, store, events(spark, "d e", "s", range(250, 260)))) == 1
    assert len(D.files_that_may_hold(spark, store, events(spark, "d e", "s", range(290, 310)))) == 2
    assert len(D.files_that_may_hold(spark, store, events(spark, "d e", "s", [700], identity="legacy-7"))) == 6
    found = D.identities(spark, store, events(spark, "d e", "s", range(250, 260)))
    assert len(found.inputFiles()) == 1 and found.count() == 100
    before = PQ.read_events(spark, store).count()
    PQ.append_events(events(spark, "d e", "s", range(450, 521)), store)
    PQ.append_events(events(spark, "d e", "s", range(450, 521)), store)
    assert PQ.read_events(spark, store).count() == before + 20


def test_rows_without_a_directory_are_found(spark, store, tmp_path):
    PQ.save_events(events(spark, "d e", "s", range(501, 601)), store, mode="append")  # a job that stopped before describing
    assert D.not_stored(spark, store, events(spark, "d e", "s", range(590, 611))).count() == 10
    plain = str(tmp_path / "plain")
    PQ.save_events(events(spark, "d", "s", range(1, 11)), plain)
    assert D.not_stored(spark, plain, events(spark, "d", "s", range(5, 16))).count() == 5
    PQ.save_events(events(spark, "d", "s", range(1, 4)), plain)  # overwritten: what the files held is gone
    assert D.not_stored(spark, plain, events(spark, "d", "s", range(1, 11))).count() == 7
    assert D.not_stored(spark, str(tmp_path / "none"), events(spark, "d", "s", [1])).count() == 1


def page(spark, path, offset, limit):
    return [(r.dataset, r.id) for r in PQ.read_slice(spark, path, offset, limit).collect()]


def test_deep_pages_open_the_files_that_hold_them(spark, store):
    rows = [("d e", i) for i in range(1, 501)] + [("other", i) for i in range(1, 51)]
    for offset, limit in ((0, 10), (95, 10), (250, 130), (480, 40), (545, 50), (600, 5)):
        assert page(spark, store, offset, limit) == rows[offset : offset + limit]
    deep = PQ.read_slice(spark, store, 450, 20)
    assert len(deep.inputFiles()) == 1
    plan = deep._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [dataset" in plan and ", true" not in plan.split("Sort [dataset")[1].split("\n")[0]  # local only
    assert "Exchange" not in deep._jdf.queryExecution().sparkPlan().toString()


def test_pages_of_files_with_gaps_and_common_ids(spark, tmp_path):
    path = str(tmp_path / "s")
    ids = [3 * k for k in range(1, 41)]
    PQ.append_events(events(spark, "d", "s", range(1, 21), ids[0:40:2]), path)
    PQ.append_events(events(spark, "d", "s", range(21, 41), ids[1:40:2]), path)
    PQ.append_events(events(spark, "d", "u", range(1, 11), range(1000, 1010)), path)
    rows = [("d", i) for i in [*ids, *range(1000, 1010)]]
    for offset, limit in ((0, 7), (15, 20), (35, 12), (45, 50)):
        assert page(spark, path, offset, limit) == rows[offset : offset + limit]
    assert page(spark, str(tmp_path / "none"), 0, 5) == []
