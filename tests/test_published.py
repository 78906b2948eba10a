import random

import pytest
from pyspark.sql import functions as F

from timberline.operators import templates as T
from timberline.sources.published import Published, read_published
from timberline.streaming import jobs as J


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "n long")


def failing(df):
    return df.withColumn("n", F.when(F.col("n") > 0, F.raise_error(F.lit("no")).cast("long")))


def read(store, name):
    return sorted(r.n for r in store.read(name).collect())


def test_versions_replace_extend_and_sweep(spark, tmp_path):
    store = Published(spark, str(tmp_path / "p"), keep=2, parts=2)
    with pytest.raises(FileNotFoundError):
        store.read("a")
    assert store.read("a", "n long").collect() == []
    for k in range(5):
        assert store.publish(replace={"a": numbers(spark, k)}, extend={"b": numbers(spark, k)}) == k
    assert read(store, "a") == [4] and read(store, "b") == [0, 1, 2, 3, 4]
    assert store.versions() == [3, 4] and len(store.version()["tables"]["b"]) <= 3
    on_disk = sorted(str(p.relative_to(tmp_path / "p")) for name in "ab" for p in (tmp_path / "p" / name).iterdir())
    assert on_disk == sorted({f for n in (3, 4) for fs in store.version(n)["tables"].values() for f in fs})


def test_a_failed_version_is_never_seen(spark, tmp_path):
    store = Published(spark, str(tmp_path / "p"))
    store.publish(replace={"a": numbers(spark, 1), "b": numbers(spark, 1)})
    with pytest.raises(Exception, match="no"):
        store.publish(replace={"a": numbers(spark, 2), "b": failing(numbers(spark, 2))})
    assert read(store, "a") == [1] and read(store, "b") == [1]
    store.publish(replace={"a": numbers(spark, 3)})
    assert read(store, "a") == [3] and read(store, "b") == [1]


def test_two_writers_cannot_take_one_number(spark, tmp_path):
    one, two = Published(spark, str(tmp_path / "p")), Published(spark, str(tmp_path / "p"))
    one.publish(replace={"a": numbers(spark, 1)})
    before = two.version
    two.version = lambda number=None: {"number": -1, "tables": {}, "streams": {}} if number is None else before(number)
    with pytest.raises(Exception, match="exists"):
        two.publish(replace={"a": numbers(spark, 2)})
    assert read(one, "a") == [1]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    store = Published(spark, str(tmp_path / "p"))
    store.publish(extend={"a": numbers(spark, 1)}, stream="s", batch=0)
    store.publish(extend={"a": numbers(spark, 1)}, stream="s", batch=0)
    store.publish(extend={"a": numbers(spark, 2)}, stream="other", batch=0)
    assert read(store, "a") == [1, 2] and store.done("s", 0) and not store.done("s", 1)


def land(spark, path, rows):
    spark.createDataFrame(rows, "dataset string, id long, template string").coalesce(1).write.mode("append").parquet(path)


def test_a_stream_that_fails_leaves_the_last_version_and_goes_on(spark, tmp_path):
    landing, out, mark = (str(tmp_path / n) for n in ("landing", "out", "mark"))
    totals = "dataset string, id long, template string"

    def run(broken):
        rows = spark.readStream.schema(totals).option("maxFilesPerTrigger", 1).parquet(landing)
        if broken:
            rows = rows.withColumn("id", F.when(F.col("id") > 1, F.raise_error(F.lit("no")).cast("long")).otherwise(F.col("id")))
        J.start_published(rows.groupBy("dataset").agg(F.sum("id").alias("n")), "totals", out, mark).awaitTermination()

    land(spark, landing, [("d", 1, "x")])
    run(False)
    land(spark, landing, [("d", 5, "x")])
    with pytest.raises(Exception):
        run(True)
    assert [r.n for r in read_published(spark, out, "totals").collect()] == [1]
    run(False)
    assert [r.n for r in read_published(spark, out, "totals").collect()] == [6]


def test_streamed_templates_equal_one_batch_with_a_child_limit(spark, tmp_path):
    rng = random.Random(6)
    words = ["a", "b", "c", "d", "<NUM>", "<*>", "e"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(240)]
    rows = [("d", i, t) for i, t in enumerate(texts, 1)]
    landing, out, mark = (str(tmp_path / n) for n in ("landing", "out", "mark"))

    def run():
        events = spark.readStream.schema("dataset string, id long, template string").option("maxFilesPerTrigger", 1).parquet(landing)
        J.start_templates(events, out, mark, max_children=3, head=7).awaitTermination()

    land(spark, landing, rows[:80])
    land(spark, landing, rows[80:160])
    run()
    land(spark, landing, rows[160:])
    run()  # goes on after a restart
    events = spark.createDataFrame(rows, "dataset string, id long, template string")
    want = T.cluster_templates(T.template_leaves(T.masked_texts(events), 3))
    got = {r.template: r.cluster_template for r in J.stream_templates(spark, out).collect()}
    assert got == {r.template: r.cluster_template for r in want.collect()} and len(got) > 100


def test_streamed_runs_equal_the_batch(spark, tmp_path):
    from timberline.functions.parsing import ENTITY_TYPE
    from timberline.operators import correlate as C
    from timberline.streaming import runs as R

    schema = ("dataset string, id long, template_id string, timestamp_epoch double, service string, host string, "
              f"entities {ENTITY_TYPE}, anomaly_score double, is_anomaly boolean")
    rng, rows, now = random.Random(8), [], 0.0
    for n in range(1, 200):
        now += rng.choice([0, 1, 50, 299, 300, 301, 900])
        entities = (rng.choice([None, "blk_1", "blk_2"]), None, None, None, None, None, None)
        rows.append(("d", n, rng.choice(["t1", "t2"]), now + rng.choice([0, 0, 200]), "s", "h", entities, 0.9, True))
    landing, out, mark = (str(tmp_path / n) for n in ("landing", "out", "mark"))
    for part in (rows[:70], rows[70:140], rows[140:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(landing)
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing)
    R.start_runs(events, out, mark, delay=900).awaitTermination()
    batch = C.assign_runs(C.with_entity_keys(spark.createDataFrame(rows, schema)))
    want = batch.groupBy("dataset", "template_id", "run_id").agg(
        F.min("timestamp_epoch").alias("start_epoch"), F.max("timestamp_epoch").alias("end_epoch"), F.count(F.lit(1)).alias("n_events"))
    got = R.stream_runs(spark, out)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert got.filter("is_open").count() == 2 and got.filter("NOT is_open").count() > 10
    assert read_published(spark, out, "late").count() == 0
    # What comes after its slice was final is kept apart.
    spark.createDataFrame([("d", 999, "t1", 1.0, "s", "h", rows[0][6], 0.9, True)], schema).coalesce(1).write.mode("append").parquet(landing)
    R.start_runs(events, out, mark, delay=900).awaitTermination()
    assert [r.id for r in read_published(spark, out, "late").collect()] == [999]
    assert sorted(map(tuple, R.stream_runs(spark, out).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
