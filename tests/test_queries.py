"""Registered queries over tables that a test builds."""

from pyspark.sql import functions as F

from timberline.operators import reports as RP
from timberline.plans.registry import all_queries
from timberline.plans.tables import tables


def events(spark, folder):
    kinds = F.array(*map(F.lit, ("view", "error", "signup", "click", "purchase")))
    spark.range(400).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(1_704_067_200 + F.col("id") * 7).alias("ts"),
        (F.col("id") % 130).alias("user_id"), F.element_at(kinds, (F.col("id") % 5 + 1).cast("int")).alias("event_type"),
        (F.col("id") % 300).cast("double").alias("value"),
    ).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_log_search_writes_no_scores(spark, tmp_path):
    folder = events(spark, tmp_path)
    got = sorted(all_queries()["log_search"](spark, folder).collect())
    t = tables(spark, folder)
    assert "scored" not in vars(t)
    want = RP.log_search(t.scored, severity="ERROR", anomalies=True, text="u12").select("dataset", "id", "message")
    assert got and got == sorted(want.collect())


def test_answers_move_only_what_they_tell(spark, tmp_path):
    folder = events(spark, tmp_path)
    answers = all_queries()["grounded_answer"](spark, folder).collect()
    t = tables(spark, folder)
    assert not {"scored", "events"} & set(vars(t))
    assert set(t.ordered.columns) == {"dataset", "id", "timestamp", "level", "service", "message", "is_anomaly", "pos", "total"}
    told = ("dataset", "id", "timestamp", "level", "service", "message", "is_anomaly")
    assert sorted(t.ordered.select(*told).collect()) == sorted(t.scored.select(*told).collect())
    assert len(answers) == 4 * t.scored.select("dataset").distinct().count() == 4 * t.datasets.count()
