"""Runs of a template over a stream, with the rule that a shared actor bridges any gap.

A run ends where the next event of its template comes more than ``gap`` seconds later and names no actor the last
one named, so no session window can state it: whether a run is over is known only when the next event is there.
Events are reduced to one row per (template, ``gap``-wide time slice) in every batch, so a hot template is
aggregated by many tasks; slices older than the watermark are final and are strung together after the run that
the template has open. Runs that another one follows are closed and written once.

State is three published tables: slices not final yet, one open run per template, the latest time per dataset.
Two more only grow: closed runs, and events that came later than the watermark allows (kept, in no run).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.streaming import StreamingQuery

from timberline.operators.correlate import SLACK, incident_candidates, with_entity_keys
from timberline.session import cut, scratch
from timberline.sources.published import Published
from timberline.streaming.jobs import start_batches

_EDGE = "struct<epoch:double,id:long,keys:array<string>>"
SLICES = f"dataset string, template_id string, slice long, first {_EDGE}, last {_EDGE}, n long, peak double"
RUNS = f"dataset string, template_id string, run_id long, start_epoch double, last {_EDGE}, n long, peak double"
LATEST = "dataset string, latest double"
LATE = "dataset string, template_id string, id long, epoch double"
_TEMPLATE = ["dataset", "template_id"]


def _slices(events: DataFrame, gap: float) -> DataFrame:
    here = F.struct(F.col("timestamp_epoch").alias("epoch"), F.col("id"), F.col("concrete").alias("keys"))
    return events.groupBy(*_TEMPLATE, F.floor(F.col("timestamp_epoch") / gap).cast("long").alias("slice")).agg(
        F.min(here).alias("first"), F.max(here).alias("last"), F.count(F.lit(1)).alias("n"), F.max("anomaly_score").cast("double").alias("peak"))


def _merged(slices: DataFrame) -> DataFrame:
    return slices.groupBy(*_TEMPLATE, "slice").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), F.max("peak").alias("peak"))


def _strung(open_runs: DataFrame, slices: DataFrame, gap: float) -> DataFrame:
    """Runs that begin with ``open_runs`` and go on through ``slices``, the last of each template marked ``is_open``.

    The window sees one row per occupied slice of a template, not its events.
    """
    begun = open_runs.select(*_TEMPLATE, F.lit(-(1 << 62)).alias("slice"), "run_id", "start_epoch",
                             F.col("last").alias("first"), "last", "n", "peak")
    rows = begun.unionByName(slices.select(*_TEMPLATE, "slice", F.lit(None).cast("long").alias("run_id"),
                                           F.col("first.epoch").alias("start_epoch"), "first", "last", "n", "peak"))
    order = Window.partitionBy(*_TEMPLATE).orderBy("slice")
    rows = rows.withColumn("before", F.lag("last").over(order))
    broken = F.col("before").isNull() | (
        (F.col("first.epoch") - F.col("before.epoch") > gap) & ~F.arrays_overlap("first.keys", "before.keys"))
    starts = F.coalesce("run_id", F.when(broken, F.col("first.id")))
    rows = rows.withColumn("run", F.last(starts, ignorenulls=True).over(order))
    runs = rows.groupBy(*_TEMPLATE, F.col("run").alias("run_id")).agg(
        F.min("start_epoch").alias("start_epoch"), F.max("last").alias("last"), F.sum("n").alias("n"), F.max("peak").alias("peak"))
    newest = F.max(F.struct("last.epoch", "last.id")).over(Window.partitionBy(*_TEMPLATE))
    return runs.withColumn("is_open", F.struct("last.epoch", "last.id") == newest)


def start_runs(
    events: DataFrame, path: str, checkpoint: str, gap: float = 5 * SLACK, delay: float = 3600.0, available_now: bool = True,
) -> StreamingQuery:
    """Keep the runs of scored ``events`` under ``path``; an event may come ``delay`` seconds after later ones.

    Every batch is one published version: one that fails changes nothing, and one that is replayed neither.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        store = Published(spark, path)
        if store.done(checkpoint, number):
            return
        with scratch(spark):
            rows = with_entity_keys(incident_candidates(batch)).select(
                *_TEMPLATE, "id", "timestamp_epoch", "concrete", "anomaly_score")
            before = store.read("latest", LATEST)
            # A slice that was final before this batch takes nothing more.
            done = before.select("dataset", F.floor((F.col("latest") - delay) / gap).cast("long").alias("done"))
            rows = cut(rows.join(done, "dataset", "left"), "candidates")
            late = F.col("done").isNotNull() & (F.floor(F.col("timestamp_epoch") / gap) < F.col("done"))
            now = rows.groupBy("dataset").agg(F.max("timestamp_epoch").cast("double").alias("latest"))
            now = cut(before.unionByName(now).groupBy("dataset").agg(F.max("latest").alias("latest")), "latest")
            slices = _merged(store.read("slices", SLICES).unionByName(_slices(rows.filter(~late), gap)))
            slices = slices.join(now, "dataset").withColumn("final", F.col("slice") < F.floor((F.col("latest") - delay) / gap))
            slices = cut(slices.drop("latest"), "slices")
            runs = cut(_strung(store.read("open", RUNS), slices.filter("final").drop("final"), gap), "runs")
            store.publish(
                replace={"slices": slices.filter("NOT final").drop("final"), "open": runs.filter("is_open").drop("is_open"), "latest": now},
                extend={"closed": runs.filter("NOT is_open").drop("is_open"),
                        "late": rows.filter(late).select(*_TEMPLATE, "id", F.col("timestamp_epoch").cast("double").alias("epoch"))},
                stream=checkpoint, batch=number,
            )

    return start_batches(events, step, checkpoint, available_now=available_now)


def stream_runs(spark: SparkSession, path: str, gap: float = 5 * SLACK) -> DataFrame:
    """``(dataset, template_id, run_id, start_epoch, end_epoch, n_events, peak, is_open)``: closed runs, and the open ones
    with what is not final yet."""
    store = Published(spark, path)
    closed = store.read("closed", RUNS).withColumn("is_open", F.lit(False))
    rest = _strung(store.read("open", RUNS), store.read("slices", SLICES), gap)
    return closed.unionByName(rest).select(
        *_TEMPLATE, "run_id", "start_epoch", F.col("last.epoch").alias("end_epoch"), F.col("n").alias("n_events"), "peak", "is_open")
