"""The pipeline over unbounded input.

Every job returns a started query; ``available_now`` runs it over what is there
and stops. Sinks are checkpointed, so a restart goes on where it stopped and
nothing is published twice.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from timberline.functions import masking as M
from timberline.functions import scores as S
from timberline.functions.text import half_up, shortened, two_decimals
from timberline.operators.incremental import unseen_in_store
from timberline.operators.normalize import normalize
from timberline.operators.ordering import number_in_order, with_offsets
from timberline.operators.scoring import score_core, score_stateless
from timberline.operators.templates import (
    CHILDREN, LEAF, MAX_CHILDREN, SIMILARITY, grow_clusters, masked_texts, template_leaves, tree_children,
)
from timberline.sources.parquet import append_events, save_events, to_stored
from timberline.sources.published import Published
from timberline.sources.text import number_lines, path_exists, valid_text
from timberline.session import cut, scratch

LINE_SCHEMA = "dataset string, dialect string, source_id string, source_line long, id long, line string"


def read_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of line tables (``LINE_SCHEMA``) landing in a folder."""
    reader = spark.readStream.schema(LINE_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def start_text_ingest(
    spark: SparkSession, folder: str, dataset: str, dialect: str, path: str, checkpoint: str,
    year: int | None = None, files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Text files landing in a folder -> stored events.

    A stream has no dense numbers, so each micro-batch numbers its own lines:
    lines within their file, ids after the highest stored one.
    """
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    raw = reader.text(folder).select(
        F.lit(dataset).alias("dataset"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), "value",
    )

    def append(batch: DataFrame, _: int) -> None:
        last = 0
        if path_exists(spark, path):
            stored = spark.read.parquet(path).filter(F.col("dataset") == dataset)
            last = stored.agg(F.max("id")).first()[0] or 0
        scanned = batch.select(
            "dataset", "file", "block", F.monotonically_increasing_id().alias("offset"),
            valid_text(F.col("value")).alias("line"),
        )
        lines = number_lines(scanned, start_id=last + 1, per_file=True)
        append_events(score_stateless(normalize(lines, F.lit(dialect), year)), path)

    return start_batches(raw, append, checkpoint)


def parse_stream(lines: DataFrame, year: int | None = None) -> DataFrame:
    """Parse and score rows on the fly: no state, no shuffle."""
    return score_stateless(normalize(lines, "dialect", year))


def start_ingest(events: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Stored event table as a streaming sink: one file set per micro-batch, exactly once."""
    writer = (
        to_stored(events).writeStream.format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .partitionBy("dataset").outputMode("append")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_batches(events: DataFrame, handle, checkpoint: str, mode: str = "append", available_now: bool = True) -> StreamingQuery:
    writer = events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).outputMode(mode)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


# --------------------------------------------------------------------------- #
# Sketches of anomalous groups
# --------------------------------------------------------------------------- #
def incident_sketch(events: DataFrame) -> DataFrame:
    """Running numbers per (dataset, template, actor); batch or stream.

    First and last are by arrival (id), not by time.
    """
    seen = F.col("timestamp") != ""
    return (
        events.filter("is_anomaly")
        .withColumn("actor", S.actor_key(F.col("entities"), F.col("service")))
        .groupBy("dataset", "template_id", "actor")
        .agg(
            F.count(F.lit(1)).alias("count"), F.max("anomaly_score").alias("peak_score"),
            F.min(F.when(seen, F.struct("id", "timestamp")))["timestamp"].alias("first_timestamp"),
            F.max(F.when(seen, F.struct("id", "timestamp")))["timestamp"].alias("last_timestamp"),
            F.min(F.struct("id", "service"))["service"].alias("service"),
        )
    )


def sketch_evidence(events: DataFrame, most: int = 8, chars: int | None = None) -> DataFrame:
    """Evidence of each sketch: errors first, then the latest; messages in full or up to ``chars``."""
    severe = F.col("level").contains("ERROR") | F.col("level").contains("FATAL")
    order = Window.partitionBy("dataset", "template_id", "actor").orderBy(F.desc("_severe"), F.desc("id"))
    return (
        events.filter("is_anomaly")
        .withColumn("actor", S.actor_key(F.col("entities"), F.col("service")))
        .withColumn("_severe", severe)
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= most)
        .select(
            "dataset", "template_id", "actor", "place", F.col("id").alias("log_id"), "timestamp", "level",
            shortened(F.col("message"), chars).alias("message"),
            F.concat(F.lit("Streaming anomaly score "), two_decimals(F.col("anomaly_score")),
                     F.lit(" - template "), F.col("template_id")).alias("reason"),
        )
    )


def bulk_incidents(sketches: DataFrame, most: int | None = None) -> DataFrame:
    """All sketches, or the ``most`` strongest per dataset, as reports numbered by strength."""
    ranked = number_in_order(sketches, ["dataset"], [F.desc("peak_score"), F.desc("count"), F.asc("template_id"), F.asc("actor")], "_r")
    if most is not None:
        ranked = ranked.filter(F.col("_r") <= most)
    peak = F.col("peak_score")
    severity = F.when(peak >= 0.95, "CRITICAL").when(peak >= 0.80, "HIGH").otherwise("MEDIUM")
    return ranked.withColumn("severity", severity).select(
        "dataset", F.concat(F.lit("STREAM-"), (F.col("_r") + 100).cast("string")).alias("incident_id"),
        F.concat(F.initcap("severity"), F.lit(" signal in "), "service").alias("title"), "severity",
        half_up(F.least(F.lit(0.98), F.greatest(F.lit(0.65), peak)), 2).alias("confidence"),
        F.concat(F.format_number("count", 0), F.lit(" streamed anomalous events grouped by template and "),
                 "actor", F.lit(".")).alias("summary"),
        "template_id", "actor", F.col("first_timestamp").alias("start_time"),
        F.col("last_timestamp").alias("end_time"), F.col("count").alias("event_count"),
    )


def start_published(results: DataFrame, name: str, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep a published table up to date with a running result: every batch is a version of its own, so a batch that
    fails leaves the version before, and one that is replayed changes nothing."""

    def publish(batch: DataFrame, number: int) -> None:
        Published(batch.sparkSession, path).publish(replace={name: batch}, stream=checkpoint, batch=number)

    return start_batches(results, publish, checkpoint, mode="complete", available_now=available_now)


def start_sketch(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the published table ``sketch`` up to date: each batch publishes the running totals."""
    return start_published(incident_sketch(events), "sketch", path, checkpoint)


def uniform_preview(events: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """A uniform sample of ``most`` rows per dataset, repeatable: the rows of smallest hash.

    Hashes are counted by their first digits; only the slices that reach into
    the sample are ranked, each on its own.
    """
    spot = F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}")))
    spots = events.withColumn("_spot", spot).withColumn("_slice", F.substring("_spot", 1, 3))
    counts = spots.groupBy("dataset", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = with_offsets(counts, ["dataset"], ["_slice"], "_n", "_before").filter(F.col("_before") < most).drop("_n")
    order = Window.partitionBy("dataset", "_slice").orderBy("_spot", "id")
    return (
        spots.join(before, ["dataset", "_slice"])
        .withColumn("_r", F.row_number().over(order) + F.col("_before"))
        .filter(F.col("_r") <= most)
        .select(*events.columns)
    )


# --------------------------------------------------------------------------- #
# Templates with state
# --------------------------------------------------------------------------- #
_LEAF = "dataset string, n_tokens int, key1 string, key2 string"
TEXTS = f"{_LEAF}, template string, first_id long, founder string, seq int"
CLUSTERS = f"{_LEAF}, seq int, founder string, template string, version long"


def start_templates(
    events: DataFrame, path: str, checkpoint: str, st: float = SIMILARITY, max_children: int = MAX_CHILDREN,
    head: int = 20000, available_now: bool = True,
) -> StreamingQuery:
    """Template clusters kept across micro-batches and restarts, published under ``path``.

    The tree is three published tables: the masked texts seen, the children of its nodes, and its clusters. A batch
    takes the texts nobody saw before, routes them through the nodes as they are (the limit on children holds
    for the whole stream), and lets them join the clusters of their leaves by the batch operator,
    which clusters a hot leaf in groups of bounded size. Only clusters that changed are written.
    Texts come in the order of batches, and of ids inside a batch: a stream that delivers lines in order
    ends with the clusters of one batch job over all lines.

    The tables grow with the distinct masked texts, not with the events. Lines without tokens are in no cluster.
    """

    def grow(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        store = Published(spark, path)
        if store.done(checkpoint, number):
            return
        with scratch(spark):
            seen = store.read("texts", TEXTS).select("dataset", "template")
            texts = cut(masked_texts(batch).join(seen, ["dataset", "template"], "left_anti"), "texts")
            if texts.isEmpty():
                store.publish(stream=checkpoint, batch=number)
                return
            known = store.read("children", CHILDREN)
            leaves = cut(template_leaves(texts, max_children, known), "leaves")
            held = _clusters_now(store).join(leaves.select(*LEAF).distinct(), LEAF, "left_semi")
            held = cut(held.select(*LEAF, F.lit("state").alias("kind"), "template", F.lit(0).cast("long").alias("first_id"), "founder", "seq"), "held")
            joined, state = grow_clusters(leaves, st, head, held)
            same = held.select(*LEAF, "seq", "template")
            changed = state.join(same, [*LEAF, "seq", "template"], "left_anti").withColumn("version", F.lit(number).cast("long"))
            store.publish(
                extend={
                    "texts": joined.select(*(c.split()[0] for c in TEXTS.split(", "))),
                    "children": _new_children(tree_children(leaves), known),
                    "clusters": changed.select(*(c.split()[0] for c in CLUSTERS.split(", "))),
                },
                stream=checkpoint, batch=number,
            )

    return start_batches(events.select("dataset", "id", "template"), grow, checkpoint, available_now=available_now)


def _new_children(children: DataFrame, known: DataFrame) -> DataFrame:
    """Those not known yet; a null ``key1`` (first layer) is a value like others."""
    old = known.select(*(F.col(c).alias(f"_{c}") for c in known.columns))
    same = F.lit(True)
    for c in known.columns:
        same = same & children[c].eqNullSafe(old[f"_{c}"])
    return children.join(old, same, "left_anti")


def _clusters_now(store: Published) -> DataFrame:
    """The last state of every cluster: each batch wrote those it changed."""
    last = F.max_by(F.struct("founder", "template"), "version").alias("c")
    return store.read("clusters", CLUSTERS).groupBy(*LEAF, "seq").agg(last).select(*LEAF, "seq", "c.founder", "c.template")


def stream_templates(spark: SparkSession, path: str) -> DataFrame:
    """``(dataset, template, template_id, cluster_template)`` of every text that the stream has published."""
    store = Published(spark, path)
    clusters = _clusters_now(store).withColumnRenamed("template", "cluster_template").drop("founder")
    return store.read("texts", TEXTS).join(clusters, [*LEAF, "seq"]).select(
        "dataset", "template", M.template_id_of(F.col("founder")).alias("template_id"), "cluster_template"
    )


# --------------------------------------------------------------------------- #
# Idempotent ingest
# --------------------------------------------------------------------------- #
def start_dedupe(lines: DataFrame, path: str, checkpoint: str, year: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Append only lines whose identity was never stored.

    The store itself is the memory: a batch drops its own repeats and the lines that the store holds, before parsing, and reads
    stored identities only from the files that may hold one. No state grows with the stream, and a batch that runs again
    after a failure finds what it had stored.
    """

    def append(batch: DataFrame, _: int) -> None:
        fresh = unseen_in_store(batch, path).drop("event_id")
        save_events(score_stateless(normalize(fresh, "dialect", year)), path, "append")

    return start_batches(lines, append, checkpoint, available_now=available_now)


def start_scored(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Score each micro-batch by its own statistics; stored scores never change.

    A batch is parsed once, into a scratch table that goes with the batch.
    """

    def append(batch: DataFrame, _: int) -> None:
        with scratch(batch.sparkSession):
            batch = cut(batch, "batch")
            if not batch.isEmpty():
                save_events(score_core(batch), path, "append")

    return start_batches(events, append, checkpoint)


# --------------------------------------------------------------------------- #
# Sessions and counters
# --------------------------------------------------------------------------- #
def session_incidents(events: DataFrame, gap: str = "300 seconds", delay: str = "1 hour") -> DataFrame:
    """Runs of one template without a quiet gap, as event-time session windows.

    A gap of exactly the limit still belongs to the run.
    """
    ts = F.timestamp_micros(F.bround(F.col("timestamp_epoch") * 1e6).cast("long"))
    df = events.select("dataset", "template_id", "anomaly_score", ts.alias("ts"))
    if events.isStreaming:
        df = df.withWatermark("ts", delay)
    return (
        df.groupBy("dataset", "template_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("event_count"), F.max("anomaly_score").alias("peak"),
             F.max("ts").alias("_last"))
        .select(
            "dataset", "template_id", F.unix_micros("w.start").alias("start_us"),
            F.unix_micros("_last").alias("end_us"), "event_count", "peak",
        )
    )


def observed(events: DataFrame, name: str = "ingest") -> DataFrame:
    """Counters that ride along with any query: rows, bytes, anomalies."""
    return events.observe(
        name, F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("raw") + 1).alias("bytes"),
        F.count_if("is_anomaly").alias("anomalies"),
    )


PROGRESS = "stream string, batch long, lines long, bytes long, anomalies long, millis long"


class ProgressLog(StreamingQueryListener):
    """Writes the counters of every finished batch to the published table ``progress``, for whoever watches.

    Counts the batches of streams that carry :func:`observed` counters under ``name``; a batch
    reported twice is written once. ``spark.streams.addListener(log)`` starts it, :meth:`wait` returns when a stopped
    query's last report has been written.
    """

    def __init__(self, spark: SparkSession, path: str, name: str = "ingest"):
        super().__init__()
        self.spark, self.name, self.store = spark, name, Published(spark, path)
        self.ended: set[str] = set()
        self.change = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        counts = (progress.observedMetrics or {}).get(self.name)
        if counts is None:
            return
        took = int((progress.durationMs or {}).get("triggerExecution", 0))
        row = (str(progress.id), progress.batchId, counts["lines"], counts["bytes"] or 0, counts["anomalies"], took)
        rows = self.spark.createDataFrame([row], PROGRESS).coalesce(1)
        self.store.publish(extend={"progress": rows}, stream=f"progress of {progress.id}", batch=progress.batchId)

    def onQueryTerminated(self, event) -> None:
        with self.change:
            self.ended.add(str(event.id))
            self.change.notify_all()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> bool:
        with self.change:
            return self.change.wait_for(lambda: str(query.id) in self.ended, seconds)


def progress_numbers(spark: SparkSession, path: str, total_bytes: int | None = None) -> DataFrame:
    """Per stream: batches, lines, bytes and anomalies so far, rates, and (with the input's size) percent done."""
    rows = Published(spark, path).read("progress", PROGRESS)
    seconds = F.greatest(F.lit(0.001), F.sum("millis") / 1000)
    size = F.coalesce(F.sum("bytes"), F.lit(0))
    percent = F.least(F.lit(100.0), 100.0 * size / F.lit(total_bytes)) if total_bytes else F.lit(None).cast("double")
    return rows.groupBy("stream").agg(
        F.count(F.lit(1)).alias("batches"), F.sum("lines").alias("lines"), size.alias("bytes"), F.sum("anomalies").alias("anomalies"),
        (F.sum("lines") / seconds).alias("lines_per_sec"), (size / seconds).alias("bytes_per_sec"), percent.alias("percent"),
    )
