"""Anomalies -> runs -> linked runs -> numbered incidents.

Tables, all keyed by dataset:

candidates  anomalous events with their concrete and wide entity keys
runs        occurrences of one template without a quiet gap (one row per run)
links       pairs of runs that share an entity and a moment
incidents   connected runs, ranked and numbered
members     (incident, event) bridge; evidence stays in rows, not in arrays
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from timberline.functions import scores as S
from timberline.functions.text import half_up, shortened, two_decimals
from timberline.operators.components import connected_components
from timberline.operators.ordering import BLOCK, number_densely, ordinal_by_sort, with_previous
from timberline.session import cut

SLACK = 60.0
FIRST_NUMBER = 101
LEAST_SCORE = 0.60


def incident_candidates(events: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    return events.filter(F.col("is_anomaly") | (F.col("anomaly_score") >= least_score))


def with_entity_keys(events: DataFrame) -> DataFrame:
    return events.withColumn("concrete", S.concrete_keys(F.col("entities"))).withColumn(
        "wide", S.wide_keys(F.col("entities"), F.col("service"), F.col("host"))
    )


def _sliced(candidates: DataFrame, gap: float) -> DataFrame:
    return candidates.withColumn("_slice", F.floor(F.col("timestamp_epoch") / gap).cast("long"))


def run_slices(candidates: DataFrame, gap: float = 5 * SLACK) -> DataFrame:
    """``dataset, template_id, _slice, run_id``: the run (id of its first event) of every occupied time slice.

    A run of one template ends where the next event comes more than ``gap``
    seconds later and names no actor the last one named. Two events in the same
    ``gap``-wide time slice are never further apart than that, so only the last
    event of a slice and the first of the next occupied one decide. Events are
    reduced to one row per (template, slice) before any ordering; the window
    then sees at most one row per slice of the calendar, however hot a template.
    """
    here = F.struct(
        F.col("timestamp_epoch").alias("epoch"), F.col("id"), F.col("concrete").alias("keys")
    )
    slices = _sliced(candidates, gap).groupBy("dataset", "template_id", "_slice").agg(
        F.min(here).alias("_first"), F.max(here).alias("_last")
    )
    order = Window.partitionBy("dataset", "template_id").orderBy("_slice")
    slices = slices.withColumn("_before", F.lag("_last").over(order))
    broken = F.col("_before").isNull() | (
        (F.col("_first.epoch") - F.col("_before.epoch") > gap)
        & ~F.arrays_overlap("_first.keys", "_before.keys")
    )
    return slices.withColumn(
        "run_id", F.last(F.when(broken, F.col("_first.id")), ignorenulls=True).over(order)
    ).select("dataset", "template_id", "_slice", "run_id")


def assign_runs(candidates: DataFrame, gap: float = 5 * SLACK, slices: DataFrame | None = None) -> DataFrame:
    """Adds ``run_id`` (id of the run's first event), and what else ``slices`` says of a slice."""
    slices = run_slices(candidates, gap) if slices is None else slices
    return _sliced(candidates, gap).join(slices, ["dataset", "template_id", "_slice"]).drop("_slice")


def run_table(with_runs: DataFrame) -> DataFrame:
    """One row per run with its span, in group order ``gidx``.

    Group order: templates by first appearance, then runs by time.
    """
    at = F.struct(F.col("timestamp_epoch").alias("epoch"), F.col("id"))
    runs = with_runs.groupBy("dataset", "template_id", "run_id").agg(
        F.min("timestamp_epoch").alias("start_epoch"),
        F.max("timestamp_epoch").alias("end_epoch"),
        F.count(F.lit(1)).alias("n_events"),
        F.max("anomaly_score").alias("peak"),
        F.min(at).alias("_at"),
    )
    firsts = runs.groupBy("dataset", "template_id").agg(F.min("_at").alias("_seen"))
    ordered = runs.join(firsts, ["dataset", "template_id"])
    return ordinal_by_sort(
        ordered, ["dataset", "_seen.epoch", "_seen.id", "start_epoch", "run_id"], "gidx", "runs"
    ).drop("_at", "_seen")


def run_links(with_runs: DataFrame, runs: DataFrame, slack: float = SLACK, width: int = BLOCK) -> DataFrame:
    """Edges between consecutive runs (in group order) of one entity key that overlap in time."""
    keyed = (
        with_runs.select("dataset", "run_id", F.explode("wide").alias("key"))
        .distinct()
        .join(runs.select("dataset", "run_id", "gidx", "start_epoch", "end_epoch"), ["dataset", "run_id"])
    )
    pairs = with_previous(
        keyed, ["dataset", "key"], "gidx", ["run_id", "gidx", "start_epoch", "end_epoch"], "prev", width
    )
    near = (F.col("prev.start_epoch") <= F.col("end_epoch") + slack) & (
        F.col("start_epoch") <= F.col("prev.end_epoch") + slack
    )
    return pairs.filter(F.col("prev").isNotNull() & near).select(
        "dataset",
        F.col("prev.run_id").alias("run_a"), F.col("run_id").alias("run_b"),
        F.col("prev.gidx").alias("a"), F.col("gidx").alias("b"),
    ).distinct()


@dataclass
class Correlation:
    """The written tables of one correlation."""

    runs: DataFrame
    links: DataFrame
    incidents: DataFrame
    members: DataFrame


def correlate(
    events: DataFrame, slack: float = SLACK, gap: float | None = None, width: int = BLOCK
) -> Correlation:
    """Candidates are written once and moved whole once, when their incidents are known; runs and
    links are found on the few columns they need."""
    gap = slack * 5 if gap is None else gap
    cands = cut(with_entity_keys(incident_candidates(events)), "candidates")
    slices = cut(run_slices(cands, gap), "slices")
    narrow = cands.select("dataset", "id", "template_id", "timestamp_epoch", "anomaly_score", "wide")
    with_runs = cut(assign_runs(narrow, gap, slices), "run-events")
    runs = run_table(with_runs)
    links = cut(run_links(with_runs, runs, slack, width), "links")
    roots = connected_components(links.select("a", "b"))
    rooted = runs.join(roots.withColumnRenamed("node", "gidx"), "gidx", "left").withColumn(
        "root", F.coalesce("root", "gidx")
    )
    rooted = cut(rooted, "rooted")
    merged = rooted.groupBy("dataset", "root").agg(
        F.max("peak").alias("peak"), F.sum("n_events").alias("event_count"),
        F.min_by("run_id", "gidx").alias("lead_id"),
    )
    ranked = ordinal_by_sort(
        merged, ["dataset", F.desc("peak"), F.desc("event_count"), "root"], "_place", "ranked"
    )
    incidents = cut(
        number_densely(ranked, ["dataset"], "_place", "_no", FIRST_NUMBER, width).select(
            "dataset", "root", "lead_id", "peak", "event_count",
            F.concat(F.lit("INC-"), F.col("_no").cast("string")).alias("incident_id"),
            F.col("_no").alias("number"),
        ),
        "incidents",
    )
    run_to_incident = rooted.select("dataset", "run_id", "root").join(
        incidents.select("dataset", "root", "incident_id", "number"), ["dataset", "root"]
    )
    placed = slices.join(run_to_incident.drop("root"), ["dataset", "run_id"])
    members = cut(assign_runs(cands, gap, placed), "members")
    return Correlation(rooted, links, incidents, members)


# --------------------------------------------------------------------------- #
# Reports over the members
# --------------------------------------------------------------------------- #
def incident_rollup(members: DataFrame) -> DataFrame:
    """One row per incident. Reduced per (incident, template, service) first, so the
    final step of a hot incident sees a few partial rows."""
    at = F.struct(F.col("timestamp_epoch").alias("epoch"), F.col("id"), F.col("timestamp").alias("ts"))
    part = members.groupBy("dataset", "incident_id", "template_id", "service").agg(
        F.count(F.lit(1)).alias("n"), F.max("anomaly_score").alias("peak"),
        F.min(at).alias("first"), F.max(at).alias("last"),
        F.max(F.col("level").isin("CRITICAL", "FATAL")).alias("critical"),
        F.max(F.col("level") == "ERROR").alias("error"),
    )
    named = F.when(F.col("service") != "", F.col("service"))
    whole = part.groupBy("dataset", "incident_id").agg(
        F.sum("n").alias("event_count"), F.max("peak").alias("peak"),
        F.min("first").alias("first"), F.max("last").alias("last"),
        F.max("critical").alias("critical"), F.max("error").alias("error"),
        F.count_distinct("template_id").alias("n_templates"),
        F.count_distinct(named).alias("n_services"),
        F.coalesce(F.min(named), F.lit("System")).alias("scope"),
    )
    n, peak = F.col("event_count").cast("string"), two_decimals(F.col("peak"))
    severity = (
        F.when(F.col("critical"), "CRITICAL").when(F.col("error"), "HIGH").otherwise("MEDIUM")
    )
    spanning = F.concat(
        n, F.lit(" correlated anomalies spanning "), F.col("n_templates").cast("string"),
        F.lit(" log templates and "), F.greatest(F.col("n_services"), F.lit(1)).cast("string"),
        F.lit(" service(s), joined by shared entities within the same time window. Peak anomaly score "),
        peak, F.lit("."),
    )
    single = F.concat(
        n, F.lit(" recurrences of a single log template in "), F.col("scope"),
        F.lit(", consolidated into one incident. Peak anomaly score "), peak, F.lit("."),
    )
    return whole.select(
        "dataset", "incident_id",
        F.concat(F.lit("Incident in "), F.col("scope"), F.lit(" ("), n, F.lit(" correlated events)")).alias("title"),
        severity.alias("severity"),
        clipped_confidence(F.col("peak")).alias("confidence"),
        F.when(F.col("n_templates") > 1, spanning).otherwise(single).alias("summary"),
        "n_templates", "n_services",
        F.col("first.ts").alias("start_time"), F.col("last.ts").alias("end_time"), "event_count",
    )


def clipped_confidence(peak: Column) -> Column:
    return half_up(F.least(F.lit(0.98), F.greatest(F.lit(0.65), peak)), 2)


def incident_services(members: DataFrame) -> DataFrame:
    return members.filter(F.col("service") != "").select("dataset", "incident_id", "service").distinct()


def incident_entities(members: DataFrame) -> DataFrame:
    """Every entity label of an incident, one row each."""
    return members.select(
        "dataset", "incident_id",
        F.explode(S.entity_labels(F.col("entities"), F.col("host"))).alias("entity"),
    ).distinct()


def top_evidence(members: DataFrame, n: int = 8, chars: int | None = None) -> DataFrame:
    """The ``n`` best-scored events of each incident (ties by time, then id); messages in full or up to ``chars``."""
    order = Window.partitionBy("dataset", "incident_id").orderBy(
        F.desc("anomaly_score"), "timestamp_epoch", "id"
    )
    return (
        members.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
        .select(
            "dataset", "incident_id", "rank", F.col("id").alias("log_id"), "timestamp", "level",
            shortened(F.col("message"), chars).alias("message"),
            F.concat(
                F.lit("Anomaly score "), two_decimals(F.col("anomaly_score")),
                F.lit(" - template "), F.col("template_id"),
            ).alias("reason"),
        )
    )


def incident_evidence(members: DataFrame, events: DataFrame) -> DataFrame:
    """Events behind each incident; ids without an event drop out."""
    return members.select("dataset", "incident_id", "id").join(
        events.select("dataset", "id", "timestamp", "level", "message"), ["dataset", "id"]
    )
