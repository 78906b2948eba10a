"""Adding a slice of lines to a stored dataset."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from timberline.functions.parsing import event_identity
from timberline.functions.text import strip
from timberline.operators.correlate import SLACK, incident_entities, incident_services
from timberline.operators.ordering import BLOCK, number_densely, number_in_order
from timberline.session import cut, new_path
from timberline.sources.directory import not_stored

def with_identity(lines: DataFrame) -> DataFrame:
    return lines.withColumn(
        "event_id", event_identity(F.col("source_id"), F.col("source_line"), strip(F.col("line")))
    )


def unseen_lines(lines: DataFrame, known: DataFrame) -> DataFrame:
    """Non-blank lines whose identity is not known yet, positions kept. Runs before
    any parsing; duplicates inside the slice count once."""
    fresh = with_identity(lines.filter(strip(F.col("line")) != "")).dropDuplicates(["event_id"])
    return fresh.join(known.select("event_id"), "event_id", "left_anti")


def unseen_in_store(lines: DataFrame, path: str) -> DataFrame:
    """:func:`unseen_lines` against a stored table: reads only the files that may hold one of the lines."""
    fresh = with_identity(lines.filter(strip(F.col("line")) != "")).dropDuplicates(["event_id"])
    return not_stored(lines.sparkSession, path, fresh)


def continue_ids(lines: DataFrame, high_water: DataFrame, order: Sequence[str] = ("source_id", "source_line")) -> DataFrame:
    """Dense ids after the highest stored one, by source and line; ``high_water(dataset, last_id)``."""
    numbered = number_in_order(lines.drop("id"), ["dataset"], [F.asc(name) for name in order], "_n")
    return numbered.join(high_water, "dataset", "left").withColumn(
        "id", F.col("_n") + F.coalesce("last_id", F.lit(0))
    ).drop("_n", "last_id")


def events_union(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return existing.unionByName(incoming)


def incident_spans(members: DataFrame) -> DataFrame:
    return members.groupBy("dataset", "incident_id", "number").agg(
        F.min("timestamp_epoch").alias("start"), F.max("timestamp_epoch").alias("end")
    )


def _keyed(members: DataFrame, by: str, slack: float, gap: float) -> DataFrame:
    """``(dataset, by, reach, key)``: a template reaches as far as the session gap, an entity as far as the slack."""
    templates = members.select("dataset", by, F.lit(gap).alias("reach"), F.col("template_id").alias("key"))
    entities = members.select("dataset", by, F.lit(slack).alias("reach"), F.explode("wide").alias("key"))
    return templates.unionByName(entities).distinct()


#: Reports that a slice founds are told from those it found by numbers from here on, in candidate order.
_FOUNDED = 1 << 48
#: Candidates of a dataset that are placed in one group.
WINDOW = 1 << 14

KEY = ["dataset", "reach", "key"]


def _one_by_one(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """``dataset, place, report`` of a window's candidates, one after the other: the first report that holds a key of
    the candidate and is near by then, or the candidate's own.

    ``held(report, r_start, r_end, reach, key)`` are the reports before the window, ``asked(place, start, end, reach,
    key)`` its candidates. Numbers of founded reports grow with the place, so new reports stand behind all others.
    """
    if not len(asked):
        return pd.DataFrame({"dataset": [], "place": [], "report": []})
    code = pd.concat([held[["reach", "key"]], asked[["reach", "key"]]]).groupby(["reach", "key"], sort=False).ngroup().to_numpy()
    reports = held.drop_duplicates("report").sort_values("report")
    firsts = asked.drop_duplicates("place")
    number = np.concatenate([reports.report.to_numpy(dtype="int64"), np.zeros(len(firsts), dtype="int64")])
    start = np.concatenate([reports.r_start.to_numpy(dtype="float64"), np.zeros(len(firsts))])
    end = np.concatenate([reports.r_end.to_numpy(dtype="float64"), np.zeros(len(firsts))])
    n, holders = len(reports), {}
    if n:
        at = np.searchsorted(number[:n], held.report.to_numpy())
        order = np.lexsort((at, code[:len(held)]))
        kinds, begin = np.unique(code[:len(held)][order], return_index=True)
        holders = dict(zip(kinds.tolist(), np.split(at[order], begin[1:]), strict=True))
    order = np.lexsort((asked.reach.to_numpy(), asked.place.to_numpy()))
    place, reach, code = asked.place.to_numpy()[order], asked.reach.to_numpy()[order], code[len(held):][order]
    low, high = asked.start.to_numpy(dtype="float64")[order], asked.end.to_numpy(dtype="float64")[order]
    edges = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True])
    out = []
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        best = n
        middle = i + np.searchsorted(reach[i:j], reach[j - 1])
        for x, y in ((i, middle), (middle, j)):
            have = [holders[c] for c in code[x:y].tolist() if c in holders]
            if have:
                have = np.concatenate(have)
                near = have[(low[i] <= end[have] + reach[x]) & (start[have] <= high[i] + reach[x])]
                best = min(best, near.min(initial=n))
        if best == n:
            number[n], start[n], n = _FOUNDED + place[i], low[i], n + 1
        end[best] = high[i]
        for c in code[i:j].tolist():
            have = holders.get(c)
            if have is None:
                holders[c] = np.array([best])
            elif (k := np.searchsorted(have, best)) == len(have) or have[k] != best:
                holders[c] = np.insert(have, k, best)
        out.append(number[best])
    return pd.DataFrame({"dataset": asked.dataset.iloc[0], "place": place[edges[:-1]], "report": out})


def match_incidents(
    existing: DataFrame, candidates: DataFrame, slack: float = SLACK, gap: float = 5 * SLACK, width: int = BLOCK, window: int = WINDOW
) -> DataFrame:
    """``dataset, candidate, candidate_number, match, number_after``: the first compatible report (null for none), and
    the number the candidate has after the slice.

    Both inputs are member tables. Compatible means a shared template within the session gap, or a shared entity key
    within the slack. Candidates come in the order of their numbers, and each sees what those before it left behind: reports
    they founded, and the templates, entities and later end of reports they joined. A candidate
    without a match founds the report of the next free number.

    Where a candidate goes depends on those before it, so they go in windows of ``window`` of a dataset, one group each. It
    gets the keys that two incidents or more have, and of the reports only what holds one of them; a report or candidate is
    one row per key, however long it lasts. Runs jobs while the plan is made, one written table a window.
    """
    old, new = incident_spans(existing), incident_spans(candidates)
    base = cut(old.select("dataset", F.col("number").alias("report"), "start", "end"), "reports")
    new = number_densely(new.withColumnRenamed("number", "place"), ["dataset"], "place", "_n", 0, width)
    new = new.withColumn("window", F.floor(F.col("_n") / window))
    named = cut(new.select("dataset", "incident_id", "place", "start", "end", "window"), "candidates")
    spans = named.drop("incident_id")
    base_keys = cut(_keyed(existing.withColumnRenamed("number", "report"), "report", slack, gap), "report-keys")
    new_keys = _keyed(candidates.withColumnRenamed("number", "place"), "place", slack, gap)
    new_keys = cut(new_keys.join(spans, ["dataset", "place"]), "candidate-keys")
    own = F.lit(_FOUNDED) + F.col("place")
    path = new_path(existing.sparkSession, "placed")
    placed = spans.select("dataset", "place", own.alias("report")).limit(0)
    for k in range((spans.agg(F.max("window")).first()[0] or 0) + 1):
        joined = placed.join(spans, ["dataset", "place"]).select("dataset", "report", "place", "start", "end")
        reports = base.withColumn("place", F.lit(-1).cast("long")).unionByName(joined).groupBy("dataset", "report").agg(
            F.min_by("start", "place").alias("r_start"), F.max_by("end", "place").alias("r_end")
        )
        asked = new_keys.filter(F.col("window") == k)
        asking = asked.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_asking"))
        moved = placed.join(new_keys, ["dataset", "place"]).select("dataset", "report", "reach", "key")
        held = base_keys.unionByName(moved).distinct().join(asking, KEY, "left_semi").join(reports, ["dataset", "report"])
        shared = asking.filter("_asking > 1").select(*KEY).unionByName(held.select(*KEY)).distinct()
        found = held.groupBy("dataset").cogroup(asked.join(shared, KEY, "left_semi").groupBy("dataset")).applyInPandas(
            _one_by_one, "dataset string, place long, report long"
        )
        step = spans.filter(F.col("window") == k).select("dataset", "place").join(found, ["dataset", "place"], "left")
        step.select("dataset", "place", F.coalesce("report", own).alias("report")).write.mode("append").parquet(path)
        placed = existing.sparkSession.read.schema(placed.schema).parquet(path)
    top = base.groupBy("dataset").agg(F.max("report").alias("_top"))
    founders = placed.filter(F.col("report") == own).select("dataset", "place")
    numbers = number_densely(founders, ["dataset"], "place", "_n", 1, width).join(top, "dataset", "left").select(
        "dataset", (F.lit(_FOUNDED) + F.col("place")).alias("report"), (F.col("_n") + F.coalesce("_top", F.lit(100))).cast("long").alias("_new")
    )
    return named.join(placed, ["dataset", "place"]).join(cut(numbers, "founded"), ["dataset", "report"], "left").select(
        "dataset", F.col("incident_id").alias("candidate"), F.col("place").alias("candidate_number"),
        F.when(F.col("report") != own, F.coalesce("_new", "report")).alias("match"),
        F.coalesce("_new", "report").alias("number_after"),
    )


def merge_incidents(existing: DataFrame, candidates: DataFrame, width: int = BLOCK) -> DataFrame:
    """Member table after the slice: matched candidates join their report, the others
    get the next free numbers in candidate order."""
    matches = cut(match_incidents(existing, candidates, width=width), "matches")
    target = matches.select(
        "dataset", F.col("candidate").alias("incident_id"), "candidate_number", "number_after",
        F.col("match").isNotNull().alias("carried"),
    )
    moved = candidates.drop("number").join(target, ["dataset", "incident_id"]).select(
        *[c for c in existing.columns if c not in ("incident_id", "number")],
        F.concat(F.lit("INC-"), F.col("number_after").cast("string")).alias("incident_id"),
        F.col("number_after").alias("number"),
        F.lit(1).alias("generation"), "candidate_number",
    )
    kept = existing.withColumn("generation", F.lit(0)).withColumn("candidate_number", F.lit(0).cast("long"))
    return kept.unionByName(moved)


def carried_reports(merged: DataFrame) -> DataFrame:
    """Report rows after a merge: size grows, the end moves to the last slice's end,
    the start stays."""
    first = F.struct("generation", F.col("timestamp_epoch").alias("e"), "id", F.col("timestamp").alias("ts"))
    last = F.struct(
        "generation", F.col("candidate_number").alias("c"), F.col("timestamp_epoch").alias("e"), "id",
        F.col("timestamp").alias("ts"),
    )
    return merged.groupBy("dataset", "incident_id").agg(
        F.count(F.lit(1)).alias("event_count"), F.min(first).alias("_f"), F.max(last).alias("_l"),
        F.count_if(F.col("generation") == 1).alias("n_added"),
    ).select(
        "dataset", "incident_id", "event_count", "n_added",
        F.col("_f.ts").alias("start_time"), F.col("_l.ts").alias("end_time"),
    )


def carried_snippets(old_evidence: DataFrame, new_evidence: DataFrame, most: int = 8) -> DataFrame:
    """Old snippets first, then those of the slice in candidate order, at most ``most``
    per incident.

    ``new_evidence`` carries the incident ids after the merge and the number of
    the candidate each row came from.
    """
    fields = ("dataset", "incident_id", "rank", "log_id")
    both = (
        old_evidence.select(*fields)
        .withColumn("_g", F.lit(0)).withColumn("_c", F.lit(0).cast("long"))
        .unionByName(
            new_evidence.select(*fields, F.lit(1).alias("_g"), F.col("candidate_number").cast("long").alias("_c"))
        )
    )
    order = Window.partitionBy("dataset", "incident_id").orderBy("_g", "_c", "rank")
    return (
        both.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= most)
        .select("dataset", "incident_id", "place", "log_id")
    )


def label_union(merged: DataFrame) -> DataFrame:
    """Services and entity labels of the merged incidents, each once."""
    services = incident_services(merged).select(
        "dataset", "incident_id", F.lit("service").alias("kind"), F.col("service").alias("label")
    )
    entities = incident_entities(merged).select(
        "dataset", "incident_id", F.lit("entity").alias("kind"), F.col("entity").alias("label")
    )
    return services.unionByName(entities)


def changed_incidents(members: DataFrame, new_ids: DataFrame, most: int | None = None) -> DataFrame:
    """Incidents with any of the new events, the first ``most`` per dataset if given."""
    changed = members.join(new_ids.select("dataset", "id"), ["dataset", "id"], "left_semi").select(
        "dataset", "incident_id", "number"
    ).distinct()
    if most is None:
        return changed
    order = Window.partitionBy("dataset").orderBy("number")
    return changed.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).drop("_r")
