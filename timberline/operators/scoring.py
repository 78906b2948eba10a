"""Dataset statistics and event scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions import scores as S
from timberline.functions.text import pin
from timberline.operators.ordering import BLOCK, with_previous
from timberline.session import cut


def template_rarity(events: DataFrame) -> DataFrame:
    """Rows, share and rarity of each template in its dataset."""
    counts = events.groupBy("dataset", "template_id").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("dataset").agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    return counts.join(totals, "dataset").select(
        "dataset", "template_id", "n", "total", share.alias("share"),
        F.greatest(F.lit(0.0), 1.0 - share * 10.0).alias("rarity"),
    )


def time_spans(events: DataFrame, seconds: float = 30.0) -> DataFrame:
    """One row per dataset: start, span, number and width of burst buckets."""
    e = F.col("timestamp_epoch")
    base = events.groupBy("dataset").agg(
        F.min(e).alias("min_epoch"), F.max(e).alias("max_epoch"),
        F.count(F.lit(1)).alias("n_rows"), F.count(e).alias("n_epochs"),
    )
    span = F.greatest(F.lit(1.0), F.col("max_epoch") - F.col("min_epoch"))
    buckets = F.greatest(F.lit(10), F.least(F.lit(100), F.floor(span / seconds).cast("int")))
    return (
        base.withColumn("span", span)
        .withColumn("n_buckets", buckets)
        .withColumn("bucket_size", F.col("span") / F.col("n_buckets"))
        .withColumn(
            "usable",
            (F.col("n_rows") == F.col("n_epochs")) & (F.col("max_epoch") > F.col("min_epoch")),
        )
    )


def bucket_index(epoch: Column, start: Column, width: Column, n: Column) -> Column:
    return F.least(n - 1, F.floor((epoch - start) / width).cast("int"))


def burst_buckets(events: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """Count, z-score and weight of every occupied bucket.

    Mean and population deviation cover the empty buckets too: both follow from
    the number of buckets and the sums of counts and squared counts.
    """
    spans = cut(time_spans(events), "spans") if spans is None else spans
    counts = (
        events.select("dataset", "timestamp_epoch")
        .join(spans.filter("usable"), "dataset")
        .withColumn(
            "bucket",
            bucket_index(
                F.col("timestamp_epoch"), F.col("min_epoch"), F.col("bucket_size"), F.col("n_buckets")
            ),
        )
        .groupBy("dataset", "n_buckets", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    stats = counts.groupBy("dataset", "n_buckets").agg(
        F.sum("n").alias("_sum"), F.sum(F.col("n") * F.col("n")).alias("_squares")
    )
    mean = F.col("_sum") / F.col("n_buckets")
    spread = F.sqrt(
        F.greatest(F.lit(0.0), F.col("_squares") / F.col("n_buckets") - F.col("mean") * F.col("mean"))
    )
    stats = stats.withColumn("mean", mean).withColumn("std", spread + 1e-5)
    z = (F.col("n") - F.col("mean")) / F.col("std")
    return (
        counts.join(stats, ["dataset", "n_buckets"])
        .withColumn("z", z)
        .select("dataset", "bucket", "n", "mean", "std", "z", burst_weight(F.col("z")).alias("weight"))
    )


def burst_weight(z: Column) -> Column:
    return F.when(z > 1.0, F.least(F.lit(0.35), z * 0.10)).otherwise(0.0)


def dataset_profile(events: DataFrame) -> DataFrame:
    """Spans plus the burst weights of a dataset (at most 100) as one map, written once."""
    spans = cut(time_spans(events), "spans")
    weights = burst_buckets(events, spans).groupBy("dataset").agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("weights")
    )
    return cut(spans.join(weights, "dataset", "left"), "profile")


def with_statistics(
    events: DataFrame, profile: DataFrame | None = None, where: Column | None = None
) -> DataFrame:
    """Adds ``share``, ``rarity`` and ``burst``; only rows with ``where`` (it may read ``burst``) are kept.

    Both statistics are written tables over all events, so the planner broadcasts them while
    their files are small and shuffles (with skew handling) when they are not. Rows
    that fail ``where`` are not moved to their template's rarity.
    """
    profile = dataset_profile(events) if profile is None else profile
    rarity = cut(template_rarity(events).drop("n", "total"), "rarity")
    bucket = bucket_index(
        F.col("timestamp_epoch"), F.col("min_epoch"), F.col("bucket_size"), F.col("n_buckets")
    )
    df = (
        events.join(profile, "dataset", "left")
        .withColumn("_bucket", bucket)
        .withColumn("burst", F.coalesce(F.try_element_at("weights", F.col("_bucket")), F.lit(0.0)))
        .drop(*[c for c in profile.columns if c not in ("dataset", "usable")], "_bucket")
    )
    df = df if where is None else df.filter(where)
    return df.join(rarity, ["dataset", "template_id"], "left")


def with_time_delta(events: DataFrame, width: int = BLOCK) -> DataFrame:
    """Seconds since the row before in id order, never negative, 0 for the first."""
    with_prev = with_previous(events, ["dataset"], "id", ["timestamp_epoch"], "_prev", width)
    gap = F.col("timestamp_epoch") - F.col("_prev.timestamp_epoch")
    return with_prev.withColumn(
        "time_delta", F.coalesce(F.greatest(F.lit(0.0), gap), F.lit(0.0))
    ).drop("_prev")


FEATURES = ("severity_num", "share", "time_delta", "n_params", "keyword", "burst")


def feature_vector(events: DataFrame) -> DataFrame:
    """The six numbers per event the outlier model reads."""
    return features_of(with_time_delta(with_statistics(events)))


def features_of(statistics: DataFrame) -> DataFrame:
    """The same numbers from events that carry their statistics and time steps already."""
    return statistics.select(
        "dataset", "id",
        S.severity_number(F.col("level")).alias("severity_num"),
        "share",
        F.when(F.col("usable"), F.col("time_delta")).otherwise(0.0).alias("time_delta"),
        F.size("params").cast("double").alias("n_params"),
        S.has_keyword(F.col("message")).cast("double").alias("keyword"),
        "burst",
    )


def _fuse(df: DataFrame, forest: Column, threshold: float) -> DataFrame:
    df = df.withColumn("_kw", S.has_keyword(F.col("message"))).withColumn(
        "_sev", S.severity_base(F.col("level"))
    )
    score = S.fused_score(
        F.col("_sev"), F.col("_kw"), F.coalesce("rarity", F.lit(0.0)), F.col("burst"), forest
    )
    df = df.withColumn("anomaly_score", score)
    return df.withColumn(
        "is_anomaly", S.fused_flag(F.col("anomaly_score"), F.col("_sev"), F.col("_kw"), threshold)
    ).drop("_kw", "_sev")


def within_reach(least: float, threshold: float = S.THRESHOLD) -> Column:
    """Rows that a rarity of 1 would flag or lift to ``least``. Scores grow with rarity, so the others do neither."""
    kw, sev = S.has_keyword(F.col("message")), S.severity_base(F.col("level"))
    score = S.fused_score(sev, kw, F.lit(1.0), F.col("burst"), F.lit(0.0))
    return F.coalesce((score >= least) | S.fused_flag(score, sev, kw, threshold), F.lit(True))


def score_core(events: DataFrame, threshold: float = S.THRESHOLD, least: float | None = None) -> DataFrame:
    """Severity, keywords, rarity and bursts fused; the outlier part left out.

    With ``least``, rows that are surely neither flagged nor scored ``least`` may be left out.
    """
    where = None if least is None else within_reach(least, threshold)
    return _fuse(with_statistics(events, where=where), F.lit(0.0), threshold).drop("share", "rarity", "burst", "usable")


def score_full(statistics: DataFrame, forest_scores: DataFrame, threshold: float = S.THRESHOLD) -> DataFrame:
    """All signals; ``statistics`` are events with theirs, ``forest_scores`` holds ``dataset, id, iforest``."""
    df = statistics.join(forest_scores, ["dataset", "id"], "left")
    return _fuse(df, F.coalesce("iforest", F.lit(0.0)), threshold).drop(
        "share", "rarity", "burst", "usable", "iforest"
    )


def score_stateless(events: DataFrame) -> DataFrame:
    """Row-wise score for bulk and streaming input."""
    df = events.withColumn("_kw", S.has_keyword(F.col("message")))
    df = df.withColumn(
        "anomaly_score", S.stateless_score(F.col("level"), F.col("_kw"), F.col("anomaly_score"))
    )
    df = df.withColumn(
        "is_anomaly", S.stateless_flag(F.col("anomaly_score"), F.col("level"), F.col("_kw"))
    ).drop("_kw")
    return df.withColumns({name: pin(name) for name in ("anomaly_score", "is_anomaly")})
