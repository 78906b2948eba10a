"""Template sequences per entity session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions import scores as S
from timberline.functions.text import half_up
from timberline.operators.ordering import BLOCK, with_previous
from timberline.session import cut


def entity_sessions(events: DataFrame) -> DataFrame:
    return events.select(
        "dataset", "id", "template_id",
        S.session_key(F.col("entities"), F.col("host"), F.col("service")).alias("session_id"),
    )


def transitions(sessions: DataFrame, width: int = BLOCK) -> DataFrame:
    """Consecutive pairs within a session, in id order; hot sessions run in id blocks."""
    df = with_previous(sessions, ["dataset", "session_id"], "id", ["id", "template_id"], "prev", width)
    return df.filter(F.col("prev").isNotNull()).select(
        "dataset", "session_id",
        F.col("prev.id").alias("log_id_a"), F.col("id").alias("log_id_b"),
        F.col("prev.template_id").alias("t1"), F.col("template_id").alias("t2"),
    )


def transition_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("dataset", "t1", "t2").agg(F.count(F.lit(1)).alias("n"))


def rare_transitions(pairs: DataFrame, share: float = 0.15, least: int = 3) -> DataFrame:
    """Transitions seen in under ``share`` of at least ``least`` departures from ``t1``."""
    counts = cut(transition_counts(pairs), "transitions")
    totals = counts.groupBy("dataset", "t1").agg(F.sum("n").alias("total"))
    rare = (
        counts.join(totals, ["dataset", "t1"])
        .withColumn("p", F.col("n") / F.col("total"))
        .filter((F.col("total") >= least) & (F.col("p") < share))
        .select("dataset", "t1", "t2", half_up(F.col("p"), 3).alias("probability"))
    )
    return pairs.join(rare, ["dataset", "t1", "t2"])


def session_summary(sessions: DataFrame) -> DataFrame:
    """Size, first and last id, number of templates; reduced per template first."""
    part = sessions.groupBy("dataset", "session_id", "template_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")
    )
    return part.groupBy("dataset", "session_id").agg(
        F.sum("n").alias("event_count"), F.min("lo").alias("first_log_id"),
        F.max("hi").alias("last_log_id"), F.count(F.lit(1)).alias("n_templates"),
    )


def retry_loops(summary: DataFrame, least: int = 4) -> DataFrame:
    return summary.filter((F.col("event_count") >= least) & (F.col("n_templates") == 1)).drop("n_templates")


def anomalous_sessions(summary: DataFrame, rare: DataFrame, least: int = 4) -> DataFrame:
    """Sessions with a rare transition or a retry loop. The transitions themselves
    stay in their own table; here their number counts."""
    per_session = rare.groupBy("dataset", "session_id").agg(F.count(F.lit(1)).alias("n_unusual"))
    df = summary.filter(F.col("event_count") >= 2).join(per_session, ["dataset", "session_id"], "left")
    loop = (F.col("event_count") >= least) & (F.col("n_templates") == 1)
    return (
        df.withColumn("is_retry_loop", loop)
        .withColumn("n_unusual", F.coalesce("n_unusual", F.lit(0)))
        .filter(F.col("is_retry_loop") | (F.col("n_unusual") > 0))
        .drop("n_templates")
    )
