"""Mixing sources to target weights: repetition rates, whole copies and one seeded Bernoulli copy.

Sizes are words. Sources in code point order, null last, weigh ``weights`` in
turn and share all words; a target stops at ``most`` times its source, and what
is over goes to the others by weight until none is above. The share of a weight
is then ``(T - C) / W`` with the words C and the weights W of stopped and open
sources, one division of whole numbers, so reruns and other engines agree.
A document is emitted floor(rate) times, plus once where a hash of its id and
text falls below the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.common import n_words, text_of
from timberline.session import cut

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, source_size, target)`` from rows of ``(source, size)``.

    Documents are summed per source before the shuffle. What is ordered after
    that is one row per source, by range, numbered from its range's offset.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranged = sums.repartitionByRange(F.col("source").asc_nulls_last()).select(
        F.spark_partition_id().alias("part"), "source", "source_size")
    ranged = cut(ranged, "sources")
    before = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("own"))
    before = before.select("part", F.coalesce(F.sum("own").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    turn = F.array(*map(F.lit, weights))
    state = ranged.join(before, "part").select(
        "source", "source_size",
        F.element_at(turn, ((F.col("before") + place - 1) % len(weights) + 1).cast("int")).cast("long").alias("weight"))
    state = cut(state.withColumn("stopped", F.lit(False)), "sources")
    while True:
        # Sums over sources: four numbers reach the driver.
        row = state.agg(
            F.sum("source_size").alias("t"),
            F.sum(F.when(F.col("stopped"), most * F.col("source_size")).otherwise(0)).alias("c"),
            F.sum(F.when(~F.col("stopped"), F.col("weight")).otherwise(0)).alias("w")).first()
        left, open_weight = (row.t or 0) - (row.c or 0), row.w or 0
        cap = most * F.col("source_size")
        wide = "decimal(19,0)"
        above = ~F.col("stopped") & (F.col("weight").cast(wide) * F.lit(left).cast(wide)
                                     > cap.cast(wide) * F.lit(open_weight).cast(wide))
        if open_weight == 0 or state.filter(above).isEmpty():
            break
        state = cut(state.withColumn("stopped", F.col("stopped") | above), "sources")
    share = (F.col("weight") * F.lit(left)).cast("double") / F.lit(float(max(open_weight, 1)))
    target = F.when(F.col("stopped"), (most * F.col("source_size")).cast("double")).otherwise(share)
    return state.select("source", "source_size", target.alias("target"))


def draw(id_col: str, text_hash: Column) -> Column:
    """A number in [0, 1) from the id and the text: 52 bits of an MD5."""
    key = F.concat_ws("|", F.lit(SEED), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text_hash)
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(doc, size, source_size, target, copies)`` per row, the row itself in the struct ``doc``.

    A null text has size 0; a null source is a source of its own, the last; a
    source without words has target 0 and gives no copies. Rows with equal id
    and text share their draw. The struct keeps extra columns apart, whatever
    their names. An empty table gives an empty result.
    """
    text = text_of(text_col)
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                       n_words(text).alias("size"), F.md5(text.cast("binary")).alias("text_hash"))
    targets = source_targets(docs.select(F.col(source_col).alias("source"), n_words(text).alias("size")), weights, most)
    # One row per source: Spark broadcasts the table only when its written size is below the threshold.
    targets = cut(targets, "targets").withColumnRenamed("source", "of")
    rows = rows.join(targets, rows["source"].eqNullSafe(targets["of"]), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    extra = (draw("id", F.col("text_hash")) < rate - whole).cast("long")
    return rows.select("doc", "size", "source_size", "target", (whole + extra).alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the plan says, with the columns of ``docs``."""
    planned = plan_mix(docs, **options).filter("copies > 0")
    times = planned.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return times.select("doc.*")
