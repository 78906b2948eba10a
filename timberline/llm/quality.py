"""Quality rules: counts per text, and a hashed n-gram log-likelihood ratio with a fixed threshold.

Features are hashed words and word pairs. Two multinomials over ``buckets`` are
counted: one over trusted documents (the target), one over all documents (the
raw corpus). A document's score is the mean over its features of log(target /
raw), so long and short texts compare. The threshold comes from labelled
documents that the target did not count.

All labels are used, however many there are: labelled texts meet their labels in a
join, and the threshold is found on a table of scores. The raw counts, the scores
and the verdicts cover every document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.common import part_offsets
from timberline.llm.words import WordHashes, mixed, windows
from timberline.session import cut

BUCKETS = 1 << 17
MAP_BITS = 1 << 26
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
RESULT = ("struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,base_failed:boolean,"
          "score:double,kept:boolean>")


@dataclass(frozen=True)
class QualityModel:
    """Log ratio of every bucket, and the score from which a document is kept."""

    ratio: np.ndarray
    threshold: float


def features(words: list[bytes], hashes: WordHashes, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all words and word pairs of a text, repeats included."""
    h = hashes.of(words)
    return np.concatenate([mixed(h), windows(h, 2)]).astype(np.uint64) % np.uint64(buckets)


def text_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    n = len(words)
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    code: dict[bytes, int] = {}
    ids = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, n)
    repeat = 0
    if n >= 3:
        _, pair = np.unique(ids[:-1] * len(code) + ids[1:], return_inverse=True)
        _, window, times = np.unique(pair[:-1] * len(code) + ids[2:], return_inverse=True, return_counts=True)
        twice = times[window] > 1
        marked = np.zeros(n, bool)
        for k in range(3):
            marked[k : n - 2 + k] |= twice
        repeat = int(marked.sum())
    return (n, len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat,
            n < MIN_WORDS or 100 * repeat > 50 * n)


def labelled_sample(labels: DataFrame) -> DataFrame:
    """``(label_id, role)`` of every labelled id.

    Of the trusted, three in four (by hash) are fitted; the others and the rejected set the threshold. An id with both
    labels counts as rejected; null ids and labels are left out.
    """
    ids = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    trusted = F.when(F.xxhash64("doc_id", F.lit("quality")) % 4 == 0, "held").otherwise("fit")
    return ids.select(F.col("doc_id").alias("label_id"), F.when(F.col("quality") == 0, "rejected").otherwise(trusted).alias("role"))


def with_role(rows: DataFrame, chosen: DataFrame, bits: int = MAP_BITS) -> DataFrame:
    """``(text, role)`` of the rows whose id is in ``chosen``.

    The texts move to their labels unless the labels are small. A map of at most ``bits`` bits (8 MB) over the hashes of the
    ids keeps most other texts from moving; what passes it by chance ends in the join.
    """
    if rows.schema["id"].dataType == chosen.schema["label_id"].dataType:
        place = F.pmod(F.xxhash64("label_id"), F.lit(bits))
        bitmap = chosen.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap"))
        place = F.pmod(F.xxhash64("id"), F.lit(bits))
        bit = F.bitmap_bit_position(place).cast("int")
        byte = F.substring(F.col("bitmap"), F.shiftright(bit, 3) + 1, F.lit(1))
        marked = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), bit % 8) == 1
        rows = rows.join(F.broadcast(bitmap), F.bitmap_bucket_number(place) == F.col("bucket")).filter(marked).select("id", "text")
    return rows.join(chosen, rows["id"] == chosen["label_id"]).select("text", "role")


def counter(name: str, buckets: int):
    """A function for ``mapInArrow``: how often each bucket is met in the texts of a task, as ``(b, name)``."""

    def run(batches):
        hashes, seen = WordHashes(), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = features((text or "").encode("utf-8", "surrogatepass").split(), hashes, buckets)
                np.add.at(seen, found.astype(np.int64), 1)
        met = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(seen[met])], ["b", name])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        buckets: int = BUCKETS) -> QualityModel:
    """Count both multinomials and set the threshold. Without trusted documents every score is 0 and all pass."""
    chosen = cut(labelled_sample(labels), "labelled")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def counted(texts: DataFrame, name: str) -> np.ndarray:
        total = np.zeros(buckets)
        sums = texts.select("text").mapInArrow(counter(name, buckets), f"b long, {name} long").groupBy("b").agg(F.sum(name).alias("n"))
        for row in sums.collect():  # one row per bucket at most
            total[row.b] = row.n
        return total

    target = counted(with_role(rows, chosen.filter("role = 'fit'")), "target")
    if not target.any():
        return QualityModel(np.zeros(buckets), float("-inf"))
    raw = counted(rows, "raw")
    ratio = np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))
    held = with_role(rows, chosen.filter("role <> 'fit'"))
    model = QualityModel(ratio, float("-inf"))
    scored = held.select("role", judge(model, buckets)(F.col("text")).alias("q")).filter("NOT q.base_failed")
    return QualityModel(ratio, threshold_of(scored.select("role", "q.score")))


def threshold_of(points: DataFrame, cost: float = 20.0) -> float:
    """What ``threshold`` gives for the distinct ``(role, score)``, a table of any size: scores are dealt out by range,
    and only counts and the best cut reach the driver."""
    every = points.groupBy("score").agg(
        F.max((F.col("role") == "held").cast("long")).alias("good"), F.max((F.col("role") == "rejected").cast("long")).alias("bad"))
    ranged = cut(every.repartitionByRange("score").withColumn("part", F.spark_partition_id()), "scores")
    n = ranged.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    if not n.good or not n.bad:
        return float("-inf")
    lower = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    df = ranged
    for name in ("good", "bad"):
        before = part_offsets(ranged, "part", F.col(name)).withColumnRenamed("before", f"{name}_before")
        df = df.join(F.broadcast(before), "part").withColumn(  # one row per task
            f"{name}_below", F.coalesce(F.sum(name).over(lower), F.lit(0)) + F.col(f"{name}_before"))
    price = F.lit(cost) * (F.col("good_below") / n.good) + (1 - F.col("bad_below") / n.bad)
    best = df.agg(F.min(F.struct(price.alias("price"), "score")).alias("best")).first().best.score
    before = ranged.filter(F.col("score") < best).agg(F.max("score").alias("score")).first().score
    return best - 1.0 if before is None else (before + best) / 2


def threshold(held: list[float], rejected: list[float], cost: float = 20.0) -> float:
    """The cut between scores that costs least when losing a trusted share weighs ``cost`` rejected shares; ties: the lowest."""
    if not held or not rejected:
        return float("-inf")
    good, bad = np.sort(held), np.sort(rejected)
    every = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[every[0] - 1.0], (every[1:] + every[:-1]) / 2])
    lost = np.searchsorted(good, cuts) / len(good)
    passed = 1 - np.searchsorted(bad, cuts) / len(bad)
    return float(cuts[np.argmin(cost * lost + passed)])


def judge(model: QualityModel, buckets: int | None = None):
    """An Arrow function from a text column to the struct ``RESULT``."""
    size = buckets or len(model.ratio)

    def run(texts: pa.Array) -> pa.Array:
        hashes, rows = WordHashes(), []
        for text in texts.to_pylist():
            text = text or ""
            words = text.encode("utf-8", "surrogatepass").split()
            counts = text_counts(text, words)
            score = float(model.ratio[features(words, hashes, size).astype(np.int64)].mean()) if words else 0.0
            rows.append((*counts, score, not counts[-1] and score >= model.threshold))
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
        columns = list(zip(*rows, strict=True)) or [[]] * 8
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, RESULT).asNondeterministic()  # evaluated once, also below filters on its fields


def assess(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """``(doc, q)``: the row itself as a struct, whatever its columns are named, and its counts, score and verdict.

    A null text counts as empty: no words, base_failed, not kept. Null ids and repeated rows get their own verdicts.
    """
    return docs.select(F.struct("*").alias("doc"), F.col(text_col).alias("t")).select("doc", judge(model)(F.col("t")).alias("q"))


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows that pass, with the columns of ``docs``."""
    return assess(docs, model, text_col).filter("q.kept").select("doc.*")
