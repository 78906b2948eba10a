"""Passages over ordered events, term index, search and grounded answers."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions import patterns as P
from timberline.functions.text import half_up
from timberline.operators.ordering import BLOCK, number_densely
from timberline.session import cut

CHUNK = 5
STRETCH = 1024
LEAST_SCORE = 0.01
SLICES = 64
#: Ids of a part of an index: some thousand passages, which share most of their terms.
SPAN = 1 << 13


def ordered_events(events: DataFrame, width: int = BLOCK) -> DataFrame:
    """Adds the 0-based position ``pos`` and the dataset's row count ``total``."""
    df = number_densely(events, ["dataset"], "id", "pos", 0, width)
    totals = cut(events.groupBy("dataset").agg(F.count(F.lit(1)).alias("total")), "totals")
    return df.join(totals, "dataset")


def _fold(spread: DataFrame, *dealt: str) -> DataFrame:
    """Rows tagged with a window ``start`` -> one row per window.
    A window holds a handful of rows, so the fold is bounded. Rows that are ``dealt`` out by a column of their window stay there."""
    line = F.concat(F.lit("["), F.col("level"), F.lit("] "), F.col("service"), F.lit(": "), F.col("message"))
    rows = F.sort_array(F.collect_list(F.struct("pos", line.alias("line"))))
    return spread.groupBy("dataset", *dealt, "start").agg(
        F.min_by("id", "pos").alias("start_id"), F.max_by("id", "pos").alias("end_id"),
        F.count(F.lit(1)).alias("n_rows"), F.max("is_anomaly").alias("has_anomaly"),
        F.array_join(F.transform(rows, lambda r: r["line"]), " | ").alias("text"),
    ).withColumn(
        "chunk_id",
        F.concat(F.lit("chunk_"), F.col("start_id").cast("string"), F.lit("_"), F.col("end_id").cast("string")),
    ).drop(*dealt)


def passages(ordered: DataFrame, size: int = CHUNK, step: int | None = None) -> DataFrame:
    """Sliding windows of ``size`` rows; windows start at every multiple of the step, half a window by default.

    The step does not depend on the dataset's size, so every row is in a passage. Rows are dealt out by
    stretches of ``STRETCH`` windows (those at an edge to both) and repeated for their windows there, not before.
    """
    step = step or max(1, size // 2)
    low = F.greatest(F.lit(0), F.ceil((F.col("pos") - (size - 1)) / step)).cast("long")
    high = F.floor(F.col("pos") / step).cast("long")
    df = ordered.withColumn("_low", low).withColumn("_high", high).filter(F.col("_low") <= F.col("_high"))
    first, last = (F.floor(F.col(c) / STRETCH).cast("long") for c in ("_low", "_high"))
    df = df.withColumn("_stretch", F.explode(F.sequence(first, last))).repartition("dataset", "_stretch")
    begin = F.col("_stretch") * STRETCH
    here = F.sequence(F.greatest("_low", begin), F.least("_high", begin + (STRETCH - 1)))
    return _fold(df.withColumn("start", F.explode(F.transform(here, lambda k: k * step))), "_stretch")


def anomalous_passages(ordered: DataFrame, base: DataFrame, size: int = CHUNK) -> DataFrame:
    """Windows around anomalous rows, beginning two rows before them, where no base window begins."""
    wanted = ordered.filter(F.col("is_anomaly") | (F.col("anomaly_score") >= 0.55))
    fresh = (
        wanted.select("dataset", F.greatest(F.lit(0), F.col("pos") - 2).cast("long").alias("start"))
        .distinct()
        .join(base.select("dataset", "start"), ["dataset", "start"], "left_anti")
    )
    rows = fresh.select("dataset", "start", F.explode(F.sequence(F.col("start"), F.col("start") + (size - 1))).alias("pos"))
    return _fold(ordered.join(cut(rows, "anomalous-windows"), ["dataset", "pos"]))


# --------------------------------------------------------------------------- #
# Terms
# --------------------------------------------------------------------------- #
def terms_of(text: Column) -> Column:
    """Words and single marks of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(P.uni(P.TERM)), F.lit(0))


def with_terms(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``terms``: the words, then the neighbouring pairs."""
    df = df.withColumn("_w", terms_of(F.col(text)))
    pairs = F.when(
        F.size("_w") > 1,
        F.zip_with(
            F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 1, F.lit(0))),
            F.slice("_w", F.lit(2), F.greatest(F.size("_w") - 1, F.lit(0))),
            lambda a, b: F.concat_ws(" ", a, b),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return df.withColumn("terms", F.concat("_w", pairs)).drop("_w")


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """``dataset, chunk_id, term, tf``. Texts are dealt out by chunk before they become terms: the count then
    needs no second shuffle, which would move every term of every text."""
    return (
        with_terms(chunks.select("dataset", "chunk_id", "text").repartition("dataset", "chunk_id"))
        .select("dataset", "chunk_id", F.explode("terms").alias("term"))
        .groupBy("dataset", "chunk_id", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def term_stats(counted: DataFrame, most: int | None = None) -> DataFrame:
    """Corpus and document frequency of every term, or of the ``most`` frequent ones (ties by term).

    A cut ranks the terms of hash slices first, so no task sorts a whole vocabulary.
    """
    stats = counted.groupBy("dataset", "term").agg(
        F.sum("tf").alias("corpus_tf"), F.count(F.lit(1)).alias("df")
    )
    return stats if most is None else most_frequent(stats, most)


def most_frequent(stats: DataFrame, most: int) -> DataFrame:
    order = (F.desc("corpus_tf"), "term")
    part = Window.partitionBy("dataset", F.pmod(F.hash("term"), F.lit(SLICES))).orderBy(*order)
    stats = stats.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= most)
    whole = Window.partitionBy("dataset").orderBy(*order)
    return stats.withColumn("_r", F.row_number().over(whole)).filter(F.col("_r") <= most).drop("_r")


class _Postings:
    """The terms of one part's texts as numbers: ``(chunk, term, tf)``, sorted by chunk, and what the numbers stand for."""

    def __init__(self, texts: pa.Table):
        words = texts.column("words").combine_chunks()
        ids = texts.column("chunk_id").combine_chunks().dictionary_encode("encode")
        self.chunk_ids, self.row_chunk = ids.dictionary, ids.indices.to_numpy().astype(np.int64)
        flat = words.flatten().dictionary_encode()
        code, n = flat.indices.to_numpy().astype(np.int64), len(flat.dictionary)
        row = np.repeat(np.arange(len(words)), pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False))
        near = np.flatnonzero(row[1:] == row[:-1])
        pairs, pair = np.unique(code[near] * n + code[near + 1], return_inverse=True)
        first, second = (flat.dictionary.take(pa.array(k)) for k in (pairs // max(n, 1), pairs % max(n, 1)))
        self.terms = pa.concat_arrays([flat.dictionary, pc.binary_join_element_wise(first, second, " ")])
        self.used = np.concatenate([code, pair + n])
        each, self.tf = np.unique(
            np.concatenate([self.row_chunk[row], self.row_chunk[row[near]]]) * max(len(self.terms), 1) + self.used, return_counts=True)
        self.chunk, self.term = each // max(len(self.terms), 1), each % max(len(self.terms), 1)


def _same(value: pa.Scalar, n: int) -> pa.Array:
    return pa.nulls(n, value.type) if not value.is_valid else pa.repeat(value, n)


def _local_terms(texts: pa.Table) -> pa.Table:
    """Corpus and document frequency of every term of one part."""
    own = _Postings(texts)
    n = len(own.terms)
    return pa.table({
        "dataset": _same(texts.column("dataset")[0], n), "part": _same(texts.column("part")[0], n), "term": own.terms,
        "tf": np.bincount(own.used, minlength=n), "df": np.bincount(own.term, minlength=n)})


def _weighed(texts: pa.Table, known: pa.Table) -> tuple[_Postings, np.ndarray, np.ndarray]:
    """Postings of a part whose terms are ``known``, each one's weight and its place in ``known``."""
    own = _Postings(texts)
    place = pc.index_in(own.terms, known.column("term").combine_chunks()).fill_null(-1).to_numpy().astype(np.int64)
    keep = place[own.term] >= 0
    own.chunk, own.term, own.tf = own.chunk[keep], own.term[keep], own.tf[keep]
    at = place[own.term]
    return own, own.tf * known.column("idf").to_numpy()[at], at


def _all_weights(texts: pa.Table, known: pa.Table) -> pa.Table:
    if not len(texts) or not len(known):
        return pa.table({"dataset": pa.nulls(0, pa.string()), "chunk_id": pa.nulls(0, pa.string()), "term": pa.nulls(0, pa.string()),
                         "w": pa.nulls(0, pa.float64())})
    own, w, _ = _weighed(texts, known)
    return pa.table({"dataset": _same(texts.column("dataset")[0], len(w)), "chunk_id": own.chunk_ids.take(pa.array(own.chunk)),
                     "term": own.terms.take(pa.array(own.term)), "w": w})


def _asked_weights(texts: pa.Table, known: pa.Table) -> pa.Table:
    """Weights of asked terms only, beside the norm over all terms of their chunk and the starts of the rows that share its id."""
    if not len(texts) or not len(known):
        return pa.table({"dataset": pa.nulls(0, pa.string()), "chunk_id": pa.nulls(0, pa.string()), "term": pa.nulls(0, pa.string()),
                         "w": pa.nulls(0, pa.float64()), "norm": pa.nulls(0, pa.float64()), "starts": pa.nulls(0, pa.list_(pa.int64()))})
    own, w, at = _weighed(texts, known)
    n = len(own.chunk_ids)
    norm = np.sqrt(np.bincount(own.chunk, w * w, n))
    ends = np.concatenate([[0], np.cumsum(np.bincount(own.row_chunk, minlength=n))]).astype(np.int32)
    start = texts.column("start_id").combine_chunks().take(pa.array(np.argsort(own.row_chunk, kind="stable")))
    starts = pa.ListArray.from_arrays(pa.array(ends), start)
    asked = np.flatnonzero(known.column("asked").combine_chunks().to_numpy(zero_copy_only=False)[at])
    chunk = pa.array(own.chunk[asked])
    return pa.table({"dataset": _same(texts.column("dataset")[0], len(asked)), "chunk_id": own.chunk_ids.take(chunk),
                     "term": own.terms.take(pa.array(own.term[asked])), "w": w[asked], "norm": pa.array(norm).take(chunk),
                     "starts": starts.take(chunk)})


class TermIndex:
    """The written vocabulary (all terms by default) of a table of passages, and what follows from it.

    No table of terms per chunk is written or moved. Texts are dealt out by parts, stretches of ``SPAN`` ids; a part
    tells which terms it has and how often, and gets each one's weight back once. ``parts`` of a term holds a number
    per part that has it. Chunks that share an id start at the same one, so they meet in one part and count as one.
    """

    def __init__(self, chunks: DataFrame, most: int | None = None):
        self.chunks = chunks
        found = self._texts().groupBy("dataset", "part").applyInArrow(
            _local_terms, "dataset string, part long, term string, tf long, df long")
        stats = found.groupBy("dataset", "term").agg(
            F.sum("tf").alias("corpus_tf"), F.sum("df").alias("df"), F.collect_list("part").alias("parts"))
        n = cut(chunks.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_chunks")), "n-chunks")
        idf = F.log((1 + F.col("n_chunks")) / (1 + F.col("df"))) + 1.0
        stats = stats if most is None else most_frequent(stats, most)
        self.vocabulary = cut(stats.join(n, "dataset").withColumn("idf", idf), "vocabulary")

    def _texts(self) -> DataFrame:
        """Chunks with their words, found after the texts have moved to their part."""
        part = F.when(F.col("chunk_id").isNotNull(), F.floor(F.col("start_id") / SPAN).cast("long"))
        dealt = self.chunks.select("dataset", F.coalesce(part, F.lit(-1)).alias("part"), "chunk_id", "start_id", "text").repartition("dataset", "part")
        return dealt.select("dataset", "part", "chunk_id", "start_id", terms_of(F.col("text")).alias("words"))

    def _known(self) -> DataFrame:
        return self.vocabulary.select("dataset", F.explode("parts").alias("part"), "term", "idf")

    @property
    def weights(self) -> DataFrame:
        """``dataset, chunk_id, term, w`` of every term of every chunk, made where it is read."""
        return self._texts().groupBy("dataset", "part").cogroup(self._known().groupBy("dataset", "part")).applyInArrow(
            _all_weights, "dataset string, chunk_id string, term string, w double")

    def search(self, questions: DataFrame, top_k: int = 3) -> DataFrame:
        """``questions(question_id, text)`` -> best chunks per dataset and question.

        Only weights of terms a question uses leave their part.
        """
        asked = (
            with_terms(questions)
            .select("question_id", F.explode("terms").alias("term"))
            .groupBy("question_id", "term").agg(F.count(F.lit(1)).alias("tf"))
            .join(self.vocabulary.select("dataset", "term", "idf"), "term")
            .withColumn("q", F.col("tf") * F.col("idf"))
        )
        asked = cut(asked.select("dataset", "question_id", "term", "q"), "asked")
        asked_norm = asked.groupBy("dataset", "question_id").agg(
            F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("q_norm")
        )
        used = asked.select("dataset", "term").distinct().withColumn("asked", F.lit(True))
        known = self._known().join(used, ["dataset", "term"], "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
        hits = self._texts().groupBy("dataset", "part").cogroup(known.groupBy("dataset", "part")).applyInArrow(
            _asked_weights, "dataset string, chunk_id string, term string, w double, norm double, starts array<long>")
        scored = (
            hits.filter(F.col("chunk_id").isNotNull())
            .join(asked, ["dataset", "term"])
            .groupBy("dataset", "question_id", "chunk_id")
            .agg(F.sum(F.col("w") * F.col("q")).alias("dot"), F.max("norm").alias("norm"), F.first("starts").alias("starts"))
            .join(asked_norm, ["dataset", "question_id"])
            .withColumn("score", F.col("dot") / (F.col("norm") * F.col("q_norm")))
            .filter(F.col("score") > LEAST_SCORE)
            .withColumn("_tie", half_up(F.col("score"), 9))
            .withColumn("score", half_up(F.col("score"), 3))
            .withColumn("start_id", F.explode("starts"))
        )
        order = Window.partitionBy("dataset", "question_id").orderBy(F.desc("_tie"), "start_id")
        return (
            scored.withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= top_k)
            .select("dataset", "question_id", "chunk_id", "start_id", "score", "rank")
        )


def search(
    questions: DataFrame, index: TermIndex | None = None, vectors: DataFrame | None = None, top_k: int = 3
) -> DataFrame:
    """Dense search where vectors are given, term search otherwise."""
    if vectors is not None:
        return dense_search(vectors, questions, top_k)
    return index.search(questions, top_k)


def dense_search(
    vectors: DataFrame, queries: DataFrame, top_k: int = 3, asked_block: int = 256, vector_block: int = 4096
) -> DataFrame:
    """``vectors(vec_id, embedding)``, ``queries(query_id, embedding)`` -> top cosine matches.

    Any number of questions meets all vectors block by block: a task multiplies
    about ``vector_block`` vectors with about ``asked_block`` questions and keeps
    its best ``top_k`` per question, so only those are shuffled on. Blocks come
    from hashes of the ids and are counted beforehand.
    """
    sizes = vectors.agg(F.count(F.lit(1)).alias("n")).first().n, queries.agg(F.count(F.lit(1)).alias("n")).first().n
    slices, blocks = -(-max(sizes[0], 1) // vector_block), -(-max(sizes[1], 1) // asked_block)
    have = vectors.select(
        "vec_id", F.col("embedding").alias("vector"), F.pmod(F.xxhash64("vec_id"), F.lit(slices)).alias("slice"),
        F.explode(_numbers(blocks)).alias("block"))
    asked = queries.select(
        "query_id", F.col("embedding").alias("question"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"),
        F.explode(_numbers(slices)).alias("slice"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "raw": []})
        scores = _unit_rows(np.array(right.question.tolist(), dtype="float64")) @ _unit_rows(
            np.array(left.vector.tolist(), dtype="float64")).T
        vec, found = left.vec_id.to_numpy(), []
        for q, row in zip(right.query_id.to_numpy(), scores, strict=True):
            best = np.lexsort((vec, -np.round(row, 9)))[:top_k]
            best = best[row[best] > LEAST_SCORE]
            found.append(pd.DataFrame({"query_id": q, "vec_id": vec[best], "raw": row[best]}))
        return pd.concat(found)

    found = have.groupBy("slice", "block").cogroup(asked.groupBy("slice", "block")).applyInPandas(
        run, "query_id long, vec_id long, raw double")
    order = Window.partitionBy("query_id").orderBy(F.desc("_tie"), "vec_id")
    return (
        found.withColumn("_tie", half_up(F.col("raw"), 9))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top_k)
        .select("query_id", "vec_id", half_up(F.col("raw"), 3).alias("score"), "rank")
    )


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def _unit_rows(rows: np.ndarray) -> np.ndarray:
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(norms == 0, 1.0, norms)


# --------------------------------------------------------------------------- #
# Answers
# --------------------------------------------------------------------------- #
def evidence_rows(found: DataFrame, ordered: DataFrame, chunks: DataFrame) -> DataFrame:
    """Events of the found passages, each event once, in order of retrieval."""
    hit = found.join(chunks.select("dataset", "chunk_id", "start", "n_rows"), ["dataset", "chunk_id"])
    spread = hit.withColumn(
        "pos", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n_rows") - 1))
    )
    rows = spread.join(
        ordered.select("dataset", "pos", F.col("id").alias("log_id"), "timestamp", "level", "service", "message"),
        ["dataset", "pos"],
    )
    # One question has at most top_k * size rows.
    once = Window.partitionBy("dataset", "question_id", "log_id").orderBy("rank", "pos")
    place = Window.partitionBy("dataset", "question_id").orderBy("rank", "pos")
    return (
        rows.withColumn("_once", F.row_number().over(once))
        .filter(F.col("_once") == 1)
        .withColumn("place", F.row_number().over(place))
        .select(
            "dataset", "question_id", "place", "log_id", "timestamp", "level", "service", "message", "score"
        )
    )


def grounded_answers(
    questions: DataFrame, datasets: DataFrame, evidence: DataFrame, citations: int | None = None
) -> DataFrame:
    """One answer per dataset and question, citing the best evidence; none -> abstain.

    ``n_cited`` counts all evidence, or up to ``citations``. Questions are a
    table of any size; every dataset meets the questions of a hash slice.
    """
    folded = evidence.groupBy("dataset", "question_id").agg(
        F.min_by(F.struct("log_id", "timestamp", "service", "message", "score"), "place").alias("top"),
        F.count(F.lit(1)).alias("n_evidence"),
    )
    top = F.col("top")
    text = F.concat(
        F.lit("Based on retrieved evidence from Line "), top["log_id"].cast("string"),
        F.lit(" (timestamp: "), top["timestamp"], F.lit("), the event was recorded by service '"),
        top["service"], F.lit("' with message: \""), top["message"],
        F.lit("\". Total matching evidence events: "), F.col("n_evidence").cast("string"), F.lit("."),
    )
    nothing = (
        "No relevant log passages were found matching your query. Please broaden your search terms "
        "or verify that logs are ingested."
    )
    sliced = questions.select("question_id", F.pmod(F.xxhash64("question_id"), F.lit(SLICES)).alias("slice"))
    spread = datasets.select("dataset").distinct().select(
        "dataset", F.explode(_numbers(SLICES)).alias("slice"))
    asked = sliced.join(spread, "slice").select("dataset", "question_id")
    cited = F.coalesce("n_evidence", F.lit(0))
    return asked.join(folded, ["dataset", "question_id"], "left").select(
        "dataset", "question_id",
        F.when(top.isNull(), nothing).otherwise(text).alias("answer"),
        F.when(top.isNull(), 0.0).otherwise(half_up(top["score"], 2)).alias("confidence"),
        (cited if citations is None else F.least(cited, F.lit(citations))).alias("n_cited"),
        top.isNull().alias("abstained"),
    )
