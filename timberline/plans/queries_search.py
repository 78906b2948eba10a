"""Passage, term, search and answer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.operators import retrieval as R
from timberline.operators import scoring as SC
from timberline.plans.oracle_base import chain, half_up
from timberline.plans.queries_correlate import six, six_sql
from timberline.plans.registry import query
from timberline.session import cut

_PASSAGE = "dataset, chunk_id, start_id, end_id, n_rows, has_anomaly, text"
_COLUMNS = ("dataset", "chunk_id", "start_id", "end_id", "n_rows", "has_anomaly", "text")


@query("passages", chain(f"SELECT {_PASSAGE} FROM passages UNION ALL SELECT {_PASSAGE} FROM passages_all", "passages", "passages_all"))
def passages(t):
    """Only what a passage tells is scored and written; the wide events are not moved."""
    told = [
        cut(SC.score_core(events).select("dataset", "id", "level", "service", "message", "is_anomaly"), "told")
        for events in (t.events, t.all_events)
    ]
    each, together = (R.passages(R.ordered_events(df)) for df in told)
    return each.unionByName(together).select(*_COLUMNS)


@query("passages_anomalous", chain(f"SELECT {_PASSAGE} FROM extra_all", "extra_all"))
def passages_anomalous(t):
    base = cut(R.passages(t.all_ordered), "passages-all")
    return R.anomalous_passages(t.all_ordered, base).select(*_COLUMNS)


@query("term_stats", chain("SELECT dataset, term, corpus_tf, df FROM vocab", "vocab"))
def term_stats(t):
    return R.term_stats(R.chunk_terms(t.passages))


@query("tfidf_search", chain("SELECT dataset, question_id, chunk_id, start_id, score, rank FROM found", "found"))
def tfidf_search(t):
    found = R.search(t.questions, t.index)
    return found.withColumn("rank", F.col("rank").cast("long"))


@query("dense_search", f"""
SELECT query_id, vec_id, score, rank FROM (
 SELECT *, {half_up('cosine', 3)} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {half_up('cosine', 9)} DESC, vec_id) AS rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS cosine
  FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0) WHERE cosine > 0.01)
WHERE rank <= 3""")
def dense_search(t):
    """Every vector whose id is divisible by 100 asks, all vectors answer."""
    vectors = t.table("embeddings")
    queries = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.search(queries, vectors=vectors).withColumn("rank", F.col("rank").cast("long"))


@query("evidence_distinct", chain("SELECT dataset, question_id, place, log_id, timestamp, level, service, message, score FROM cited", "cited"))
def evidence_distinct(t):
    rows = R.evidence_rows(t.found, t.ordered, t.passages)
    return rows.withColumn("place", F.col("place").cast("long"))


@query("grounded_answer", chain(f"""
SELECT d.dataset, qn.question_id, CASE WHEN c.n IS NULL THEN 'No relevant log passages were found matching your query. Please broaden your search terms or verify that logs are ingested.'
 ELSE 'Based on retrieved evidence from Line ' || log_id || ' (timestamp: ' || timestamp || '), the event was recorded by service ''' || service
  || ''' with message: "' || message || '". Total matching evidence events: ' || c.n || '.' END AS answer,
 CASE WHEN c.n IS NULL THEN 0.0::DOUBLE ELSE {half_up('score', 2)} END AS confidence, coalesce(c.n, 0) AS n_cited, c.n IS NULL AS abstained
FROM (SELECT DISTINCT dataset FROM scored) d CROSS JOIN questions qn
LEFT JOIN (SELECT * FROM cited JOIN (SELECT dataset, question_id, count(*) AS n FROM cited GROUP BY 1, 2) USING (dataset, question_id) WHERE place = 1) c
ON c.dataset = d.dataset AND c.question_id = qn.question_id""", "scored", "questions", "cited"))
def grounded_answer(t):
    evidence = cut(R.evidence_rows(t.found, t.ordered, t.passages), "evidence")
    return R.grounded_answers(t.questions, t.datasets, evidence)


@query("term_weights", chain(f"SELECT dataset, chunk_id, term, {six_sql('w')} FROM weights", "weights"))
def term_weights(t):
    return t.index.weights.select("dataset", "chunk_id", "term", six("w"))
