"""Retrieval over more rows and questions than any former limit."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.operators import retrieval as R
from timberline.session import cut

ROWS = 10_500


@pytest.fixture(scope="module")
def ordered(spark):
    df = spark.range(ROWS).select(
        F.lit("big").alias("dataset"), (F.col("id") + 1).alias("id"), F.lit("INFO").alias("level"), F.lit("svc").alias("service"),
        F.concat(F.lit("event number w"), F.col("id").cast("string")).alias("message"), F.lit("t").alias("timestamp"),
        (F.col("id") % 1000 == 7).alias("is_anomaly"), F.lit(0.0).alias("anomaly_score"))
    return R.ordered_events(df)


def test_every_row_is_in_a_passage(ordered):
    chunks = R.passages(ordered)
    covered = chunks.select(F.explode(F.sequence("start_id", "end_id")).alias("id")).distinct()
    assert covered.count() == ROWS
    extra = R.anomalous_passages(ordered, chunks).collect()
    # Anomalies stand at odd places, so a window two rows before each is new.
    assert sorted(r.start for r in extra) == [k * 1000 + 5 for k in range(11) if k * 1000 + 7 < ROWS]


def test_all_terms_or_the_most_frequent(ordered):
    counted = R.chunk_terms(R.passages(ordered))
    every = R.term_stats(counted)
    assert every.filter(F.col("term") == f"w{ROWS - 1}").count() == 1
    want = sorted(every.collect(), key=lambda r: (-r.corpus_tf, r.term))[:40]
    got = sorted(R.term_stats(counted, 40).collect(), key=lambda r: (-r.corpus_tf, r.term))
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_three_hundred_questions(spark, ordered):
    chunks = R.passages(ordered.filter("pos < 400"))
    asked = spark.range(300).select(F.col("id").alias("question_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"))
    found = R.TermIndex(chunks).search(asked)
    evidence = R.evidence_rows(found, ordered, chunks)
    answers = R.grounded_answers(asked, ordered, evidence).collect()
    assert len(answers) == 300 and not any(a.abstained for a in answers)
    assert all(f'w{a.question_id}"' in a.answer or a.n_cited > 1 for a in answers)


def test_dense_search_in_blocks(spark):
    rng = np.random.default_rng(3)
    rows = rng.standard_normal((500, 8))
    frame = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(rows)], "vec_id long, embedding array<double>")
    asked = frame.filter("vec_id < 300").withColumnRenamed("vec_id", "query_id")
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    cosine = unit[:300] @ unit.T
    want = {q: [int(v) for v in np.argsort(-cosine[q], kind="stable")[:3]] for q in range(300)}
    for options in ({"asked_block": 64, "vector_block": 70}, {}):
        got = {}
        for r in R.dense_search(frame, asked, **options).collect():
            got.setdefault(r.query_id, {})[r.rank] = r.vec_id
        assert {q: [v for _, v in sorted(own.items())] for q, own in got.items()} == want
    assert R.dense_search(frame, asked.limit(0)).count() == 0


def test_terms_are_counted_without_moving_them(spark):
    rows = [("d", f"c{n % 7}", f"one two {n} two") for n in range(20)]
    counted = R.chunk_terms(spark.createDataFrame(rows, "dataset string, chunk_id string, text string"))
    want = {}
    for dataset, chunk, text in rows:
        words = text.split(" ")
        for term in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]:
            want[chunk, term] = want.get((chunk, term), 0) + 1
    assert {(r.chunk_id, r.term): r.tf for r in counted.collect()} == want
    plan = counted._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) >= 1 and all("term" not in line for line in exchanges)


def test_windows_are_repeated_where_they_are_folded(ordered, monkeypatch):
    ordered = cut(ordered)
    plan = R.passages(ordered)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert any("_stretch#" in line for line in dealt) and all("start#" not in line for line in dealt)
    small = ordered.filter("pos < 900")
    want = sorted(R.passages(small).collect())
    for stretch in (1, 7):
        monkeypatch.setattr(R, "STRETCH", stretch)
        assert sorted(R.passages(small).collect()) == want


def plain_index(rows, most=None):
    """Weights by (dataset, chunk, term) as a list of rows would give them; rows of one chunk id count as one chunk."""
    tf, chunks = defaultdict(Counter), Counter(r[0] for r in rows)
    for dataset, chunk, _, text in rows:
        words = (text or "").lower().replace("|", " ").split()
        tf[dataset, chunk].update(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)])
    total, df = Counter(), Counter()
    for (dataset, _), own in tf.items():
        for term, n in own.items():
            total[dataset, term] += n
            df[dataset, term] += 1
    held = set(df)
    if most is not None:
        held = {k for d in chunks for k in sorted((k for k in df if k[0] == d), key=lambda k: (-total[k], k[1]))[:most]}
    return {(d, c, t): n * (math.log((1 + chunks[d]) / (1 + df[d, t])) + 1.0)
            for (d, c), own in tf.items() for t, n in own.items() if (d, t) in held}


def test_index_writes_no_table_of_terms_by_chunk(spark, monkeypatch):
    rows = [(f"d{n % 2}", f"chunk_{n // 3}_{n // 3 + 4}", n // 3, f"Alpha <W{n % 5}> | b{n % 11} é{n % 3} alpha") for n in range(200)]
    rows = [(d, c, s, t.replace("<", "").replace(">", "")) for d, c, s, t in rows]  # ids come twice
    rows += [("d0", None, 5, "alpha null"), ("d0", None, 900, "alpha"), ("d1", "chunk_7_8", 7, None), ("d1", "chunk_9_9", 9, ""), ("d1", "chunk_700_700", 700, "x")]
    chunks = cut(spark.createDataFrame(rows, "dataset string, chunk_id string, start_id long, text string"))
    written = []
    monkeypatch.setattr(R, "cut", lambda df, label="stage": written.append(label) or cut(df, label))
    for span, most in ((7, None), (1 << 13, None), (7, 6)):
        monkeypatch.setattr(R, "SPAN", span)
        written.clear()
        index = R.TermIndex(chunks, most)
        weights = index.weights.collect()
        got = {(r.dataset, r.chunk_id, r.term): r.w for r in weights}
        assert sorted(written) == ["n-chunks", "vocabulary"] and len(weights) == len(got)
        want = plain_index(rows, most)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
        assert most is None or index.vocabulary.count() == 2 * most


def test_search_equals_plain_cosines(spark, monkeypatch):
    rows = [("d", f"chunk_{n}_{n}", n, f"w{n % 9} same v{n % 4} w{n % 9}") for n in range(0, 120, 2)]
    rows += rows[4:6]
    chunks = spark.createDataFrame(rows, "dataset string, chunk_id string, start_id long, text string")
    weights = plain_index(rows)
    own = defaultdict(dict)
    for (_, chunk, term), w in weights.items():
        own[chunk][term] = w
    n = len(rows)
    asked = {1: "w3 same", 2: "v2", 3: "nothing here"}
    idf = {t: math.log((1 + n) / (1 + sum(t in o for o in own.values()))) + 1.0 for o in own.values() for t in o}
    want = {}
    for q, text in asked.items():
        words = text.split()
        vector = {t: idf[t] for t in words + [" ".join(words)] if t in idf}
        norm = math.sqrt(sum(v * v for v in vector.values()))
        scores = []
        for _, chunk, start, _ in rows:
            dot = sum(v * own[chunk].get(t, 0.0) for t, v in vector.items())
            if dot:
                scores.append((-round(dot / norm / math.sqrt(sum(w * w for w in own[chunk].values())), 9), start))
        want[q] = [start for _, start in sorted(scores)[:3]]
    for span in (16, 1 << 13):
        monkeypatch.setattr(R, "SPAN", span)
        found = R.TermIndex(chunks).search(spark.createDataFrame([*asked.items()], "question_id long, text string"))
        got = {q: [] for q in asked}
        for r in sorted(found.collect(), key=lambda r: r["rank"]):
            got[r.question_id].append(r.start_id)
        assert got == want and want[1] and want[2]
