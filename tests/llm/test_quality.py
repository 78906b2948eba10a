import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
import xxhash

from timberline.llm import quality as Q
from timberline.llm.words import WordHashes

WORD = r"[^\x20\x09-\x0D]+"


def plain(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    marked = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
    failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked), failed)


def corpus():
    rnd = random.Random(8)
    good, bad = [f"w{k}" for k in range(300)], [f"w{k}***" for k in range(300)]
    rows, labels = [], []
    for k in range(240):
        junk = k % 6 == 0
        words = [rnd.choice(bad if junk else good) for _ in range(60 + k % 50)]
        rows.append((k, " ".join(words) + ("\nsame\nsame" if k % 4 == 0 else "")))
        if k % 2 == 0:
            labels.append((k, 0 if junk else 1))
    rows += [(300, None), (301, ""), (None, "a b a b a b " * 20), (302, "é\x85ü \t\x0b x"), (5, rows[5][1]), (303, "the " * 4000)]
    labels += [(None, 1), (7, None), (8, 0), (8, 1)]
    return rows, labels


@pytest.fixture(scope="module")
def frames(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, True, "x") for r in rows], "doc_id long, text string, kept boolean, q string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int")


def test_counts_equal_plain_ones(frames):
    for _, text in corpus()[0]:
        assert Q.text_counts(text or "", (text or "").encode().split()) == plain(text)


def test_model_equals_brute_force(spark, frames):
    docs, labels = frames
    model = Q.fit(docs, labels, buckets=4096)
    roles = {r.label_id: r.role for r in Q.labelled_sample(labels).collect()}
    hashes = WordHashes()
    raw, target = np.zeros(4096), np.zeros(4096)
    for doc, text in corpus()[0]:
        own = np.bincount(Q.features((text or "").encode().split(), hashes, 4096).astype(int), minlength=4096)
        raw += own
        target += own * (roles.get(doc) == "fit")
    want = np.log((target + 1) / (target.sum() + 4096)) - np.log((raw + 1) / (raw.sum() + 4096))
    assert np.allclose(model.ratio, want)
    got = {(r.doc.doc_id, r.doc.text): r.q for r in Q.assess(docs, model).collect()}
    for doc, text in corpus()[0]:
        q = got[doc, text]
        assert tuple(q)[:6] == plain(text)
        found = Q.features((text or "").encode().split(), hashes, 4096).astype(int)
        score = want[found].mean() if len(found) else 0.0
        assert q.score == pytest.approx(score) and q.kept == (not q.base_failed and q.score >= model.threshold)
    for doc in range(240):  # labelled or not, junk goes and clean text stays
        q = next(v for k, v in got.items() if k[0] == doc)
        assert q.kept == (doc % 6 != 0)
    assert Q.keep_good(docs, model).columns == docs.columns


def test_empty_tables(spark, frames):
    docs, labels = frames
    assert Q.assess(docs.limit(0), Q.fit(docs.limit(0), labels)).count() == 0
    unlabelled = Q.fit(docs, labels.limit(0), buckets=64)
    assert unlabelled.threshold == float("-inf")
    assert all(r.q.kept != r.q.base_failed for r in Q.assess(docs, unlabelled).collect())


def test_threshold_prefers_keeping():
    assert 1.0 < Q.threshold([2.0, 3.0], [0.0, 1.0, 5.0]) < 2.0
    assert Q.threshold([], [1.0]) == float("-inf")


def test_every_label_counts(spark):
    """More labels of a class than any bound there was."""
    labels = spark.range(46_000).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality")
    roles = Q.labelled_sample(labels)
    assert {r.role == "rejected": r["count"] for r in roles.groupBy("role").count().collect() if r.role != "fit"}[True] == 23_000
    assert roles.count() == roles.select("label_id").distinct().count() == 46_000
    docs = spark.range(46_000).selectExpr("id AS doc_id", "concat('word', id) AS text")
    model = Q.fit(docs, labels, buckets=1 << 20)
    fitted = {r.label_id for r in roles.filter("role = 'fit'").collect()}
    hashes = WordHashes()
    place = np.array([Q.features([b"word%d" % k], hashes, 1 << 20)[0] for k in range(46_000)], int)
    raw = np.bincount(place, minlength=1 << 20)
    target = np.bincount(place[sorted(fitted)], minlength=1 << 20)
    want = np.log((target + 1) / (len(fitted) + (1 << 20))) - np.log((raw + 1) / (46_000 + (1 << 20)))
    assert len(fitted) > 15_500 and np.allclose(model.ratio, want)


def test_labels_meet_their_texts(spark):
    docs = spark.createDataFrame([(k % 900 if k % 7 else None, f"t{k}") for k in range(1000)], "id long, text string")
    chosen = spark.createDataFrame([(k, f"r{k % 3}") for k in range(0, 2000, 3)], "label_id long, role string")
    want = sorted((f"t{k}", f"r{k % 900 % 3}") for k in range(1000) if k % 7 and k % 900 % 3 == 0)
    for kind in ("long", "string"):  # ids of another kind than the labels' meet them too
        rows = docs.withColumn("id", docs["id"].cast(kind))
        for bits in (64, 40_000, Q.MAP_BITS):
            assert sorted(tuple(r) for r in Q.with_role(rows, chosen, bits).collect()) == want


def test_threshold_of_a_table(spark):
    rnd = random.Random(4)
    for held, rejected in (([2.0, 3.0], [0.0, 1.0, 5.0]), ([1.0], [1.0]), ([], [1.0]), ([1.0], []),
                           ([rnd.gauss(1, 1) for _ in range(900)], [rnd.gauss(-1, 1) for _ in range(700)]),
                           ([k / 8 for k in range(40)], [k / 8 for k in range(-30, 20)])):
        points = [("held", s) for s in held] + [("rejected", s) for s in rejected]
        table = spark.createDataFrame(points + points[:3], "role string, score double").repartition(3)
        assert Q.threshold_of(table) == Q.threshold(held, rejected)


def test_hashes_held_by_a_worker_stay_small():
    tracemalloc.start()
    hashes = WordHashes()
    for low in range(0, 300_000, 1_000):
        words = [b"word%d" % k for k in range(low, low + 1_000)]
        assert hashes.of(words)[-1] == xxhash.xxh64_intdigest(words[-1])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20 << 20
