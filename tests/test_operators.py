import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from timberline.operators import components as K
from timberline.operators import correlate as C
from timberline.operators import forest as FO
from timberline.operators import ordering as O
from timberline.operators import reports as RP
from timberline.operators import scoring as SC
from timberline.operators import templates as T
from timberline.functions.parsing import ENTITY_TYPE

EVENT = (
    "dataset string, id long, template_id string, timestamp string, timestamp_epoch double, service string, "
    f"host string, entities {ENTITY_TYPE}, anomaly_score double, level string, is_anomaly boolean, message string"
)


def event(n, template, epoch, block=None, service="datanode", host="node-1"):
    entities = (block, None, None, None, None, None, None)
    return ("d", n, template, f"t{epoch}", float(epoch), service, host, entities, 0.9, "ERROR", True, "m")


def test_dense_numbers_and_previous_rows_cross_blocks(spark):
    rng = random.Random(3)
    rows = [(k, o) for k in "ab" for o in sorted(rng.sample(range(1000), 80))]
    df = spark.createDataFrame(rows, "k string, o long")
    for row in O.number_densely(df, ["k"], "o", "n", width=64).collect():
        assert row.n == sum(1 for k, o in rows if k == row.k and o <= row.o)
    for row in O.with_previous(df, ["k"], "o", ["o"], width=16).withColumn("p", F.col("prev.o")).collect():
        before = [o for k, o in rows if k == row.k and o < row.o]
        assert row.p == (max(before) if before else None)


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.root for r in K.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in linked}


def incidents(spark, rows):
    members = C.correlate(spark.createDataFrame(rows, EVENT)).members
    return sorted(r["count"] for r in members.groupBy("incident_id").count().collect())


def test_correlation_cases(spark):
    assert incidents(spark, [event(i, "t1", 1000 + 120 * i) for i in range(20)]) == [20]
    assert incidents(spark, [event(1, "t1", 0), event(2, "t2", 100000, service="other")]) == [1, 1]
    assert incidents(spark, [event(1, "t1", 0, "blk_42"), event(2, "t2", 5, "blk_42")]) == [2]
    assert incidents(spark, [event(1, "t1", 0), event(2, "t1", 300)]) == [2]
    assert incidents(spark, [event(1, "t1", 0), event(2, "t1", 301)]) == [1, 1]
    assert incidents(spark, [event(1, "t1", 0, "blk_1"), event(2, "t1", 301, "blk_1")]) == [2]


def test_runs_match_a_row_by_row_model(spark):
    rng = random.Random(11)
    rows, now = [], 0.0
    for n in range(1, 400):
        now += rng.choice([0, 1, 50, 299, 300, 301, 900])
        rows.append(event(n, rng.choice(["t1", "t2"]), now, rng.choice([None, "blk_1", "blk_2"])))
    expected, last, run = {}, {}, {}
    for r in rows:
        t, prev = r[2], last.get(r[2])
        if prev is None or (r[4] - prev[4] > 300 and not (r[7][0] and r[7][0] == prev[7][0])):
            run[t] = r[1]
        expected[r[1]] = run[t]
        last[t] = r
    df = C.assign_runs(C.with_entity_keys(spark.createDataFrame(rows, EVENT)))
    assert {r.id: r.run_id for r in df.collect()} == expected


def leaf_table(spark, texts, max_children):
    df = spark.createDataFrame([("d", t, i, 1) for i, t in enumerate(texts, 1)], "dataset string, template string, first_id long, n long")
    df = df.withColumn("tokens", F.split("template", " ")).withColumn("n_tokens", F.size("tokens"))
    return T.template_leaves(df, max_children)


@pytest.mark.parametrize("head", [1000, 7])
def test_clusters_equal_one_pass_over_a_tree(spark, head):
    rng = random.Random(2)
    words = ["a", "b", "c", "d", "e", "<NUM>", "<*>", "f"]
    texts = list(dict.fromkeys(" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(250)))
    root, expected = {}, {}
    for text in texts:
        tokens = text.split(" ")
        node = root.setdefault(len(tokens), {})
        for token in tokens[:2]:
            token = "<*>" if token.startswith("<") and token.endswith(">") else token
            if token not in node and len(node) >= 3:
                token = "<*>"
            node = node.setdefault(token, {})
        clusters = node.setdefault("clusters", [])
        shared = [sum(a == b != "<*>" for a, b in zip(tokens, c["now"], strict=True)) for c in clusters]
        if shared and max(shared) >= 0.5 * len(tokens):
            own = clusters[shared.index(max(shared))]
            own["now"] = [a if a == b else "<*>" for a, b in zip(tokens, own["now"], strict=True)]
        else:
            own = {"founder": text, "now": tokens}
            clusters.append(own)
        expected[text] = own
    got = T.cluster_templates(leaf_table(spark, texts, 3), head=head).collect()
    assert len(got) == len(texts)
    for row in got:
        assert row.founder == expected[row.template]["founder"]
        assert row.cluster_template == " ".join(expected[row.template]["now"])


def test_template_pair_shares_a_template(spark):
    texts = [f"Connection established to worker {w} with status OK" for w in ("alpha", "beta")]
    got = T.cluster_templates(leaf_table(spark, texts, 100)).collect()
    assert {r.cluster_template for r in got} == {"Connection established to worker <*> with status OK"}
    assert len({r.founder for r in got}) == 1


def test_forest_ranks_planted_outliers(spark):
    rng = random.Random(1)
    rows = [("d", i, 1.0, 0.3, rng.random(), 1.0, 0.0, 0.0) for i in range(400)]
    rows += [("d", 1000 + i, 4.5, 0.001, 900.0, 9.0, 1.0, 0.35) for i in range(4)]
    rows += [("small", i, 1.0, 0.3, 0.0, 1.0, 0.0, 0.0) for i in range(19)]
    schema = "dataset string, id long, " + ", ".join(f"{f} double" for f in SC.FEATURES)
    df = spark.createDataFrame(rows, schema)
    scores = {(r.dataset, r.id): r.iforest for r in FO.forest_scores(df).collect()}
    assert min(scores.values()) == 0.0 and max(scores.values()) == 1.0
    assert {k[1] for k in sorted(scores, key=scores.get)[-4:]} == {1000, 1001, 1002, 1003}
    assert all(k[0] == "d" for k in scores)
    assert scores == {(r.dataset, r.id): r.iforest for r in FO.forest_scores(df).collect()}


def test_board_order_and_pages(spark):
    rows = [("d", "1", "MEDIUM", 0.99, 99, "a"), ("d", "2", "HIGH", 0.70, 2, "a"),
            ("d", "3", "CRITICAL", 0.80, 2, "a"), ("d", "4", "CRITICAL", 0.95, 1, "a")]
    df = spark.createDataFrame(rows, "dataset string, incident_id string, severity string, confidence double, event_count long, start_time string")
    pages = [[r.incident_id for r in RP.incident_page(df, o, 2).collect()] for o in (0, 2, 4)]
    assert pages == [["4", "3"], ["2", "1"], []]
    with pytest.raises(ValueError):
        RP.incident_page(df, 0, 101)


def brute_force_similar(texts, st=0.5):
    """The earlier text each resembles most, by comparing all."""
    want = {}
    for text, first in texts:
        a, best = text.split(" "), None
        for other, o_first in texts:
            b = other.split(" ")
            if o_first < first and len(a) == len(b):
                share = sum(x == y != "<*>" for x, y in zip(a, b, strict=True)) / len(a)
                if share >= st:
                    best = max(best or (0, 0, ""), (share, -o_first, other))
        if best:
            want[text] = (best[2], best[0])
    return want


def leaf_rows(spark, texts):
    rows = [("d", t, f, 1, t.split(" "), len(t.split(" ")), "k", "k") for t, f in texts]
    return spark.createDataFrame(rows, "dataset string, template string, first_id long, n long, tokens array<string>, n_tokens int, key1 string, key2 string")


def test_similar_templates_equal_all_pairs(spark):
    rng = random.Random(8)
    texts = {" ".join(rng.choice(["a", "b", "c", "<*>"]) for _ in range(k)) for k in (1, 2, 5, 6) for _ in range(25)}
    texts |= {" ".join(f"{w}{rng.randrange(2 if w < 'p' else 9)}" for w in "abcdefghijklmnopqrst") for _ in range(30)}
    texts = [(t, n) for n, t in enumerate(sorted(texts, key=lambda _: rng.random()))]
    got = {r.template: (r.nearest, r.similarity) for r in T.similar_templates(leaf_rows(spark, texts)).collect()}
    assert got == brute_force_similar(texts)


def test_resembling_templates_do_not_meet_pairwise(spark, monkeypatch):
    written, cut = {}, T.cut

    def counted(df, label="stage"):
        out = cut(df, label)
        written[label] = out.count()
        return out

    monkeypatch.setattr(T, "cut", counted)
    texts = [(f"user u{n} registered from <*>", n) for n in range(400)]
    got = T.similar_templates(leaf_rows(spark, texts)).collect()
    assert len(got) == 399 and {(r.nearest, r.similarity) for r in got} == {(texts[0][0], 0.6)}
    assert written["near-templates"] == 399 and written["probes"] == 0


def test_long_chains_take_few_rounds(spark, monkeypatch):
    written, cut = [], K.cut
    monkeypatch.setattr(K, "cut", lambda df, label: written.append(label) or cut(df, label))
    chain = spark.range(5000).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    got = K.connected_components(chain)
    assert got.count() == 5001 and got.filter("root <> 0").isEmpty()
    assert len(written) <= 4


def test_chains_are_shortened_in_bounded_parts(monkeypatch):
    monkeypatch.setattr(K, "HELD", 4)
    rows = [(2, 1), (3, 2), (4, 3), (9, 8), (8, 7), (5, 4), (6, 5)]
    batches = [pa.RecordBatch.from_arrays([pa.array([a]), pa.array([b])], ["u", "v"]) for a, b in rows]
    parts = [list(zip(*x.to_pydict().values(), strict=True)) for x in K._shorten(iter(batches))]
    assert parts == [[(2, 1), (3, 1), (4, 1), (9, 8)], [(5, 4), (6, 4), (8, 7)]]


def test_rows_out_of_reach_are_not_scored(spark):
    rng, rows = random.Random(11), []
    for n in range(600):
        level, message = rng.choice(["DEBUG", "INFO", "WARN", "ERROR", "FATAL"]), rng.choice(["m", "read failed", "timeout"])
        epoch = rng.choice([50, rng.randrange(20_000)])
        rows.append((*event(n % 590, f"t{min(n, rng.randrange(40))}", epoch)[:8], 0.0, level, False, message))
    events = spark.createDataFrame(rows, EVENT)
    whole, some = SC.score_core(events), SC.score_core(events, least=C.LEAST_SCORE)
    assert some.count() < whole.count()
    assert sorted(map(str, C.incident_candidates(some).collect())) == sorted(map(str, C.incident_candidates(whole).collect()))


def test_correlation_moves_whole_candidates_once(spark, monkeypatch):
    written, cut = {}, C.cut
    monkeypatch.setattr(C, "cut", lambda df, label: written.setdefault(label, df.columns) and cut(df, label))
    C.correlate(spark.createDataFrame([event(1, "a", 0, "b1"), event(2, "a", 5, "b1")], EVENT))
    assert [label for label, columns in written.items() if "message" in columns] == ["candidates", "members"]
