import duckdb
import pytest

from timberline.llm import mixing
from timberline.llm.queries import op8_mix_sources
from timberline.llm.sql import OP8

SCHEMA = "doc_id long, text string, source string, size int, copies int"


def water(sizes, weights=(5, 2, 1), most=3):
    """Plain targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s] + 1e-9}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def rows():
    out = [(k, "w " * (k % 9 + 1), f"s{k % 4}", 1, 2) for k in range(400)]
    out += [(k, "big text " * 40, "s9", 1, 2) for k in range(400, 700)]
    return [*out, (1, "w w", "s1", 1, 2), (1, "w w", "s1", 1, 2), (None, "a b c", "s2", 1, 2), (800, None, "s2", 1, 2),
            (801, "", "empty", 1, 2), (802, "few words", None, 1, 2), (803, "a\x85b c", "s3", 1, 2)]


def test_targets_rates_and_copies(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    planned = mixing.plan_mix(docs).collect()
    assert len(planned) == len(rows())
    sizes = {}
    for r in rows():
        sizes[r[2]] = sizes.get(r[2], 0) + len((r[1] or "").split(" ")) - (r[1] or "").endswith(" ") - (not r[1])
    want = water(sizes)
    taken = {}
    for r in planned:
        assert r.source_size == sizes[r.doc.source] and r.target == pytest.approx(want[r.doc.source])
        assert 0 <= r.copies <= 3
        taken[r.doc.source] = taken.get(r.doc.source, 0) + r.copies * r.size
    for source in ("s0", "s9"):
        assert abs(taken[source] - want[source]) < 0.15 * want[source] + 20
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in planned)


def test_reruns_agree_and_empty(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    again = docs.repartition(7)
    key = lambda df: sorted((str(r.doc), r.copies) for r in mixing.plan_mix(df).collect())
    assert key(docs) == key(again)
    assert mixing.plan_mix(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_sql_agrees(spark, tmp_path):
    docs = spark.createDataFrame(rows(), SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(OP8).fetchall()
    got = [tuple(r) for r in op8_mix_sources(spark, str(tmp_path)).collect()]
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))
    assert order(got) == order(want)
