import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest

import corpus_pipeline
from tests.llm.test_lines import plain as plain_lines
from tests.llm.test_minhash import edited, plain_components
from timberline.llm import mixing, pieces, quality


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(11)
    good, junk = [f"w{k}" for k in range(400)], [f"w{k}$$$" for k in range(400)]
    shared = "A line of words that very many documents of this corpus share with all others."
    rows, labels = [], []
    for k in range(150):
        own = junk if k % 10 == 0 else good
        words = [rnd.choice(own) for _ in range(70 + k % 40)]
        if k % 7 == 3 and k % 10 > 1:
            words = edited(rnd, rows[-1][1].split("\n")[-1].split(" "), 1)
        rows.append((k, "\n".join([shared] * (k % 3 == 0) + [" ".join(words)]), f"src{k % 3}"))
        labels.append((k, 0 if k % 10 == 0 else 1))
    rows += [(200, rows[5][1], "src0"), (201, None, "src1"), (202, "too short", None), (203, "again and again " * 30, "src1"),
             (None, " ".join(rnd.choice(good) for _ in range(80)), None)]
    path = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(a, b, "en", c, len(b or "")) for a, b, c in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(*r, 0) for r in labels], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    def step(name, df):
        out = stage[name](spark, df, folder)
        out = spark.createDataFrame(out.collect(), out.schema)
        return out

    good = step("quality rules", docs)
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    verdict = {(r.doc.doc_id, r.doc.text): r.q.kept for r in quality.assess(docs, model).collect()}
    assert good.columns == columns
    assert sorted(map(str, good.collect())) == sorted(str(r) for r in docs.collect() if verdict[r.doc_id, r.text])
    assert {r.doc_id for r in good.collect()} >= {k for k in range(150) if k % 10} and good.filter("doc_id % 10 = 0 AND doc_id < 150").count() == 0

    lined = step("line dedup", good)
    rows = [(r.doc_id, r.text) for r in good.collect()]
    want = plain_lines(rows)
    assert lined.columns == columns
    assert Counter((r.doc_id, r.text) for r in lined.collect()) == Counter((d, want[d, t]) for d, t in rows if want[d, t].split())

    single = step("minhash near-dedup", lined)
    rows = [(r.doc_id, r.text) for r in lined.collect()]
    component = plain_components(rows, 5, 80)
    assert single.columns == columns
    kept = Counter(r.doc_id for r in single.collect())
    assert kept == Counter({c: 1 for _, _, c in component})

    mixed = step("mix sources", single)
    planned = {r.doc.doc_id: r.copies for r in mixing.plan_mix(single).collect()}
    assert mixed.columns == columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({d: n for d, n in planned.items() if n})

    ids = step("byte-level bpe", mixed)
    ranks = pieces.rank_encoding(P.path("byte_bpe_multi_50k.tiktoken"))
    def row(d, t):
        own = ranks.encode_ordinary(t or "")
        return (d, len(own), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert Counter(tuple(r) for r in ids.collect()) == Counter(row(r.doc_id, r.text) for r in mixed.collect())
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, folder).collect()) == Counter(tuple(r) for r in ids.collect())


def test_empty_tables(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
