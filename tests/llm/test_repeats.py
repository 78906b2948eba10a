import hashlib
import random
import re
import zlib

from timberline.llm import repeats
from timberline.llm.queries import op12_columns, op12_periodic_runs, op12_repeated_words

SF = "/root/testdata/sf0.001"


def brute_runs(words, least=12):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q):
                part = words[i : i + length]
                if not any(part[:-d] == part[d:] for d in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def contract_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    short = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *top, top[1] and 1000 * top[1] // top[2],
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(short.encode()).hexdigest())


def test_runs_of_random_texts_against_brute_force():
    rnd = random.Random(1)
    for _ in range(300):
        texts = []
        for _ in range(rnd.randint(1, 4)):
            words = [bytes([97 + rnd.randrange(rnd.choice([1, 2, 3, 5]))]) for _ in range(rnd.randint(0, 60))]
            unit = [bytes([97 + rnd.randrange(6)]) for _ in range(rnd.randint(1, 12))]
            texts.append(words[:20] + (unit * 10)[: rnd.randint(0, 60)] + words[20:])
        least = rnd.choice([2, 3, 5, 12])
        assert repeats.text_runs(texts, least) == [brute_runs(t, least) for t in texts]


def test_classes_of_many_positions():
    assert repeats.text_runs([[b"a"] * 5000]) == [[(0, 5000, 1)]]
    assert repeats.text_runs([[b"a", b"b"] * 3000]) == [[(0, 6000, 2)]]
    one, two = [b"a"], [b"a", b"b"]
    while len(two) < 900:
        one, two = two, two + one
    assert repeats.text_runs([two]) == [brute_runs(two)]
    places, seen = repeats.Places(500), [500]
    for p in random.Random(2).sample(range(5000), 3000):
        if p != 500:
            before, after = places.add(p)
            seen.append(p)
            assert before == max((q for q in seen if q < p), default=-1)
            assert after == min((q for q in seen if q > p), default=-1)
    assert list(places) == sorted(seen)


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"]: contract_row(r["doc_id"], r["text"]) for r in docs.collect()}
    got = op12_periodic_runs(spark, SF).collect()
    assert len(got) == docs.count()
    assert {r["doc_id"]: tuple(r) for r in got} == want
    assert sum(r["n_runs"] > 0 for r in got) > 5


def test_nulls_ties_spaces_and_clashing_columns(spark):
    unit = " ".join(f"w{k}" for k in range(6))
    rows = [(1, None, "a", 1), (2, "", "b", 2), (3, " \t\n ", "c", 3), (None, f"{unit} {unit}", "d", 4), (5, f"{unit}\x0b{unit}\r\n{unit} x {unit} {unit} {unit}", "e", 5),
            (5, f"{unit}\x0b{unit}\r\n{unit} x {unit} {unit} {unit}", "e", 5), (7, "a b " * 12, "f", 6), (8, "a " * 5000, "g", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n long")
    found = repeats.periodic_runs(docs)
    got = {r["id"]: r for r in found.collect()}
    assert found.count() == len(rows)
    assert all(got[k]["runs"] == [] and got[k]["collapsed"] == "" and got[k]["n_words"] == 0 for k in (1, 2, 3))
    assert [tuple(r) for r in got[None]["runs"]] == [(0, 12, 6)] and got[None]["collapsed"] == unit
    assert [tuple(r) for r in got[5]["runs"]] == [(0, 18, 6), (19, 18, 6)]
    assert tuple(op12_columns(found).filter("doc_id = 5").first())[1:6] == (2, 0, 18, 6, 3000)
    assert [tuple(r) for r in got[7]["runs"]] == [(0, 12, 1)] and got[7]["collapsed"] == "a b"
    assert got[8]["collapsed"] == "a"
    assert repeats.periodic_runs(docs.limit(0)).collect() == []
    changed = {r["doc_id"]: r["text"] for r in op12_repeated_words(docs).collect()}
    assert changed[None] == f"{unit} {unit}" and changed[2] == ""
