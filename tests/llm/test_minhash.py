import random

import numpy as np
import pytest

from timberline.llm import minhash as M
from timberline.llm.queries import op6_columns


def plain_set(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} or {tuple(words)}


def plain_components(rows, width, percent):
    sets = [plain_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if sets[x] and sets[y] and 100 * both >= percent * len(sets[x] | sets[y]):
                parent[find(x)] = find(y)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(k)
    out = [None] * len(rows)
    for own in groups.values():
        ids = [rows[k][0] for k in own if rows[k][0] is not None]
        for k in own:
            out[k] = (rows[k][0], len(sets[k]), min(ids) if ids else None)
    return out


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"e{rnd.randrange(10**6)}"
    return words


def corpus():
    rnd = random.Random(6)
    rows = []
    for g in range(12):
        words = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randrange(40, 160))]
        for k in range(12):  # many edits from one text: links, and near misses
            rows.append((g * 100 + k, " ".join(edited(rnd, words, k % 7))))
        rows.append((g * 100 + 50, " ".join(words).upper()))
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "one"), (2004, "ONE"), (2005, "a b c"), (2006, "É one"),
             (None, "a b c"), (None, "no id at all"), (3, rows[3][1]), (7, "another text with the id seven of many words"),
             (2007, "same " * 5000), (2008, "same " * 6000)]
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "b") for r in corpus()], "doc_id long, text string, n_shingles int, print string")


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("block", [4, 1024])
def test_components_equal_brute_force(spark, docs, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    got = M.near_duplicates(docs, width=4).collect()
    want = plain_components(corpus(), 4, 80)
    assert order([(r.id, r.n_shingles, r.component_id) for r in got]) == order(want)
    columns = op6_columns(M.near_duplicates(docs, width=4)).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in columns)


def test_one_of_each_group_stays(spark, docs):
    kept = M.keep_one(docs)
    assert kept.columns == docs.columns
    want = plain_components(corpus(), 5, 80)
    groups = {c for _, n, c in want if n and c is not None}
    rows = kept.collect()
    worded = [r for r in rows if (r.text or "").split()]
    assert len(rows) - len(worded) == 3
    assert {r.doc_id for r in worded if r.doc_id is not None} == groups
    assert len(worded) == len(groups) + 1  # and one text that has no id


def test_empty_table(spark, docs):
    assert M.near_duplicates(docs.limit(0)).count() == 0 and M.keep_one(docs.limit(0)).count() == 0


def test_sketch_estimates_similarity():
    rnd = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        both = rnd.integers(0, 1 << 63, 400, np.uint64)
        only = int(400 * (1 - share) / (2 * share))
        sets = [np.unique(np.concatenate([both, rnd.integers(0, 1 << 63, only, np.uint64)])) for _ in range(2)]
        sketch = M.sketches(sets, 512)
        assert not (sketch == np.uint64(0xFFFFFFFFFFFFFFFF)).any()
        assert abs((sketch[0] == sketch[1]).mean() - share) < 0.08
    assert M.sketches([np.zeros(0, np.uint64), np.array([5], np.uint64)], 64).shape == (2, 64)
