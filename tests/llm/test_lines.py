import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from timberline.llm import lines as L
from timberline.llm.queries import op4_columns


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=600, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12), st.integers(0, 6))
def test_banded_distance(a, b, most):
    assert L.within(a, b, most) == (distance(a, b) <= most)


def test_banded_distance_on_long_lines():
    rnd = random.Random(1)
    for _ in range(300):
        a = "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(30, 200)))
        b = change(rnd, a, rnd.randrange(6))
        for most in (1, 2, 5):
            assert L.within(a, b, most) == (distance(a, b) <= most)


def test_very_long_lines_take_linear_time():
    rnd = random.Random(3)
    a = "".join(rnd.choice("abcdefgh ") for _ in range(1_000_000))
    b = "x" + a[1:500_000] + "y" + a[500_000:-1] + "zz"
    begin = time.time()
    assert not L.within(a, b, 2) and L.within(a, "x" + a[1:-1] + "z", 2) and L.within(a, a[:5] + a[6:] + "q", 2)
    assert time.time() - begin < 20


def change(rnd, text, edits):
    text = list(text)
    for _ in range(edits):
        k = rnd.randrange(len(text))
        how = rnd.randrange(3)
        if how == 0:
            text[k] = rnd.choice("xyzé")
        elif how == 1:
            del text[k]
        else:
            text.insert(k, rnd.choice("xyzé"))
    return "".join(text)


def corpus():
    rnd = random.Random(7)
    bases = ["".join(rnd.choice("abcdefghijklmnop  ") for _ in range(n)) for n in [18, 20, 22, 23, 24, 25, 38, 39, 40, 41, 42, 47, 48, 49, 56, 57, 90, 150]]
    rows = []
    for k in range(160):
        own = [change(rnd, rnd.choice(bases), rnd.randrange(4)) for _ in range(rnd.randrange(1, 4))]
        rows.append((k, "\n".join([*own, "short", "", f"unique line number {rnd.random()} of document {k}"])))
    rows += [(200, None), (201, ""), (202, "\n\n"), (None, rows[3][1]), (3, rows[3][1]), (203, " " * 30 + "\n" + " " * 30),
             (204, "long line " * 2000), (205, "long line " * 2000 + "!"), (206, rows[0][1])]
    return rows


def plain(rows):
    """Per distinct row: text after dropping lines of a class that began earlier."""
    import hashlib

    places = []
    for doc, text in sorted({*rows}, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest())):
        for at, line in enumerate((text or "").split("\n")):
            if len(line) >= 20 and line.strip(" \t\n\x0b\x0c\r"):
                places.append((doc, text, at, line))
    distinct = list(dict.fromkeys(p[3] for p in places))
    parent = {x: x for x in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(distinct):
        for y in distinct[:i]:
            if abs(len(x) - len(y)) <= 2 and find(x) != find(y):
                most = 1 if min(len(x), len(y)) < 40 else 2
                if len(x) < 1000 and distance(x, y) <= most or len(x) >= 1000 and x + "!" == y or y + "!" == x:
                    parent[find(x)] = find(y)
    seen, drops = set(), {}
    for doc, text, at, line in places:
        if find(line) in seen:
            drops.setdefault((doc, text), set()).add(at)
        seen.add(find(line))
    return {r: None if r[1] is None else "\n".join(x for at, x in enumerate(r[1].split("\n")) if at not in drops.get(r, ())) for r in rows}


def plain_classes(rows):
    """Per distinct row: (line, document and line where its class begins, links) of every line with a copy or an alike line."""
    import hashlib
    from collections import Counter

    lines = [(d, hashlib.md5((t or "").encode()).digest(), at, line, t) for d, t in rows for at, line in enumerate((t or "").split("\n"))
             if len(line) >= 20 and line.strip(" \t\n\x0b\x0c\r")]
    copies = Counter(line[3] for line in lines)
    distinct = list(copies)
    near = {x: set() for x in distinct}
    for i, x in enumerate(distinct):
        for y in distinct[:i]:
            most = 1 if min(len(x), len(y)) < 40 else 2
            if abs(len(x) - len(y)) <= 2 and (distance(x, y) <= most if len(x) < 1000 else x + "!" == y or y + "!" == x):
                near[x].add(y)
                near[y].add(x)
    first, out = {}, {}
    for d, p, at, line, _ in sorted(lines, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        if line not in first:
            todo = [line]
            while todo:
                x = todo.pop()
                if x not in first:
                    first[x] = (d, at)
                    todo += near[x]
    for d, _, at, line, t in lines:
        if copies[line] > 1 or near[line]:
            out.setdefault((d, t), set()).add((at, *first[line], copies[line] - 1 + sum(copies[y] for y in near[line])))
    return {k: sorted(v, key=lambda r: r[0]) for k, v in out.items()}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", 3) for r in corpus()], "doc_id long, text string, line string, at int")


@pytest.mark.parametrize("block", [5, 1024])
def test_dedup_equals_brute_force(spark, docs, monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    got = L.dedup_lines(docs).collect()
    want, classes = plain(corpus()), plain_classes(corpus())
    assert len(got) == len(corpus()) and len(classes) > 100
    for r in got:
        assert [tuple(c) for c in r.classes] == classes.get((r.doc.doc_id, r.doc.text), [])
        assert r.text == want[r.doc.doc_id, r.doc.text]
        assert r.n_lines - r.n_dropped == (0 if r.text is None else len(r.text.split("\n"))) or r.n_lines == r.n_dropped
    assert len(op4_columns(L.dedup_lines(docs)).collect()) == len(corpus())


def test_documents_without_words_left_go(spark, docs):
    kept = L.drop_repeated(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {200, 201, 202, 203, 204} <= set(ids) and 205 not in ids
    assert L.drop_repeated(docs.limit(0)).count() == 0
