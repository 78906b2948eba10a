import heapq
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from timberline.llm import token_files as T

JSON = P.path("byte_bpe_50k.json")


def huffman_cost(counts):
    heap = list(map(int, counts))
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    return cost


@pytest.mark.parametrize("n", [2, 3, 10, 300])
def test_lengths_are_a_code_and_least(n):
    rnd = np.random.default_rng(n)
    counts = rnd.integers(1, 50, n)
    lengths = T.code_lengths(counts)
    assert sum(2.0 ** -lengths) == 1 and int((lengths * counts).sum()) == huffman_cost(counts)
    steep = np.array([int(1.7**k) + 1 for k in range(min(n, 40))])
    limited = T.code_lengths(steep, 8)
    assert limited.max() <= 8 and sum(2.0 ** -limited) <= 1


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_streams_round_trip(n):
    rnd = np.random.default_rng(n)
    ids = np.minimum(rnd.geometric(0.05, n), 400) * 7
    symbols, counts = np.unique(np.append(ids, [3, 2800]), return_counts=True)
    codes = T.Codes(symbols, T.code_lengths(counts))
    streams, marks = zip(*(codes.pack(x) for x in (ids, ids[::-1])), strict=True)
    one, two = codes.unpack(list(streams), list(marks), [n, n])
    assert one.tolist() == ids.tolist() and two.tolist() == ids[::-1].tolist()


def test_store_equals_library(spark, tmp_path, monkeypatch):
    rnd = random.Random(4)
    words = ["alpha", "beta", "gamma", "<|endoftext|>", "\n", "中文", "x" * 50]
    rows = [(k * 3 % 101, " ".join(rnd.choice(words) for _ in range(rnd.randrange(60))), 5, "p") for k in range(101)]
    rows += [(7, "tie", 5, "p"), (7, None, 5, "p"), (None, "no id", 5, "p"), (500, "", 5, "p"), (501, "long " * 4000, 5, "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, part string")
    monkeypatch.setattr(T, "BLOCK_TOKENS", 600)
    path = str(tmp_path / "store")
    T.write_ids(T.encode_in_order(docs, JSON), path)
    got = sorted(T.read_ids(spark, path).collect(), key=lambda r: r.start)
    library, start, want = Tokenizer.from_file(JSON), 0, []
    for doc, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n, zlib.crc32(bytes(r.ids))) for r in got] == want


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = str(tmp_path / "none")
    T.write_ids(T.encode_in_order(docs, JSON), path)
    assert T.read_ids(spark, path).count() == 0


def test_blocks_are_decoded_together(monkeypatch):
    rnd = np.random.default_rng(6)
    symbols = np.arange(300) * 5
    codes = T.Codes(symbols, T.code_lengths(rnd.integers(1, 99, 300)))
    rows, want = [], []
    for block in range(40):
        sizes = [40_000] if block == 13 else rnd.integers(1, 400, rnd.integers(1, 5)).tolist()
        docs = [symbols[rnd.integers(0, 300, n)] for n in sizes]
        stream, marks = codes.pack(np.concatenate(docs))
        names = [None if block == 7 else 10 * block + k for k in range(len(docs))]
        rows.append({"part": block // 9, "first": 1000 * block, "doc_ids": names, "counts": sizes, "n": sum(sizes),
                     "marks": marks.tolist(), "stream": stream})
        want += [(block // 9, 1000 * block + sum(sizes[:k]), names[k], sizes[k], docs[k].tolist()) for k in range(len(docs))]
    kinds = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
                       ("n", pa.int64()), ("marks", pa.list_(pa.int64())), ("stream", pa.binary())])
    batches = [pa.RecordBatch.from_pylist(rows[a:b], kinds) for a, b in ((0, 30), (30, 30), (30, 40))]
    calls, unpack = [], codes.unpack
    monkeypatch.setattr(codes, "unpack", lambda *a: calls.append(sum(a[2])) or unpack(*a))
    for most, fewest in ((1 << 20, 2), (5000, 5)):
        calls.clear()
        monkeypatch.setattr(T, "UNPACK_TOKENS", most)
        got = [tuple(r.values()) for batch in T.unpack_blocks(batches, codes) for r in batch.to_pylist()]
        assert [(*r[:4], np.frombuffer(r[4], "<u4").tolist()) for r in got] == want
        assert fewest <= len(calls) < len(rows) / 2 and max(calls) < 40_000 + most
