"""Token counts by overlap resynchronisation.

A document up to ``chunk_chars`` is one chunk. A longer one is cut into chunks
that overlap; chunks are encoded wherever they land, and neighbours are spliced
at a cut both found inside the overlap. The splice is proven: the first chunk
starts at a true cut; the pattern remembers nothing but its position, so from a
true cut on a later chunk agrees with the whole text; and cuts closer than
``pieces.MARGIN`` to a chunk's end are not used. Documents with an overlap that
holds no common cut go through another round with chunks and overlaps four
times as large, until every document is spliced (or is one chunk).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm import pieces as X
from timberline.llm.common import text_of
from timberline.session import cut

SPECIAL = "<|endoftext|>"
_CHUNK = "key long, id {id}, n_bytes long, at int, of int, begin long, body string"
_SPLIT = ("key long, id {id}, n_bytes long, at int, of int, total long, "
          "left_at array<long>, left_n array<long>, right_at array<long>, right_n array<long>")


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 chunk_chars: int = 1 << 16, overlap: int = 512) -> DataFrame:
    """``(id, n_bytes, n_tokens)`` per row, as the tokenizers library counts with the byte-level BPE file at ``path``.

    A null text counts as empty (0 bytes, 0 tokens); null ids and repeated rows
    are kept as they are, one result each; other columns are ignored, whatever
    their names; an empty table gives an empty result. The special string of the
    file inside a text counts as one token, which is the library's default.
    """
    if not 2 * X.MARGIN < overlap < chunk_chars:
        raise ValueError("overlap must be above 64 and below chunk_chars")
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    base = base.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    kind = base.schema["id"].dataType.simpleString()

    def short(batches):
        cache = X.library_cache(path)
        for batch in batches:
            n = X.count_texts(batch.column("text").to_pylist(), cache, SPECIAL)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(n)],
                                             ["id", "n_bytes", "n_tokens"])

    schema = f"id {kind}, n_bytes long, n_tokens long"
    out = base.filter(F.length("text") <= chunk_chars).mapInArrow(short, schema)
    todo = cut(base.filter(F.length("text") > chunk_chars)
               .select(F.monotonically_increasing_id().alias("key"), "*"), "long-texts")
    while not todo.isEmpty():
        chunks = todo.mapInArrow(_chunker(chunk_chars, overlap), _CHUNK.format(id=kind))
        parts = chunks.repartition("key", "at").mapInArrow(_encoder(path, chunk_chars, overlap), _SPLIT.format(id=kind))
        done = cut(_splice(parts), "spliced")
        out = out.unionByName(done.filter("failed = 0").select("id", "n_bytes", "n_tokens"))
        todo = cut(todo.join(done.filter("failed > 0").select("key"), "key", "left_semi"), "long-texts")
        chunk_chars, overlap = chunk_chars * 4, overlap * 4
    return out


def _chunker(size: int, overlap: int):
    def run(batches):
        for batch in batches:
            for key, id_, n_bytes, text in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "n_bytes", "text")),
                                               strict=True):
                of = max(1, -(-(len(text) - overlap) // size))
                for at in range(of):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key]), pa.array([id_], batch.schema.field("id").type), pa.array([n_bytes]),
                         pa.array([at], pa.int32()), pa.array([of], pa.int32()), pa.array([at * size]),
                         pa.array([text[at * size : (at + 1) * size + overlap]])],
                        ["key", "id", "n_bytes", "at", "of", "begin", "body"])

    return run


def _encoder(path: str, size: int, overlap: int):
    def run(batches):
        cache = X.library_cache(path)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for begin, body in zip(batch.column("begin").to_pylist(), batch.column("body").to_pylist(), strict=True):
                starts, counts, total = _cuts(body, cache)
                left = starts < overlap - X.MARGIN
                right = (starts >= size) & (starts <= len(body) - X.MARGIN)
                for row, value in zip(rows, (total, starts[left] + begin, counts[left], starts[right] + begin,
                                             counts[right]), strict=True):
                    row.append(value)
            arrays = [batch.column(c) for c in ("key", "id", "n_bytes", "at", "of")]
            arrays += [pa.array(rows[0], pa.int64()), *(pa.array(r, pa.list_(pa.int64())) for r in rows[1:])]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "id", "n_bytes", "at", "of", "total", "left_at", "left_n",
                                                      "right_at", "right_n"])

    return run


def _cuts(body: str, cache: X.PieceIds):
    """Where pieces of ``body`` start, and how many tokens come before each."""
    starts, counts, begin, total = [], [], 0, 0
    for part in X.steps(body, SPECIAL):
        found = X.Pieces([part], SPECIAL)
        _, n = cache.find(found)
        before = np.cumsum(n, dtype=np.int64) - n
        starts.append(found.start + begin)
        counts.append(before + total)
        begin, total = begin + len(part), total + int(n.sum())
    return np.concatenate(starts), np.concatenate(counts), total


def _splice(parts: DataFrame) -> DataFrame:
    after = Window.partitionBy("key").orderBy("at")
    pairs = parts.select("*", F.lead("left_at").over(after).alias("next_at"), F.lead("left_n").over(after).alias("next_n"))
    common = F.array_min(F.array_intersect("right_at", "next_at"))
    pairs = pairs.withColumn("p", common)
    upto = F.element_at("right_n", F.array_position("right_at", F.col("p")).cast("int"))
    dropped = F.element_at("next_n", F.array_position("next_at", F.col("p")).cast("int"))
    last = F.col("at") == F.col("of") - 1
    own = F.when(last, F.col("total")).when(F.col("p").isNotNull(), upto - dropped)
    return (pairs.select("key", "id", "n_bytes", own.alias("own"))
            .groupBy("key").agg(F.first("id").alias("id"), F.first("n_bytes").alias("n_bytes"),
                                F.sum("own").alias("n_tokens"),
                                F.count_if(F.col("own").isNull()).alias("failed")))
