"""Token ids as files: canonical, length-limited Huffman codes in independent blocks.

A store is three Parquet folders, so Spark commits, retries and reads them
anywhere: ``blocks`` (whole documents in id order, about ``BLOCK_TOKENS`` tokens
each: document ids, token counts, the bit stream, and the bit offset of every
``STEP``-th token), ``codes`` (code length of every id that occurs; canonical
codes need nothing else) and ``bases`` (tokens before each part). Lengths come
from the counts of all ids, by package-merge, so no code is longer than
``MAX_BITS`` and one table look-up decodes a token. A block needs no other block
to be decoded, and the checkpoints let all stretches of a block advance together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import pieces as X
from timberline.llm.common import part_offsets, text_of
from timberline.session import new_path

MAX_BITS = 16
BLOCK_TOKENS = 1 << 16
STEP = 256
LENGTH_BITS = MAX_BITS.bit_length()
#: Blocks are decoded together up to about this many tokens; a longer block goes with few others.
UNPACK_TOKENS = 16 * BLOCK_TOKENS


# --- codes ------------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Length of each symbol's code, none above ``most``, least in total for these counts (package-merge)."""
    n = len(counts)
    if n > 1 << most:
        raise ValueError(f"{n} symbols do not fit {most} bits")
    if n < 2:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    weights = np.asarray(counts, np.int64)[order]
    lists, packages = [], np.zeros(0, np.int64)
    for _ in range(most):
        items = np.concatenate([weights, packages])
        by = np.argsort(items, kind="stable")
        lists.append(by < n)
        items = items[by]
        packages = items[: len(items) // 2 * 2].reshape(-1, 2).sum(1)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for single in reversed(lists):
        own = int(single[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Codes:
    """Canonical codes of ``symbols`` with these ``lengths``, and the table that decodes them."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((symbols, lengths))
        self.symbols, self.lengths = np.asarray(symbols, np.int64)[order], np.asarray(lengths, np.int64)[order]
        self.bits = int(self.lengths[-1]) if len(order) else 1
        span = np.left_shift(1, self.bits - self.lengths)  # table entries that begin with a code
        first = np.cumsum(span) - span
        self.code = first >> (self.bits - self.lengths)
        # What a code's first bits decode to: its place among the symbols, and its length.
        self.entry_at = np.repeat((np.arange(len(span)) << LENGTH_BITS | self.lengths).astype(np.int32), span)
        size = int(self.symbols.max(initial=-1)) + 1
        self.code_of = np.zeros(size, np.int64)  # codes, each followed by its length
        self.code_of[self.symbols] = self.code << LENGTH_BITS | self.lengths

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit stream of ``ids`` and the bit offset of every ``STEP``-th."""
        code = self.code_of.take(ids)
        length = code & ((1 << LENGTH_BITS) - 1)
        end = np.cumsum(length)
        at = end - length
        word = at >> 5
        value = ((code >> LENGTH_BITS) << (64 - length - (at & 31))).view(np.uint64)
        words = np.zeros((int(end[-1]) + 31) // 32 + 1 if len(ids) else 0, np.uint64)
        if len(ids):
            heads = np.flatnonzero(np.diff(word, prepend=-1))
            both = np.add.reduceat(value, heads)  # codes that begin in one word share no bit
            words[word[heads]] += both >> np.uint64(32)
            words[word[heads] + 1] += both & np.uint64(0xFFFFFFFF)
        return words.astype(">u4").tobytes(), at[::STEP]

    def unpack(self, streams: list[bytes], marks: list[np.ndarray], counts: list[int]) -> list[np.ndarray]:
        """Ids of several streams; all stretches between checkpoints move on together."""
        data = np.frombuffer(b"".join(streams) + b"\0" * 8, ">u4").astype(np.uint64)
        two = (data[:-1] << np.uint64(32)) | data[1:]
        base = np.cumsum([0, *map(len, streams)])[:-1] * 8
        at = np.concatenate([m + b for m, b in zip(marks, base, strict=True)] or [np.zeros(0, np.int64)]).astype(np.int64)
        left = np.concatenate([np.minimum(STEP, n - np.arange(0, n, STEP)) for n in counts] or [np.zeros(0, np.int64)])
        out = np.empty((STEP, len(at)), np.int32)
        mask, top = np.uint64((1 << self.bits) - 1), 64 - self.bits
        for k in range(int(left.max(initial=0))):  # a stretch that has ended reads on, wherever that is; its rest is cut off
            peek = two.take(at >> 5, mode="clip") >> (top - (at & 31)).view(np.uint64)
            found = self.entry_at.take((peek & mask).view(np.int64), mode="clip")
            out[k] = found >> LENGTH_BITS
            at += found & ((1 << LENGTH_BITS) - 1)
        flat = self.symbols.astype(np.uint32).take(out.T[np.arange(STEP) < left[:, None]])
        return np.split(flat, np.cumsum(counts)[:-1]) if counts else []


# --- files ------------------------------------------------------------------------------------------------------


def encode_in_order(docs: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(part, first, doc_id, n, ids)`` in ascending id order over parts and inside them, written once.

    Ids are those of the tokenizers library for the file at ``path``, with ``end_id`` appended, packed as
    little-endian 32-bit numbers; ``first`` counts the part's ids before the row. A null or empty text is its end id
    alone. Null ids come first; rows with equal ids are ordered by their texts. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = rows.select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def run(batches):
        cache, first = X.library_cache(path), 0
        for batch in batches:
            ids, count = X.encode_texts(batch.column("text").to_pylist(), cache, "<|endoftext|>")
            own = np.split(ids, np.cumsum(count)[:-1]) if len(count) else []
            n = count + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), pa.array(first + np.cumsum(n) - n), batch.column("doc_id"), pa.array(n),
                 pa.array([np.append(x, end_id).astype("<u4").tobytes() for x in own], pa.binary())],
                ["part", "first", "doc_id", "n", "ids"])
            first += int(n.sum())

    schema = f"part int, first long, doc_id {kind}, n long, ids binary"
    at = new_path(docs.sparkSession, "ids")
    rows.mapInArrow(run, schema).write.option("compression", "zstd").parquet(at)
    return docs.sparkSession.read.schema(schema).parquet(at)


def write_ids(ordered: DataFrame, path: str) -> None:
    """Write rows of :func:`encode_in_order` under ``path``. An empty table gives an empty store."""
    spark = ordered.sparkSession

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), "<u4"))
            if len(own) > len(total):
                total = np.pad(total, (0, len(own) - len(total)))
            total[: len(own)] += own
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    # One row per id of the vocabulary at most, whatever the corpus; code_lengths checks the bound.
    rows = (ordered.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
            .limit((1 << MAX_BITS) + 1).collect())
    symbols = np.array([r.id for r in rows], np.int64)
    lengths = code_lengths(np.array([r.n for r in rows], np.int64))
    codes = spark.createDataFrame(list(zip(symbols.tolist(), lengths[: len(rows)].tolist(), strict=True)), "id long, bits long")
    codes.coalesce(1).write.parquet(f"{path}/codes")
    schema = _block_schema(ordered.schema["doc_id"].dataType.simpleString())

    def pack(batches):
        table, held = Codes(symbols, lengths[: len(symbols)]), []
        part = first = total = 0

        def block(kind):
            ids = np.concatenate([np.frombuffer(x, "<u4") for _, x in held])
            stream, marks = table.pack(ids)
            values = [part, first, [d for d, _ in held], [len(x) // 4 for _, x in held], len(ids), marks.tolist(), stream]
            kinds = [pa.int32(), pa.int64(), pa.list_(kind), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)],
                                              ["part", "first", "doc_ids", "counts", "n", "marks", "stream"])

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            columns = (batch.column(c).to_pylist() for c in ("part", "first", "doc_id", "n", "ids"))
            for p, f, doc, n, ids in zip(*columns, strict=True):
                if held and (p != part or f != first + total or total + n > BLOCK_TOKENS):
                    yield block(kind)
                    held, total = [], 0
                if not held:
                    part, first = p, f
                held.append((doc, ids))
                total += n
        if held:
            yield block(kind)

    ordered.mapInArrow(pack, schema).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    blocks = spark.read.schema(schema).parquet(f"{path}/blocks")
    part_offsets(blocks, "part", F.col("n")).write.parquet(f"{path}/bases")


def _block_schema(kind: str) -> str:
    return (f"part int, first long, doc_ids array<{kind}>, counts array<long>, n long, marks array<long>, stream binary")


def unpack_blocks(batches, table: Codes):
    """The documents of batches of blocks, blocks of up to about ``UNPACK_TOKENS`` tokens decoded together."""
    for batch in batches:
        last = np.cumsum(batch.column("n").to_numpy()) - 1
        heads = np.flatnonzero(np.diff(last // UNPACK_TOKENS, prepend=-1)).tolist()
        for low, high in zip(heads, [*heads[1:], batch.num_rows], strict=False):  # a batch without rows has no heads
            part, first, doc_ids, counts, n, marks, streams = batch.slice(low, high - low).columns
            docs, n = counts.value_lengths().to_numpy(), n.to_numpy()
            counts = counts.flatten().to_numpy()
            ids = np.concatenate(table.unpack(streams.to_pylist(), [m.values.to_numpy() for m in marks], n.tolist()))
            end = np.cumsum(counts)
            before = np.repeat(first.to_numpy() - (np.cumsum(n) - n), docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(part.to_numpy(), docs)), pa.array(before + end - counts), doc_ids.flatten(), pa.array(counts),
                 pa.array([x.tobytes() for x in np.split(ids.astype("<u4"), end[:-1])], pa.binary())],
                ["part", "first", "doc_id", "n", "ids"])


def read_ids(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """``(doc_id, start, n, ids)`` per document of the store; ``start`` counts the ids of all documents before it,
    ``ids`` are little-endian 32-bit numbers."""
    rows = spark.read.schema("id long, bits long").parquet(f"{path}/codes").limit((1 << MAX_BITS) + 1).collect()
    symbols, lengths = np.array([r.id for r in rows], np.int64), np.array([r.bits for r in rows], np.int64)
    blocks = spark.read.schema(_block_schema(id_type)).parquet(f"{path}/blocks")

    def unpack(batches):
        return unpack_blocks(batches, Codes(symbols, lengths))

    rows = blocks.mapInArrow(unpack, f"part int, first long, doc_id {id_type}, n long, ids binary")
    bases = spark.read.schema("part int, before long").parquet(f"{path}/bases")
    return rows.join(bases, "part").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n", "ids")
