"""Byte-level BPE as a monoid: elements are encoded texts, joined up a tree.

A text is halved until its parts are leaves, leaves are encoded on their own,
and neighbours are joined by encoding a window around the seam again. The
window grows until what lies outside is proven to stay:

* cuts of the left part that end ``pieces.MARGIN`` before the seam stay, because
  the pattern looks no further ahead;
* once the window finds a cut the right part has too, the rest of the right part
  stays, because the pattern remembers nothing but its position;
* inside one long piece, tokens stay when each pair of neighbours encodes to
  itself: a BPE sequence whose neighbours all do is the encoding of its bytes.

Texts up to ``segment_chars`` are reduced inside one task. Longer ones are
spread as segments and reduced by Spark, two neighbours per group and round, so
no group holds more than two elements. Decoding concatenates up the same tree.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm import pieces as X
from timberline.llm.common import text_of

LEAF_CHARS = 1 << 13
#: A worker that is used again keeps its pieces in later stages too: how many, and how many characters it cuts at once.
PIECES = 1 << 17
RUN_CHARS = 1 << 17
LONG_PIECE = 64


# --- inside one piece -------------------------------------------------------------------------------------------


class TokenTree:
    """Encoding of one pre-tokenized piece; long pieces are halved and joined token by token."""

    def __init__(self, path: str):
        self.encoding = X.rank_encoding(path)
        self.base = self.encoding._encode_single_piece
        self.bytes_of = self.encoding.decode_single_token_bytes
        self.fits = functools.lru_cache(1 << 15)(self._fits)

    def _fits(self, a: int, b: int) -> bool:
        return self.base(self.bytes_of(a) + self.bytes_of(b)) == [a, b]

    def pieces(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and how many each has."""
        lists = [self.piece(s.encode("utf-8", "surrogatepass")) for s in strings]
        n = np.fromiter(map(len, lists), np.int32, len(lists))
        return np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(n.sum())), n

    def piece(self, data: bytes) -> list[int]:
        if len(data) <= LONG_PIECE:
            return self.base(data)
        try:
            return [self.encoding.encode_single_token(data)]
        except KeyError:
            return self.tree(data)

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= LONG_PIECE:
            return self.base(data)
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        k = 1
        while True:
            i, j = min(k, len(left)), min(k, len(right))
            seam = self.base(b"".join(map(self.bytes_of, left[len(left) - i :] + right[:j])))
            if ((i == len(left) or self.fits(left[-i - 1], seam[0]))
                    and (j == len(right) or self.fits(seam[-1], right[j]))):
                return left[: len(left) - i] + seam + right[j:]
            k *= 2


@functools.cache
def rank_cache(path: str) -> X.PieceIds:
    return X.PieceIds(TokenTree(path).pieces, PIECES)


# --- cuts of one text -------------------------------------------------------------------------------------------


def join_cuts(text: str, left: np.ndarray, seam: int, right: np.ndarray, begin: int = 0) -> tuple[int, np.ndarray, int]:
    """Join the piece ends of ``text[begin:seam]`` and of what follows.

    Returns how many ends of the left part stay, the new ends, and how many ends of the right part go.
    """
    keep = int(np.searchsorted(left, seam - X.MARGIN, "right"))
    at = int(left[keep - 1]) if keep else begin
    stop = int(right[-1]) if len(right) else seam
    width = 2 * X.MARGIN
    while True:
        until = min(stop, seam + width)
        fresh = X.Pieces([text[at:until]]).end + at
        if until == stop:
            return keep, fresh, len(right)
        common = np.intersect1d(fresh[(fresh >= seam) & (fresh <= until - X.MARGIN)], right)
        if len(common):
            return keep, fresh[fresh <= common[0]], int(np.searchsorted(right, common[0], "right"))
        width *= 2


def reduce_cuts(text: str, leaves: list[np.ndarray], begins: list[int]) -> np.ndarray:
    """Join the leaves' ends (in text coordinates), neighbours first."""
    while len(leaves) > 1:
        merged = []
        for k in range(0, len(leaves) - 1, 2):
            keep, fresh, gone = join_cuts(text, leaves[k], begins[k + 1], leaves[k + 1], begins[k])
            merged.append(np.concatenate([leaves[k][:keep], fresh, leaves[k + 1][gone:]]))
        if len(leaves) % 2:
            merged.append(leaves[-1])
        leaves, begins = merged, begins[::2]
    return leaves[0]


def encode_batch(texts: list[str], cache: X.PieceIds, leaf: int = LEAF_CHARS):
    """Ends, ids per piece and ids of every text; leaves of all texts are cut together."""
    parts, owner, begin = [], [], []
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text)), leaf):
            parts.append(text[at : at + leaf])
            owner.append(k)
            begin.append(at)
    found = X.Pieces(parts)
    low = np.searchsorted(found.owner, np.arange(len(parts) + 1))
    first = np.searchsorted(np.asarray(owner), np.arange(len(texts) + 1))
    whole = X.Pieces(texts, cuts=False)
    ends = []
    for k, text in enumerate(texts):
        leaves = [found.end[low[p] : low[p + 1]] - found.base[p] + begin[p] for p in range(first[k], first[k + 1])]
        ends.append(reduce_cuts(text, leaves, begin[first[k] : first[k + 1]]) if len(leaves) > 1 else leaves[0])
    size = np.fromiter(map(len, ends), np.int64, len(ends))
    whole.owner = np.repeat(np.arange(len(texts)), size)
    whole.end = np.concatenate(ends) + whole.base[whole.owner] if ends else np.zeros(0, np.int64)
    whole.start = np.concatenate([[0], whole.end[:-1]])[: len(whole.end)]
    heads = (np.cumsum(size) - size)[size > 0]
    whole.start[heads] = whole.base[size > 0]
    at, n = cache.find(whole)
    ids = cache.ids(at, n)
    count = np.bincount(whole.owner, weights=n, minlength=len(texts)).astype(np.int64)
    return ends, np.split(n, np.cumsum(size)[:-1]) if len(ends) else [], np.split(ids, np.cumsum(count)[:-1])


# --- over tables ------------------------------------------------------------------------------------------------


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
           segment_chars: int = 1 << 16, decoded: bool = False) -> DataFrame:
    """``(id, ids array<int>)`` per row: what tiktoken gives for the rank file at ``path``, no special tokens.

    With ``decoded`` the ids are decoded in the same pass and ``decoded`` (binary) is added.

    A null or empty text has an empty array; null ids and repeated rows stay,
    one result each; other columns are ignored, whatever their names; an empty
    table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()

    def short(batches):
        cache, decoder = rank_cache(path), Decoder(path) if decoded else None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for low, high in _runs(texts):
                _, _, ids = encode_batch(texts[low:high], cache)
                columns = {"id": batch.column("id").slice(low, high - low), "ids": _lists(ids)}
                if decoder:
                    columns["decoded"] = pa.array([decoder.text(own.tolist()) for own in ids], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    schema = f"id {kind}, ids array<int>" + ", decoded binary" * decoded
    out = base.filter(F.length("text") <= segment_chars).mapInArrow(short, schema)
    long = base.filter(F.length("text") > segment_chars).select(F.monotonically_increasing_id().alias("key"), "*")
    longest = long.agg(F.max(F.length("text"))).first()[0]
    if longest is None:
        return out
    tree = _segments(long, kind, path, segment_chars)
    for _ in range((-(-longest // segment_chars) - 1).bit_length()):
        pair = tree.groupBy("key", F.expr("at div 2").cast("int").alias("pair"))
        tree = pair.applyInArrow(_joiner(path), tree.schema)
    tree = tree.select("id", "ids")
    return out.unionByName(decode(tree, path) if decoded else tree)


def _runs(texts: list[str], most: int = RUN_CHARS):
    low = total = 0
    for high, text in enumerate(texts):
        if total + len(text) > most and high > low:
            yield low, high
            low, total = high, 0
        total += len(text)
    if texts:
        yield low, len(texts)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


_ELEMENT = ("key", "id", "at", "body", "ends", "n", "ids")


def _segments(long: DataFrame, kind: str, path: str, size: int) -> DataFrame:
    def spread(batches):
        for batch in batches:
            for key, id_, text in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "text")), strict=True):
                for at, low in enumerate(range(0, len(text), size)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key]), pa.array([id_], batch.schema.field("id").type), pa.array([at], pa.int32()),
                         pa.array([text[low : low + size]])], ["key", "id", "at", "body"])

    def encoded(batches):
        cache = rank_cache(path)
        for batch in batches:
            bodies = batch.column("body").to_pylist()
            for low, high in _runs(bodies):
                ends, n, ids = encode_batch(bodies[low:high], cache)
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(ends), _lists(n), _lists(ids)], list(_ELEMENT))

    rows = long.mapInArrow(spread, f"key long, id {kind}, at int, body string").repartition("key", "at")
    return rows.mapInArrow(encoded, f"key long, id {kind}, at int, body string, ends array<int>, n array<int>, ids array<int>")


def _joiner(path: str):
    def run(pair: pa.Table) -> pa.Table:
        pair = pair.sort_by("at")
        key, id_, at, body, *_ = (pair.column(c).to_pylist() for c in _ELEMENT)
        ends, n, ids = ([np.asarray(x, np.int64) for x in pair.column(c).to_pylist()] for c in ("ends", "n", "ids"))
        if len(at) == 2:
            seam, text = len(body[0]), body[0] + body[1]
            keep, fresh, gone = join_cuts(text, ends[0], seam, ends[1] + seam)
            begin = int(ends[0][keep - 1]) if keep else 0
            cache = rank_cache(path)
            window = X.Pieces([text[begin : int(fresh[-1]) if len(fresh) else begin]], cuts=False)
            window.end = fresh - begin
            window.start = np.concatenate([[0], window.end[:-1]])[: len(fresh)]
            found, m = cache.find(window)
            new = cache.ids(found, m)
            ids = [np.concatenate([ids[0][: int(n[0][:keep].sum())], new, ids[1][int(n[1][:gone].sum()) :]])]
            ends = [np.concatenate([ends[0][:keep], fresh, ends[1][gone:] + seam])]
            n = [np.concatenate([n[0][:keep], m, n[1][gone:]])]
            body = [text]
        return pa.table([pa.array(key[:1]), pa.array(id_[:1], pair.schema.field("id").type),
                         pa.array([at[0] // 2], pa.int32()), pa.array(body[:1]), _lists(ends), _lists(n), _lists(ids)],
                        names=list(_ELEMENT))

    return run


@functools.cache
def _bytes_of_ids(path: str) -> list[bytes]:
    encoding = X.rank_encoding(path)
    table = [b""] * encoding.n_vocab
    for token in encoding.token_byte_values():
        table[encoding.encode_single_token(token)] = token
    return table


class Decoder:
    """Bytes of ids, concatenated up a tree of halves."""

    def __init__(self, path: str, leaf: int = 1 << 16):
        self.table, self.leaf = _bytes_of_ids(path), leaf

    def text(self, ids: list[int]) -> bytes:
        if len(ids) > self.leaf:
            half = len(ids) // 2
            return self.text(ids[:half]) + self.text(ids[half:])
        return b"".join(map(self.table.__getitem__, ids))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary) to the rows; a null array decodes to no bytes. An existing ``decoded`` is replaced."""

    def run(ids: pa.Array) -> pa.Array:
        decoder = Decoder(path)
        return pa.array([decoder.text(own) if own else b"" for own in ids.to_pylist()], pa.binary())

    run.__annotations__ = {"ids": pa.Array, "return": pa.Array}
    return encoded.withColumn("decoded", F.arrow_udf(run, "binary")(F.col(ids_col)))
