"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

Sketch: every element is thrown into one of ``size`` bins per round, and a bin
keeps the least (round, hash) it saw; rounds go on until all bins are filled,
and from round ``size`` on round k fills bin k for certain. Coordinates of two
sketches agree with the probability of the sets' similarity, concentrated as if
drawn independently, in O(size log size + set) steps.

Texts with equal sets are one node from the start, so copies cost one row each.
Nodes that share a band are candidates, settled on full sets as ``linking``
says; inside a task rare shingles come first. No candidate is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import text_of
from timberline.llm.linking import Roots, bucket_links
from timberline.llm.words import WordHashes, mixed, shingles
from timberline.operators.components import connected_components
from timberline.session import cut

BANDS, ROWS = 24, 4
WIDTH = 5
SIMILAR = 80  # per cent
BLOCK = 1024
_ROUND = np.uint64(48)


def sketches(sets: list[np.ndarray], size: int = BANDS * ROWS) -> np.ndarray:
    """One row of ``size`` values per non-empty set; rounds run for all sets that still have empty bins."""
    out = np.full((len(sets), size), np.uint64(0xFFFFFFFFFFFFFFFF))
    live = np.array([k for k, s in enumerate(sets) if len(s)], np.int64)
    for k in range(2 * size):
        if not len(live):
            break
        lengths = np.fromiter((len(sets[i]) for i in live), np.int64, len(live))
        row = np.repeat(live, lengths)
        h = mixed(np.concatenate([sets[i] for i in live]) + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        place = (h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32) if k < size else np.uint64(k - size)
        value = (h & np.uint64((1 << 32) - 1)) | (np.uint64(k) << _ROUND)
        np.minimum.at(out, (row, np.broadcast_to(place, h.shape).astype(np.int64)), value)
        live = live[(out[live] == np.uint64(0xFFFFFFFFFFFFFFFF)).any(1)]
    return out


def band_keys(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key per band of every sketch; bands do not meet one another."""
    parts = sketch.reshape(len(sketch), bands, -1)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(parts.shape[2]):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int = SIMILAR) -> bool:
    """100 * intersection >= percent * union, of sorted distinct values."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def links(sets: list[np.ndarray], root: list[int], left: list[bool], percent: int = SIMILAR) -> list[tuple[int, int]]:
    """Links (positions) that join different roots, enough to connect all that are linked.

    A pair counts if one is ``left`` and the other not, or if all are. Rare shingles come first: similar sets
    share one of the first n - ceil(percent / 100 * n) + 1.
    """
    roots = Roots(root)
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.argsort(np.argsort(times, kind="stable"))
    alone = all(left)
    index: dict[int, list[int]] = {}
    out = []
    for x, own in enumerate(np.split(code, np.cumsum([len(s) for s in sets])[:-1])):
        n = len(own)
        first = own[np.argsort(rank[own])][: n - -(-percent * n // 100) + 1]
        keys = first[times[first] > 1].tolist()
        for y in sorted({y for key in keys for y in index.get(key, ())}):
            if (alone or left[x] != left[y]) and roots.find(x) != roots.find(y) and similar(sets[x], sets[y], percent):
                out.append((x, y))
                roots.join(x, y)
        for key in keys:
            index.setdefault(key, []).append(x)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                    percent: int = SIMILAR) -> DataFrame:
    """``(id, text_md5, n_shingles, group, component_id)`` per row.

    ``component_id`` is the smallest id reached by links, itself included; ``group`` names the group (null for
    texts without words, which link with nothing and keep their own id). Null ids never win: a row without id
    takes the smallest id of its group, or null where there is none. Repeated rows are one text, each with its
    row; other columns are ignored, whatever their names; an empty table gives an empty result. The function runs
    jobs while the plan is made.
    """
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    base = base.select("id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "text")
    kind = base.schema["id"].dataType.simpleString()

    def sign(batches):
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(t, width, hashes) for t in batch.column("text").to_pylist()]
            keys = band_keys(sketches(sets)) if sets else np.zeros((0, BANDS), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_md5"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                 pa.array([k.tolist() if len(s) else None for k, s in zip(keys, sets, strict=True)], pa.list_(pa.int64()))],
                ["id", "text_md5", "n_shingles", "print", "bands"])

    signed = cut(base.mapInArrow(sign, f"id {kind}, text_md5 string, n_shingles long, print binary, bands array<long>"), "sketches")
    nodes = signed.filter("print IS NOT NULL").groupBy("print").agg(
        F.min("id").alias("least"), F.min(F.struct("text_md5", "id")).alias("rep"), F.first("bands").alias("bands"),
        F.count(F.lit(1)).alias("copies"))
    nodes = cut(nodes.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")
    edges = _linked(nodes, base, width, percent)
    roots = connected_components(edges).withColumnRenamed("node", "n")
    placed = nodes.join(roots, nodes["node"] == roots["n"], "left").select(
        "print", "least", "copies", F.coalesce("root", "node").alias("root"), F.col("root").isNotNull().alias("linked"))
    # Only texts that have a copy or a link look their group up; the rest are their own.
    shared = placed.filter("linked OR copies > 1")
    names = shared.groupBy("root").agg(F.min("least").alias("component_id"), F.min(F.hex("print")).alias("group"))
    lookup = cut(shared.join(names, "root").select(F.col("print").alias("p"), "component_id", "group"), "groups")
    out = signed.join(lookup, signed["print"] == lookup["p"], "left")
    return out.select("id", "text_md5", "n_shingles", F.coalesce("group", F.hex("print")).alias("group"),
                      F.when(F.col("p").isNotNull(), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def _linked(nodes: DataFrame, base: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between nodes, enough to connect all that are similar: ``(a, b)``."""

    def full(batches):
        hashes = WordHashes()
        for batch in batches:
            packed = [shingles(t, width, hashes).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(packed, pa.binary())], ["node", "body"])

    def sets(wanted: DataFrame) -> DataFrame:
        wanted = wanted.join(nodes, "node").select("node", F.col("rep.text_md5").alias("md5"), F.col("rep.id").alias("rep_id"))
        texts = base.join(wanted, (base["text_md5"] == wanted["md5"]) & base["id"].eqNullSafe(wanted["rep_id"]))
        return texts.select("node", "text").dropDuplicates(["node"]).mapInArrow(full, "node long, body binary")

    def unpacked(body: bytes) -> np.ndarray:
        return np.frombuffer(body, np.uint64)

    return bucket_links(nodes.select("node", F.explode("bands").alias("bucket")), sets,
                        lambda a, b: similar(unpacked(a), unpacked(b), percent),
                        lambda bodies, root, left: links([unpacked(b) for b in bodies], root, left, percent), BLOCK)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group one row with the smallest id stays.

    Texts without words all stay. Columns are those of ``docs``.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    found = cut(found.select("id", "text_md5", "group", "component_id").filter("group IS NOT NULL"), "near")
    # One row per group: its smallest id and one text of that id.
    winners = found.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_md5")).alias("w"))
    winners = cut(winners.select(F.col("w.id").alias("win_id"), F.col("w.text_md5").alias("win_md5")), "winners")
    text = text_of(text_col)
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), F.md5(text.cast("binary")).alias("md5"),
                       F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]")).alias("worded"))
    kept = rows.filter("worded").join(winners, (rows["md5"] == winners["win_md5"]) & rows["id"].eqNullSafe(winners["win_id"]), "left_semi")
    # Rows repeated with id and text: one of them.
    first = kept.groupBy("md5", "id").agg(F.first("doc").alias("doc")).select("doc.*")
    return first.unionByName(rows.filter("NOT worded").select("doc.*"))
