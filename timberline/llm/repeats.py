"""Periodic runs of words, found by uniting suffixes in the order of falling common prefixes.

A run is a stretch of words with smallest period q that is at least ``least`` words and two periods
long and that no neighbouring word extends. Its first word and the word one period later begin suffixes
with a common prefix of all its words but q, so at least half of ``least`` words. The suffixes of a
batch of texts are sorted by doubling; neighbours in that order are united, longest
common prefix first. Each class keeps its positions in order, the smaller joins the larger, and two
positions that become neighbours at a distance within the prefix are a run's seed: of all seeds of a run
exactly the one at its first word counts, and no smaller period can hide there, because the words
one such period on would already stand between the two.

Only texts in which some stretch of ``least`` / 2 words comes twice are sorted at all.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import text_of

LEAST = 12
RUNS = "array<struct<start:long,length:long,period:long>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Places:
    """An ordered set of positions in blocks, so that a large class takes a new one without moving all others."""

    BLOCK = 512

    def __init__(self, first: int):
        self.blocks, self.tops, self.size = [[first]], [first], 1

    def __iter__(self):
        for block in self.blocks:
            yield from block

    def add(self, p: int) -> tuple[int, int]:
        """Take ``p`` in; its neighbours before and after, -1 for none."""
        k = bisect_left(self.tops, p)
        if k == len(self.tops):
            k -= 1
            self.tops[k] = p
        block = self.blocks[k]
        at = bisect_left(block, p)
        before = block[at - 1] if at else self.tops[k - 1] if k else -1
        after = block[at] if at < len(block) else self.blocks[k + 1][0] if k + 1 < len(self.blocks) else -1
        block.insert(at, p)
        self.size += 1
        if len(block) > self.BLOCK:
            half = len(block) // 2
            self.blocks[k : k + 1] = [block[:half], block[half:]]
            self.tops.insert(k, block[half - 1])
        return before, after


def _repeats_within(codes: np.ndarray, ends: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """Texts in which a window of ``width`` words comes twice, by hashes (a false one costs time only)."""
    if len(codes) < width:
        return np.zeros(0, np.int64)
    h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    n = len(codes) - width + 1
    total = text[:n].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    for k in range(width):
        total += h[k : k + n] * np.uint64(pow(0x94D049BB133111EB, k + 1, 1 << 64))
    whole = np.arange(n) + width <= ends[text[:n]]
    order = np.argsort(total, kind="stable")
    same = (np.diff(total[order]) == 0) & whole[order[1:]] & whole[order[:-1]] & (np.diff(text[order]) == 0)
    return np.unique(text[order[1:][same]])


def suffix_order(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffixes in order, each ending at ``ends`` (by position); doubling of those not yet told apart."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(codes[order]) != 0]))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    slots, h = np.arange(n), 1
    while True:
        # Slots whose neighbour has the same rank are open.
        r = rank[order[slots]]
        alike = (np.diff(r) == 0) & (np.diff(slots) == 1)
        slots = slots[np.concatenate([alike, [False]]) | np.concatenate([[False], alike])]
        if not len(slots):
            return order
        at = order[slots]
        ahead = np.where(at + h < ends[at], rank[np.minimum(at + h, n - 1)], -1)
        own = rank[at]
        turn = np.lexsort((ahead, own))
        at, own, ahead = at[turn], own[turn], ahead[turn]
        order[slots] = at
        first = np.concatenate([[True], (np.diff(own) != 0) | (np.diff(ahead) != 0)])
        rank[at] = slots[np.flatnonzero(first)][np.cumsum(first) - 1]
        h *= 2


def common_prefixes(codes: list[int], ends: list[int], order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix in order with the one before it (Kasai's scan)."""
    n = len(codes)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out, h = [0] * n, 0
    for i, j in enumerate(before.tolist()):
        if j < 0 or ends[i] != ends[j]:
            h = 0
            continue
        most = min(ends[i] - i, ends[j] - j)
        while h < most and codes[i + h] == codes[j + h]:
            h += 1
        out[i] = h
        if h:
            h -= 1
    return np.array(out, np.int64)[order]


def runs_of(codes: np.ndarray, ends: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of several texts laid end to end; ``ends`` is by position."""
    if not len(codes):
        return []
    text = np.concatenate([[0], np.cumsum(np.diff(ends) != 0)])
    order = suffix_order(text * (int(codes.max()) + 1) + codes, ends)
    words, stops = codes.tolist(), ends.tolist()
    prefix = common_prefixes(words, stops, order)
    links = np.flatnonzero(prefix >= -(-least // 2))
    links = links[np.argsort(-prefix[links], kind="stable")]
    parent: dict[int, int] = {}
    places: dict[int, Places] = {}

    def find(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top and x != top:
            parent[x] = top
            x = up
        return top

    found = set()
    for x, y, common in zip(order[links - 1].tolist(), order[links].tolist(), prefix[links].tolist(), strict=True):
        x, y = find(x), find(y)
        one, two = places.pop(x, None) or Places(x), places.pop(y, None) or Places(y)
        if one.size < two.size:
            x, y, one, two = y, x, two, one
        parent[y] = x
        places[x] = one
        moving = list(two)
        for gone, p, coming in zip([-1, *moving[:-1]], moving, [*moving[1:], len(words)], strict=True):
            before, after = one.add(p)
            # Neighbours of the other class only, and only if the next to come does not part them.
            for i, j in ((before if before != gone else -1, p), (p, after if after < coming else -1)):
                period = j - i
                if i >= 0 and 0 < period <= common and common + period >= least:
                    if i == 0 or stops[i - 1] != stops[i] or words[i - 1] != words[j - 1]:
                        found.add((i, common + period, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def text_runs(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """Runs of each text (a list of words), by start, then period."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.fromiter((number[w] for t in texts for w in t), np.int64, int(sizes.sum()))
    last = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    open_ = _repeats_within(codes, last, text, -(-least // 2))
    if len(open_):
        begin, size = (last - sizes)[open_], sizes[open_]
        low = np.cumsum(size) - size
        picked = np.repeat(begin - low, size) + np.arange(int(size.sum()))
        for start, length, period in runs_of(codes[picked], np.repeat(low + size, size), least):
            k = int(np.searchsorted(low, start, "right")) - 1
            out[open_[k]].append((start - int(low[k]), length, period))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by blanks."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``(id, n_words, runs, collapsed)`` per row: all runs by start, then period, with starts as word numbers from 0,
    and the text without what runs repeat, its words joined by blanks.

    Words are stretches of anything but ASCII white space. A null or empty text has no words and no runs and
    collapses to the empty string; null ids and repeated rows stay; extra columns may have any names; an empty table
    gives an empty result. A text is held by one task, at some 400 bytes a word where it repeats.
    """

    def run(batches):
        for batch in batches:
            texts = [t.split() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            runs = text_runs(texts, least)
            short = pa.array([collapsed(t, r) for t, r in zip(texts, runs, strict=True)], pa.binary())
            rows = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
            yield pa.record_batch([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(rows, _RUNS), short],
                                  names=["id", "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    found = rows.mapInArrow(run, f"id {kind}, n_words long, runs {RUNS}, collapsed binary")
    return found.select("id", "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))
