"""Line dedup: an edit-distance join of all lines by segments.

Two lines are alike within ``edits_of`` edits (by the shorter one): 1 from
``MIN_CHARS`` characters on, 2 from ``TWO_EDITS`` on. Of tau + 1 disjoint segments
of the shorter line one must stand in the longer line unchanged, at a place the
edits before and after it allow; lengths are taken in steps of 8, so a line needs
few probes: its own segments (index and probe at once), its segments shifted by
what edits can shift them, and, near a step's low end, probes for the step below.
Lines that share a key are checked exactly: common ends are cut off, and a banded
bit-parallel edit distance runs on the rest.

Equal lines are one node from the start. Of each class (components of links) the
first line in order of document id, text hash and position stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import text_of
from timberline.llm.linking import Roots, bucket_links
from timberline.operators.components import connected_components
from timberline.session import cut

MIN_CHARS = 20
TWO_EDITS = 40
STEP = 8
BLOCK = 1024


# --- edit distance ----------------------------------------------------------------------------------------------


def edits_of(length: int) -> int:
    return 0 if length < MIN_CHARS else 1 if length < TWO_EDITS else 2


def _common(a: str, b: str) -> int:
    """Length of the common beginning, by comparing ever larger and then ever smaller stretches."""
    most, low, step = min(len(a), len(b)), 0, 32
    while low < most and a[low : low + step] == b[low : low + step]:
        low, step = min(low + step, most), step * 2
    while step > 1 and low < most:
        step //= 2
        if a[low : low + step] == b[low : low + step]:
            low = min(low + step, most)
    return low


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most ``most`` (up to 31)."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return False
    low = _common(a, b)
    a, b = a[low:], b[low:]
    high = _common(a[::-1], b[::-1])
    a, b = a[: len(a) - high], b[: len(b) - high]
    if not a or len(b) <= most:
        return len(b) <= most
    return _banded(b, a, most) <= most


_WORD = (1 << 64) - 1
_TOP = 1 << 63


def _banded(a: str, b: str, most: int) -> int:
    """Edit distance of ``a`` and the shorter ``b`` in a 64-bit band along the diagonal, or ``most`` + 1.

    The top bit walks down the band's lowest diagonal, row column + most, until it meets the last row of ``a``;
    from there the score is followed along that row. A letter's mask holds its rows inside the band only, as of the
    column that last used it.
    """
    rows: dict[str, int] = {}
    seen: dict[str, int] = {}
    for k, c in enumerate(a[:most]):
        rows[c] = rows.get(c, 0) | 1 << (63 - most + k)
        seen[c] = 0
    up, down, score = (_WORD << (63 - most)) & _WORD, 0, most
    limit = most + (len(b) - (len(a) - most))  # what the last row can still take back
    mask = 1 << 62
    for k, c in enumerate(b):
        if k + most < len(a):
            x = a[k + most]
            rows[x] = rows.get(x, 0) >> (k - seen.get(x, k)) | _TOP
            seen[x] = k
        match = rows.get(c, 0) >> (k - seen.get(c, k))
        diagonal = ((((match & up) + up) & _WORD) ^ up) | match | down
        plus = (down | ~(diagonal | up)) & _WORD
        minus = diagonal & up
        if k < len(a) - most:
            score += not diagonal >> 63
            if score > limit:
                return most + 1
        else:
            score += bool(plus & mask) - bool(minus & mask)
            mask >>= 1
        half = diagonal >> 1
        up = (minus | ~(half | plus)) & _WORD
        down = half & plus
    return score


def alike(a: bytes, b: bytes) -> bool:
    x, y = a.decode(), b.decode()
    return within(x, y, edits_of(min(len(x), len(y))))


def _pair_counts(texts: list[str]) -> np.ndarray:
    """Hashed counts of letter pairs; an edit changes two pairs, so lines far apart here need no closer look."""
    counts = np.zeros((len(texts), 64), np.int32)
    for k, t in enumerate(texts):
        codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        counts[k] = np.bincount((codes[:-1] * 31 + codes[1:]) % 61, minlength=64)
    return counts


def settle(bodies: list[bytes], root: list[int], left: list[bool]) -> list[tuple[int, int]]:
    """Links between lines of different roots; counts of hashed letter pairs rule most pairs out at once."""
    texts = [b.decode() for b in bodies]
    size, counts = np.array([len(t) for t in texts]), _pair_counts(texts)
    roots, side, alone, out = Roots(root), np.array(left), all(left), []
    for x in range(1, len(texts)):
        near = (np.abs(size[:x] - size[x]) <= 2) & (np.abs(counts[:x] - counts[x]).sum(1) <= 8)
        if not alone:
            near &= side[:x] != side[x]
        for y in np.flatnonzero(near).tolist():
            if roots.find(x) != roots.find(y) and within(texts[x], texts[y], edits_of(min(len(texts[x]), len(texts[y])))):
                out.append((x, y))
                roots.join(x, y)
    return out


def degrees(texts: list[str], copies: np.ndarray, own: np.ndarray, i: int, j: int) -> np.ndarray:
    """Copies of the lines that each line is alike with, among the pairs of block ``i`` with block ``j``."""
    size, counts, total = np.array([len(t) for t in texts]), _pair_counts(texts), np.zeros(len(texts), np.int64)
    right = np.flatnonzero(own == j)
    for x in np.flatnonzero(own == i).tolist():
        other = right[right > x] if i == j else right
        near = other[(np.abs(size[other] - size[x]) <= 2)]
        near = near[np.abs(counts[near] - counts[x]).sum(1) <= 8]
        for y in near.tolist():
            if within(texts[x], texts[y], edits_of(min(len(texts[x]), len(texts[y])))):
                total[x] += copies[y]
                total[y] += copies[x]
    return total


# --- keys -------------------------------------------------------------------------------------------------------


def line_keys(line: Column, n: Column) -> list[Column]:
    """Keys under which a line meets all lines that may be alike: 3 to 13 numbers, null where there is none."""
    low = n - n % STEP
    past = n % STEP

    def key(step: Column, segment: int, parts: int, shift: int) -> Column:
        size = F.floor(step / parts).cast("int")
        begin = size * (segment - 1) + shift + 1
        return F.xxhash64(step, F.lit(segment), F.substr(line, begin.cast("int"), size))

    def keys(when: Column, step: Column, parts: int, shifts: dict[int, tuple[int, ...]]) -> list[Column]:
        return [F.when(when, key(step, i, parts, s)) for i, own in shifts.items() for s in own]

    # By segment, the shifts that edits before (i - 1 at most) and the difference of lengths allow together.
    two, one, under = n >= TWO_EDITS, n < TWO_EDITS, low - STEP
    own = keys(two, low, 3, {1: (0,), 2: (0, -1, 1), 3: (0, 1, 2)}), keys(one, low, 2, {1: (0,), 2: (0, 1)})
    # Lines near a step's low end look up lines of the step below, which may be of one edit only.
    below = (
        keys((under >= TWO_EDITS) & (past == 0), under, 3, {1: (0,), 2: (0, 1), 3: (1, 2)}),
        keys((under >= TWO_EDITS) & (past == 1), under, 3, {1: (0,), 2: (1,), 3: (2,)}),
        keys((under < TWO_EDITS) & (n > MIN_CHARS) & (past == 0), under, 2, {1: (0,), 2: (1,)}),
    )
    # Alternatives exclude each other, so they share places.
    return [*_merge(own), *_merge(below)]


def _merge(alternatives) -> list[Column]:
    longest = max(map(len, alternatives))
    return [F.coalesce(*(a[k] for a in alternatives if k < len(a))) for k in range(longest)]


# --- over tables ------------------------------------------------------------------------------------------------


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines that count: ``(id, doc_print, at, line, h1, h2)``, equal lines having equal ``h1`` and ``h2``."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("doc_print"), text.alias("text"))
    rows = rows.select("id", "doc_print", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    rows = rows.filter((F.length("line") >= MIN_CHARS) & (F.btrim("line", F.lit(" \t\n\x0b\x0c\r")) != ""))
    return rows.select("*", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, doc_print, at, first, n_links)`` of every line that has a copy or an alike line: where its class begins,
    and how many other lines it is linked with directly, copies included.

    A class is what links connect. ``first`` is a struct like ``(id, doc_print, at)``; null ids come first in the
    order. Runs jobs while the plan is made. Distinct lines are counted on columns of fixed width; texts are fetched of
    lines that share a key only, and links counted inside the classes, block by block.
    """
    lines = _lines(docs, id_col, text_col)
    keys = [k.alias(f"k{i}") for i, k in enumerate(line_keys(F.col("line"), F.col("n")))]
    names = [f"k{i}" for i in range(len(keys))]
    found = lines.select("h1", "h2", "line", F.length("line").alias("n")).select("h1", "h2", *keys)
    found = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), *(F.first(k).alias(k) for k in names))
    nodes = cut(found.select(F.monotonically_increasing_id().alias("node"), "*"), "lines")
    held: dict[str, DataFrame] = {}

    def bodies(wanted: DataFrame) -> DataFrame:
        """Texts of the wanted nodes; all places of those and of repeated lines are kept on the way."""
        marked = nodes.select("node", "h1", "h2", "copies").join(wanted.withColumn("asked", F.lit(True)), "node", "left")
        marked = marked.filter("asked OR copies > 1").select("node", "h1", "h2", "asked")
        held["places"] = cut(lines.join(marked, ["h1", "h2"]).select("node", "id", "doc_print", "at", F.col("line").cast("binary").alias("line"), "asked"), "places")
        return held["places"].filter("asked").select("node", F.col("line").alias("body")).dropDuplicates(["node"])

    edges = bucket_links(nodes.select("node", F.explode(F.array_compact(F.array(*names))).alias("bucket")), bodies, alike, settle, BLOCK)
    roots = cut(connected_components(edges), "roots")
    placed = nodes.select("node", "copies").join(roots, "node", "left").filter("root IS NOT NULL OR copies > 1")
    linked = _degrees(held["places"], roots, nodes)
    placed = placed.join(linked, "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # Written first, so that the places of a line with very many copies are a join of their own, which is split.
    at = cut(held["places"].drop("line", "asked").join(cut(placed, "class-nodes"), "node"), "placed")
    heads = at.groupBy("root").agg(F.min(F.struct("id", "doc_print", "at")).alias("first"))
    return cut(at.join(heads, "root").select("id", "doc_print", "at", "first", "n_links"), "classes")


def _degrees(places: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, others)``: lines alike but not equal, copies counted. A task compares two blocks of a class."""
    texts = places.join(roots, "node").select("root", "node", "line").dropDuplicates(["node"])
    texts = cut(texts.join(nodes.select("node", "copies"), "node"), "class-lines")
    blocks = roots.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    spread = texts.join(blocks, "root").select(
        "root", "node", "line", "copies", F.pmod(F.hash("node"), F.col("blocks")).alias("own"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = spread.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "line", "copies", "own")

    def count(table: pa.Table) -> pa.Table:
        node, copies, own, i, j = (table.column(c).to_numpy() for c in ("node", "copies", "own", "i", "j"))
        total = degrees([b.decode() for b in table.column("line").to_pylist()], copies, own, i[0], j[0])
        return pa.table({"node": pa.array(node), "n": pa.array(total)})

    return tasks.groupBy("root", "i", "j").applyInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("others"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, text, n_lines, n_dropped, classes)`` per row: the row as a struct, its text without lines that come
    earlier in the corpus (equal or alike), and of every line with a copy or an alike line its number, the document
    and line where its class begins, and its number of links (see ``line_classes``).

    Lines under ``MIN_CHARS`` characters or without a word stay, equal ones too: they repeat by chance ("Yes."). A null
    text stays null. Rows repeated with id and text are one document and get the same result; extra columns may have any
    names; an empty table gives an empty result.
    """
    here = F.struct("id", "doc_print", "at")
    classes = line_classes(docs, id_col, text_col).withColumn("drop", ~here.eqNullSafe(F.col("first")))
    line = F.struct(F.col("at").alias("line"), F.col("first.id").alias("class_doc"), F.col("first.at").alias("class_line"), "n_links")
    own = classes.groupBy(F.col("id").alias("own_id"), F.col("doc_print").alias("own_print")).agg(
        F.collect_set(F.when(F.col("drop"), F.col("at"))).alias("drops"), F.array_sort(F.collect_set(line)).alias("classes"))
    text = text_of(text_col)
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("i"), F.unhex(F.md5(text.cast("binary"))).alias("p"))
    joined = rows.join(own, (rows["p"] == own["own_print"]) & rows["i"].eqNullSafe(own["own_id"]), "left")
    before = F.col("doc").getField(text_col).cast("string")
    joined = joined.select("doc", before.alias("before"), F.split(before, "\n").alias("parts"), "drops", "classes")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("drops")), lambda at: F.get("parts", at))
    dropped = F.coalesce(F.size("drops"), F.lit(0))
    none = F.array().cast(own.schema["classes"].dataType)
    return joined.select("doc", F.when(dropped == 0, F.col("before")).otherwise(F.array_join(kept, "\n")).alias("text"),
                         F.coalesce(F.size("parts"), F.lit(0)).cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"),
                         F.coalesce("classes", none).alias("classes"))


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with their shortened texts and the same columns; rows of which no word is left go."""
    out = dedup_lines(docs, id_col, text_col)
    out = out.filter((F.col("n_dropped") == 0) | F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")))
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns))
