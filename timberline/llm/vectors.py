"""Near-duplicate vectors: sorted projection passes.

Every pass gives a vector a key of concatenated random hashes (signs of random
projections), orders all vectors of a label by it, and compares each with its
``window`` next neighbours. Close vectors share long prefixes and so stand close
in some pass; pairs with a verified cosine are united across passes. Blocks put out
only links that join something new inside them. An exact step follows: inside each
component all pairs are compared in blocks and counted, not put out, so the number
of links does not depend on how many neighbours a window holds.

Equal vectors of a label are one row from the start, so copies neither fill
windows nor make pairs. The order is one range sort of (label, pass, key); ranks
come from counts per range, and neighbourhoods are blocks of ``BLOCK`` ranks plus
the next ``window`` rows as guests, so a label of any size is many small tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import part_offsets
from timberline.llm.linking import Roots
from timberline.operators.components import connected_components
from timberline.session import cut, new_path

PASSES = 24
BITS = 48
WINDOW = 48
BLOCK = 1024
COSINE = 0.98
SEED = 20_240_613


def _matrix(column) -> np.ndarray:
    """A list column as rows, padded with zeros to one width (which changes no product)."""
    lists = column.to_pylist()
    width = max(map(len, lists), default=0)
    out = np.zeros((len(lists), width))
    for k, own in enumerate(lists):
        out[k, : len(own)] = own
    return out


def pass_keys(rows: np.ndarray, which: int, bits: int = BITS) -> np.ndarray:
    """Keys of one pass, as numbers whose order is the lexicographic order of their bits."""
    plane = np.random.default_rng((SEED, which)).standard_normal((bits, rows.shape[1])) if rows.shape[1] else np.zeros((bits, 0))
    signs = rows @ plane.T >= 0
    return (signs.astype(np.int64) << np.arange(bits - 1, -1, -1, dtype=np.int64)).sum(1)


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    return (a @ b) / np.sqrt((a @ a) * (b @ b))


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(1))[:, None]


def cosine_links(rows: np.ndarray, own: np.ndarray, window: int, least: float) -> list[tuple[int, int]]:
    """Positions of pairs at most ``window`` apart with cosine >= least, the first an own row; enough to join all such."""
    unit, roots, out = _unit(rows), Roots(list(range(len(rows)))), []
    for step in range(1, min(window, len(rows) - 1) + 1):
        close = ((unit[:-step] * unit[step:]).sum(1) >= least - 1e-9) & own[:-step]
        for k in np.flatnonzero(close).tolist():
            if roots.find(k) != roots.find(k + step) and _cosine(rows[k], rows[k + step]) >= least:
                out.append((k, k + step))
                roots.join(k, k + step)
    return out


def linked_matrix(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which rows of ``a`` and ``b`` have cosine >= least; products near the limit are taken again one by one."""
    product = _unit(a) @ _unit(b).T
    linked = product >= least
    for x, y in zip(*np.nonzero(np.abs(product - least) < 1e-9), strict=True):
        linked[x, y] = _cosine(a[x], b[y]) >= least
    return linked


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 least: float = COSINE, passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """``(id, n_links, component_id)`` per row, over pairs of equal, non-null label with cosine >= ``least`` whose
    components were found.

    Null, zero and empty vectors, those with null or non-finite components, and rows without label link with
    nothing: 0 links, their own id. Vectors of different lengths compare as if padded with zeros. Equal vectors
    are linked with each other. Ids may repeat; a null id never is a component's smallest unless all are null.
    Other columns are ignored. The function runs jobs while the plan is made.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"),
                          F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("vec", lambda x: x != 0), F.lit(False))
    # Both signs of zero are one number; equal vectors must be equal bytes.
    rows = rows.withColumn("vec", F.when(valid, F.transform("vec", lambda x: F.when(x == 0, 0.0).otherwise(x))))
    nodes = rows.filter("vec IS NOT NULL").groupBy("label", "vec").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    at = new_path(spark, "vectors")
    nodes.select(F.monotonically_increasing_id().alias("node"), "*").write.parquet(at)
    nodes = spark.read.parquet(at)
    links = _links(nodes, least, passes, window)

    roots = cut(connected_components(links), "roots")
    degree = _degrees(nodes, roots, least)
    placed = (nodes.join(degree, nodes["node"] == degree["a"], "left").drop("a")
              .join(roots.withColumnRenamed("node", "r"), F.col("node") == F.col("r"), "left")
              .select("label", "vec", "least", "copies", F.coalesce("others", F.lit(0)).alias("others"),
                      F.coalesce("root", "node").alias("root")))
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = placed.join(names, "root").select(F.col("label").alias("l"), F.col("vec").alias("v"), "component_id",
                                               (F.col("copies") - 1 + F.col("others")).alias("n_links"))
    out = rows.join(placed, (rows["label"] == placed["l"]) & (rows["vec"] == placed["v"]), "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.when(F.col("v").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def _degrees(nodes: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """``(a, others)``: rows linked with node ``a``, copies of others included. A task compares two blocks of a component."""
    placed = nodes.select("node", "vec", "copies").join(roots, "node")
    blocks = roots.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    spread = placed.join(blocks, "root").select(
        "root", "node", "vec", "copies", F.pmod(F.hash("node"), F.col("blocks")).alias("own"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = spread.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "vec", "copies", "own")

    def count(table: pa.Table) -> pa.Table:
        node, copies, own, i, j = (table.column(c).to_numpy() for c in ("node", "copies", "own", "i", "j"))
        rows, total = _matrix(table.column("vec").combine_chunks()), np.zeros(len(node), np.int64)
        left, right = np.flatnonzero(own == i[0]), np.flatnonzero(own == j[0])
        linked = linked_matrix(rows[left], rows[right], least)
        if i[0] == j[0]:
            np.fill_diagonal(linked, False)
        else:
            total[right] += linked.T @ copies[left]
        total[left] += linked @ copies[right]
        return pa.table({"a": pa.array(node), "n": pa.array(total)})

    return tasks.groupBy("root", "i", "j").applyInArrow(count, "a long, n long").groupBy("a").agg(F.sum("n").alias("others"))


def _links(nodes: DataFrame, least: float, passes: int, window: int) -> DataFrame:
    """Written ``(a, b)``, a < b: links that joined something in their block."""
    spark = nodes.sparkSession
    kind = nodes.schema["label"].dataType.simpleString()
    row = f"label {kind}, pass int, sort_key long, node long, vec array<double>"

    def project(batches):
        for batch in batches:
            found = _matrix(batch.column("vec"))
            for which in range(passes):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label"), pa.array([which] * batch.num_rows, pa.int32()), pa.array(pass_keys(found, which)),
                     batch.column("node"), batch.column("vec")], ["label", "pass", "sort_key", "node", "vec"])

    keyed = nodes.select("label", "node", "vec").mapInArrow(project, row)
    keyed = keyed.repartitionByRange("label", "pass", "sort_key", "node").sortWithinPartitions("label", "pass", "sort_key", "node")
    keyed = keyed.select(F.spark_partition_id().alias("part"), "*")

    def number(batches):
        place = 0
        for batch in batches:
            yield batch.append_column("place", pa.array(np.arange(place, place + batch.num_rows)))
            place += batch.num_rows

    at = new_path(spark, "passes")
    keyed.mapInArrow(number, f"part int, {row}, place long").write.parquet(at)
    ranked = spark.read.parquet(at)
    before = part_offsets(ranked, "part", F.lit(1))
    ranked = ranked.join(before, "part").withColumn("rank", F.col("before") + F.col("place"))
    home = F.expr(f"rank div {BLOCK}")
    guest = F.when((F.col("rank") % BLOCK < window) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))
    blocks = ranked.select(F.explode(guest).alias("block"), "label", "pass", "rank", "node", "vec")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        rank, node = table.column("rank").to_numpy(), table.column("node").to_numpy()
        own = rank // BLOCK == table.column("block").to_numpy()
        place = list(zip(table.column("label").to_pylist(), table.column("pass").to_pylist(), strict=True))
        found, low = [], 0
        vectors = _matrix(table.column("vec").combine_chunks())
        for high in range(1, len(place) + 1):
            if high == len(place) or place[high] != place[low]:
                found += [(node[low + x], node[low + y]) for x, y in cosine_links(vectors[low:high], own[low:high], window, least)]
                low = high
        pairs = sorted({(int(min(p)), int(max(p))) for p in found})
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    at = new_path(spark, "links")
    blocks.groupBy("block").applyInArrow(compare, "a long, b long").distinct().write.parquet(at)
    return spark.read.parquet(at)
