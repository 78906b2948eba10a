"""Template mining over distinct masked texts.

A masked text is one row however often it occurs, so hot templates carry no
weight here. Routing narrows texts to leaves; clustering runs per leaf.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from timberline.functions import masking as M
from timberline.functions import patterns as P
from timberline.operators.ordering import block_of, with_offsets
from timberline.session import cut

SIMILARITY = 0.5
MAX_CHILDREN = 100


def masked_texts(events: DataFrame) -> DataFrame:
    """Distinct masked texts with first id and size."""
    return (
        events.filter(F.col("template") != P.EMPTY_TEMPLATE)
        .groupBy("dataset", "template")
        .agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .withColumn("tokens", F.split("template", " "))
        .withColumn("n_tokens", F.size("tokens"))
    )


def _route(texts: DataFrame, keys: list[str], position: int, name: str, max_children: int, known: DataFrame | None = None) -> DataFrame:
    """Child taken at one layer: the token itself while it is among the first
    ``max_children`` distinct tokens of its node, else the wildcard.

    ``known(*keys, token)`` are children that the nodes have already.
    """
    token = F.try_element_at("tokens", F.lit(position))
    texts = texts.withColumn("_tok", F.when(M.is_mark(token), P.WILDCARD).otherwise(token))
    children = texts.filter(F.col("_tok").isNotNull()).groupBy(*keys, "_tok").agg(F.min("first_id").alias("_first"))
    taken = F.lit(0)
    if known is not None:
        old = known.select(*keys, F.col("token").alias("_tok"), F.lit(True).alias("_admitted"))
        children = children.join(old.drop("_admitted"), [*keys, "_tok"], "left_anti")
        children = children.join(known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_taken")), keys, "left")
        taken = F.coalesce("_taken", F.lit(0))
    # A node's first tokens are among the first of each part of its tokens: no window holds a whole large node.
    order = (F.col("_first"), F.col("_tok"))
    part = F.pmod(F.xxhash64("_tok"), F.lit(64))
    children = children.withColumn("_part", part).withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
    children = children.filter(F.col("_rank") <= max_children)
    admitted = (
        children.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) + taken)
        .filter(F.col("_rank") <= max_children)
        .select(*keys, "_tok", F.lit(True).alias("_admitted"))
    )
    if known is not None:
        admitted = admitted.unionByName(old)
    return (
        texts.join(admitted, [*keys, "_tok"], "left")
        .withColumn(
            name,
            F.when(F.col("_tok").isNull(), "")
            .when(F.col("_admitted"), F.col("_tok"))
            .otherwise(P.WILDCARD),
        )
        .drop("_tok", "_admitted")
    )


CHILDREN = "dataset string, n_tokens int, key1 string, token string"


def template_leaves(texts: DataFrame, max_children: int = MAX_CHILDREN, known: DataFrame | None = None) -> DataFrame:
    """Adds ``key1, key2``: with the token count they name the leaf of a text.

    ``known`` (``CHILDREN``; null ``key1`` in the first layer) are the children of an earlier tree that goes on growing.
    """
    one = two = None
    if known is not None:
        one, two = known.filter("key1 IS NULL").drop("key1"), known.filter("key1 IS NOT NULL")
    df = _route(texts, ["dataset", "n_tokens"], 1, "key1", max_children, one)
    return _route(df, ["dataset", "n_tokens", "key1"], 2, "key2", max_children, two)


def tree_children(leaves: DataFrame) -> DataFrame:
    """The children (``CHILDREN``) of the nodes that routed texts went through.

    A wildcard counts as a child only if a mask made it one; the one that overflow goes to comes on top of the
    limit and cannot lower it, since its node is full by then.
    """

    def child(position: int, key1):
        token = F.try_element_at("tokens", F.lit(position))
        return leaves.filter(token.isNotNull()).select("dataset", "n_tokens", key1.alias("key1"), F.col(f"key{position}").alias("token"))

    return child(1, F.lit(None).cast("string")).unionByName(child(2, F.col("key1"))).distinct()


LEAF = ["dataset", "n_tokens", "key1", "key2"]


def similarity(tokens: Column, template: Column) -> Column:
    """Share of equal positions; wildcard tokens of the first side never count."""
    same = F.zip_with(
        tokens, template, lambda a, b: F.when((a == b) & (a != P.WILDCARD), 1).otherwise(0)
    )
    return F.aggregate(same, F.lit(0), lambda acc, x: acc + x) / F.size(tokens)


def _leaf_positions(base: DataFrame, most_pairs: int = 16) -> DataFrame:
    """Per leaf: ``fixed``, the number of positions at which all its texts have one token that is no wildcard;
    ``varied``, the other positions with more than one token; ``drops``, all sets of up to two of them (one, where more
    than ``most_pairs`` are varied)."""
    tokens = base.select(*LEAF, F.posexplode("tokens").alias("pos", "tok"))
    spread = tokens.groupBy(*LEAF, "pos").agg(F.min("tok").alias("_lo"), F.max("tok").alias("_hi"))
    same = F.col("_lo") == F.col("_hi")
    leaf = spread.groupBy(*LEAF).agg(
        F.count_if(same & (F.col("_lo") != P.WILDCARD)).alias("fixed"),
        F.sort_array(F.collect_list(F.when(~same, F.col("pos")))).alias("varied"),
    )
    v = F.col("varied")
    pairs = F.flatten(F.transform(v, lambda x: F.transform(F.filter(v, lambda y: y > x), lambda y: F.array(x, y))))
    few = F.concat(F.array(F.array().cast("array<int>")), F.transform(v, lambda x: F.array(x)))
    return leaf.withColumn("drops", F.when(F.size(v) <= most_pairs, F.concat(few, pairs)).otherwise(few))


def _nearest_by_drops(base: DataFrame, st: float) -> DataFrame:
    """``dataset, template, first_id, b`` of the texts that differ from an earlier one at two positions at most.

    Texts that agree outside a set of positions form a group, whose earliest member is the partner of all others. The
    smallest set with an earlier member gives the largest similarity, so no text meets all that resemble it.
    """
    texts = base.join(cut(_leaf_positions(base), "leaf-positions"), LEAF)
    marks = F.filter("varied", lambda i: F.element_at("tokens", i + 1) == P.WILDCARD)
    texts = texts.withColumn("_marks", marks).withColumn(
        "drop", F.explode(F.filter("drops", lambda d: F.size(F.array_except(F.col("_marks"), d)) == 0))
    )
    kept = F.array_except("varied", "drop")
    texts = texts.withColumn("similarity", (F.col("fixed") + F.size(kept)) / F.col("n_tokens")).filter(F.col("similarity") >= st)
    texts = texts.withColumn("_rest", F.transform(kept, lambda i: F.element_at("tokens", i + 1)))
    texts = texts.select(*LEAF, "drop", "_rest", "template", "first_id", "similarity")
    group = [*LEAF, "drop", "_rest"]
    early = F.max(F.struct((-F.col("first_id")).alias("_early"), F.col("template").alias("t"))).alias("_e")
    firsts = texts.groupBy(*group).agg(early, F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    found = texts.join(firsts, group).filter(-F.col("_e._early") < F.col("first_id"))
    best = F.struct("similarity", "_e._early", "_e.t")
    return found.groupBy("dataset", "template", "first_id").agg(F.max(best).alias("b"))


def similar_templates(leaves: DataFrame, st: float = SIMILARITY) -> DataFrame:
    """For each text the earlier text of its leaf it resembles most, if any reaches ``st``.

    Texts that differ from an earlier one at two positions at most find it by grouping. For the others: two texts of ``k``
    tokens with at least ``st * k`` equal positions share a
    token among any ``k - ceil(st * k) + 1`` positions. Each text therefore looks
    up partners only through its rarest such (position, token) pairs, instead of
    meeting every text of the leaf. Reaching the threshold is then checked in full.
    """
    base = leaves.select(*LEAF, "template", "tokens", "first_id")
    near = cut(_nearest_by_drops(base, st), "near-templates")
    rest = base.join(near, ["dataset", "template", "first_id"], "left_anti")
    oldest = base.groupBy(*LEAF).agg(F.min("first_id").alias("_oldest"))
    rest = cut(rest.join(oldest, LEAF).filter("first_id > _oldest").drop("_oldest"), "lone-templates")
    lone = rest.select(*LEAF, "template", "first_id", "tokens", F.posexplode("tokens").alias("pos", "tok"))
    lone = lone.filter(F.col("tok") != P.WILDCARD)
    pairs = base.select(
        *LEAF, "template", "first_id", "tokens", F.posexplode("tokens").alias("pos", "tok")
    ).filter(F.col("tok") != P.WILDCARD)
    freq = pairs.groupBy(*LEAF, "pos", "tok").agg(F.count(F.lit(1)).alias("_df"))
    ranked = lone.join(freq, [*LEAF, "pos", "tok"])
    need = F.ceil(F.col("n_tokens") * F.lit(st))
    rarest = Window.partitionBy(*LEAF, "template").orderBy("_df", "pos")
    # At most n_tokens rows per text.
    probes = cut(
        ranked.withColumn("_r", F.row_number().over(rarest))
        .filter(F.col("_r") <= F.col("n_tokens") - need + 1)
        .select(*LEAF, "pos", "tok", "template", "first_id", "tokens"),
        "probes",
    )
    other = pairs.select(
        *LEAF, "pos", "tok", F.col("template").alias("o_template"), F.col("first_id").alias("o_first"),
        F.col("tokens").alias("o_tokens"),
    )
    scored = (
        probes.join(other, [*LEAF, "pos", "tok"])
        .filter(F.col("o_first") < F.col("first_id"))
        .select(
            "dataset", "template", "first_id", "o_template", "o_first",
            similarity(F.col("tokens"), F.col("o_tokens")).alias("similarity"),
        )
        .filter(F.col("similarity") >= st)
    )
    best = F.struct(F.col("similarity"), (-F.col("o_first")).alias("_early"), F.col("o_template").alias("t"))
    far = scored.groupBy("dataset", "template", "first_id").agg(F.max(best).alias("b"))
    return near.unionByName(far).select(
        "dataset", "template", F.col("b.t").alias("nearest"), F.col("b.similarity").alias("similarity")
    )


# --------------------------------------------------------------------------- #
# Clustering
# --------------------------------------------------------------------------- #
class LeafMatcher:
    """Clusters of one leaf as a matrix of token codes; code 0 is the wildcard.

    All texts of a leaf have the same number of tokens, so a text meets all
    clusters in one comparison, and many texts meet them position by position.
    """

    def __init__(self, st: float = SIMILARITY, templates=(), founders=()):
        self.st, self.code, self.word = st, {P.WILDCARD: 0}, [P.WILDCARD]
        self.founders = list(founders)
        self.size = len(self.founders)
        self.grid = self.encode(templates)

    def encode(self, texts) -> np.ndarray:
        rows = [text.split(" ") for text in texts]
        for token in {t for row in rows for t in row} - self.code.keys():
            self.code[token] = len(self.word)
            self.word.append(token)
        return np.array([[self.code[t] for t in row] for row in rows], np.int32).reshape(len(rows), len(rows[0]) if rows else 0)

    @property
    def templates(self) -> list[str]:
        return [" ".join(self.word[c] for c in row) for row in self.grid[: self.size]]

    def settle(self, texts) -> list[int]:
        """Take texts in order; each joins its most similar cluster, or founds one. Returns their clusters."""
        texts, places = list(texts), []
        for text, row in zip(texts, self.encode(texts), strict=True):
            if not self.grid.size:
                self.grid = np.zeros((8, len(row)), np.int32)
            equal = ((self.grid[: self.size] == row) & (row != 0)).sum(1)
            at = int(equal.argmax()) if self.size else -1
            if at >= 0 and equal[at] / len(row) >= self.st:
                self.grid[at] = np.where(self.grid[at] == row, row, 0)
            else:
                at = self.size
                if at == len(self.grid):
                    self.grid = np.concatenate([self.grid, np.zeros_like(self.grid)])
                self.grid[at] = row
                self.founders.append(text)
                self.size += 1
            places.append(at)
        return places

    def probe(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Where each text would go among the clusters as they are (-1: a new one), and whether that would change any."""
        rows, now = self.encode(texts), self.grid[: self.size]
        at, moves = np.full(len(rows), -1), np.ones(len(rows), bool)
        for low in range(0, len(rows), 512):
            part = rows[low : low + 512]
            equal = np.zeros((len(part), self.size), np.int32)
            for k in range(part.shape[1]):
                equal += (part[:, k, None] == now[None, :, k]) & (part[:, k, None] != 0)
            best = equal.argmax(1)
            fits = equal[np.arange(len(part)), best] / part.shape[1] >= self.st
            changed = ((part != now[best]) & (now[best] != 0)).any(1)
            at[low : low + 512] = np.where(fits, best, -1)
            moves[low : low + 512] = ~fits | changed
        return at, moves


_STEP = (
    "dataset string, n_tokens int, key1 string, key2 string, kind string, template string, first_id long, "
    "founder string, seq int"
)


def grow_clusters(leaves: DataFrame, st: float = SIMILARITY, head: int = 20000, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Take texts into clusters in first-id order: ``(texts, state)`` with each text's cluster (``seq`` of its leaf)
    and all clusters of the leaves that ``leaves`` or ``state`` name.

    ``state`` are clusters that earlier texts left. A text joins the most similar earlier cluster of its leaf, which
    turns the differing positions into wildcards, or founds one. The order matters only
    while texts still change clusters, so the work goes in rounds. Per leaf, the
    first open texts (``head`` to twice that) are clustered in order in one small group. All
    other open texts are then matched in parallel, in groups of bounded size,
    and those before the first one that would change anything are settled too.
    The rest goes to the next round. No group holds more than twice ``head`` texts
    (plus the clusters of the leaf), and the outcome equals one pass in order.
    """
    leaves = cut(leaves.select(*LEAF, "template", "first_id"), "leaves")
    open_texts = leaves
    settled: list[DataFrame] = []
    while True:
        ranked = _first_per_leaf(open_texts, head)
        step = cut(_cluster_heads(ranked, state, st), "cluster-step")
        state = step.filter("kind = 'state'")
        settled.append(step.filter("kind = 'text'"))
        done = settled[-1].select("dataset", "template")
        rest = open_texts.join(done, ["dataset", "template"], "left_anti")
        if not rest.take(1):
            break
        rest = cut(rest, "open-texts")
        probed = cut(_probe(rest, state, st, head), "probed")
        stop = probed.filter("moves").groupBy(*LEAF).agg(F.min("first_id").alias("_stop"))
        marked = probed.join(stop, LEAF, "left")
        before = F.col("_stop").isNull() | (F.col("first_id") < F.col("_stop"))
        stable = cut(marked.filter(before), "stable")
        settled.append(
            stable.select(*LEAF, F.lit("text").alias("kind"), "template", "first_id", "founder", "seq")
        )
        open_texts = cut(marked.filter(~before).select(*LEAF, "template", "first_id"), "open-texts")
        if not open_texts.take(1):
            break
    texts = settled[0]
    for more in settled[1:]:
        texts = texts.unionByName(more)
    return texts, state


def cluster_templates(leaves: DataFrame, st: float = SIMILARITY, head: int = 20000) -> DataFrame:
    """Cluster per text in first-id order -> leaf, ``dataset, template, first_id, founder, cluster_template``."""
    texts, state = grow_clusters(leaves, st, head)
    final = state.select(*LEAF, "seq", F.col("template").alias("cluster_template"))
    return texts.join(final, [*LEAF, "seq"]).select(
        *LEAF, "template", "first_id", "founder", "cluster_template"
    )


def _first_per_leaf(texts: DataFrame, head: int) -> DataFrame:
    """The first texts of every leaf: blocks of ids until ``head`` is reached, at most two heads."""
    blocked = texts.withColumn("_block", block_of("first_id", head))
    counts = blocked.groupBy(*LEAF, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = with_offsets(counts, LEAF, ["_block"], "_n", "_before").filter(F.col("_before") < head)
    return blocked.join(before.select(*LEAF, "_block"), [*LEAF, "_block"], "left_semi").drop("_block")


def _cluster_heads(texts: DataFrame, state: DataFrame | None, st: float) -> DataFrame:
    rows = texts.select(
        *LEAF, F.lit("text").alias("kind"), "template", "first_id",
        F.lit(None).cast("string").alias("founder"), F.lit(-1).alias("seq"),
    )
    if state is not None:
        rows = rows.unionByName(state.select(*rows.columns))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        clusters = _load(group, st)
        todo = group[group.kind == "text"].sort_values("first_id").copy()
        todo["seq"] = clusters.settle(todo.template)
        todo["founder"] = [clusters.founders[i] for i in todo.seq]
        return pd.concat([todo, _dump(group, clusters)], ignore_index=True)

    return rows.groupBy(*LEAF).applyInPandas(run, _STEP)


def _probe(texts: DataFrame, state: DataFrame, st: float, head: int) -> DataFrame:
    """Match texts against fixed clusters; groups are (leaf, slice of ids)."""
    part = F.pmod(F.xxhash64("template"), F.lit(1 << 16))
    slices = texts.groupBy(*LEAF).agg(F.ceil(F.count(F.lit(1)) / head).cast("int").alias("_slices"))
    texts = texts.join(slices, LEAF).withColumn("_slice", (part % F.col("_slices")).cast("int")).drop("_slices")
    spread = state.join(slices, LEAF).withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))
    ).drop("_slices")
    rows = texts.select(
        *LEAF, "_slice", F.lit("text").alias("kind"), "template", "first_id",
        F.lit(None).cast("string").alias("founder"), F.lit(-1).alias("seq"),
    ).unionByName(spread.select(*LEAF, "_slice", "kind", "template", "first_id", "founder", "seq"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        clusters = _load(group, st)
        todo = group[group.kind == "text"].copy()
        todo["seq"], todo["moves"] = clusters.probe(todo.template)
        todo["founder"] = [clusters.founders[at] if at >= 0 else None for at in todo.seq]
        return todo.drop(columns=["_slice"])

    return rows.groupBy(*LEAF, "_slice").applyInPandas(run, _STEP + ", moves boolean")


def _load(group: pd.DataFrame, st: float) -> LeafMatcher:
    state = group[group.kind == "state"].sort_values("seq")
    return LeafMatcher(st, state.template, state.founder)


def _dump(group: pd.DataFrame, clusters: LeafMatcher) -> pd.DataFrame:
    first = group.iloc[0]
    n = clusters.size
    return pd.DataFrame(
        {
            "dataset": [first.dataset] * n, "n_tokens": [first.n_tokens] * n,
            "key1": [first.key1] * n, "key2": [first.key2] * n, "kind": ["state"] * n,
            "template": clusters.templates, "first_id": [0] * n,
            "founder": clusters.founders, "seq": range(n),
        }
    )


def mine_templates(events: DataFrame, st: float = SIMILARITY) -> DataFrame:
    """Events with the templates of their clusters: masked, routed, clustered and joined back.

    Scores, runs, sequences and incidents of these events are those of mined
    templates. Runs jobs while the plan is made.
    """
    clustered = cut(cluster_templates(template_leaves(masked_texts(events)), st), "clustered")
    return with_cluster_templates(events, clustered)


def with_cluster_templates(events: DataFrame, clustered: DataFrame) -> DataFrame:
    """Replace the one-per-text template of events by the template of its cluster."""
    mapping = clustered.select(
        "dataset", "template", F.col("cluster_template").alias("_text"),
        M.template_id_of(F.col("founder")).alias("_id"),
    )
    return (
        events.join(mapping, ["dataset", "template"], "left")
        .withColumn("template_id", F.coalesce("_id", "template_id"))
        .withColumn("template", F.coalesce("_text", "template"))
        .drop("_id", "_text")
        .select(*events.columns)
    )


# --------------------------------------------------------------------------- #
# Catalogue
# --------------------------------------------------------------------------- #
def template_catalog(events: DataFrame) -> DataFrame:
    return events.groupBy("dataset", "template_id").agg(
        F.min_by("template", "id").alias("template"), F.count(F.lit(1)).alias("size"),
        F.min("id").alias("first_log_id"),
    )


def templates_vs_truth(events: DataFrame, truth: DataFrame) -> DataFrame:
    """Discovered templates next to the number of ground-truth templates."""
    found = events.groupBy("dataset", "template_id").count().groupBy("dataset").agg(
        F.count(F.lit(1)).alias("discovered")
    )
    known = truth.groupBy("dataset").agg(F.count(F.lit(1)).alias("truth"))
    return found.join(known, "dataset", "left").select(
        "dataset", "discovered", F.coalesce("truth", F.lit(0)).alias("truth")
    )


def template_union(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Known template texts stay; new ids are added."""
    both = existing.select("dataset", "template_id", "template", F.lit(0).alias("_gen")).unionByName(
        incoming.select("dataset", "template_id", "template", F.lit(1).alias("_gen"))
    )
    return both.groupBy("dataset", "template_id").agg(
        F.min(F.struct("_gen", "template")).alias("_t")
    ).select("dataset", "template_id", F.col("_t.template").alias("template"))
