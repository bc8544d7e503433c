"""Near-duplicate embeddings by NN-descent.

1. Equal vectors are one node with a number of copies. A random-hyperplane forest gives
   every node its first neighbour list: nodes of one leaf are compared with each other. Leaves
   get more bits as vectors get more, and the forest more trees as bits do.
2. Descent: the neighbours of a node, forward and reverse, are compared with each other,
   and lists keep the best ``k``. A list that is full of links is saturated and may grow to
   twice its length each round.
3. Every comparison with a cosine at the threshold or above is a link, also when it falls
   out of a list; a block emits a spanning forest of its links, which ties the same vectors. Components come from the links, and the links of a node are counted in
   double precision against all of its component, block by block, so that a saturated list
   hides none.
4. The result is audited: for samples of nodes (``audit`` at most of the largest component, and as
   many outside it) all nodes are compared. Below ``recall`` more trees and rounds follow; a
   recall below ``least`` after all ``attempts`` is an error.

Leaves, reverse lists and components of any size are cut into blocks of bounded size.

Defined cases: vectors that are NULL, empty, zero or hold NULL or non-finite components
link with nothing; vectors of different lengths neither; NULL ids lose to every other id;
rows that repeat a vector are linked with each other; an empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripstrata.llm.base import staged
from tripstrata.llm.blocks import by_block
from tripstrata.llm.components import components

LEAF = 128
BLOCK = 256
GRID = 1024
CANDIDATES = "src binary, dst binary, sim double, link boolean"


@dataclass(frozen=True)
class Descent:
    threshold: float = 0.95
    k: int = 8
    trees: int = 12
    rounds: int = 2
    per_block: int = 3
    miss: float = 0.02
    audit: int = 1024
    recall: float = 0.999
    least: float = 0.9
    attempts: int = 4


def vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, node, dim, vector)``; node is a 128-bit key, NULL for vectors that link with nothing."""
    value = F.col(vector_col).cast("array<double>")
    usable = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)
    good = F.coalesce(usable, F.lit(False))
    # 0.0 and -0.0 are the same component
    plain = F.transform(value, lambda x: x + F.lit(0.0))
    key = F.unhex(F.md5(F.to_json(F.struct(plain.alias("v"))).cast("binary")))
    return rows.select(
        F.col(id_col).alias("id"), F.when(good, key).alias("node"), F.when(good, F.size(value)).alias("dim"), F.when(good, plain).alias("vector")
    )


def units(vector: pd.Series) -> np.ndarray:
    """Unit vectors as rows, in double precision; scaled first, so that squares stay finite."""
    made = np.stack(vector.to_numpy()).astype(np.float64)
    made /= np.abs(made).max(axis=1, keepdims=True)
    return made / np.sqrt((made * made).sum(axis=1, keepdims=True))


def leaves(nodes: DataFrame, trees: int, bits: int, seed: int) -> DataFrame:
    """``(block, node, vector)``: nodes of one leaf, in blocks."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, own in batch.groupby("dim"):
                planes = np.random.default_rng([seed, dim]).standard_normal((int(dim), trees * bits))
                signs = (units(own.vector) @ planes > 0).reshape(len(own), trees, bits)
                codes = signs @ (np.int64(1) << np.arange(bits, dtype=np.int64))
                yield pd.DataFrame({"dim": int(dim), "tree": np.tile(np.arange(trees), len(own)), "code": codes.ravel(), "node": own.node.repeat(trees)})

    coded = staged(nodes.select("node", "dim", "vector").mapInPandas(scan, "dim int, tree int, code bigint, node binary"), "leaves")
    leaf = ["dim", "tree", "code"]
    sizes = coded.groupBy(*leaf).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    block = F.xxhash64(*leaf, F.pmod(F.xxhash64("node", F.lit(seed), "tree"), F.col("parts")))
    return coded.join(sizes, leaf).select(block.alias("block"), "node")


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what the symmetric matrix ``linked`` connects, one fewer than each component has members."""
    left, src, dst = np.ones(len(linked), bool), [], []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root], reached = False, [root]
        while reached:
            at = reached.pop()
            new = np.flatnonzero(linked[at] & left)
            left[new] = False
            src += [at] * len(new)
            dst += new.tolist()
            reached += new.tolist()
    return np.array(src, np.int64), np.array(dst, np.int64)


def compared(blocks: DataFrame, nodes: DataFrame, plan: Descent) -> DataFrame:
    """Each block member's best candidates of its block, and a spanning forest of the block's links."""

    def best(block: pd.DataFrame) -> pd.DataFrame | None:
        if len(block) < 2:
            return None
        unit, keys = units(block.vector), block.node.to_numpy()
        sims = unit @ unit.T
        np.fill_diagonal(sims, -2.0)
        take = min(plan.per_block, len(block) - 1)
        top = np.argpartition(-sims, take - 1, axis=1)[:, :take]
        rows = np.arange(len(block))
        linked = sims >= plan.threshold
        one, two = forest(linked | linked.T)
        src = np.concatenate([rows.repeat(take), one, two])
        dst = np.concatenate([top.ravel(), two, one])
        value = sims[src, dst]
        tied = np.arange(len(src)) >= rows.size * take
        return pd.DataFrame({"src": keys[src], "dst": keys[dst], "sim": value, "link": tied | (value >= plan.threshold)})

    return by_block(blocks.join(nodes.select("node", "vector"), "node"), ["node"], best, CANDIDATES)


def shortened(candidates: DataFrame, plan: Descent, most: int) -> DataFrame:
    """The best ``k`` of each node, and links beyond that up to ``most``."""
    order = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    once = candidates.groupBy("src", "dst").agg(F.max("sim").alias("sim"))
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.where((F.col("rank") <= plan.k) | (F.col("sim") >= plan.threshold)).select("src", "dst", "sim")


def neighbourhoods(graph: DataFrame) -> DataFrame:
    """``(block, node)``: forward neighbours of a node with its reverse ones, the latter cut into blocks."""
    reverse = graph.select(F.col("dst").alias("centre"), F.col("src").alias("node"))
    parts = reverse.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    back = reverse.join(parts, "centre").select("centre", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node")
    ahead = graph.select(F.col("src").alias("centre"), F.col("dst").alias("node")).join(parts, "centre", "left")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    ahead = ahead.select("centre", every.alias("part"), "node")
    return back.unionByName(ahead).select(F.xxhash64("centre", "part").alias("block"), "node").distinct()


def link_counts(grouped: DataFrame, nodes: DataFrame, plan: Descent) -> DataFrame:
    """``(node, links)``: linked vectors of each node among its component.

    In a component of more than ``GRID`` nodes, those within half the threshold's angle of one of
    them, its leader, are linked with each other without being compared. Only the others are
    compared, with all of the component, in blocks.
    """
    sizes = grouped.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader"))
    axes = sizes.where(F.col("n") > GRID).join(nodes.select(F.col("node").alias("leader"), F.col("vector").alias("axis")), "leader").select("component", "axis")
    held = grouped.join(nodes.select("node", "vector", "copies"), "node").join(axes, "component", "left")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    # scaled first, so that squares stay finite
    even = lambda v: F.transform(v, lambda x: x / F.array_max(F.transform(v, F.abs)))
    held = held.withColumn("v", even(F.col("vector"))).withColumn("a", even(F.col("axis")))
    cosine = dot("v", "a") / F.sqrt(dot("v", "v") * dot("a", "a"))
    near = F.coalesce(cosine >= float(np.sqrt((1 + plan.threshold) / 2)) + 1e-9, F.lit(False))
    held = staged(held.select("component", "node", "vector", "copies", near.alias("core")), "component-vectors")

    parts = held.groupBy("component").agg(
        F.ceil(F.count_if(~F.col("core")) / GRID).cast("int").alias("lefts"),
        F.ceil(F.count(F.lit(1)) / GRID).cast("int").alias("rights"),
        F.sum(F.when(F.col("core"), F.col("copies")).otherwise(0)).alias("within"),
    )
    dealt = held.join(parts, "component")
    settled = dealt.where("core").select("node", (F.col("within") - F.col("copies")).alias("links"))
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.where("NOT core").select("*", part("lefts").alias("l")).select("*", every("rights").alias("r"), F.lit(True).alias("left"))
    right = dealt.where("lefts > 0").select("*", part("rights").alias("r")).select("*", every("lefts").alias("l"), F.lit(False).alias("left"))
    columns = [F.xxhash64("component", "l", "r").alias("block"), "left", "node", "vector", "copies", "core"]
    rows = left.select(*columns).unionByName(right.select(*columns))

    def count(block: pd.DataFrame) -> pd.DataFrame | None:
        one, two = block[block.left], block[~block.left]
        if not len(one) or not len(two):
            return None
        linked = units(one.vector) @ units(two.vector).T >= plan.threshold
        linked &= one.node.to_numpy()[:, None] != two.node.to_numpy()[None, :]
        # a node of the core is compared from the other side only
        core = two.core.to_numpy(bool)
        counts = [linked @ two.copies.to_numpy(), linked[:, core].T @ one.copies.to_numpy()]
        return pd.DataFrame({"node": [*one.node, *two.node[core]], "links": np.concatenate(counts)})

    counted = by_block(rows, ["left", "node"], count, "node binary, links bigint")
    return counted.unionByName(settled).groupBy("node").agg(F.sum("links").alias("links"))


def trees_for(bits: int, plan: Descent) -> int:
    """Enough trees that a pair at the threshold shares a leaf in one of them but with probability ``miss``."""
    together = (1 - np.arccos(min(plan.threshold, 1.0)) / np.pi) ** bits
    return max(plan.trees, int(np.ceil(np.log(plan.miss) / np.log1p(-together))))


def audited(nodes: DataFrame, groups: DataFrame, counts: DataFrame, plan: Descent) -> float:
    """The recall: over asked vectors, the mean share of a vector's true links that were found.

    The vectors of the largest component and those outside it are asked and averaged apart, and
    the lower mean counts, so that a large dense group does not hide what is lost elsewhere.
    """
    largest = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    marked = nodes.join(groups, "node", "left").join(largest.select("component", F.lit(True).alias("hot")), "component", "left")
    marked = marked.select("node", "dim", "vector", F.coalesce("hot", F.lit(False)).alias("hot"))
    some = lambda hot: marked.where(F.col("hot") == hot).orderBy(F.xxhash64("node"), "node").limit(plan.audit)
    asked = some(True).unionByName(some(False)).toPandas()
    if not len(asked):
        return 1.0
    by_dim = {dim: (own.node.to_numpy(), own.hot.to_numpy(), units(own.vector)) for dim, own in asked.groupby("dim")}

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, own in batch.groupby("dim"):
                if dim in by_dim:
                    keys, hot, unit = by_dim[dim]
                    linked = unit @ units(own.vector).T >= plan.threshold
                    linked &= keys[:, None] != own.node.to_numpy()[None, :]
                    yield pd.DataFrame({"node": keys, "hot": hot, "truth": linked @ own.copies.to_numpy()})

    truth = nodes.select("node", "dim", "vector", "copies").mapInPandas(scan, "node binary, hot boolean, truth bigint")
    truth = truth.groupBy("node", "hot").agg(F.sum("truth").alias("truth")).where("truth > 0")
    share = F.least("truth", F.coalesce("links", F.lit(0))) / F.col("truth")
    means = truth.join(counts, "node", "left").groupBy("hot").agg(F.avg(share).alias("recall")).collect()
    return min((r["recall"] for r in means), default=1.0)


def near_duplicates(rows: DataFrame, plan: Descent = Descent(), id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, float]:
    """``(id, n_links, component_id)`` per row, and the recall that the audit measured."""
    facts = staged(vectors(rows, id_col, vector_col), "vectors")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id"))
    grouped = facts.where("node is not null").groupBy("node").agg(
        first.alias("f"), F.count(F.lit(1)).alias("copies"), F.first("dim").alias("dim"), F.first("vector").alias("vector")
    )
    nodes = staged(grouped.select("node", F.col("f.id").alias("id"), "copies", "dim", "vector"), "vector-nodes")
    bits = max(1, int(np.ceil(np.log2(max(nodes.count(), 1) / LEAF + 1))))
    graph = links = None
    for attempt in range(plan.attempts):
        fresh = staged(compared(leaves(nodes, trees_for(bits, plan), bits, attempt), nodes, plan), "forest")
        links = fresh.where("link") if links is None else links.unionByName(fresh.where("link"))
        pool = fresh.select("src", "dst", "sim")
        graph = staged(shortened(pool if graph is None else graph.unionByName(pool), plan, plan.k), "lists")
        for step in range(plan.rounds):
            seen = staged(compared(neighbourhoods(graph), nodes, plan), "descent")
            links = links.unionByName(seen.where("link"))
            back = graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim")
            pool = graph.unionByName(back).unionByName(seen.select("src", "dst", "sim"))
            graph = staged(shortened(pool, plan, plan.k << (step + 1)), "lists")
        groups = staged(components(links.unionByName(graph.where(F.col("sim") >= plan.threshold).withColumn("link", F.lit(True))), "src", "dst"), "vector-components")
        counts = staged(link_counts(groups, nodes, plan), "link-counts")
        recall = audited(nodes, groups, counts, plan)
        if recall >= plan.recall:
            break
    if recall < plan.least:
        raise RuntimeError(f"recall is {recall:.3f} after {plan.attempts} attempts")
    labels = nodes.select("node", "id", "copies").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = labels.groupBy("component").agg(F.min("id").alias("component_id"))
    named = labels.join(smallest, "component").join(counts, "node", "left")
    named = named.select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    joined = facts.select("id", "node").join(named, "node", "left")
    alone = F.col("node").isNull()
    return joined.select(
        "id", F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("bigint").alias("n_links"), F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    ), recall
