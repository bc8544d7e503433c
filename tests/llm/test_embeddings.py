"""Embedding links against brute force over all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripstrata.llm import embeddings

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute_force(rows):
    usable = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for n, i in enumerate(usable):
        for j in usable[:n]:
            a, b = (np.array(rows[x][1], np.float32).astype(float) for x in (i, j))
            if len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.95:
                links[i].add(j)
                links[j].add(i)
    group = list(range(len(rows)))
    for i in links:
        for j in links[i]:
            old, new = group[i], group[j]
            group = [new if g == old else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in set(group)}
    return sorted(((r[0], len(links[i]), least[group[i]]) for i, r in enumerate(rows)), key=repr)


def found(spark, rows):
    result, recall = embeddings.near_duplicates(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA))
    assert recall >= 0.999
    return sorted(map(tuple, result.collect()), key=repr)


def clusters(seed, sizes, dim=32, spread=0.02):
    draw = np.random.default_rng(seed)
    out = []
    for size in sizes:
        centre = draw.standard_normal(dim)
        out += [(centre + spread * draw.standard_normal(dim)).astype(np.float32).tolist() for _ in range(size)]
    return out


def test_matches_brute_force(spark):
    vectors = clusters(3, [1] * 150 + [2] * 20 + [5] * 6 + [60]) + clusters(4, [40], spread=0.16)
    rows = list(enumerate(vectors, start=3))
    rows += [(1000 + i, v) for i, v in enumerate(vectors[:4])]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 32), (2003, [float("nan")] * 32), (2004, [None] + [1.0] * 31), (2005, [1.0, 2.0]), (2006, [2.0, 4.0])]
    rows += [(None, vectors[0]), (5, vectors[2]), (3000, [x * 1e30 for x in vectors[7]])]
    assert found(spark, rows) == brute_force(rows)


def test_embeddings_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert found(spark, rows) == brute_force(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_block_keeps_its_components(spark):
    """Two dense groups and one bridge: the bridge is no best neighbour of its ends, nor the first link of either."""
    turn = lambda degrees, n: [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees))), 1e-4 * n]
    angles = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 10.0, 27.0, 36.0, 36.1, 36.2, 36.3, 36.4, 36.5]
    # keys in the order of the angles, then the bridge's ends last, so that neither is the first link of the other
    order = [*range(6), *range(8, 14), 6, 7]
    rows = [("b", bytes([n]), turn(angles[at], n)) for n, at in enumerate(order)]
    nodes = spark.createDataFrame([(k, v) for _, k, v in rows], "node binary, vector array<double>")
    blocks = spark.createDataFrame([(1, k) for _, k, _ in rows], "block bigint, node binary")
    found = embeddings.compared(blocks, nodes, embeddings.Descent()).where("link").collect()
    group = {bytes(k): n for n, (_, k, _) in enumerate(rows)}
    for r in found:
        old, new = group[bytes(r.src)], group[bytes(r.dst)]
        group = {k: new if g == old else g for k, g in group.items()}
    assert len(set(group.values())) == 1


def test_a_hot_group_hides_no_lost_pairs(spark):
    """A third of all rows in one dense group; pairs just over the threshold beside it are asked apart."""
    draw = np.random.default_rng(7)
    dim, pairs = 64, 150
    hot = [(np.eye(dim)[0] + 0.01 * draw.standard_normal(dim)).tolist() for _ in range(300)]
    rows = hot + draw.standard_normal((300, dim)).tolist()
    for _ in range(pairs):
        a = draw.standard_normal(dim)
        a /= np.linalg.norm(a)
        b = draw.standard_normal(dim)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [a.tolist(), (0.952 * a + np.sqrt(1 - 0.952**2) * b).tolist()]
    rows = list(enumerate(rows))
    assert found(spark, rows) == brute_force(rows)


def test_the_audit_sees_lost_pairs(spark):
    """Links of all pairs outside the hot group taken away: the recall says so, whatever the group's size."""
    vectors = clusters(5, [200] + [2] * 30)
    table = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], SCHEMA)
    nodes = embeddings.vectors(table, "vec_id", "embedding").selectExpr("node", "id", "1L as copies", "dim", "vector")
    group = F.when(F.col("id") < 200, F.lit(b"h")).otherwise(F.col("node"))
    groups = nodes.select("node", group.alias("component"))
    counts = nodes.select("node", F.when(F.col("id") < 200, 199).otherwise(0).cast("bigint").alias("links"))
    assert embeddings.audited(nodes, groups, counts, embeddings.Descent()) == 0.0
    right = nodes.select("node", F.when(F.col("id") < 200, 199).otherwise(1).cast("bigint").alias("links"))
    assert embeddings.audited(nodes, groups, right, embeddings.Descent()) == 1.0


def test_trees_follow_the_bits():
    plan = embeddings.Descent()
    trees = [embeddings.trees_for(bits, plan) for bits in (1, 6, 17, 23)]
    assert trees[0] == plan.trees and trees == sorted(trees) and trees[3] > 40


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], b"x", 3), (2, [1.0, 0.01], b"y", 4)], "vec_id bigint, embedding array<double>, node binary, dim int")
    result, _ = embeddings.near_duplicates(rows)
    assert sorted(map(tuple, result.collect())) == [(1, 1, 1), (2, 1, 1)]


@pytest.mark.parametrize("grid", [1024, 8])
def test_links_of_large_components(spark, monkeypatch, grid):
    """A dense core, a shell around it, and copies: counted with and without a leader."""
    monkeypatch.setattr(embeddings, "GRID", grid)
    vectors = clusters(11, [40], spread=0.01) + clusters(11, [30], spread=0.16) + clusters(12, [25], spread=0.12)
    rows = list(enumerate(vectors + vectors[:3] + [[x * 1e200 for x in vectors[0]]]))
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id bigint, embedding array<double>")
    nodes = embeddings.vectors(table, "vec_id", "embedding").groupBy("node").agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies"))
    known = {bytes(r.node): (np.array(r.vector) / np.abs(r.vector).max(), r.copies) for r in nodes.collect()}
    grouped = nodes.select("node", F.lit(b"c").alias("component"))
    unit = {k: v / np.sqrt(v @ v) for k, (v, _) in known.items()}
    want = {k: sum(known[o][1] for o in unit if o != k and unit[k] @ unit[o] >= 0.95) for k in unit}
    found = {bytes(r.node): r.links for r in embeddings.link_counts(grouped, nodes, embeddings.Descent()).collect()}
    assert {k: n for k, n in found.items() if n} == {k: n for k, n in want.items() if n}
