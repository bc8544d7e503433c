"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact check.

1. Each text becomes its set of distinct word shingles, a set key and a signature. Texts
   with equal sets are one node from here on, however many there are.
2. Nodes that share a band of the signature are candidates. Of a bucket's members the one
   that meets most others over all its buckets is compared with each of them, never all
   pairs: in a group of near copies that is the text they were made from.
3. A comparison looks at the signatures in batches and stops as soon as the posterior
   probability of a similarity over the threshold falls below ``miss``. Survivors are
   verified on their full sets.
4. Members of a bucket that are in different components after that are still compared with
   each other, in blocks of bounded size. Pairs within a component need no comparison, so
   the links that matter for components are complete for all pairs that share a band.
   With 32 bands of 4 minima a pair at the threshold shares none with probability 5e-6.

Defined cases: a NULL or blank text has no shingles and is alone; fewer words than a shingle
count as one shingle; NULL ids lose to every other id as representative; rows that repeat
id and text are in one component; an empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripstrata.llm.base import condensed, keep_one, staged, tidy
from tripstrata.llm.blocks import by_block
from tripstrata.llm.components import components
from tripstrata.llm.shingles import MinHash, WordHashes, band_keys, shingle_set

BLOCK = 1024
# shingles of the sets of a block together, 8 bytes apiece
BLOCK_SHINGLES = 2_000_000
BATCH_ROWS = 256
BATCH_BYTES = 8 << 20


@dataclass(frozen=True)
class NearDup:
    """Link texts whose sets have intersection / union >= ``percent`` / 100."""

    percent: int = 75
    shingle: int = 5
    size: int = 128
    rows: int = 4
    batch: int = 16
    miss: float = 1e-4


def least_matches(plan: NearDup) -> list[int]:
    """Per number of minima seen (batch, 2 batch, ...): fewer matches than this are pruned.

    With a uniform prior the posterior of the similarity is Beta(matches + 1, misses + 1).
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    above = grid >= plan.percent / 100
    wanted = []
    for seen in range(plan.batch, plan.size + 1, plan.batch):
        for matches in range(seen + 1):
            weight = matches * np.log(grid) + (seen - matches) * np.log1p(-grid)
            weight = np.exp(weight - weight.max())
            if weight[above].sum() >= plan.miss * weight.sum():
                break
        wanted.append(matches)
    return wanted


def text_facts(docs: DataFrame, plan: NearDup, id_col: str, text_col: str) -> DataFrame:
    """``(id, text_hash, n_shingles, node, signature)``; node is a 128-bit key of the set, NULL for the empty one."""
    id_type = dict(docs.dtypes)[id_col]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        hashes, minhash = WordHashes(), MinHash(plan.size)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                sizes, nodes, signatures = [], [], []
                for text in part.column(2):
                    shingles = shingle_set(hashes.of(text.as_py() or b""), plan.shingle)
                    sizes.append(len(shingles))
                    nodes.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                    signatures.append(minhash.of(shingles).tobytes() if len(shingles) else None)
                # ids pass as they are: as numbers with NULLs among them they would become doubles
                made = [pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(signatures, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names=["id", "text_hash", "n_shingles", "node", "signature"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(tidy(scan), f"id {id_type}, text_hash bigint, n_shingles bigint, node binary, signature binary")


def banded(nodes: DataFrame, plan: NearDup) -> DataFrame:
    """``(band, key, node)`` of every node and band."""
    bands = plan.size // plan.rows

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        np.seterr(over="ignore")
        for batch in batches:
            for at in range(0, len(batch), BATCH_ROWS):
                part = batch.iloc[at : at + BATCH_ROWS]
                keys = band_keys(np.frombuffer(b"".join(part.signature), np.uint32).reshape(len(part), -1), plan.rows)
                yield pd.DataFrame({"band": np.tile(np.arange(bands, dtype=np.int32), len(part)), "key": keys.ravel(), "node": part.node.repeat(bands)})

    return nodes.select("node", "signature").mapInPandas(tidy(scan), "band int, key bigint, node binary")


def plausible(blocks: DataFrame, nodes: DataFrame, plan: NearDup) -> DataFrame:
    """``(block, node, partners, needs)`` that survive the sequential comparison of signatures.

    ``partners`` are keys side by side; ``needs``, in one row a block, all distinct keys of the block's pairs.

    ``blocks`` has ``(block, left, band, node, component, outside)``. Rows with ``left`` are compared
    with the others of their block and of another component. Where both are ``outside`` the
    bucket's largest component, the pair comes up twice, and the smaller key is compared. A
    pair is compared in the first band it shares; ``band`` is NULL where there is one block a pair.
    """
    wanted = least_matches(plan)

    def compare(block: pd.DataFrame) -> pd.DataFrame | None:
        left, right = block[block.left], block[~block.left]
        if not len(left) or not len(right):
            return None
        to_matrix = lambda side: np.frombuffer(b"".join(side.signature), np.uint32).reshape(len(side), -1)
        a, b = to_matrix(left), to_matrix(right)
        (la, ca, oa), (lb, cb, ob) = ((s.node.to_numpy(), s.component.to_numpy(), s.outside.to_numpy()) for s in (left, right))
        rows, used = [], np.zeros(len(b), bool)
        for i in range(len(a)):
            stay = np.flatnonzero((cb != ca[i]) & (~(ob & oa[i]) | (lb > la[i])))
            matches = np.zeros(len(stay), np.int32)
            for step, least in enumerate(wanted):
                at = slice(step * plan.batch, (step + 1) * plan.batch)
                matches = matches + (b[stay, at] == a[i, at]).sum(axis=1)
                good = matches >= least
                stay, matches = stay[good], matches[good]
                if not len(stay):
                    break
            if len(stay) and not pd.isna(left.band.iloc[0]):
                shared = (b[stay] == a[i]).reshape(len(stay), -1, plan.rows).all(axis=2)
                stay = stay[shared.argmax(axis=1) == left.band.iloc[0]]
            if len(stay):
                rows.append((block.block.iloc[0], la[i], b"".join(lb[stay])))
                used[stay] = True
        if not rows:
            return None
        found = pd.DataFrame(rows, columns=["block", "node", "partners"])
        return found.assign(needs=[b"".join({*found.node, *lb[used]}), *[None] * (len(rows) - 1)])

    signed = blocks.join(nodes.select("node", "signature"), "node")
    return by_block(signed, ["left", "node"], compare, "block bigint, node binary, partners binary, needs binary")


def verify(found: DataFrame, nodes: DataFrame, docs: DataFrame, plan: NearDup, id_col: str, text_col: str) -> DataFrame:
    """Links ``(a, b)`` among ``found`` that hold on the full sets.

    Only the texts of nodes in ``found`` are cut into shingles again, and each block gets each
    set it needs once.
    """
    starts = F.sequence(F.lit(1), F.octet_length("needs"), F.lit(16))
    keys = F.transform(starts, lambda i: F.substring("needs", i, F.lit(16)))
    needed = found.where("needs is not null").select("block", F.explode(keys).alias("node"))
    wanted = needed.select("node").distinct().join(nodes.select("node", "id"), "node")
    wanted = staged(wanted, "wanted-sets")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        hashes = WordHashes()

        def made(sets: list[bytes]) -> pa.RecordBatch:
            keys = [xxhash.xxh3_128_digest(s) for s in sets]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=["node", "payload"])

        sets, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                sets.append(shingle_set(hashes.of(text.as_py() or b""), plan.shingle).tobytes())
                size += len(sets[-1])
                if size >= BATCH_BYTES or len(sets) >= BATCH_ROWS:
                    yield made(sets)
                    sets, size = [], 0
        if sets:
            yield made(sets)

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).alias("d")
    some = texts.join(wanted.alias("w"), F.col("d.id").eqNullSafe(F.col("w.id")), "left_semi").select("text")
    sets = staged(some.mapInArrow(tidy(cut), "node binary, payload binary").join(wanted.select("node"), "node", "left_semi"), "sets", batch_bytes=BATCH_BYTES)
    sets = sets.dropDuplicates(["node"])

    def exact(block: pd.DataFrame) -> pd.DataFrame | None:
        is_set = block.kind.to_numpy() == 0
        held = {n: np.frombuffer(p, np.uint64) for n, p in zip(block.node[is_set], block.payload[is_set], strict=True)}
        links = []
        for a, joined in zip(block.node[~is_set], block.payload[~is_set], strict=True):
            one = held[a]
            for at in range(0, len(joined), 16):
                other = held[joined[at : at + 16]]
                small, large = (one, other) if len(one) <= len(other) else (other, one)
                if 100 * len(small) < plan.percent * len(large):
                    continue
                at_most = np.minimum(np.searchsorted(large, small), len(large) - 1)
                common = int((large[at_most] == small).sum())
                if 100 * common >= plan.percent * (len(one) + len(other) - common):
                    links.append((a, joined[at : at + 16]))
        return pd.DataFrame(links, columns=["a", "b"]) if links else None

    rows = needed.join(sets, "node").select("block", F.lit(0).alias("kind"), "node", "payload").unionByName(
        found.select("block", F.lit(1).alias("kind"), "node", F.col("partners").alias("payload"))
    )
    return by_block(rows, ["kind"], exact, "a binary, b binary")


def parts_of(count, shingles) -> Column:
    """Into how many blocks so many members go, with so many shingles: blocks are bounded in rows and in bytes."""
    return F.ceil(F.greatest(count / BLOCK, shingles / BLOCK_SHINGLES, F.lit(1)))


def hub_blocks(members: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The buckets of several members, and blocks that pair each member with the one that has most meetings."""
    sizes = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"))
    sized = staged(members.join(sizes.where("n > 1"), ["band", "key"]), "buckets")
    meets = sized.groupBy("node").agg(F.sum("n").alias("meets"))
    hubs = sized.join(meets, "node").groupBy("band", "key").agg(F.max(F.struct("meets", "node")).alias("hub"))
    pairs = sized.join(hubs.select("band", "key", F.col("hub.node").alias("hub")), ["band", "key"]).where("node <> hub").select("hub", "node").distinct()
    pairs = staged(pairs.join(nodes.select("node", "n_shingles"), "node"), "hub-pairs")
    parts = pairs.groupBy("hub").agg(parts_of(F.count(F.lit(1)), F.sum("n_shingles")).alias("parts"))
    salted = pairs.join(parts, "hub").select("hub", "node", F.xxhash64("hub", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block"))
    plain = [F.lit(None).cast("int").alias("band"), F.lit(False).alias("outside")]
    left = salted.select("block", F.col("hub").alias("node")).distinct().select("block", F.lit(True).alias("left"), "node", F.lit(b"l").alias("component"), *plain)
    right = salted.select("block", F.lit(False).alias("left"), "node", F.lit(b"r").alias("component"), *plain)
    return sized, left.unionByName(right)


def rest_blocks(sized: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members of a bucket in different components, in blocks: all outside the largest one against all."""
    marked = sized.where("n > 2").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    marked = marked.join(nodes.select("node", "n_shingles"), "node")
    counts = marked.groupBy("band", "key", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n_shingles").alias("s"))
    buckets = counts.groupBy("band", "key").agg(
        F.max(F.struct("c", "component", "s")).alias("top"), F.sum("c").alias("n"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("kinds")
    ).where("kinds > 1").select(
        "band",
        "key",
        F.col("top.component").alias("largest"),
        parts_of(F.col("n") - F.col("top.c"), F.col("s") - F.col("top.s")).alias("lefts"),
        parts_of(F.col("n"), F.col("s")).alias("rights"),
    )
    rows = staged(marked.select("band", "key", "node", "component").join(buckets, ["band", "key"]), "mixed-buckets")
    rows = rows.withColumn("outside", F.col("component") != F.col("largest"))
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["left", "band", "key", "node", "component", "outside", "l", "r"]
    left = rows.where("outside").withColumn("left", F.lit(True)).withColumn("l", part("lefts")).withColumn("r", every("rights")).select(*columns)
    right = rows.withColumn("left", F.lit(False)).withColumn("r", part("rights")).withColumn("l", every("lefts")).select(*columns)
    return left.unionByName(right).withColumn("block", F.xxhash64("band", "key", "l", "r")).drop("key", "l", "r")


def near_duplicates(docs: DataFrame, plan: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text_hash, n_shingles, node, component, component_id)`` per row; ``component_id`` is the smallest id of its component."""
    facts = staged(text_facts(docs, plan, id_col, text_col), "signatures", batch_bytes=BATCH_BYTES)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id"))
    grouped = facts.where("node is not null").groupBy("node").agg(first.alias("f"), F.max("signature").alias("signature"), F.max("n_shingles").alias("n_shingles"))
    nodes = staged(grouped.select("node", F.col("f.id").alias("id"), "signature", "n_shingles"), "nodes")
    sized, blocks = hub_blocks(banded(nodes, plan), nodes)
    near = staged(plausible(blocks, nodes, plan), "plausible")
    links = staged(verify(near, nodes, docs, plan, id_col, text_col), "links")
    labels = components(links, "a", "b")
    more = staged(plausible(rest_blocks(sized, labels, nodes), nodes, plan), "plausible")
    late = staged(verify(more, nodes, docs, plan, id_col, text_col), "links")
    if not late.isEmpty():
        labels = components(links.unionByName(late), "a", "b")
    labels = nodes.select("node", "id").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = labels.groupBy("component").agg(F.min("id").alias("component_id"))
    named = labels.join(smallest, "component").select("node", "component", "component_id")
    joined = facts.select("id", "text_hash", "n_shingles", "node").join(named, "node", "left")
    return joined.withColumn("component_id", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")))


def one_of_each(docs: DataFrame, plan: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of which one per component stays: the smallest id's."""
    found = condensed(lambda: near_duplicates(docs, plan, id_col, text_col).select("id", "text_hash", "component"), "near-duplicates")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    first = found.where("component is not null").groupBy("component").agg(F.min(order).alias("first"))
    own = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    marks = found.join(first, "component", "left").withColumn("kept", F.col("component").isNull() | (own == F.col("first")))
    # a key with an empty text has no component and stays; keys are equal in all their rows
    return keep_one(docs, marks.select("id", "text_hash", "kept"), {"id": F.col(id_col), "text_hash": F.xxhash64(text_col)})
