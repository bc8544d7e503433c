"""Mixing sources to target weights by a low-discrepancy slot schedule.

Slot ``i`` of the mix has the point frac(i * golden ratio); the cumulative target shares
name its source. Slots are ranked per source, and slot ``k`` of a source takes block
``k mod n`` of the source's ``n`` equal-token blocks, which are cut from its documents in a
hashed order. So every prefix of the schedule is near the targets, a source is used up
before it repeats, and reruns agree.

Ranks and token offsets are prefix sums in two steps: within small chunks, and over one
sum per chunk. No source is ordered in one task.

Defined cases: a NULL text has no words; NULL is a source of its own and comes last;
documents without words are kept with nothing taken; rows repeated with id and size are
interchangeable; an empty input gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripstrata.llm.base import WORD, condensed, staged

GOLDEN = 0.6180339887498949
GRID = 4096
CHUNK = 8192


@dataclass(frozen=True)
class MixPlan:
    """``weights`` repeat over the sources in code point order. A source gives at most
    ``repeats`` times its words. A slot takes a block of ``block_words`` words."""

    weights: tuple[int, ...] = (1, 2, 3)
    repeats: int = 3
    block_words: int = 32
    seed: str = "mix"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def targets(facts: DataFrame, plan: MixPlan) -> DataFrame:
    """``(s, source, weight, source_size, target)``: one row per source, ``s`` its place.

    Water filling: sources whose cap is reached earliest are fixed first, and the level of
    the others is what remains over their weights. The windows run over one row a source.
    """
    sizes = facts.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(w) for w in plan.weights])
    ranked = sizes.withColumn("s", place).withColumn("weight", F.element_at(weights, F.col("s") % len(plan.weights) + 1))
    cap = F.col("source_size") * F.lit(plan.repeats)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "s")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (
        ranked.withColumn("cap", cap)
        .withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_weights", F.sum("weight").over(everything))
        .withColumn("_capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("_gone", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("_level", (F.col("_total") - F.col("_capped")).cast("double") / (F.col("_weights") - F.col("_gone")))
        .withColumn("_free", F.col("cap") / F.col("weight") > F.col("_level"))
    )
    water = F.min(F.when(F.col("_free"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "s", "_level"))).over(everything)
    filled = level.withColumn("_water", water["_level"])
    target = F.when(F.col("_water").isNull(), F.col("cap").cast("double")).otherwise(
        F.least(F.col("cap").cast("double"), F.col("_water") * F.col("weight"))
    )
    return filled.select("s", "source", "weight", "source_size", target.alias("target"))


def slots(facts: DataFrame, sources: DataFrame, plan: MixPlan) -> DataFrame:
    """``(slot, s, rank)``: the source of every slot, and its place among the source's slots."""
    spark = facts.sparkSession
    total = facts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    number = -(-total // plan.block_words)
    running = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = F.col("target") / F.lit(float(max(total, 1)))
    bounds = sources.select("s", F.sum(share).over(running).alias("hi"), F.lag("s").over(Window.orderBy("s")).alias("prior"))
    bounds = bounds.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("s")), F.lit(0.0)))
    last = Window.partitionBy()
    # rounding must not leave a gap before 1
    bounds = bounds.withColumn("hi", F.when(F.col("s") == F.max("s").over(last), F.greatest("hi", F.lit(1.0))).otherwise(F.col("hi")))
    cell = lambda x: F.least(F.floor(x * GRID), F.lit(GRID - 1))
    cells = bounds.where(F.col("hi") > F.col("lo")).select("s", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    # i * golden in two parts, so that the fraction keeps its digits for large i
    high, low = F.floor(F.col("slot") / (1 << 20)), F.col("slot") % (1 << 20)
    point = high * F.lit(GOLDEN * (1 << 20) % 1.0) + low * F.lit(GOLDEN)
    drawn = spark.range(number).withColumnRenamed("id", "slot").withColumn("u", point - F.floor(point)).withColumn("cell", cell(F.col("u")))
    placed = drawn.join(cells, "cell").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    placed = placed.select("slot", "s", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = placed.groupBy("s", "chunk").agg(F.count(F.lit(1)).alias("n"))
    prior = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("s", "chunk", F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("s", "chunk").orderBy("slot")) - 1
    return placed.withColumn("inside", inside).join(offsets, ["s", "chunk"]).select("slot", "s", (F.col("offset") + F.col("inside")).alias("rank"))


def block_uses(ranked: DataFrame, sources: DataFrame, plan: MixPlan) -> DataFrame:
    """``(s, block, uses)``: how many slots take a block; no block is taken more than ``repeats`` times."""
    blocks = sources.select("s", F.ceil(F.col("source_size") / plan.block_words).alias("blocks")).where("blocks > 0")
    taken = ranked.join(blocks, "s").where(F.col("rank") < F.col("blocks") * plan.repeats)
    return taken.groupBy("s", (F.col("rank") % F.col("blocks")).alias("block")).agg(F.count(F.lit(1)).alias("uses"))


def spans(facts: DataFrame, sources: DataFrame, plan: MixPlan) -> DataFrame:
    """Every document with words: where it starts and ends in its source's shuffled token stream."""
    key = F.md5(F.concat(F.lit(plan.seed), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    keyed = (
        facts.where("size > 0")
        .alias("f")
        .join(sources.select("s", "source").alias("k"), F.col("f.source").eqNullSafe(F.col("k.source")))
        .select("id", "size", "s", key.alias("key"))
        .withColumn("bin", F.substring("key", 1, 4))
    )
    sums = keyed.groupBy("s", "bin").agg(F.sum("size").alias("n"))
    prior = Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("s", "bin", F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("s", "bin").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keyed.withColumn("upto", F.sum("size").over(inside)).join(offsets, ["s", "bin"])
    end = F.col("offset") + F.col("upto")
    return placed.select("id", "size", "s", (end - F.col("size")).alias("start"), end.alias("end"))


def pieces(placed: DataFrame, uses: DataFrame, plan: MixPlan) -> DataFrame:
    """One row per document and block: the words in it and how often the mix takes them."""
    b = plan.block_words
    cut = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("end") - 1) / b))))
    words = F.least(F.col("end"), (F.col("block") + 1) * b) - F.greatest(F.col("start"), F.col("block") * b)
    return cut.withColumn("words", words).join(uses, ["s", "block"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))


def mix(docs: DataFrame, plan: MixPlan = MixPlan(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(id, size, source, source_size, target, taken, copies)`` per document.

    ``taken`` counts the words the schedule takes, repeats included; ``copies`` is how often
    it takes the block that holds the document's first word, for mixes of whole documents.
    """
    facts = staged(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "mix-sizes"
    )
    sources = staged(targets(facts, plan), "mix-targets")
    uses = staged(block_uses(slots(facts, sources, plan), sources, plan), "mix-uses")
    cut = pieces(spans(facts, sources, plan), uses, plan)
    first = F.max(F.when(F.col("block") == F.floor(F.col("start") / plan.block_words), F.col("uses")))
    whole = cut.groupBy("s", "start", "id", "size").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"), first.alias("copies"))
    filled = whole.select("id", "size", "s", "taken", "copies")
    empty = (
        facts.where("size = 0")
        .alias("f")
        .join(sources.select("s", "source").alias("k"), F.col("f.source").eqNullSafe(F.col("k.source")))
        .select("id", "size", "s", F.lit(0).cast("bigint").alias("taken"), F.lit(0).cast("bigint").alias("copies"))
    )
    return filled.unionByName(empty).join(sources, "s").select("id", "size", "source", "source_size", "target", "taken", "copies")


def mixed_rows(docs: DataFrame, plan: MixPlan = MixPlan(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Ids name rows here: rows that share an id share the smallest number of copies among them. There is
    one number per id, so they are merged with the rows at every size and never broadcast.
    """
    copies = condensed(lambda: mix(docs, plan, id_col, text_col, source_col).groupBy("id").agg(F.min("copies").cast("int").alias("copies")), "mix-copies")
    inner = docs.select(F.struct("*").alias("row")).alias("d")
    joined = inner.join(copies.hint("merge").alias("c"), F.col(f"d.row.{id_col}").eqNullSafe(F.col("c.id")))
    return joined.where("copies > 0").select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("_n")).select("row.*")
