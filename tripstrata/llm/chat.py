"""Chat formatting with collapse of cumulative snapshots.

Logs often hold one conversation many times, each time a few turns longer. Every turn gets
the rolling hash of the turns up to it: the running sum of two hashes of (place, role,
text), kept exact. A conversation is dropped when its last hash occurs inside a longer
one (anti-join), and of equal ones the smallest id stays. What is left is rendered.

Turns are dealt out by ranges of (conversation, turn), so a conversation with a third of all rows
is spread over many tasks: places and hashes are counted within a range first, and what the
ranges before add comes from one row per conversation and range.

Defined cases: turns are ordered by turn (NULL last), role, text; NULL role or text counts as
empty; a NULL conversation id is one conversation, the largest id; repeated rows are
turns of their own; an empty input gives an empty result. The rendered row of a conversation is
as long as the conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripstrata.llm.base import staged

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _summed_before(rows: DataFrame, values: list[str]) -> DataFrame:
    """``(conv, part, <values>)``: sums over the parts of a conversation that come before each part; a row per part."""
    totals = rows.groupBy("conv", "part").agg(*[F.sum(v).alias(v) for v in values])
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("conv", "part", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}_before") for v in values])


def _carried_on(rows: DataFrame, values: list[str]) -> DataFrame:
    """``rows`` with what the earlier parts of their conversation sum up to."""
    sums = _summed_before(rows, values)
    both = rows.alias("r").join(sums.alias("s"), F.col("r.conv").eqNullSafe(F.col("s.conv")) & (F.col("r.part") == F.col("s.part")))
    return both.select("r.*", *[F.col(f"s.{v}_before") for v in values])


def rolling_hashes(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, place, n_turns, role, text, h1, h2)``; ``h1, h2`` identify the turns up to ``place``."""
    empty = F.lit("")
    rows = turns.select(
        F.col(id_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), empty).alias("role"),
        F.coalesce(F.col(text_col), empty).alias("text"),
    )
    keys = [F.col("turn").asc_nulls_last(), "role", "text"]
    # equal turns may be dealt to several parts: which is which does not matter
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("conv", *keys, "tie")
    parts = staged(dealt.withColumn("part", F.spark_partition_id()), "chat-parts")
    order = Window.partitionBy("conv", "part").orderBy(*keys, "tie")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    counted = _carried_on(parts.withColumn("rows", F.lit(1).cast("bigint")), ["rows"])
    placed = counted.withColumn("place", (F.row_number().over(order) + F.col("rows_before")).cast("int"))
    one = F.xxhash64(F.lit(1), "place", "role", "text").cast("decimal(38,0)")
    two = F.xxhash64(F.lit(2), "text", "role", "place").cast("decimal(38,0)")
    hashed = staged(placed.withColumn("one", one).withColumn("two", two).select(*parts.columns, "place", "one", "two"), "chat-places")
    summed = _carried_on(hashed, ["one", "two"])
    sizes = parts.groupBy("conv").agg(F.count(F.lit(1)).alias("n_turns"))
    h1, h2 = ((F.sum(name).over(upto) + F.col(f"{name}_before")).alias(alias) for name, alias in (("one", "h1"), ("two", "h2")))
    rolled = summed.select("conv", "place", "role", "text", h1, h2)
    whole = rolled.alias("r").join(sizes.alias("s"), F.col("r.conv").eqNullSafe(F.col("s.conv")))
    return whole.select("r.conv", "r.place", "s.n_turns", "r.role", "r.text", "r.h1", "r.h2")


def maximal_conversations(hashed: DataFrame) -> DataFrame:
    """``(conv, n_turns, copies)``: conversations that no longer one starts with; equal ones as one."""
    keys = ["place", "h1", "h2"]
    whole = hashed.where("place = n_turns").select("conv", *keys)
    # the smallest id of equal conversations; NULL is the largest
    first = F.min(F.struct(F.col("conv").isNull().alias("none"), F.col("conv").alias("conv")))
    one = whole.groupBy(*keys).agg(first.alias("first"), F.count(F.lit(1)).alias("copies"))
    inside = hashed.where("place < n_turns").select(*keys).distinct()
    return one.join(inside, keys, "left_anti").select(F.col("first.conv").alias("conv"), F.col("place").alias("n_turns"), "copies")


def collapse_and_render(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, n_turns, copies, rendered)`` of the maximal conversations; ``copies`` counts equal ones."""
    hashed = staged(rolling_hashes(turns, id_col, turn_col, role_col, text_col), "chat-turns")
    stays = maximal_conversations(hashed)
    line = F.concat(F.lit(OPEN), "role", F.lit("\n"), "text", F.lit(CLOSE))
    picked = hashed.alias("t").join(stays.alias("s"), F.col("t.conv").eqNullSafe(F.col("s.conv")))
    texts = picked.groupBy("s.conv", "s.n_turns", "s.copies").agg(F.sort_array(F.collect_list(F.struct("t.place", line.alias("line")))).alias("lines"))
    return texts.select("conv", "n_turns", "copies", F.array_join(F.col("lines.line"), "").alias("rendered"))
