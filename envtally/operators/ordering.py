"""Positions within a group that may be too large for one task."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys per slice in the sample that the cut points are taken from.
SAMPLED_PER_SLICE = 64
#: Each row meets the cut points, so there are no more than this many slices.
MOST_SLICES = 1024


def whole(df: DataFrame) -> DataFrame:
    """``df`` with all its columns computed, whichever of them are used.

    What several branches of a plan read is then the same subtree in each of them, so that
    its last exchange is run once and reused. No column is pruned below an explode of more
    than one field.
    """
    row = F.explode(F.array(F.struct(*df.columns))).alias("_whole")
    return df.select(row).select(*[F.col("_whole").getField(c).alias(c) for c in df.columns])


def _cut_points(df: DataFrame, keys: Sequence[str], slices: int) -> DataFrame:
    """One row, ``heads, blocks``: the keys that begin the slices but the first, in order.

    They are quantiles of a sample, the keys with the smallest hashes. So they are the same
    each time ``df`` is computed, and their number is bounded. They stand in blocks of about
    the root of their number; heads has the first key of each block but the first.
    """
    block = math.isqrt(slices) + 1
    sample = (
        df.select(F.struct(*keys).alias("key"), F.xxhash64(*keys).alias("hash"))
        .orderBy("hash")
        .limit(slices * SAMPLED_PER_SLICE)
    )
    return sample.agg(F.array_sort(F.collect_list("key")).alias("keys")).selectExpr(
        f"transform(sequence(1, {max(1, slices - 1)}), i -> get(keys, CAST(i * size(keys) div {slices} AS INT))) AS cuts"
    ).selectExpr(
        f"transform(sequence(1, {block}), b -> get(cuts, b * {block})) AS heads",
        f"transform(sequence(0, {block}), b -> slice(cuts, b * {block} + 1, {block})) AS blocks",
    )


def with_slice(
    df: DataFrame,
    keys: Sequence[str],
    sampled: DataFrame | None = None,
    edge: Sequence[str] = (),
) -> DataFrame:
    """Add ``_slice``, the number of the slice that a row is in, in the order of ``keys``.

    The cut points are a scalar subquery: they are found when the plan runs, not before.
    With ``edge``, the first of ``keys``, there is also ``_edge``: whether the row's slice
    begins or ends between two rows that agree with it in these.
    """
    slices = min(MOST_SLICES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = _cut_points(df if sampled is None else sampled, keys, slices)
    cuts = cuts.select(F.struct("heads", "blocks").alias("cuts")).scalar()
    key, block = F.struct(*keys), math.isqrt(slices) + 1

    def upto(points: Column) -> Column:
        return F.size(F.filter(points, lambda point: point <= key))

    def agrees(number: Column) -> Column:
        cut = F.get(F.get("_cuts.blocks", F.floor(number / block).cast("int")), number % block)
        same = [cut.getField(name).eqNullSafe(F.col(name)) for name in edge]
        return reduce(Column.__and__, same, cut.isNotNull())

    sliced = (
        df.withColumn("_cuts", cuts)
        .withColumn("_head", upto(F.col("_cuts.heads")))
        .withColumn("_slice", F.col("_head") * block + upto(F.get("_cuts.blocks", F.col("_head"))))
    )
    if edge:
        begins = (F.col("_slice") > 0) & agrees(F.greatest(F.col("_slice") - 1, F.lit(0)))
        sliced = sliced.withColumn("_edge", begins | agrees(F.col("_slice")))
    return sliced.drop("_cuts", "_head")


def with_item_and_part(
    df: DataFrame,
    group: Sequence[str],
    item: str,
    order: Sequence[str],
    sampled: DataFrame | None = None,
) -> DataFrame:
    """Number the items of each group, and the parts of each item, in one prefix scan.

    Rows with ``is_part`` false are the heads of items, one for each; the others are their
    parts. Adds ``item``, the 1-based position of the row's item in its group, and ``part``,
    that of a part in its item and 0 for a head. Both are running counts in a slice, which
    one sort serves, plus what earlier slices hold of the group and of the item. Only groups
    and items that a slice cuts through have such offsets, so these are few. ``df`` is
    computed as often as by ``with_position``; nulls and ties are as there.
    """
    keys = [*group, item, "is_part", *order]
    sliced = with_slice(df, keys, sampled, edge=[*group, item])
    head, part = (~F.col("is_part")).cast("long"), F.col("is_part").cast("long")

    within = [*group, "_slice"]
    scan = Window.partitionBy(*within).orderBy(item, "is_part", *order)
    of_item = Window.partitionBy(*within, item).orderBy("is_part", *order)
    running = (Window.unboundedPreceding, Window.currentRow)
    numbered = sliced.withColumn("_items", F.sum(head).over(scan.rowsBetween(*running))).withColumn(
        "_parts", F.sum(part).over(of_item.rowsBetween(*running))
    )

    # Two or three rows for each slice and group: cut items by name, all others together.
    cut_item = F.when(F.col("_edge"), F.col(item)).alias("_cut_item")
    sizes = sliced.groupBy(*within, cut_item).agg(F.sum(head).alias("_heads"), F.sum(part).alias("_parts"))
    by_group = Window.partitionBy(*group).orderBy("_slice").rangeBetween(Window.unboundedPreceding, -1)
    by_item = Window.partitionBy(*group, "_cut_item").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumns(
        {"_items_before": F.sum("_heads").over(by_group), "_parts_before": F.sum("_parts").over(by_item)}
    )
    offsets = before.groupBy(*within).agg(
        F.max("_items_before").alias("_items_before"),
        # At most one item of a slice began before it.
        F.max(F.when(F.col("_parts_before") > 0, F.struct("_cut_item", "_parts_before"))).alias("_carry"),
    ).where((F.col("_items_before") > 0) | F.col("_carry").isNotNull())
    carried = F.when(F.col("_carry._cut_item") == F.col(item), F.col("_carry._parts_before"))
    return (
        numbered.join(F.broadcast(offsets), within, "left")
        .withColumn("item", F.col("_items") + F.coalesce("_items_before", F.lit(0)))
        .withColumn("part", F.when(F.col("is_part"), F.col("_parts") + F.coalesce(carried, F.lit(0))).otherwise(0))
        .select(*df.columns, "item", "part")
    )


def with_position(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    name: str,
    sampled: DataFrame | None = None,
) -> DataFrame:
    """Add the 1-based position of each row within its group, as a window would.

    A window over the group alone sorts a hot group in one task. Here the rows are cut into
    slices by group and order, so a hot group spans many slices; a row's position is its
    position in its slice plus the size of the group's earlier slices. A slice has at most
    one group that began before it, so the offsets that are broadcast are fewer than the
    slices. Nothing runs before the result does. ``df`` is computed three times: for the cut
    points, the sizes and the rows. Pass one that is cheap, pinned, or ends in an exchange
    that ``whole`` lets Spark reuse; and in ``sampled``, if there is something cheaper with
    about the same keys, that for the cut points. Any cut points give the same positions.
    Rows with equal keys share a slice. Group columns must not be NULL.
    """
    sliced = with_slice(df, [*group, *order], sampled)

    earlier = (
        Window.partitionBy(*group)
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        sliced.groupBy(*group, "_slice")
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_before", F.sum("_size").over(earlier))
        .where(F.col("_before") > 0)
        .drop("_size")
    )
    in_slice = Window.partitionBy(*group, "_slice").orderBy(*order)
    return (
        sliced.withColumn("_in_slice", F.row_number().over(in_slice))
        .join(F.broadcast(offsets), [*group, "_slice"], "left")
        .withColumn(name, F.col("_in_slice") + F.coalesce("_before", F.lit(0)))
        .select(*df.columns, name)
    )
