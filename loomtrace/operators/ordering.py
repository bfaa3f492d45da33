"""Dense numbering and running sums without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.workspace import Workspace

_LOW_BITS = 33  # monotonically_increasing_id keeps the row's place in its partition here


def number_in_order(df: DataFrame, order: list[str], out: str, ws: Workspace) -> DataFrame:
    """Number the rows 1..n by ``order`` (which must be unique per row).

    The rows are range-partitioned and sorted, so a row's number is its place in its
    partition plus the sizes of the partitions before it. The only unpartitioned window
    sees one row per partition.
    """
    placed = ws.save(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id()),
        f"by-{out}",
    )
    part = F.shiftright("_place", _LOW_BITS)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(out, F.col("_start") + (F.col("_place") - F.shiftleft("_part", _LOW_BITS)) + 1)
        .drop("_part", "_start", "_place")
    )


def running_sum_before(df: DataFrame, group: list[str], order: str, values: dict[str, str],
                       chunk: int = 1 << 16) -> DataFrame:
    """Per group, the sum of ``values`` over the rows before this one in ``order``.

    ``order`` is a dense non-negative integer within its group. A group is cut into chunks
    of the order key; chunk totals are accumulated first, so no window sees more than one
    chunk of rows (or one row per chunk).
    """
    df = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    rows_before = (Window.partitionBy(*group, "_chunk").orderBy(order)
                   .rowsBetween(Window.unboundedPreceding, -1))
    chunks_before = (Window.partitionBy(*group).orderBy("_chunk")
                     .rowsBetween(Window.unboundedPreceding, -1))
    totals = df.groupBy(*group, "_chunk").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    totals = totals.select(
        *group, "_chunk",
        *[F.coalesce(F.sum(f"_t_{v}").over(chunks_before), F.lit(0)).alias(f"_t_{v}") for v in values],
    )
    local = df.select(
        "*", *[F.coalesce(F.sum(v).over(rows_before), F.lit(0)).alias(f"_l_{v}") for v in values]
    )
    out = local.join(totals, [*group, "_chunk"])
    for value, name in values.items():
        out = out.withColumn(name, F.col(f"_t_{value}") + F.col(f"_l_{value}"))
    return out.drop("_chunk", *[f"_t_{v}" for v in values], *[f"_l_{v}" for v in values])
