"""Running numbers and runs over a total order, without a single-task window."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logstrata.operators.skew import lookup_side
from logstrata.session import cut_lineage

# monotonically_increasing_id keeps the row index of a partition in its low 33 bits.
_INDEX_BITS = 33

BLOCK_ROWS = 1 << 16


def with_line_number(df: DataFrame, order: list, name: str = "line_number",
                     start: int = 1) -> DataFrame:
    """Exact consecutive numbers in the given order, which must be total.

    A range sort gives ordered partitions; the sorted rows are stored once, because a second
    evaluation could cut the ranges elsewhere. The offsets table has one row per partition,
    whatever the size of the data, which is the bound that allows the broadcast.
    """
    placed = F.monotonically_increasing_id()
    ordered = cut_lineage(df.orderBy(*order).withColumn("_place", placed))
    part = F.shiftright("_place", _INDEX_BITS)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0))
                           .alias("_offset"))
    index = F.col("_place").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    return (ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_offset") + index + start)
            .select(name, *df.columns))


def sums_before(sizes: Column) -> Column:
    """Of a list of whole numbers the sum of those before each, as a list; NULL for a NULL list."""
    @F.arrow_udf("array<bigint>")
    def before(lists: pa.Array) -> pa.Array:
        held = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(held)))
        numbers = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        sums = np.concatenate(([0], np.cumsum(numbers)))
        values = sums[:-1] - np.repeat(sums[ends[:-1]], held)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()),
                                        mask=lists.is_null() if lists.null_count else None)

    return before(sizes)


def running_before(df: DataFrame, key: list[str], index: str, sums: dict[str, str],
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with sums over all rows before, by ``index`` (consecutive from 0) within a key.

    ``sums`` tells the new columns' names by the summed ones. A key's rows are cut in blocks:
    one window runs over the rows of a block, one over the totals of a key's blocks, so no task
    holds all rows of a large key.
    """
    block = F.floor(F.col(index) / block_rows)
    rows = df.select("*", block.alias("_block"))
    totals = rows.groupBy(*key, "_block").agg(*[F.sum(c).alias(f"_total_{c}") for c in sums])
    over = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*[F.col(k).alias(f"_of_{k}") for k in [*key, "_block"]], *[
        F.coalesce(F.sum(f"_total_{c}").over(over), F.lit(0)).alias(f"_base_{c}") for c in sums])
    inside = (Window.partitionBy(*key, "_block").orderBy(index)
              .rowsBetween(Window.unboundedPreceding, -1))
    local = rows.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{c}")
                               for c in sums])
    same = F.lit(True)
    for k in [*key, "_block"]:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return local.join(lookup_side(base), same).select(
        *df.columns, *[(F.col(f"_base_{c}") + F.col(f"_in_{c}")).alias(name)
                       for c, name in sums.items()])


def _last_before(df: DataFrame, order: str, value: str, out: str, block_rows: int,
                 levels: int) -> DataFrame:
    """The last ``value`` that is not NULL strictly before each row, across blocks."""
    if levels == 0:
        window = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.last(value, ignorenulls=True).over(window))
    block = f"{order}_{levels}"
    rows = df.withColumn(block, F.floor(F.col(order) / block_rows))
    window = (Window.partitionBy(block).orderBy(order)
              .rowsBetween(Window.unboundedPreceding, -1))
    local = rows.withColumn(out, F.last(value, ignorenulls=True).over(window))
    blocks = rows.groupBy(block).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_value"))
    carried = _last_before(blocks, block, "_value", "_carried", block_rows, levels - 1)
    return (local.join(carried.select(block, "_carried"), block, "left")
            .withColumn(out, F.coalesce(out, "_carried")).drop(block, "_carried"))


def with_runs(df: DataFrame, key: str, order: str, out: str = "run_start",
              block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mark runs of adjacent equal keys by the order value of their first row.

    ``order`` is a dense integer column such as ``line_number``. Rows are cut into blocks of
    consecutive numbers, so a run of any length spans many equal blocks instead of one task.
    Only block summaries are looked at in sequence, and those again in blocks: with the
    default block size the last, single-task level sees one row for 2**32 rows.
    """
    position = F.col(order)
    block = F.floor(position / block_rows)
    rows = df.withColumn("_block", block)
    window = Window.partitionBy("_block").orderBy(order)
    key_struct = F.struct(F.col(key).alias("key"))
    previous = F.lag(key_struct).over(window)
    local = (rows.withColumn("_previous", previous)
             .withColumn("_first", F.row_number().over(window) == 1)
             .withColumn("_starts", F.when(
                 ~F.col("_first") & ~F.col("_previous.key").eqNullSafe(F.col(key)), position))
             .withColumn("_start", F.last("_starts", ignorenulls=True).over(
                 window.rowsBetween(Window.unboundedPreceding, 0))))
    summary = local.groupBy("_block").agg(
        F.min(position).alias("_first_order"),
        F.min_by(key_struct, position).alias("_first_key"),
        F.max_by(key_struct, position).alias("_last_key"),
        F.max("_starts").alias("_last_start"))
    linked = _last_before(summary, "_block", "_last_key", "_before", block_rows, 1)
    opens = F.col("_before").isNull() | ~F.col("_before.key").eqNullSafe(F.col("_first_key.key"))
    linked = (linked.withColumn("_opening", F.when(opens, F.col("_first_order")))
              .withColumn("_anchor", F.coalesce("_last_start", "_opening")))
    carried = (_last_before(linked, "_block", "_anchor", "_carry", block_rows, 1)
               .select("_block", F.coalesce("_opening", "_carry").alias("_inherited")))
    return (local.join(carried, "_block")
            .withColumn(out, F.coalesce("_start", "_inherited"))
            .select(*df.columns, out))
