"""Plans that hold when one key has a large share of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Each group has up to so many rows of sums, so more would cost small groups most of a copy.
SHARDS = 16


def lookup_side(df: DataFrame) -> DataFrame:
    """The small side of a join whose other side may be skewed.

    Spark splits a skewed partition of a join only if both inputs come straight from a
    shuffle. Keys that were just grouped or joined by the same key do not, so one extra
    shuffle of them (never of the large side) is what lets the large side be split.
    """
    return df.hint("rebalance")


def with_group_totals(df: DataFrame, grouping: list[str], spread: list[str],
                      sums: dict[str, Column], shards: int = SHARDS) -> DataFrame:
    """``df`` with the sum of each of ``sums`` over its group; NULL keys form groups too.

    A window over the rows would put a whole group into one task. Here a group is cut into
    shards by a hash of the ``spread`` columns: sums per shard first (combined before the
    shuffle), then a window over at most ``shards`` such sums per group, then a join of each
    row with the totals of its shard. Only shards that exist have a row, so small groups cost
    nothing extra.
    """
    shard = F.pmod(F.xxhash64(*spread), F.lit(shards)).alias("_shard")
    rows = df.select("*", shard)
    by_shard = [*grouping, "_shard"]
    parts = rows.groupBy(*by_shard).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    group = Window.partitionBy(*grouping)
    totals = parts.select(*[F.col(k).alias(f"_key_{k}") for k in by_shard],
                          *[F.sum(n).over(group).alias(n) for n in sums])
    same = [rows[k].eqNullSafe(totals[f"_key_{k}"]) for k in by_shard]
    # The totals are a row for each shard, so the rows, by far the larger side, need no sorting.
    joined = rows.join(totals.hint("shuffle_hash"), reduce(lambda a, b: a & b, same))
    return joined.select(*[rows[c] for c in df.columns], *[totals[n] for n in sums])
