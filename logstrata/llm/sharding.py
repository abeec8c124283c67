"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logstrata.llm.common import without
from logstrata.session import cut_lineage

# Rows that one task permutes after the exchange. A shard of more rows is cut into equal buckets.
BUCKET_ROWS = 250_000
_NUMPY_LIMIT = 10 ** 9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` items out of good + bad are good. Exact law at any size."""
    if not good or not drawn:
        return 0
    if not bad:
        return drawn
    if good < _NUMPY_LIMIT and bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, drawn))
    low, high = max(0, drawn - bad), min(good, drawn)
    total = good + bad
    mean = drawn * good / total
    spread = 40 * math.sqrt(max(1.0, mean * (bad / total) * (total - drawn) / max(1, total - 1)))
    k = np.arange(max(low, int(mean - spread)), min(high, int(mean + spread)) + 1, dtype=np.float64)
    # Ratio of neighbouring probabilities, summed up from the lowest value: no large factorials.
    step = np.log((good - k[:-1]) / (k[:-1] + 1)) + np.log((drawn - k[:-1]) / (bad - drawn + k[:-1] + 1))
    weight = np.concatenate(([0.0], np.cumsum(step)))
    weight = np.cumsum(np.exp(weight - weight.max()))
    return int(k[min(len(k) - 1, int(np.searchsorted(weight, rng.random() * weight[-1], "right")))])


def draw_row(counts_before: list[int], sizes: np.ndarray, part: int, seed: int) -> np.ndarray:
    """Row ``part`` of the communication matrix: rows of this partition for each bucket.

    ``counts_before`` are running totals of the partitions' row counts, from 0. The matrix is
    split in halves of partitions; each half's totals are drawn from a generator seeded by the
    halves' place, so every task draws the same numbers and none needs the whole matrix.
    """
    low, high, have = 0, len(counts_before) - 1, sizes.astype(object)
    while high - low > 1:
        mid = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = counts_before[mid] - counts_before[low]
        rest = counts_before[high] - counts_before[low]
        first = np.zeros(len(have), object)
        for i, size in enumerate(have):  # one bucket after the other, from what is left
            first[i] = hypergeometric(rng, size, rest - size, left)
            left -= first[i]
            rest -= size
        if part < mid:
            have, high = first, mid
        else:
            have, low = have - first, mid
    return have.astype(np.int64)


def bucket_sizes(n_rows: int, n_shards: int, bucket_rows: int) -> list[tuple[int, int, int]]:
    """(shard, first slot, rows) of every bucket; shards and their buckets differ by one row."""
    found = []
    for shard in range(n_shards):
        rows = n_rows // n_shards + (shard < n_rows % n_shards)
        pieces, begin = max(1, -(-rows // bucket_rows)), 0
        for i in range(pieces):
            size = rows // pieces + (i < rows % pieces)
            found.append((shard, begin, size))
            begin += size
    return found


def shuffle_into_shards(rows: DataFrame, n_shards: int, seed: int = 0,
                        bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``: a uniform random order cut into equal shards.

    Shard sizes differ by one row at most, slots of a shard count from 0 without gaps. Every
    order of the rows is as likely as any other: the exact numbers of rows that go from each
    partition to each bucket are drawn from the law that a uniform shuffle has, each partition
    deals its rows out in random order, and each bucket is permuted again after the exchange.

    ``rows`` is written to the checkpoint folder once, which fixes partitions and their order, so
    a lost executor changes nothing; give the columns that identify a row and join the rest.
    Nulls, equal rows and any column types are fine, an empty table gives no rows, fewer rows
    than shards leave the last shards empty, columns named ``shard`` or ``slot`` are replaced.
    To the driver come one row count for each partition.
    """
    spark = rows.sparkSession
    names = ["shard", "slot"]
    fixed = cut_lineage(without(rows, names))
    found = fixed.groupBy(F.spark_partition_id().alias("p")).count().collect()
    parts = sorted((r["p"], r["count"]) for r in found)
    before = [0]
    for _, n in parts:
        before.append(before[-1] + n)
    buckets = bucket_sizes(before[-1], n_shards, bucket_rows)
    plan = spark.sparkContext.broadcast(([p for p, _ in parts], before, buckets))
    columns = fixed.columns
    schema = T.StructType([*fixed.schema.fields, T.StructField("shard", T.IntegerType()),
                           T.StructField("__begin", T.LongType()),
                           T.StructField("__order", T.LongType()),
                           T.StructField("__from", T.LongType())])

    def deal(batches):
        places, totals, all_buckets = plan.value
        me = bisect.bisect_left(places, TaskContext.get().partitionId())
        labels, done = None, 0
        for batch in batches:
            if labels is None:
                sizes = np.array([b[2] for b in all_buckets], np.int64)
                row = draw_row(totals, sizes, me, seed)
                rng = np.random.default_rng([seed, me])
                labels = rng.permutation(np.repeat(np.arange(len(sizes), dtype=np.int32), row))
                shard_of = np.array([b[0] for b in all_buckets], np.int32)
                begin_of = np.array([b[1] for b in all_buckets], np.int64)
            n = batch.num_rows
            mine = labels[done:done + n]
            order = rng.integers(-2 ** 63, 2 ** 63 - 1, n, np.int64)
            place = totals[me] + done + np.arange(n, dtype=np.int64)
            done += n
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(shard_of[mine]), pa.array(begin_of[mine]),
                 pa.array(order), pa.array(place)], schema.names)

    dealt = fixed.mapInArrow(deal, schema)
    within = Window.partitionBy("shard", "__begin").orderBy("__order", "__from")
    slot = (F.col("__begin") + F.row_number().over(within) - 1).alias("slot")
    return dealt.select(*[f"`{c}`" for c in columns], "shard", slot)
