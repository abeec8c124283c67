"""Hard negatives by inner products of whole numbers, many candidates in one wide integer."""

from __future__ import annotations

from collections.abc import Iterator
from operator import mul

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logstrata.llm.common import stored
from logstrata.llm.vectors import matrix, whole_vectors

POSITIVES, NEGATIVES = 5, 5
ANCHORS_A_BLOCK = 4096       # anchors held by one task
ROWS_A_BLOCK = 65536         # at most about so many rows held by one task
FIELDS = 4096                # candidates in one wide integer


class PackedCandidates:
    """Blocks of candidates, component by component, in the fields of wide integers.

    ``shift`` makes every component of candidates and anchors a number of 0 or more and below
    ``2 * shift``. The fields of a wide integer are 4 or 8 bytes, wide enough for the sum over
    all components of products of two such numbers, so no field runs over into the next one.
    """

    def __init__(self, candidates: np.ndarray, shift: int):
        self.shift, self.width = shift, candidates.shape[1]
        most = self.width * (2 * shift) ** 2
        if most >= 1 << 55:  # room for the fractions of scores, too
            raise ValueError("inner products of these vectors do not fit a long")
        self.field = np.dtype("<u4" if most < 1 << 32 else "<u8")
        self.sums = candidates.sum(1)
        self.blocks = []
        for begin in range(0, len(candidates), FIELDS):
            part = (candidates[begin:begin + FIELDS] + shift).astype(self.field)
            self.blocks.append((len(part), [int.from_bytes(np.ascontiguousarray(part[:, d]).tobytes(), "little")
                                            for d in range(self.width)]))

    def scores(self, anchor: np.ndarray) -> np.ndarray:
        """The exact inner product of the anchor with every candidate.

        One product of a wide integer and a small one for each component gives, in each field,
        the sum of (a + s)(c + s), which is the inner product, s times both sums, and s * s for
        every component.
        """
        times = (anchor + self.shift).tolist()
        found = []
        for n, packed in self.blocks:
            total = sum(map(mul, packed, times))
            fields = np.frombuffer(total.to_bytes(n * self.field.itemsize, "little"), self.field)
            found.append(fields.astype(np.int64))
        given = self.shift * int(anchor.sum()) + self.width * self.shift ** 2
        whole = np.concatenate(found) if found else np.zeros(0, np.int64)
        return whole - self.shift * self.sums - given


def first_of(scores: np.ndarray, places: np.ndarray, most: int) -> np.ndarray:
    """Of ``places`` (ascending), the ``most`` with the highest scores, best first; of equal
    scores the earlier place comes first."""
    own = scores[places]
    if len(places) > most:
        least = np.partition(own, len(own) - most)[len(own) - most]
        near = np.flatnonzero(own >= least)
        places, own = places[near], own[near]
    return places[np.argsort(-own, kind="stable")[:most]]


class _Block:
    """The rows of one task by ascending id, each id once, and their packed components."""

    def __init__(self, rows: pd.DataFrame, width: int, shift: int):
        values = matrix(pa.array(rows["__q"], pa.list_(pa.int64())), width)
        ids, labels = rows["__id"].to_numpy(np.int64), rows["__label"].to_numpy(np.int64)
        order = np.lexsort((*values.T[::-1], labels, ids))
        ids, labels, values = ids[order], labels[order], values[order]
        first = np.ones(len(ids), bool)
        first[1:] = ids[1:] != ids[:-1]
        self.ids, self.labels = ids[first], labels[first]
        self.packed = PackedCandidates(values[first], shift)
        self.by_label = np.argsort(self.labels, kind="stable")
        self.sorted_labels = self.labels[self.by_label]
        self.last: tuple[int | None, np.ndarray] = (None, self.by_label[:0])

    def same(self, label: int) -> np.ndarray:
        begin, end = np.searchsorted(self.sorted_labels, (label, label + 1))
        return self.by_label[begin:end]

    def other(self, label: int) -> np.ndarray:
        if self.last[0] != label:
            self.last = label, np.flatnonzero(self.labels != label)
        return self.last[1]


def _positives_of(block: _Block, anchors: np.ndarray, ids: list[int], labels: list[int],
                  most: int) -> Iterator[tuple]:
    for anchor, own, label in zip(anchors, ids, labels):
        scores, places = block.packed.scores(anchor), block.same(label)
        for p in first_of(scores, places[block.ids[places] != own], most).tolist():
            yield own, int(block.ids[p]), int(scores[p])


def _negatives_of(block: _Block, anchors: np.ndarray, ids: list[int], labels: list[int],
                  wanted: list, least: tuple[int, int], most: int) -> Iterator[tuple]:
    """Of each anchor and distinct positive score, the best rows of other labels in its range."""
    part, whole = least
    for i in np.argsort(labels, kind="stable").tolist():
        anchor, own, label, positive = anchors[i], ids[i], labels[i], wanted[i]
        scores, places = block.packed.scores(anchor), block.other(label)
        have = scores[places]
        for score in positive:
            near = places[(part * score <= whole * have) & (have <= score)]
            for p in first_of(scores, near, most).tolist():
                yield own, int(score), int(block.ids[p]), int(scores[p])


def hard_negatives(rows: DataFrame, is_anchor, id_col: str = "vec_id", label_col: str = "label",
                   vector_col: str = "embedding", factor: int = 256,
                   n_positives: int = POSITIVES, n_negatives: int = NEGATIVES,
                   least: tuple[int, int] = (80, 100)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A component x counts as floor(factor * x); a row's score is its whole-number inner product
    with the anchor. Higher scores come first, of equal ones the smaller id. The positives of an
    anchor (``is_anchor``, a condition on the columns of ``rows``) are its first ``n_positives``
    other rows of the same label. For each of them the first ``n_negatives`` rows of another
    label are returned whose score is at most the positive's and at least ``least`` (a fraction
    in whole numbers) of it; ``rank`` counts from 1.

    Rows take no part whose id, label or vector is null, or whose vector has a null, infinite or
    NaN component. A row is told by its id: of repeated rows, or rows of one id, that with the
    least label, then vector, counts. Shorter vectors count as filled up with zeros. An anchor
    without positives or without rows in the range gives no rows, an empty table none at all.
    Other columns are not read, whatever their names. Sums of products that do not fit a long
    end the job with an error.

    Rows are dealt into blocks by a hash of their id, anchors likewise; each block of anchors
    meets each block of rows in a task of its own, once for the positives and once for the
    negatives. Every block gives its best for every anchor, and the best of these are the result.
    Blocks have a bounded number of rows, so a task's memory does not grow with the table.
    """
    spark = rows.sparkSession
    asked = rows.select(F.col(f"`{id_col}`").cast("long").alias("__id"),
                        F.col(f"`{label_col}`").cast("long").alias("__label"),
                        F.coalesce(is_anchor, F.lit(False)).alias("__anchor"),
                        F.col(f"`{vector_col}`").alias("__vector"))
    asked = asked.where("__id is not null and __label is not null")
    table = stored(whole_vectors(asked, "__vector", factor, ["__id", "__label", "__anchor"]),
                   "whole-vectors")
    size = F.when(F.size("__q") > 0, F.greatest(F.abs(F.array_max("__q")), F.abs(F.array_min("__q"))))
    told = table.agg(F.count("*"), F.count_if("__anchor"), F.max(F.size("__q")), F.max(size)).first()
    n_rows, n_anchors, width = told[0], told[1], max(told[2] or 0, 1)
    shift = (told[3] or 0) + 1
    # More blocks than the size asks for, so that every core has work; the result is the same.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row_blocks = max(1, -(-n_rows // ROWS_A_BLOCK), min(tasks, -(-n_rows // 256)))
    anchor_blocks = max(1, -(-n_anchors // ANCHORS_A_BLOCK))

    of_rows = F.pmod(F.xxhash64("__id"), F.lit(row_blocks)).alias("__rows")
    of_anchors = F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(anchor_blocks)).alias("__anchors")
    every_anchors = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(anchor_blocks - 1).cast("long"))).alias("__anchors")
    every_rows = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))).alias("__rows")
    grid = ["__anchors", "__rows"]
    # An id's vectors are compared as lists, as the blocks do.
    anchors = table.where("__anchor").groupBy("__id").agg(
        F.min(F.struct("__label", "__q")).alias("__least")).select(
            "__id", "__least.__label", "__least.__q")
    candidates = table.select("__id", "__label", "__q", of_rows, every_anchors).toDF(
        "__id", "__label", "__q", "__rows", "__anchors")

    def unpacked(left: pd.DataFrame):
        values = matrix(pa.array(left["__q"], pa.list_(pa.int64())), width)
        return values, left["__id"].tolist(), left["__label"].tolist()

    def positives(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = list(_positives_of(_Block(right, width, shift), *unpacked(left), n_positives)) \
            if len(left) and len(right) else []
        return pd.DataFrame(found, columns=["__anchor_id", "__positive_id", "__score"], dtype="int64")

    dealt = anchors.select("__id", "__label", "__q", of_anchors, every_rows)
    best = dealt.groupBy(*grid).cogroup(candidates.groupBy(*grid)).applyInPandas(
        positives, "__anchor_id long, __positive_id long, __score long")
    order = Window.partitionBy("__anchor_id").orderBy(F.desc("__score"), "__positive_id")
    firsts = stored(best.withColumn("__n", F.row_number().over(order))
                    .where(F.col("__n") <= n_positives).drop("__n"), "positives")

    scored = firsts.groupBy("__anchor_id").agg(F.collect_set("__score").alias("__scores"))
    ready = anchors.join(scored, F.col("__id") == F.col("__anchor_id")).select(
        "__id", "__label", "__q", "__scores", of_anchors, every_rows)

    def negatives(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = list(_negatives_of(_Block(right, width, shift), *unpacked(left),
                                   [sorted(s) for s in left["__scores"]], least, n_negatives)) \
            if len(left) and len(right) else []
        return pd.DataFrame(found, columns=["__of", "__limit", "__negative_id", "__negative"],
                            dtype="int64")

    worst = ready.groupBy(*grid).cogroup(candidates.groupBy(*grid)).applyInPandas(
        negatives, "__of long, __limit long, __negative_id long, __negative long")
    order = Window.partitionBy("__of", "__limit").orderBy(F.desc("__negative"), "__negative_id")
    ranked = worst.withColumn("__rank", F.row_number().over(order)) \
        .where(F.col("__rank") <= n_negatives)
    return firsts.join(ranked, (F.col("__anchor_id") == F.col("__of"))
                       & (F.col("__score") == F.col("__limit"))).select(
        F.col("__anchor_id").alias("anchor_id"), F.col("__positive_id").alias("positive_id"),
        F.col("__rank").cast("int").alias("rank"), F.col("__negative_id").alias("negative_id"),
        F.col("__score").alias("positive_score"), F.col("__negative").alias("negative_score"))
