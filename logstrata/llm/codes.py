"""Compression of vectors to codes of their parts' nearest codebook entries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logstrata.llm.common import stored
from logstrata.llm.vectors import matrix, whole_vectors
from logstrata.operators.skew import lookup_side

PARTS, ENTRIES, ROUNDS = 8, 16, 6
BATCH = 4096                 # vectors searched at once


class EqualAverageSearch:
    """Nearest entries of one codebook, entries sorted by the sum of their components.

    The squared difference of two sums is at most the dimension times the squared distance. From
    the place of a vector's sum the search goes outward, always to the side with the smaller gap
    of sums, and ends when the squared gap over the dimension is strictly more than the best
    distance: an entry further out is further away, and one at the same distance is still met.
    """

    def __init__(self, entries: np.ndarray):
        self.dimension = max(1, entries.shape[1])
        sums = entries.sum(1)
        self.index = np.argsort(sums, kind="stable")
        self.sums, self.entries = sums[self.index], entries[self.index]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each vector; of equal distances the
        lower index."""
        n, k = len(vectors), len(self.sums)
        own = vectors.sum(1)
        best = np.full(n, -1, np.int64)
        distance = np.full(n, np.iinfo(np.int64).max, np.int64)
        up = np.searchsorted(self.sums, own)
        down = up - 1
        going = np.arange(n)
        while len(going):
            # The sums are far enough from the ends of the range of a long to stand for "none".
            far = np.iinfo(np.int64).max >> 2
            lo, hi, sums = down[going], up[going], own[going]
            gap_lo = np.where(lo >= 0, sums - self.sums[np.maximum(lo, 0)], far)
            gap_hi = np.where(hi < k, self.sums[np.minimum(hi, k - 1)] - sums, far)
            left = gap_lo <= gap_hi
            gap = np.where(left, gap_lo, gap_hi)
            # gap * gap / dimension > distance, without overflow for the gap of no entry.
            on = gap < far
            on[on] = gap[on] * gap[on] <= np.minimum(
                distance[going[on]], np.iinfo(np.int64).max // self.dimension) * self.dimension
            going, at, left = going[on], np.where(left, lo, hi)[on], left[on]
            if not len(going):
                break
            apart = vectors[going] - self.entries[at]
            found, name = np.einsum("ij,ij->i", apart, apart), self.index[at]
            better = (found < distance[going]) | ((found == distance[going]) & (name < best[going]))
            distance[going[better]], best[going[better]] = found[better], name[better]
            down[going[left]] -= 1
            up[going[~left]] += 1
        return best, distance


def _assigned(values: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, distances), vectors by parts."""
    each = values.shape[1] // len(books)
    found = [EqualAverageSearch(book).nearest(values[:, p * each:(p + 1) * each])
             for p, book in enumerate(books)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _matrices(batches: Iterator[pa.RecordBatch], column: int, width: int):
    for batch in batches:
        for begin in range(0, batch.num_rows, BATCH):
            part = batch.slice(begin, BATCH)
            yield part, matrix(part.column(column), width)


def _next_books(table: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    """Each entry replaced by the floor of its parts' mean; an entry without parts stays.

    A task sends one sum of every part position and entry; sums of all tasks are added by Spark.
    """
    each = width // len(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(books), books.shape[1], each), np.int64)
        count = np.zeros((len(books), books.shape[1]), np.int64)
        for _, values in _matrices(batches, 0, width):
            chosen, _ = _assigned(values, books)
            for p in range(len(books)):
                order = np.argsort(chosen[:, p], kind="stable")
                names, first = np.unique(chosen[order, p], return_index=True)
                part = values[order, p * each:(p + 1) * each]
                total[p, names] += np.add.reduceat(part, first, axis=0)
                count[p, names] += np.diff(np.append(first, len(order)))
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p), pa.array(e), pa.array(count[p, e]),
             pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    partial = table.select("__q").mapInArrow(sums, "part long, entry long, n long, sums array<long>")
    added = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[
        F.sum(F.element_at("sums", i + 1)) for i in range(each)]).alias("sums"))
    changed = books.copy()
    for row in added.collect():  # at most one row of every part position and entry
        changed[row.part, row.entry] = [s // row.n for s in row.sums]
    return changed


def train_codebooks(table: DataFrame, width: int, parts: int, entries: int, rounds: int) -> np.ndarray:
    """The codebooks as (part, entry, component), from a table (``__id``, ``__q``)."""
    first = table.select("__id", "__q").orderBy(F.asc_nulls_last("__id"), "__q").limit(entries).collect()
    start = np.zeros((len(first), width), np.int64)
    for i, row in enumerate(first):
        start[i, :len(row["__q"])] = row["__q"]
    books = start.reshape(len(first), parts, width // parts).swapaxes(0, 1)
    for _ in range(rounds):
        books = _next_books(table, books, width)
    return books


def compress_vectors(rows: DataFrame, id_col: str = "vec_id", label_col: str = "label",
                     vector_col: str = "embedding", factor: int = 4096, parts: int = PARTS,
                     entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((id, label, ``codes``, ``error``, ``label_error``), codebooks) of the rows with a vector.

    A component x counts as floor(factor * x). Vectors are cut in ``parts`` equal consecutive
    parts; the codebook of each part position starts as that part of the ``entries`` rows of
    least id and is improved in ``rounds`` rounds: every part goes to its nearest entry (squared
    distance, of equal ones the lower index), then every entry becomes the floor of its parts'
    mean. ``codes`` is the list of the parts' nearest entries in the end, ``error`` their squared
    distances added up, ``label_error`` the sum of the errors of all rows of that label, a null
    label being one of its own. Rows whose vector is null or has a null, infinite or NaN
    component are left out.

    Repeated rows are rows like others; of rows with one id the lesser vector starts a codebook
    first, null ids come last. With fewer rows than entries there are fewer entries; an empty
    table gives no rows and codebooks without entries. Vectors of unequal length, or of a length
    that the parts do not divide, count as filled up with zeros to the least length that fits
    all. Other columns are not read, whatever their names.

    Each round is one pass over the table, which is stored once as whole numbers. Only sums and
    counts of every part position and entry come to the driver: entries x vector length numbers.
    """
    kept = rows.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{label_col}`").alias("__label"),
                       F.col(f"`{vector_col}`").alias("__vector"))
    table = stored(whole_vectors(kept, "__vector", factor, ["__id", "__label"]), "whole-vectors")
    longest = table.agg(F.max(F.size("__q"))).first()[0] or 1
    width = -(-max(longest, 1) // parts) * parts
    books = train_codebooks(table, width, parts, entries, rounds)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in _matrices(batches, 2, width):
            chosen, distance = _assigned(values, books)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(list(chosen), pa.list_(pa.int64())),
                 pa.array(distance.sum(1))], ["__id", "__label", "codes", "error"])

    kinds = {c: rows.schema[n].dataType.simpleString()
             for c, n in (("__id", id_col), ("__label", label_col))}
    coded = stored(table.select("__id", "__label", "__q").mapInArrow(
        encode, f"__id {kinds['__id']}, __label {kinds['__label']}, codes array<long>, error long"),
        "codes")
    of_label = coded.groupBy("__label").agg(F.sum("error").alias("label_error")) \
        .withColumnRenamed("__label", "__same")
    told = coded.join(lookup_side(of_label), F.col("__label").eqNullSafe(F.col("__same")))
    return told.select(F.col("__id").alias(id_col), F.col("__label").alias(label_col), "codes",
                       "error", "label_error"), books


def codebooks_digest(books: np.ndarray) -> str:
    """The hash of all components in writing, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
