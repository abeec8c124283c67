"""Repeated passages by prefix-partitioned suffix trees.

A passage of ``window`` words that starts in two places is found in the suffix tree of all word
sequences as an internal node at least that deep. The tree is never built whole: suffixes are
split by a prefix of variable length, which ends with the smallest hash of ``GRAM`` words within
the first ``window`` words. Suffixes that agree in their first ``window`` words agree in this
prefix, so they meet in one group, and prefixes that occur once are dropped early. Suffixes of one
document that end their prefix at the same place travel together as one segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logstrata.llm.common import (GOLDEN, append_columns, byte_texts, coded_words, mixed,
                                  rolling, signed, sliced, without, word_hashes)
from logstrata.operators.skew import lookup_side
from logstrata.session import cut_lineage

WINDOW = 35
GRAM = 8
# Different segments of a group that one subtree is built from. A larger group is split by longer
# prefixes, up to the whole window.
GROUP = 4_000
TOGETHER = 8_000  # segments whose subtrees a task builds at once
_SHAPE = 10  # bits for a segment's number of suffixes and the place of its prefix's end

_INVERSE = np.uint64(pow(int(GOLDEN), -1, 1 << 64))


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of the least one, the first of equal ones."""
    n = max(0, len(values) - width + 1)
    at, span = np.arange(len(values)), 1
    while span * 2 <= width:
        left, right = at[:len(at) - span], at[span:]
        at = np.where(values[left] <= values[right], left, right)
        span *= 2
    left, right = at[:n], at[width - span:width - span + n]
    return np.where(values[left] <= values[right], left, right)


def segments_of(codes: np.ndarray, bounds: np.ndarray, hashes: np.ndarray, window: int):
    """Segments of a batch of texts, as arrays (text, first suffix's word, suffixes, key, content).

    ``key`` is the hash at the end of the shared prefix, ``content`` a hash of all words of the
    segment and of its shape.
    """
    n = len(codes)
    if n < window:
        return [np.zeros(0, np.int64)] * 5
    grams = rolling(hashes, GRAM)
    ends = sliding_argmin(grams, window - GRAM + 1)
    text_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    starts = np.flatnonzero(text_of[:len(ends)] == text_of[window - 1:])
    if not len(starts):
        return [np.zeros(0, np.int64)] * 5
    end = ends[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (end[1:] != end[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    low = starts[first]
    count = np.diff(np.append(first, len(starts)))
    end = end[first]
    # Hash of a run of words from running sums of a polynomial: independent of its place.
    power = np.full(n, GOLDEN)
    power[0] = 1
    power = np.cumprod(power)
    inverse = np.full(n, _INVERSE)
    inverse[0] = 1
    inverse = np.cumprod(inverse)
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(hashes + GOLDEN) * power)))
    content = mixed((run[low + count + window - 1] - run[low]) * inverse[low])
    shape = ((count << 5) | (end - low)).astype(np.uint64)
    content = (content << np.uint64(_SHAPE)) | shape
    text = text_of[low]
    return text, low - bounds[text], count, signed(grams[end]), signed(content)


def shape_of(content):
    """(number of suffixes, words before the prefix's last ``GRAM``) of a segment."""
    return (content >> 5) & 31, content & 31


def repeated_suffixes(groups: np.ndarray, segments: list[bytes], counts: np.ndarray,
                      window: int) -> np.ndarray:
    """Which suffixes of each segment start a window found twice in its group, as bits.

    The groups' suffix trees down to the depth of a window, as sorted suffixes and the lengths
    of their common prefixes: neighbours with a common prefix of a whole window lie below one
    internal node that deep. The group comes first in the order, so many small trees are built
    at once.
    """
    codes, bounds, _ = coded_words(segments)
    owner = np.repeat(np.arange(len(segments)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = bounds[owner] + place
    rows = np.empty((len(owner), window + 1), ">u4")
    rows[:, 0] = np.unique(groups, return_inverse=True)[1][owner]
    rows[:, 1:] = codes[start[:, None] + np.arange(window)]
    order = np.argsort(rows.view(f"V{4 * (window + 1)}").ravel(), kind="stable")
    differs = rows[order[1:]] != rows[order[:-1]]
    common = np.where(differs.any(1), differs.argmax(1) - 1, window)
    deep = np.zeros(len(order), bool)
    deep[1:] |= common >= window
    deep[:-1] |= common >= window
    found = np.zeros(len(segments), np.int64)
    hit = order[deep]
    np.bitwise_or.at(found, owner[hit], np.int64(1) << place[hit])
    return found


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``__rid`` and ``__size``, which name a row by its id and text."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select("*", F.xxhash64(F.col(f"`{id_col}`"), text).alias("__rid"),
                       F.octet_length(text).cast("long").alias("__size"))


def _segments(rows: DataFrame, text_col: str, window: int) -> DataFrame:
    given = rows.select("__rid", "__size", F.col(f"`{text_col}`").alias("__text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sliced(whole, 2)):
            codes, bounds, words = coded_words(byte_texts(batch.column(2)))
            hashes = word_hashes(words)[codes] if len(words) else np.zeros(0, np.uint64)
            text, low, _, key, content = segments_of(codes, bounds, hashes, window)
            size = batch.column(1).to_numpy()[text]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(content), pa.array(batch.column(0).to_numpy()[text]),
                 pa.array((size << 32) | low)], ["key", "content", "rid", "place"])

    return given.mapInArrow(find, "key long, content long, rid long, place long")


_LISTED = "struct<key:long,content:long,low:long,hot:boolean>"


def _texts_of(needed: DataFrame, keyed: DataFrame, text_col: str, window: int) -> DataFrame:
    """The words of segments of groups to be split by a subtree, and of the suffixes of others.

    Of an ordinary group come (key, content, words); of a hot one a row for each suffix with a
    hash of its whole window in place of the words.
    """
    lists = needed.groupBy(F.col("rid").alias("__r"), F.col("size").alias("__s")).agg(
        F.collect_list(F.struct("key", "content", "low", "hot")).alias("__asked"))
    texts = keyed.select(F.col(f"`{text_col}`").alias("__text"), "__rid", "__size")
    joined = texts.join(lookup_side(lists), (F.col("__rid") == F.col("__r"))
                        & (F.col("__size") == F.col("__s")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sliced(whole, 0)):
            asked = batch.column(1)
            rows = []
            for i, text in enumerate(byte_texts(batch.column(0))):
                words = text.split()
                for a in asked[i].as_py():
                    count, _ = shape_of(a["content"])
                    segment = words[a["low"]:a["low"] + count + window - 1]
                    if not a["hot"]:
                        rows.append((a["key"], a["content"], b" ".join(segment), None, None))
                        continue
                    hashes = word_hashes(segment)
                    one, two = rolling(hashes, window), rolling(mixed(hashes), window)
                    rows += [(a["key"], a["content"], None, k, h)
                             for k, h in enumerate(signed(one ^ (two << np.uint64(1))).tolist())]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                 pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.int32()),
                 pa.array(columns[4], pa.int64())], ["key", "content", "words", "k", "prefix"])

    return joined.select("__text", "__asked").mapInArrow(cut, "key long, content long, words binary, k int, prefix long")


def _marked(segments: DataFrame, keyed: DataFrame, text_col: str, window: int,
            group: int) -> DataFrame:
    """(key, content, bits): which suffixes of a segment start a repeated window."""
    kinds = segments.groupBy("key", "content").agg(
        F.count("*").alias("n"), F.min(F.struct("rid", "place")).alias("one"))
    counts = kinds.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1") \
        .withColumnRenamed("key", "__key")
    split = kinds.join(lookup_side(counts), kinds["key"] == counts["__key"]).select(
        "key", "content", F.col("one.rid").alias("rid"),
        F.shiftright("one.place", 32).alias("size"),
        F.col("one.place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"),
        (F.col("kinds") > group).alias("hot"))
    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in (part for whole in batches for part in sliced(whole, 2)):
            waiting.append(batch)
            if sum(w.num_rows for w in waiting) >= TOGETHER:
                rows = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                key = rows.column(0).to_numpy()
                end = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
                if end:
                    yield work(rows.slice(0, end))
                waiting = [rows.slice(end)]
        if waiting and (rows := pa.Table.from_batches(waiting).combine_chunks().to_batches()):
            yield work(rows[0])

    def work(rows: pa.RecordBatch) -> pa.RecordBatch:
        key, content = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        bits = repeated_suffixes(key, rows.column(2).to_pylist(), shape_of(content)[0], window)
        keep = bits != 0
        return pa.RecordBatch.from_arrays(
            [pa.array(key[keep]), pa.array(content[keep]), pa.array(bits[keep])],
            ["key", "content", "bits"])

    # Whole groups meet in a partition, in order; a task holds a few thousand segments at a time.
    texts = _texts_of(split.where("not hot"), keyed, text_col, window)
    plain = texts.select("key", "content", "words").repartition("key") \
        .sortWithinPartitions("key").mapInArrow(subtrees, "key long, content long, bits long")
    # The longest prefix: suffixes of a hot group, each with the others that share its window.
    deep = _texts_of(split.where("hot"), keyed, text_col, window)
    twice = deep.groupBy("key", "prefix").agg(F.count("*").alias("n")).where("n > 1") \
        .select(F.col("key").alias("__key"), F.col("prefix").alias("__prefix"))
    hot = deep.join(lookup_side(twice), (F.col("key") == F.col("__key"))
                    & (F.col("prefix") == F.col("__prefix"))) \
        .groupBy("key", "content").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("bits"))
    # A segment found twice is repeated as a whole.
    full = kinds.where("n > 1").select("key", "content", F.expr(
        "shiftleft(1L, cast(shiftright(content, 5) & 31 as int)) - 1").alias("bits"))
    return plain.union(hot).union(full).groupBy("key", "content").agg(
        F.bit_or("bits").alias("bits"))


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """``docs`` with ``repeats``: runs of words covered by windows that also start elsewhere.

    Words lie between ASCII white space; a window is ``window`` (9 to 38) consecutive words of
    one text; it counts if its words also start at any other place, of the same text or another,
    equal texts and repeated rows included. ``repeats`` is a list of (first word, end), in order
    and apart; empty where nothing repeats, and for null, empty and short texts. Rows are known
    by ``id_col`` (null allowed, ties too) and text. A column named ``repeats`` is replaced;
    other names may be any. An empty table gives no rows.

    Texts are read twice to hash them, and moved once. Prefixes are counted before the shuffle;
    only segments whose prefix occurs twice are moved further. Groups of more than ``group``
    different segments are split by the longest prefix, so no task holds a hot group.
    """
    if not GRAM < window < 39:
        raise ValueError("a window has 9 to 38 words")
    rows = _keyed(without(docs, ["repeats", "__rid", "__size", "__r", "__s", "__found"]), id_col,
                  text_col)
    names = [c for c in rows.columns if c not in ("__rid", "__size")]
    segments = _segments(rows, text_col, window)
    common = segments.groupBy("key").agg(F.count("*").alias("n")).where("n > 1") \
        .select(F.col("key").alias("__key"))
    again = cut_lineage(segments.join(lookup_side(common), F.col("key") == F.col("__key"))
                        .drop("__key"))
    marked = _marked(again, rows, text_col, window, group) \
        .withColumnsRenamed({"key": "__key", "content": "__content"})
    found = again.join(lookup_side(marked), (F.col("key") == F.col("__key"))
                       & (F.col("content") == F.col("__content")))
    lists = found.groupBy(F.col("rid").alias("__r"), F.shiftright("place", 32).alias("__s")).agg(
        F.collect_set(F.struct(F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"),
                               "bits")).alias("__found"))
    joined = rows.join(lookup_side(lists), (F.col("__rid") == F.col("__r"))
                       & (F.col("__size") == F.col("__s")), "left")
    spans = T.ArrayType(T.StructType([T.StructField("first", T.LongType()),
                                      T.StructField("end", T.LongType())]))
    schema = T.StructType([*[rows.schema[n] for n in names], T.StructField("repeats", spans)])
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = [_runs(one, window) for one in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(names)], pa.array(merged, kind)],
                                             schema.names)

    return joined.select(*[f"`{n}`" for n in names], "__found").mapInArrow(merge, schema)


def _runs(found: list[dict] | None, window: int) -> list[dict]:
    starts = sorted({f["low"] + k for f in found or [] for k in range(f["bits"].bit_length())
                     if f["bits"] >> k & 1})
    runs: list[dict] = []
    for s in starts:
        if runs and s <= runs[-1]["end"]:
            runs[-1]["end"] = s + window
        else:
            runs.append({"first": s, "end": s + window})
    return runs


def kept_words(text: bytes, repeats: list[dict]) -> tuple[int, int, bytes]:
    """(words, words removed, the others joined by one space) of a text."""
    words = text.split()
    kept, at = [], 0
    for run in repeats:
        kept += words[at:run["first"]]
        at = run["end"]
    kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated words (see ``find_repeats``) taken out of the texts.

    A text that loses words becomes the others, joined by one space; all other texts stay as
    they are. Every row stays.
    """
    found = find_repeats(docs, id_col, text_col, window)
    names = [c for c in found.columns if c != "repeats"]

    def cut():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = [kept_words(text or b"", runs)[2] if runs else text for text, runs in
                     zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist())]
            return [pa.array(texts, pa.binary()).cast(pa.string())]
        return work

    field = T.StructField("__kept", T.StringType())
    shorter = append_columns(found, [field], cut, [text_col, "repeats"])
    return shorter.select(*[F.col("__kept").alias(c) if c == text_col else f"`{c}`" for c in names])
