"""Benchmark decontamination with one Aho-Corasick automaton over normalised item windows."""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logstrata.llm.common import append_columns, byte_texts

WINDOW = 10
# Item text in one automaton. A larger benchmark is cut into blocks and the texts are scanned
# once for each block, so neither the driver nor a task holds more than this of it at once.
BLOCK_BYTES = 32 * 1024 * 1024

_WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127
               else 32 for c in range(256))

HIT = T.ArrayType(T.StructType([T.StructField("item", T.StringType()),
                                T.StructField("first", T.LongType()),
                                T.StructField("last", T.LongType())]))
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
          T.StructField("items", T.ArrayType(T.StringType())),
          T.StructField("spans", T.ArrayType(T.StructType([
              T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])))]
_HITS = pa.list_(pa.struct([("item", pa.string()), ("first", pa.int64()),
                            ("last", pa.int64())]))
_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def item_windows(items: list[tuple[str, bytes]], window: int) -> dict[str, tuple[int, list[str]]]:
    """Padded window text -> (its number of words, the items that have it)."""
    found: dict[str, tuple[int, list[str]]] = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            part = words[i:i + window]
            key = (b" " + b" ".join(part) + b" ").decode("latin-1")
            owners = found.setdefault(key, (len(part), []))[1]
            if not owners or owners[-1] != item:
                owners.append(item)
    return found


def automaton(items: list[tuple[str, bytes]], window: int) -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for key, (n, owners) in item_windows(items, window).items():
        built.add_word(key, (len(key), n, owners))
    if len(built):
        built.make_automaton()
    return built


# The last block a Python worker met, its window and its automaton. The block is held, so no
# other block can be taken for it.
_built: list = [None, 0, None]


def _cached(block: list, window: int) -> ahocorasick.Automaton:
    """The automaton of a block, built once in each Python worker."""
    if _built[0] is not block or _built[1] != window:
        _built[:] = block, window, automaton(block, window)
    return _built[2]


def _covered(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of runs of words (first, last) as disjoint runs."""
    joined: list[list[int]] = []
    for first, last in sorted(runs):
        if joined and first <= joined[-1][1] + 1:
            joined[-1][1] = max(joined[-1][1], last)
        else:
            joined.append([first, last])
    return [(a, b) for a, b in joined]


def _scan(text: bytes, built: ahocorasick.Automaton) -> tuple[int, dict[str, list]]:
    """Number of words and, for each item that occurs, its runs of words."""
    words = words_of(text)
    runs: dict[str, list] = {}
    if words and len(built):
        normal = b" " + b" ".join(words) + b" "
        found = list(built.iter(normal.decode("latin-1")))
        if found:
            gaps = np.flatnonzero(np.frombuffer(normal, np.uint8) == 32)
            starts = np.array([end - size + 1 for end, (size, _, _) in found])
            for first, (_, (_, n, owners)) in zip(np.searchsorted(gaps, starts).tolist(), found):
                for item in owners:
                    runs.setdefault(item, []).append((first, first + n - 1))
    return len(words), {item: _covered(r) for item, r in runs.items()}


def item_blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[list]:
    """The items, in blocks of about ``block_bytes`` of text."""
    rows = items.select(F.col(item_col).cast("string").alias("item"),
                        F.col(text_col).alias("text")).where("item is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = -(-size // block_bytes)
    part = F.pmod(F.xxhash64("item"), F.lit(max(1, blocks)))
    return [[(r.item, r.text.encode()) for r in rows.where(part == b).sort("item", "text").collect()]
            for b in range(blocks)]


def find_benchmark_text(docs: DataFrame, items: DataFrame, text_col: str = "text",
                        item_col: str = "item_id", item_text_col: str = "text",
                        window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items`` and ``spans``.

    A window is ``window`` consecutive words of an item, or all words of a shorter item. A
    document word inside an occurrence of any window is hit. ``items`` are the ids (as text,
    sorted as text, each once) of the items with an occurring window; ``spans`` are the hit runs
    as code point offsets into the text as given. Null and empty texts have no words and no
    hits, items without words or without an id match nothing, items with equal text are all
    named, repeated rows are treated alike, an empty item table leaves everything clean, and
    columns of ``docs`` named like a result are replaced.

    Each text is scanned once in each block of the benchmark (one, up to ``block_bytes``).
    """
    spark = docs.sparkSession
    blocks = [spark.sparkContext.broadcast(b)
              for b in item_blocks(items, item_col, item_text_col, block_bytes)]

    def scan_block(shared, last: bool):
        def compute():
            built = _cached(shared.value, window) if shared else ahocorasick.Automaton()

            def work(batch: pa.RecordBatch) -> list[pa.Array]:
                before = batch.column(1).to_pylist() if batch.num_columns > 1 else None
                counts, hits = [], []
                for i, text in enumerate(byte_texts(batch.column(0))):
                    n, runs = _scan(text, built)
                    hit = [{"item": item, "first": a, "last": b}
                           for item, r in runs.items() for a, b in r]
                    counts.append(n)
                    hits.append(before[i] + hit if before else hit)
                if not last:
                    return [pa.array(hits, _HITS)]
                return [pa.array(counts, pa.int64()), *_summary(batch.column(0), hits)]
            return work
        return compute

    out, needs = docs, [text_col]
    blocks = blocks or [None]
    for shared in blocks[:-1]:
        out = append_columns(out, [T.StructField("__hits", HIT)], scan_block(shared, False), needs)
        needs = [text_col, "__hits"]
    return append_columns(out, FIELDS, scan_block(blocks[-1], True), needs).drop("__hits")


def _summary(texts: pa.Array, hits: list[list[dict]]) -> list[pa.Array]:
    """Columns n_hit, items and spans; offsets are looked up for texts with a hit only."""
    n_hit, items, spans = [], [], []
    for i, found in enumerate(hits):
        runs = _covered([(h["first"], h["last"]) for h in found])
        n_hit.append(sum(b - a + 1 for a, b in runs))
        items.append(sorted({h["item"] for h in found}))
        at = [m.span() for m in _WORD.finditer(texts[i].as_py().translate(_LOWER))] if runs else []
        spans.append([{"begin": at[a][0], "end": at[b][1]} for a, b in runs])
    return [pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())),
            pa.array(spans, _SPANS)]


_LOWER = {c: c + 32 for c in range(65, 91)}
