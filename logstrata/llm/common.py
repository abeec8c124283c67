"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logstrata.session import scratch_path

SLICE_BYTES = 4 * 1024 * 1024
WHITE = "[\\x20\\x09-\\x0D]+"
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def documents(spark, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: smaller than a checkpoint if large."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that :func:`stored` wrote and nothing reads any more."""
    hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = hadoop(folder)
        path.getFileSystem(conf).delete(path, True)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` less the columns an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in taken])


REST = "__rest"


def apart(df: DataFrame, used: list[str]) -> DataFrame:
    """The columns ``used``, and all others in one struct, where no name meets an operator's."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in used]
    rest = F.struct(*others) if others else F.lit(True)
    return df.select(*[F.col(f"`{c}`") for c in used], rest.alias(REST))


def together(columns: list[str], used: list[str]) -> list[Column]:
    """``columns`` of a table that went through :func:`apart`, by their names."""
    return [F.col(f"`{c}`") if c in used else F.col(f"{REST}.`{c}`").alias(c) for c in columns]


def append_columns(df: DataFrame, fields: list[T.StructField],
                   compute: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
                   needs: list[str], limit: int = SLICE_BYTES) -> DataFrame:
    """``df`` with columns computed per Arrow batch; a column of the same name is replaced.

    ``compute`` is called once in each task and gives the function for the batches, which sees
    the columns ``needs`` only, in that order, with about ``limit`` bytes of the first at once.
    """
    new = [f.name for f in fields]
    lent = [F.col(f"`{c}`").alias(f"__need_{i}") for i, c in enumerate(needs)]
    rest = without(df, new)
    kept = len(rest.columns)
    wide = df.select(*[df[f"`{c}`"] for c in rest.columns], *lent)
    schema = T.StructType([*rest.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = compute()
        for batch in batches:
            for part in sliced(batch, kept, limit):
                given = pa.RecordBatch.from_arrays(part.columns[kept:], list(needs))
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], *work(given)],
                                                 schema.names)

    return wide.mapInArrow(run, schema)


def sliced(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of one text or list column, a longer one alone.

    Rows in Python take many times their size in Arrow; this bounds what is unpacked at once.
    """
    held = batch.column(column)
    size = pc.multiply(pc.list_value_length(held), 8) if pa.types.is_list(held.type) \
        else pc.binary_length(held)
    size = size.fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // limit
    begin = 0
    for end in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]:
        if end > begin:
            yield batch.slice(begin, end - begin)
        begin = end


def byte_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text, none for null."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def coded_words(texts: list[bytes], lower: bool = False):
    """Words of a batch of texts: (code of every word in order, first word of each text and the
    end, the distinct words). Words are what lies between ASCII white space."""
    flat: list[bytes] = []
    bounds = np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        flat += (text.lower() if lower else text).split()
        bounds[i + 1] = len(flat)
    coded = pa.array(flat, pa.binary()).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), bounds, coded.dictionary.to_pylist()


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def rolling(hashes: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each run of ``length`` consecutive word hashes, in order."""
    n = max(0, len(hashes) - length + 1)
    total = np.zeros(n, np.uint64)
    for i in range(length):
        total = mixed(total * GOLDEN + hashes[i:i + n]) if i % 4 == 3 else \
            total * GOLDEN + hashes[i:i + n]
    return mixed(total)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
