"""Word n-gram model in Elias-Fano tries, one for each shard of the contexts.

The model is a bigram model over words, a begin and an end mark. With c for counts in the learnt
texts, mu for the weight of the shorter model, N for all tokens and V for distinct ones:

    P(w | v) = c(v, w) / (c(v) + mu)                                       if c(v, w) > 0
             = mu / (c(v) + mu) * (c(w) + 0.1) / (N + 0.1 * (V + 1))       otherwise

The share that the shorter model gives to words seen after v is not dealt out again, so the
probabilities after a context sum to at most one. Probabilities of seen pairs and the weights of
contexts are quantised to 8 bits each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logstrata.llm.common import GOLDEN, byte_texts, coded_words, mixed, signed, sliced, stored, word_hashes
from logstrata.operators.skew import lookup_side
from logstrata.session import cut_lineage

MU = 2.0
SHARD_TOKENS = 2_500_000     # pairs of a shard; a context with more is split
FLUSH_TOKENS = 2_000_000     # pairs that a task packs at once
BYTES_OF_WORD = 6.0          # to tell the number of shards from the bytes of all texts
HASH_BITS = 48
BEGIN, END = np.uint64(1), np.uint64(2)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


# ---------------------------------------------------------------- Elias-Fano

class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary, two bits a value and more.

    ``to_arrays`` and ``from_arrays`` use flat arrays, which may lie in mapped memory.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, n: int, width: int):
        self.low, self.high, self.n, self.width = low, high, n, width

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        width = max(0, (top // max(1, n)).bit_length() - 1)
        bits = np.zeros(0, np.uint8)
        if width:
            powers, parts = np.arange(width, dtype=np.uint64), []
            for begin in range(0, n, 1 << 15):  # whole bytes each
                part = values[begin:begin + (1 << 15), None] >> powers
                parts.append(np.packbits((part & np.uint64(1)).astype(np.uint8).ravel(),
                                         bitorder="little"))
            bits = np.concatenate(parts)
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(bits, np.packbits(unary, bitorder="little"), n, width)

    def values(self) -> np.ndarray:
        """All values again."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        found = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.width)
        if self.width:
            bits = np.unpackbits(self.low, count=self.n * self.width, bitorder="little")
            powers = np.uint64(1) << np.arange(self.width, dtype=np.uint64)
            for begin in range(0, self.n, 1 << 16):
                part = bits[begin * self.width:(begin + (1 << 16)) * self.width]
                low = part.reshape(-1, self.width).astype(np.uint64) @ powers
                found[begin:begin + len(low)] |= low
        return found

    def successor(self, targets: np.ndarray) -> np.ndarray:
        """For each target the place of the first value not less than it."""
        return np.searchsorted(self.values(), np.asarray(targets, np.uint64), "left")

    def to_arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width], np.int64), self.low, self.high]

    @classmethod
    def from_arrays(cls, arrays: list[np.ndarray]) -> EliasFano:
        return cls(arrays[1], arrays[2], int(arrays[0][0]), int(arrays[0][1]))


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(8-bit code of each value, mean value of each code): 256 bins of equal width."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1)
    low, span = values.min(), max(float(np.ptp(values)), 1e-9)
    bins = np.minimum(255, ((values - low) * (256 / span)).astype(np.int64))
    count = np.bincount(bins, minlength=256)
    return bins.astype(np.uint8), np.bincount(bins, values, 256) / np.maximum(1, count)


class Trie:
    """Two levels: contexts with pointers into their successors, and successors by context.

    ``words`` are the sorted hashes of all words of the shard, whose places are the word numbers.
    A successor is stored as its word number plus the context's place times the number of words,
    which makes the whole level one increasing sequence: it is searched relative to its context.
    """

    NAMES = ("words", "contexts", "pointers", "successors")

    def __init__(self, levels: dict[str, EliasFano], codes: np.ndarray, book: np.ndarray,
                 weight_codes: np.ndarray, weight_book: np.ndarray):
        self.levels, self.codes, self.book = levels, codes, book
        self.weight_codes, self.weight_book = weight_codes, weight_book

    @classmethod
    def of(cls, v: np.ndarray, w: np.ndarray, log_p: np.ndarray, contexts: np.ndarray,
           log_weight: np.ndarray) -> Trie:
        """From distinct pairs sorted by v and w, and the sorted contexts with their weights."""
        words = np.unique(np.concatenate((contexts, w)))
        place = np.searchsorted(contexts, v)
        pointers = np.searchsorted(place, np.arange(len(contexts) + 1))
        relative = place.astype(np.uint64) * np.uint64(len(words)) + np.searchsorted(words, w).astype(np.uint64)
        levels = {"words": words, "contexts": np.searchsorted(words, contexts),
                  "pointers": pointers, "successors": relative}
        return cls({k: EliasFano.of(x) for k, x in levels.items()}, *quantised(log_p),
                   *quantised(log_weight))

    def look_up(self, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context known, its log weight, log probability or NaN) of pairs."""
        words, contexts = self.levels["words"], self.levels["contexts"]
        all_words = words.values()

        def number(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.searchsorted(all_words, x)
            return at, (at < len(all_words)) & (all_words[np.minimum(at, len(all_words) - 1)] == x)

        if not len(all_words):
            return np.zeros(len(v), bool), np.zeros(len(v)), np.full(len(v), np.nan)
        v_at, v_in = number(v)
        w_at, w_in = number(w)
        at = contexts.successor(v_at)
        all_contexts = contexts.values()
        known = v_in & (at < len(all_contexts))
        known[known] = all_contexts[at[known]] == v_at[known]
        at = np.where(known, at, 0)
        weight = np.where(known, self.weight_book[self.weight_codes[at]], 0.0)
        found = np.full(len(v), np.nan)
        ask = np.flatnonzero(known & w_in)
        target = at[ask].astype(np.uint64) * np.uint64(len(all_words)) + w_at[ask].astype(np.uint64)
        end = self.levels["pointers"].values()[at[ask] + 1]
        children = self.levels["successors"].values()
        place = np.searchsorted(children, target)
        hit = (place < end.astype(np.int64))
        hit[hit] = children[place[hit]] == target[hit]
        found[ask[hit]] = self.book[self.codes[place[hit]]]
        return known, weight, found

    def to_bytes(self) -> bytes:
        """One flat buffer: a table of lengths, then every array from a multiple of 8."""
        arrays = [a for n in self.NAMES for a in self.levels[n].to_arrays()]
        arrays += [self.codes, self.book, self.weight_codes, self.weight_book]
        parts = [np.array([a.nbytes for a in arrays], np.int64).tobytes()]
        for a in arrays:
            parts += [a.tobytes(), b"\0" * (-a.nbytes % 8)]
        return b"".join(parts)

    @classmethod
    def from_buffer(cls, buffer) -> Trie:
        """A trie over a buffer, such as a mapped file, without a copy."""
        kinds = [np.int64, np.uint8, np.uint8] * 4 + [np.uint8, np.float64] * 2
        sizes, at, arrays = np.frombuffer(buffer, np.int64, len(kinds)), 8 * len(kinds), []
        for size, kind in zip(sizes.tolist(), kinds):
            arrays.append(np.frombuffer(buffer, kind, size // np.dtype(kind).itemsize, at))
            at += size + -size % 8
        levels = {n: EliasFano.from_arrays(arrays[3 * i:3 * i + 3]) for i, n in enumerate(cls.NAMES)}
        return cls(levels, *arrays[12:])


# ---------------------------------------------------------------- packing of pairs

def _tokens(batch: pa.RecordBatch, column: int):
    """(v, w, text) of all pairs of a batch; every text begins with BEGIN and ends with END."""
    texts = [t.translate(_LOWER) for t in byte_texts(batch.column(column))]
    codes, bounds, words = coded_words(texts)
    hashes = _word_hash(words)[codes] if words else np.zeros(0, np.uint64)
    n = np.diff(bounds)
    text = np.repeat(np.arange(len(n)), n + 1)
    w = np.full(len(text), END)
    v = np.full(len(text), BEGIN)
    own = np.arange(len(codes)) + np.repeat(np.arange(len(n)), n)
    w[own] = hashes
    v[own + 1] = hashes
    return v, w, text


def _squeezed(x: np.ndarray, kind) -> bytes:
    """Bytes of an array, the first bytes of all numbers first, compressed."""
    raw = np.ascontiguousarray(x.astype(kind)).view(np.uint8).reshape(len(x), -1).T.tobytes()
    return len(x).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True) if len(x) else b"\0" * 4


def _pack(v: np.ndarray, w: np.ndarray, text: np.ndarray, rids: np.ndarray, held: np.ndarray) -> bytes:
    order = np.lexsort((w, v))
    v, w, text = v[order], w[order], text[order]
    contexts, count = np.unique(v, return_counts=True)
    words, place = np.unique(w, return_inverse=True)
    used, own = np.unique(text, return_inverse=True)
    parts = [_squeezed(np.diff(contexts, prepend=np.uint64(0)), np.uint64), _squeezed(count, np.uint32),
             _squeezed(np.diff(words, prepend=np.uint64(0)), np.uint64), _squeezed(place, np.uint32),
             _squeezed(own, np.uint32), _squeezed(rids[used], np.int64), _squeezed(held[used], np.uint8)]
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _unpack(data: bytes):
    found, at = [], 0
    for kind in (np.uint64, np.uint32, np.uint64, np.uint32, np.uint32, np.int64, np.uint8):
        size = int.from_bytes(data[at:at + 4], "little")
        n = int.from_bytes(data[at + 4:at + 8], "little")
        width = np.dtype(kind).itemsize
        raw = pa.decompress(data[at + 8:at + 4 + size], n * width, "zstd", asbytes=True) if n else b""
        found.append(np.frombuffer(raw, np.uint8).reshape(width, n).T.copy().view(kind).ravel())
        at += 4 + size
    contexts, count, words, place, own, rids, held = found
    return np.repeat(np.cumsum(contexts), count), np.cumsum(words)[place], own, rids, held


def _shard_of(v: np.ndarray, w: np.ndarray, hot: np.ndarray, pieces: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a pair: by its context, for a hot context by a piece of its successors too."""
    spread = np.zeros(len(v), np.uint64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, v), len(hot) - 1)
        split = hot[at] == v
        spread[split] = mixed(w[split]) % pieces[at[split]].astype(np.uint64)
    return (mixed(v * GOLDEN + spread) % np.uint64(shards)).astype(np.int64)


# ---------------------------------------------------------------- the operator

def _word_hash(words: list[bytes]) -> np.ndarray:
    return np.maximum(word_hashes(words) >> np.uint64(64 - HASH_BITS), np.uint64(3))


def _hot_contexts(rows: DataFrame, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts with more pairs than half a shard: (sorted hashes, pairs, learnt pairs).

    Such a context has at least half a shard's share of some slice of the texts, so slices
    report what has a quarter; these few, the begin mark (an empty word here) among them, are
    then counted exactly. Their number is bounded by that of the shards.
    """
    def slices(batches):
        for batch in (part for whole in batches for part in sliced(whole, 2)):
            codes, bounds, words = coded_words([t.translate(_LOWER) for t in byte_texts(batch.column(2))])
            yield codes, bounds, words, ~batch.column(1).to_numpy(zero_copy_only=False)

    def often(batches):
        for codes, bounds, words, _ in slices(batches):
            count = np.bincount(codes, minlength=len(words))
            keep = np.flatnonzero(count * 4 * shards >= len(codes) + len(bounds))
            yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in keep], pa.binary())], ["v"])

    reported = rows.mapInArrow(often, "v binary").distinct().collect()
    seen = [b""] + [bytes(r.v) for r in reported]

    def exact(batches):
        place = {w: i for i, w in enumerate(seen)}
        for codes, bounds, words, learnt in slices(batches):
            size = np.diff(bounds)
            own = [(i, place[w]) for i, w in enumerate(words) if w in place]
            every = np.bincount(codes, minlength=len(words))
            ours = np.bincount(codes, np.repeat(learnt, size), len(words)).astype(np.int64)
            ids = [0] + [p for _, p in own]
            yield pa.RecordBatch.from_arrays(
                [pa.array([seen[p] for p in ids], pa.binary()),
                 pa.array([len(size)] + [int(every[i]) for i, _ in own]),
                 pa.array([int(learnt.sum())] + [int(ours[i]) for i, _ in own])],
                ["v", "n", "learnt"])

    counts = rows.mapInArrow(exact, "v binary, n long, learnt long").groupBy("v").agg(
        F.sum("n").alias("n"), F.sum("learnt").alias("learnt")).where(F.col("n") > SHARD_TOKENS // 2)
    found = [(bytes(r.v), r.n, r.learnt) for r in counts.collect()]
    hashes = np.where([not f[0] for f in found], BEGIN, _word_hash([f[0] for f in found])) \
        if found else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    return (hashes[order].astype(np.uint64), np.array([f[1] for f in found], np.int64)[order],
            np.array([f[2] for f in found], np.int64)[order])


def _scored(blobs: list[bytes], hot: np.ndarray, hot_learnt: np.ndarray, mu: float):
    """Of one shard: sums by text, unigram counts of its contexts, and pairs not seen."""
    v, w, text, rids, held = [], [], [], [], []
    texts = 0
    for blob in blobs:
        bv, bw, own, brids, bheld = _unpack(blob)
        v.append(bv)
        w.append(bw)
        text.append((own + np.uint32(texts)).astype(np.int32))
        rids.append(brids)
        held.append(bheld.astype(bool))
        texts += len(brids)
    v, w, text, rids, held = (np.concatenate(x) for x in (v, w, text, rids, held))
    order = np.lexsort((w, v)).astype(np.int32)
    v, w, text = v[order], w[order], text[order]
    del order
    learnt = ~held[text]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
    first = np.flatnonzero(new)
    pair = (np.cumsum(new) - 1).astype(np.int32)
    pair_v, pair_w = v[first], w[first]
    count = np.bincount(pair, learnt, len(first))
    all_contexts, context = np.unique(pair_v, return_inverse=True)
    total = np.bincount(context, count, len(all_contexts))
    split = np.isin(all_contexts, hot)
    total[split] = hot_learnt[np.searchsorted(hot, all_contexts[split])]
    seen = count > 0
    used = total > 0
    trie = Trie.of(pair_v[seen], pair_w[seen],
                   np.log10(count[seen] / (total[context[seen]] + mu)),
                   all_contexts[used], np.log10(mu / (total[used] + mu)))
    trie = Trie.from_buffer(trie.to_bytes())
    _, weight, log_p = trie.look_up(pair_v, pair_w)
    known = ~np.isnan(log_p[pair])
    words = v != BEGIN
    of_word = total[context][pair]
    sums = pd.DataFrame({
        "kind": 0, "a": rids, "n": np.bincount(text, words & (of_word > 0), texts).astype(np.int64),
        "x": np.bincount(text, np.where(words, np.log10(of_word + 0.1), 0.0), texts),
        "y": np.bincount(text, np.where(known, log_p[pair], 0.0), texts)})
    sums["b"] = np.int64(0)
    sums = sums.groupby("a", as_index=False).agg({"kind": "first", "b": "first", "n": "sum", "x": "sum", "y": "sum"})
    own = used & ~split & (all_contexts != BEGIN)
    unigrams = pd.DataFrame({"kind": 1, "a": all_contexts[own].view(np.int64), "b": np.int64(0),
                             "n": total[own].astype(np.int64), "x": 0.0, "y": 0.0})
    lost = ~known
    unseen = pd.DataFrame({"a": rids[text[lost]], "b": signed(w[lost]), "n": 1, "y": weight[pair[lost]]})
    unseen = unseen.groupby(["a", "b"], as_index=False).agg({"n": "sum", "y": "sum"})
    unseen["kind"], unseen["x"] = 2, 0.0
    names = ["kind", "a", "b", "n", "x", "y"]
    return pd.concat([sums[names], unigrams[names], unseen[names]])


def score_texts(docs: DataFrame, held_out_col: str, id_col: str = "doc_id", text_col: str = "text",
                mu: float = MU, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model (see the module) and the unigram counts of the base score are learnt from the rows
    that are not held out; a null flag counts as not held out. A-Z count as a-z, tokens are the
    words between ASCII white space and one end. ``n_known`` counts tokens that occur in learnt
    texts. Null and empty texts are one end token; repeated rows count as often as they occur and
    get the same scores; with no learnt text every probability comes from the shorter model; an
    empty table gives no rows. Only the three columns are read.

    All pairs of adjacent tokens are packed and sent once to the shard of their context, where
    counting, building the trie and scoring happen; a context with more pairs than half a shard
    is split by successor, its count being known beforehand. Only pairs not seen in learnt texts,
    which held-out texts alone have, go on to meet the unigram count of their second word.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    given = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"),
                        F.xxhash64(F.col(f"`{id_col}`"), text).alias("rid"),
                        F.coalesce(F.col(f"`{held_out_col}`"), F.lit(False)).alias("held"))
    rows = given.select("rid", "held", "text")
    size = rows.agg(F.sum(F.octet_length("text")).alias("s")).first().s or 0
    shards = int(max(1, -(-size // int(shard_tokens * BYTES_OF_WORD))))
    hot, hot_pairs, hot_learnt = _hot_contexts(rows, shards)
    pieces = -(-hot_pairs // (shard_tokens // 2))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n, texts = [], 0, 0
        for batch in (part for whole in batches for part in sliced(whole, 2)):
            v, w, text = _tokens(batch, 2)
            parts.append((v, w, text + texts, batch.column(0).to_numpy(),
                          batch.column(1).to_numpy(zero_copy_only=False)))
            n, texts = n + len(v), texts + batch.num_rows
            if n >= FLUSH_TOKENS:
                yield from packed(parts)
                parts, n, texts = [], 0, 0
        if parts:
            yield from packed(parts)

    def packed(parts):
        v, w, text, rids, held = (np.concatenate(x) for x in zip(*parts))
        shard = _shard_of(v, w, hot, pieces, shards)
        order = np.argsort(shard, kind="stable")
        ends = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in range(shards):
            mine = order[ends[s]:ends[s + 1]]
            if len(mine):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.int32()),
                     pa.array([_pack(v[mine], w[mine], text[mine], rids, held)], pa.binary())],
                    ["shard", "pairs"])

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        return _scored(frame["pairs"].tolist(), hot, hot_learnt, mu)

    found = stored(rows.mapInArrow(pack, "shard int, pairs binary").groupBy("shard").applyInPandas(
        score, "kind int, a long, b long, n long, x double, y double"), "ngram-sums")
    words = F.filter(F.split(F.translate("text", "\t\n\u000b\f\r", "     "), " ", -1), lambda t: t != "")
    facts = cut_lineage(given.select("id", "rid", "held", (F.size(words) + 1).cast("long").alias("n_tokens")))

    learnt = facts.where("not held").agg(F.count("*").alias("texts"), F.sum("n_tokens").alias("tokens")).first()
    n_all, n_texts = learnt.tokens or 0, learnt.texts
    own = hot_learnt[(hot != BEGIN) & (hot_learnt > 0)] if len(hot) else hot_learnt
    distinct = found.where("kind = 1").count() + len(own) + (1 if n_texts else 0)
    whole = float(np.log10(n_all + 0.1 * (distinct + 1)))

    extra = [(int(h.view(np.int64)), int(c)) for h, c in zip(hot, hot_learnt) if h != BEGIN and c]
    extra += [(int(END), n_texts)] if n_texts else []
    spark = docs.sparkSession
    unigrams = found.where("kind = 1").select(F.col("a").alias("__w"), F.col("n").alias("c")).union(
        spark.createDataFrame(extra, "__w long, c long"))
    unseen = found.where("kind = 2").groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    shorter = unseen.join(lookup_side(unigrams), F.col("b") == F.col("__w"), "left").select(
        "a", (F.col("y") + F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + 0.1) - whole)).alias("y"))
    sums = found.where("kind = 0").select("a", "n", "x", "y").union(shorter.select(
        "a", F.lit(0).cast("long"), F.lit(0.0), "y")).groupBy("a").agg(
        F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    times = facts.groupBy(F.col("rid").alias("__rid")).agg(F.count("*").alias("m"))
    each = sums.join(times, F.col("a") == F.col("__rid")).select(
        "__rid", (F.col("n") / F.col("m")).cast("long").alias("n"), (F.col("x") / F.col("m")).alias("x"),
        (F.col("y") / F.col("m")).alias("y"))
    end = F.lit(float(np.log10(n_texts + 0.1)))
    return facts.join(each, F.col("rid") == F.col("__rid")).select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens",
        (F.col("n") + F.lit(1 if n_texts else 0)).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("x") + end - F.col("n_tokens") * whole).alias("base_score"), F.col("y").alias("score"))
