"""Near-duplicate documents by ProbMinHash signatures of weighted word shingles."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logstrata.llm.common import (GOLDEN, byte_texts, coded_words, discard, mixed, rolling, signed,
                                  sliced, stored, word_hashes)
from logstrata.operators.skew import lookup_side
from logstrata.session import scratch_path

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5          # a pair at 0.8 shares no band with probability 7e-5
SLOTS = BANDS * ROWS
# Slots that a pair must have in common to be verified: a pair at 0.8 has 96 of 120 on average,
# fewer than 78 with probability 2e-5.
AGREE = 78
HUBS = 2                     # hubs of a mixed bucket in one round
TRIALS = 0                   # rounds of hubs before all members of a mixed bucket are compared
# A block of a bucket: so many signatures, or so many texts and bytes of texts.
SIGNED_BLOCK, TEXT_BLOCK, TEXT_BLOCK_BYTES = 2048, 256, 4 * 1024 * 1024


# ---------------------------------------------------------------- signatures

def shingles(codes: np.ndarray, bounds: np.ndarray, hashes: np.ndarray):
    """(text, shingle, count) of a batch of texts; a text of fewer words is one shingle."""
    n = np.diff(bounds)
    text_of = np.repeat(np.arange(len(n)), n)
    runs = rolling(hashes, SHINGLE)
    inside = np.flatnonzero(text_of[:len(runs)] == text_of[SHINGLE - 1:]) if len(runs) else \
        np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    whole = np.array([rolling(hashes[bounds[i]:bounds[i + 1]], int(n[i]))[0] for i in short],
                     np.uint64)
    text = np.concatenate((text_of[inside], short))
    shingle = np.concatenate((runs[inside], whole))
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    first = np.flatnonzero(new)
    return text[first], shingle[first], np.diff(np.append(first, len(text)))


def prob_min_hash(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_texts: int,
                  slots: int = SLOTS) -> np.ndarray:
    """For each text and slot the shingle that arrives first.

    Every shingle sends arrivals at times of a Poisson process whose rate is its weight, each to
    a random slot; times and slots are functions of the shingle alone, so texts agree in a slot
    with their probability Jaccard similarity. A shingle stops as soon as its next arrival is
    later than the latest first arrival of its text, after which it can change nothing.
    """
    earliest = np.full(n_texts * slots, np.inf)
    winner = np.zeros(n_texts * slots, np.uint64)
    time = np.zeros(len(text))
    state = shingle.copy()
    while len(text):
        state = mixed(state + GOLDEN)
        uniform = ((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53
        time = time - np.log(uniform) / weight
        slot = text * slots + (mixed(state ^ GOLDEN) % np.uint64(slots)).astype(np.int64)
        np.minimum.at(earliest, slot, time)
        won = earliest[slot] == time
        winner[slot[won]] = shingle[won]
        last = earliest.reshape(n_texts, slots).max(1)
        going = time < last[text]
        text, shingle, weight, time, state = (x[going] for x in (text, shingle, weight, time, state))
    return winner.reshape(n_texts, slots)


def _bands(winners: np.ndarray) -> np.ndarray:
    key = np.tile(mixed(np.arange(1, BANDS + 1).astype(np.uint64) * GOLDEN), (len(winners), 1))
    for i in range(ROWS):
        key = mixed(key * GOLDEN + winners[:, i::ROWS])
    return key


def _signatures(docs: DataFrame) -> DataFrame:
    """(id, rid, f1, f2, bands, slots) of the texts with a word.

    f1 and f2 are a 128-bit hash of all words; ``slots`` has a byte of each slot's shingle.
    """
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sliced(whole, 2)):
            texts = [t.lower() for t in byte_texts(batch.column(2))]
            codes, bounds, words = coded_words(texts)
            has = np.flatnonzero(np.diff(bounds))
            if not len(has):
                continue
            text, shingle, count = shingles(codes, bounds, word_hashes(words)[codes])
            place = np.zeros(len(texts), np.int64)
            place[has] = np.arange(len(has))
            won = prob_min_hash(place[text], shingle, count.astype(np.float64), len(has))
            prints = [xxhash.xxh3_128_intdigest(b" ".join(texts[i].split())) for i in has.tolist()]
            keys = signed(_bands(won))
            rows = batch.take(pa.array(has))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1),
                 pa.array(np.array([p >> 64 for p in prints], np.uint64).view(np.int64)),
                 pa.array(np.array([p & (1 << 64) - 1 for p in prints], np.uint64).view(np.int64)),
                 pa.array(list(keys), pa.list_(pa.int64())),
                 pa.array([w.tobytes() for w in (won & np.uint64(255)).astype(np.uint8)],
                          pa.binary())], ["id", "rid", "f1", "f2", "bands", "slots"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "rid", "text").mapInArrow(
        sign, f"id {kind}, rid long, f1 long, f2 long, bands array<long>, slots binary")


# ---------------------------------------------------------------- verification

def probability_jaccard(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two weighted sets given as (sorted elements, weights)."""
    elements = np.union1d(one[0], two[0])
    x, y = np.zeros(len(elements)), np.zeros(len(elements))
    x[np.searchsorted(elements, one[0])] = one[1]
    y[np.searchsorted(elements, two[0])] = two[1]
    if not (x > 0)[y > 0].any():
        return 0.0
    # Element e adds 1 / sum over d of max(x_d / x_e, y_d / y_e): the first term is the larger
    # one where x_d / y_d is at least x_e / y_e, so running sums in that order give every sum.
    with np.errstate(divide="ignore"):
        ratio = np.where(y > 0, x / np.where(y > 0, y, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    from_here = np.concatenate((np.cumsum(x[::-1])[::-1], [0.0]))
    before = np.concatenate(([0.0], np.cumsum(y)))
    both = np.flatnonzero((x > 0) & (y > 0))
    at = np.searchsorted(ratio, ratio[both], "left")
    return float((1.0 / (from_here[at] / x[both] + before[at] / y[both])).sum())


def weighted_shingles(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    codes, bounds, words = coded_words([text.lower()])
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0)
    _, shingle, count = shingles(codes, bounds, word_hashes(words)[codes])
    return shingle, count.astype(np.float64)


def _alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b, agree) whose signatures agree in enough slots, and in how many."""
    one = nodes.select(F.col("node").alias("__a"), F.col("slots").alias("one"))
    two = nodes.select(F.col("node").alias("__b"), F.col("slots").alias("two"))
    both = pairs.join(one, F.col("a") == F.col("__a")).drop("__a")
    both = both.join(lookup_side(two), F.col("b") == F.col("__b")).select("a", "b", "one", "two")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8)
                            .reshape(-1, SLOTS) for i in (2, 3))
                same = (one == two).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(same, pa.int64())],
                    ["a", "b", "agree"]).filter(pa.array(same >= AGREE))

    return both.mapInArrow(agree, "a long, b long, agree long")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose exact similarity is high enough; ``b`` may be a hub of many pairs."""
    hubs = pairs.select(F.col("b").alias("__b")).distinct()
    hub_texts = hubs.join(texts, F.col("__b") == F.col("node")).select("__b", F.col("text").alias("two"))
    members = pairs.join(texts, F.col("a") == F.col("node")).select("a", "b", F.col("text").alias("one"))
    both = members.join(lookup_side(hub_texts), F.col("b") == F.col("__b")).select("a", "b", "one", "two")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub = None, None
        for batch in (part for whole in batches for part in sliced(whole, 2)):
            keep = []
            for b, one, two in zip(batch.column(1).to_pylist(), byte_texts(batch.column(2)),
                                   byte_texts(batch.column(3))):
                if b != last:
                    last, hub = b, weighted_shingles(two)
                keep.append(probability_jaccard(weighted_shingles(one), hub) >= similarity - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(verify, "a long, b long").distinct()


# ---------------------------------------------------------------- components

def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes but the roots, the least node of each component.

    Large-star and small-star steps in turn until only stars are left; each step sends every edge to
    one join whose other side has one row for each node, so a hub's edges may be split.
    """
    def stars(edges: DataFrame, both_ways: bool) -> DataFrame:
        ways = edges.union(edges.select("v", "u")) if both_ways else edges
        ways = ways.toDF("u", "v")
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("__u"), F.least("u", "m").alias("m"))
        near = ways.join(lookup_side(least), F.col("u") == F.col("__u"))
        if both_ways:
            return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # u > v holds here: u and all its neighbours go to the least of them.
        return near.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")) \
            .where("u <> v").distinct()

    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stored(edges, "edges")
    while not _all_stars(edges):
        old, edges = edges, stored(stars(stars(edges, True), False), "edges")
        discard(old)
    return edges.toDF("node", "root")


def _all_stars(edges: DataFrame) -> bool:
    """Every node below an edge has that edge only, so its root is the least of its component."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    met = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return met.where("down > 1 or down = 1 and up = 1").isEmpty()


def _linked(alike: DataFrame, texts: DataFrame, stars: DataFrame | None, similarity: float) -> DataFrame:
    """The components after the pairs that are alike by signature and by text.

    Of the pairs of each node that with the hub of most pairs is verified first. It links most
    nodes of a family of copies, and most of the family's hubs, to one hub; a pair of two nodes
    that both have that link joins nothing any more and needs no texts.
    """
    pairs = stored(alike, "alike")
    liked = pairs.groupBy("b").agg(F.count("*").alias("n")).toDF("__b", "n")
    best = pairs.join(lookup_side(liked), F.col("b") == F.col("__b")) \
        .groupBy("a").agg(F.max(F.struct("n", "b"))["b"].alias("b"))
    best = stored(best, "best")
    first = stored(_verified(best, texts, similarity), "links")
    rest = pairs.join(lookup_side(best.toDF("__x", "__y")), F.col("a") == F.col("__x")) \
        .where("b <> __y").select("a", "b")
    for end in ("a", "b"):
        hub = first.select(F.col("a").alias(f"__{end}"), F.col("b").alias(f"__hub_{end}"))
        rest = rest.join(lookup_side(hub), F.col(end) == F.col(f"__{end}"), "left")
    joined = F.coalesce("__hub_a", "a") == F.coalesce("__hub_b", "b")
    links = stored(_verified(rest.where(~joined).select("a", "b"), texts, similarity).union(first), "links")
    for done in (pairs, best, first):
        discard(done)
    return _with_links(links, stars)


def _with_links(links: DataFrame, stars: DataFrame | None) -> DataFrame:
    if stars is not None and links.isEmpty():
        return stars
    found = components(links if stars is None else links.union(stars.toDF("a", "b")))
    discard(links)
    if stars is not None:
        discard(stars)
    return found


# ---------------------------------------------------------------- the operator

def _pairs(rows: DataFrame) -> DataFrame:
    return rows.where("a <> b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    similarity: float = SIMILARITY) -> DataFrame:
    """(id, class_id, n_class): documents alike, directly or through others, share a class.

    Two texts are alike if the probability Jaccard similarity of their five-word shingles,
    weighted by count, is at least ``similarity`` (0.8 or more); words lie between ASCII white
    space, A-Z count as a-z. ``class_id`` is the least id of the class, ``n_class`` its number
    of rows. Null texts and texts without a word are classes of their own, a text of fewer words
    is one shingle, repeated rows are one class, null ids are never a class id unless all are.
    An empty table gives no rows; only the two columns are read.

    Texts with equal words are first made one node. Signatures are cut in bands; nodes that
    share a band form a bucket. In each bucket all members are compared with its hub, the member
    met most often in all buckets; signatures are compared first, then whole texts. Buckets that
    still hold several components are compared with further hubs in ``TRIALS`` rounds, drawn
    anew in each bucket and round. These only save work: in buckets that are mixed after that all
    members are compared with all of other components, block by block inside tasks
    (``_links_in_cells``). Only links that join two components become rows there.
    """
    return _classes(docs, id_col, text_col, similarity).select(
        F.col("id").alias(id_col), "class_id", "n_class")


def _classes(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """(id, rid, class_id, n_class, stays) of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    given = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"),
                        F.xxhash64(F.col(f"`{id_col}`"), text).alias("rid"))
    signed_docs = stored(_signatures(given), "signatures")
    nodes = stored(signed_docs.groupBy("f1", "f2").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("one"),
        F.first("bands").alias("bands"), F.first("slots").alias("slots")).select(
            F.monotonically_increasing_id().alias("node"), "f1", "f2", "one", "bands", "slots"), "nodes")
    spread = nodes.select("node", F.explode("bands").alias("key"))
    sizes = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1") \
        .withColumnRenamed("key", "__key")
    members = stored(spread.join(lookup_side(sizes), F.col("key") == F.col("__key"))
                     .select("key", "node", "n"), "members")
    table = _text_table(given, nodes, members)
    texts = spark.table(table)

    # Round 0: the hub of a bucket is the member with most company in all its buckets.
    degree = members.groupBy("node").agg(F.sum("n").alias("d")).withColumnRenamed("node", "__node")
    ranked = members.join(degree, F.col("node") == F.col("__node")).select("key", "node", "d")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("d", "node"))["node"].alias("hub")) \
        .withColumnRenamed("key", "__key")
    pairs = members.join(lookup_side(hubs), F.col("key") == F.col("__key")).select(
        F.col("node").alias("a"), F.col("hub").alias("b"))
    stars, left = _linked(_alike(_pairs(pairs), nodes), texts, None, similarity), members
    for turn in range(1, TRIALS + 2):
        before, left = left, _mixed(left, stars)
        discard(before)
        if left.isEmpty():
            break
        if turn <= TRIALS:
            near = nodes.join(left.select(F.col("node").alias("__n")).distinct(),
                              F.col("node") == F.col("__n")).select("node", "slots")
            stars = _linked(_alike(_rest(left, turn), near), texts, stars, similarity)
        else:
            links = stored(_links_in_cells(left, nodes, texts, similarity), "links")
            stars = _with_links(links, stars)
    discard(left)
    discard(texts)
    spark.sql(f"DROP TABLE {table}")

    roots = nodes.select("node", "f1", "f2", "one").join(
        stars.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left") \
        .select("f1", "f2", "one", F.coalesce("root", "node").alias("root"))
    copies = signed_docs.groupBy("f1", "f2").agg(F.count("*").alias("n"))
    whole = roots.join(copies, ["f1", "f2"])
    named = whole.groupBy("root").agg(F.min("one").alias("least"), F.sum("n").alias("n_class")) \
        .withColumnRenamed("root", "__root")
    classes = stored(whole.join(lookup_side(named), F.col("root") == F.col("__root"))
                     .select(F.col("f1").alias("__f1"), F.col("f2").alias("__f2"),
                             "least", "n_class"), "classes")
    told = signed_docs.join(lookup_side(classes), (F.col("f1") == F.col("__f1"))
                            & (F.col("f2") == F.col("__f2"))).select(
        "id", "rid", F.col("least.id").alias("class_id"), "n_class",
        (F.col("rid") == F.col("least.rid")).alias("stays"))
    alone = given.where(~F.col("text").rlike("[^\\x20\\x09-\\x0D]")).select(
        "id", "rid", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("n_class"),
        F.lit(True).alias("stays"))
    return told.union(alone)


def _text_table(given: DataFrame, nodes: DataFrame, members: DataFrame) -> str:
    """The texts of nodes in a bucket with others, stored once by node for all comparisons."""
    spark = given.sparkSession
    wanted = nodes.join(members.select(F.col("node").alias("__n")).distinct(),
                        F.col("node") == F.col("__n")).select("node", F.col("one.rid").alias("__rid"))
    rows = given.join(lookup_side(wanted), F.col("rid") == F.col("__rid")).select("node", "text")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"probminhash_{uuid.uuid4().hex}"
    (rows.repartition(buckets, "node").write.bucketBy(buckets, "node").sortBy("node")
     .option("path", scratch_path(spark, "texts")).saveAsTable(name))
    return name


def _mixed(members: DataFrame, stars: DataFrame) -> DataFrame:
    """(key, node, root) of buckets that hold several components so far."""
    roots = stars.toDF("__node", "__root")
    rows = members.select("key", "node").join(
        lookup_side(roots), F.col("node") == F.col("__node"), "left").select(
        "key", "node", F.coalesce("__root", "node").alias("root"))
    several = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")) \
        .where("lo < hi").select(F.col("key").alias("__key"))
    return stored(rows.join(lookup_side(several), F.col("key") == F.col("__key")).drop("__key"), "mixed")


def _rest(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs of a member and a hub of its bucket in another component.

    Each round and bucket draw their own hubs, so a member meets others of each bucket in turn.
    """
    draws = [F.min(F.struct(F.xxhash64("node", "key", F.lit(turn * HUBS + i)).alias("h"),
                            F.col("node").alias("hub"), F.col("root").alias("hub_root")))
             .alias(f"h{i}") for i in range(HUBS)]
    hubs = rows.groupBy("key").agg(*draws).select(F.col("key").alias("__key"), F.array_distinct(
        F.array(*[f"h{i}" for i in range(HUBS)])).alias("hubs"))
    near = rows.join(lookup_side(hubs), F.col("key") == F.col("__key"))
    apart = F.filter("hubs", lambda h: h["hub_root"] != F.col("root"))
    return _pairs(near.select(F.col("node").alias("a"),
                              F.explode(F.transform(apart, lambda h: h["hub"])).alias("b")))


def _cells(rows: DataFrame, blocks: Column, *carried: str) -> DataFrame:
    """(key, lo, hi, block, node, root, slots, bands, carried), a cell's rows together and in order.

    A bucket is dealt into ``blocks`` blocks; a cell (key, lo, hi) is two of them, or one with
    itself, so a bucket of any size is many tasks and each holds two blocks.
    """
    own = F.pmod(F.xxhash64("node", "key"), F.col("blocks"))
    others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    dealt = rows.withColumn("blocks", blocks.cast("long")).withColumn("block", own) \
        .withColumn("other", F.explode(others))
    return dealt.select("key", F.least("block", "other").alias("lo"),
                        F.greatest("block", "other").alias("hi"), "block", "node", "root", "slots",
                        "bands", *carried) \
        .repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that end where a cell ends, with the first row of each cell and the end."""
    def first_rows(batch: pa.RecordBatch) -> np.ndarray:
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in (batch.column(i).to_numpy() for i in range(3))], 0)
        return np.flatnonzero(new)

    held = None
    for batch in batches:
        if held is not None:
            batch = pa.concat_batches([held, batch])
        if batch.num_rows:
            first = first_rows(batch)
            if len(first) > 1:
                yield batch.slice(0, int(first[-1])), first
            held = batch.slice(int(first[-1]))
    if held is not None:
        yield held, np.array([0, held.num_rows])


def _near_pairs(batch: pa.RecordBatch, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of one cell and of two components whose signatures agree in enough slots.

    A pair that meets in several buckets is told in that of its first common band only.
    """
    key, lo, hi, block, _, root = (batch.column(i).to_numpy() for i in range(6))
    slots = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint8).reshape(-1, SLOTS)
    bands = batch.column(7).flatten().to_numpy().reshape(-1, BANDS)
    cell = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    here = (bands == key[:, None]).argmax(1)
    at, found = np.arange(len(cell)), []
    for step in range(1, len(cell)):
        at = at[at + step < len(cell)]
        at = at[cell[at] == cell[at + step]]
        if not len(at):
            break
        to = at + step
        asked = at[(root[at] != root[to]) & ((lo[at] == hi[at]) | (block[at] != block[to]))]
        asked = asked[(slots[asked] == slots[asked + step]).sum(1) >= AGREE]
        asked = asked[(bands[asked] == bands[asked + step]).argmax(1) == here[asked]]
        if len(asked):
            found.append((asked, asked + step))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one, two = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((two, one))
    return one[order], two[order]


def _joined(texts: list[bytes], component: np.ndarray, one: np.ndarray, two: np.ndarray,
            similarity: float) -> list[int]:
    """Places of those pairs (one, two) that are alike and join two components not yet joined.

    Let two texts share shingles that are a part p of the weight of one and q of the other. Their
    similarity is at most 1 / (1 / p + 1 / q - 1): for a shared shingle e the sum over d of
    max(x_d / x_e, y_d / y_e) is at least X / x_e + (1 - q) Y / y_e, X and Y being the whole
    weights, and the sum over e of the inverses is concave in the shared parts. The parts are told
    for one text and many at once; few pairs that are not alike get beyond them.
    """
    codes, bounds, words = coded_words([t.lower() for t in texts])
    text, shingle, count = shingles(codes, bounds, word_hashes(words)[codes])
    order = np.lexsort((shingle, text))
    text, shingle, weight = text[order], shingle[order], count[order].astype(np.float64)
    element = np.unique(shingle, return_inverse=True)[1]
    begin = np.searchsorted(text, np.arange(len(texts) + 1))
    total = np.bincount(text, weight, len(texts))
    own, component, joined = np.zeros(len(element)), component.copy(), []
    starts = np.flatnonzero(np.append(True, one[1:] != one[:-1])).tolist()
    for start, end in zip(starts, [*starts[1:], len(one)]):
        i = int(one[start])
        mine = slice(begin[i], begin[i + 1])
        places = start + np.flatnonzero(component[two[start:end]] != component[i])
        if not len(places):
            continue
        others = two[places]
        n = begin[others + 1] - begin[others]
        pair = np.repeat(np.arange(len(others)), n)
        rows = np.arange(len(pair)) + (begin[others] - np.cumsum(n) + n)[pair]
        own[element[mine]] = weight[mine]
        met = own[element[rows]]
        own[element[mine]] = 0
        p = np.bincount(pair, met, len(others)) / total[i]
        q = np.bincount(pair, weight[rows] * (met > 0), len(others)) / total[others]
        with np.errstate(divide="ignore"):
            near = 1 / p + 1 / q - 1 <= 1 / similarity + 1e-9
        for place in places[near].tolist():
            j = int(two[place])
            if component[i] != component[j]:
                its = slice(begin[j], begin[j + 1])
                if probability_jaccard((element[mine], weight[mine]),
                                       (element[its], weight[its])) >= similarity - 1e-9:
                    component[component == component[j]] = component[i]
                    joined.append(place)
    return joined


def _links_in_cells(rows: DataFrame, nodes: DataFrame, texts: DataFrame,
                    similarity: float) -> DataFrame:
    """Links (a, b) that join all components with alike members in a bucket.

    Signatures are compared first; only members with a pair that agrees are sent with their
    texts. Neither kind of pair becomes a row: a cell gives its members, then links between
    components it has not joined yet, which are fewer than its members.
    """
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in _whole_cells(batches):
            found = np.unique(np.concatenate(_near_pairs(batch, bounds)))
            yield batch.take(pa.array(found)).select(["key", "node", "root", "slots", "bands"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in _whole_cells(batches):
            one, two = _near_pairs(batch, bounds)
            node, root = (batch.column(i).to_numpy() for i in (4, 5))
            cell, links = np.searchsorted(bounds, one, "right"), []
            for c in np.unique(cell).tolist():
                a, b = one[cell == c], two[cell == c]
                asked, place = np.unique(np.concatenate((a, b)), return_inverse=True)
                kept = _joined(byte_texts(batch.column(8).take(pa.array(asked))), root[asked],
                               place[:len(a)], place[len(a):], similarity)
                links += [(node[a[k]], node[b[k]]) for k in kept]
            ends = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    shape = nodes.select("node", "slots", "bands").withColumnRenamed("node", "__node")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).withColumnRenamed("key", "__key")
    members = rows.join(shape, F.col("node") == F.col("__node")).join(
        lookup_side(sizes), F.col("key") == F.col("__key"))
    met = _cells(members, F.ceil(F.col("n") / SIGNED_BLOCK)).mapInArrow(
        near, "key long, node long, root long, slots binary, bands array<long>")
    met = stored(met.dropDuplicates(["key", "node"]), "met")
    read = met.join(texts.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"))
    sizes = read.groupBy("key").agg(
        F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).withColumnRenamed("key", "__key")
    placed = read.join(lookup_side(sizes), F.col("key") == F.col("__key"))
    blocks = F.greatest(F.ceil(F.col("n") / TEXT_BLOCK), F.ceil(F.col("bytes") / TEXT_BLOCK_BYTES))
    return _cells(placed, blocks, "text").mapInArrow(link, "a long, b long").distinct()


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                similarity: float = SIMILARITY) -> DataFrame:
    """The documents less all but one of each class: that with the least id stays.

    Of repeated rows one stays, too. See ``near_duplicates`` for the classes.
    """
    told = _classes(docs, id_col, text_col, similarity).groupBy("rid").agg(
        F.bool_and("stays").alias("__stays")).withColumnRenamed("rid", "__told")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select("*", F.xxhash64(F.col(f"`{id_col}`"), text).alias("__rid"))
    joined = rows.join(lookup_side(told), F.col("__rid") == F.col("__told")).where("__stays")
    first = F.row_number().over(Window.partitionBy("__rid").orderBy("__told")).alias("__nth")
    return joined.select("*", first).where("__nth = 1").select(*[f"`{c}`" for c in docs.columns])
