"""Brute-force versions and edge cases of hard negatives, vector codes and source mixing."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from logstrata.llm import codes, mixing, negatives

VECTORS = "vec_id long, embedding array<float>, label int, __id string, __q int, error string"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        vector = [round(rng.uniform(-1, 1), 3) for _ in range(16)]
        if i % 9 == 0:
            vector = [0.25, -0.5] * 8  # a common vector: ties
        label = None if i % 31 == 0 else rng.randrange(4)
        rows.append([i, vector, label, "x", 1, None])
    rows[10][1] = None
    rows[11][1] = [None, *rows[11][1][1:]]
    rows[12][1] = [math.nan, *rows[12][1][1:]]
    rows[13][1] = [math.inf, *rows[13][1][1:]]
    rows.append(rows[40])  # a repeated row
    rows.append([None, [0.1] * 16, 1, "x", 1, None])
    return spark.createDataFrame([tuple(r) for r in rows], VECTORS).repartition(5).cache()


def sound(vectors, factor):
    for r in vectors.collect():
        if r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding):
            yield r.vec_id, r.label, [math.floor(factor * x) for x in r.embedding]


def best_negatives(rows):
    of_id = {}
    for i, label, q in rows:
        if i is not None and label is not None:
            of_id[i] = min(of_id.get(i, (label, q)), (label, q))
    found = set()
    for a, (label, q) in of_id.items():
        if a % 20:
            continue
        score = {b: int(np.dot(q, v)) for b, (_, v) in of_id.items()}
        order = sorted((b for b in of_id if b != a), key=lambda b: (-score[b], b))
        for p in [b for b in order if of_id[b][0] == label][:5]:
            near = [b for b in order if of_id[b][0] != label
                    and 80 * score[p] <= 100 * score[b] <= 100 * score[p]]
            found |= {(a, p, k, b, score[p], score[b]) for k, b in enumerate(near[:5], 1)}
    return found


@pytest.mark.parametrize("sizes", [None, (7, 64, 16)])
def test_hard_negatives(spark, vectors, sizes, monkeypatch):
    if sizes:
        for name, value in zip(("ANCHORS_A_BLOCK", "ROWS_A_BLOCK", "FIELDS"), sizes):
            monkeypatch.setattr(negatives, name, value)
    found = negatives.hard_negatives(vectors, F.col("vec_id") % 20 == 0).collect()
    assert len(found) == len(set(found)) > 100
    assert {tuple(r) for r in found} == best_negatives(sound(vectors, 256))


def test_hard_negatives_of_little(spark, vectors):
    none = vectors.where("false")
    assert negatives.hard_negatives(none, F.col("vec_id") % 20 == 0).count() == 0
    assert negatives.hard_negatives(vectors, F.lit(None).cast("boolean")).count() == 0
    one_label = vectors.where("label = 1")
    assert negatives.hard_negatives(one_label, F.col("vec_id") % 20 == 0).count() == 0
    uneven = spark.createDataFrame([(0, [1.0, 1.0], 0), (1, [1.0], 0), (2, [0.9], 1), (3, [], 1)],
                                   "vec_id long, embedding array<double>, label int")
    assert [tuple(r) for r in negatives.hard_negatives(uneven, F.col("vec_id") == 0).collect()] == \
        [(0, 1, 1, 2, 65536, 256 * 230)]


def test_packed_scores():
    rng = np.random.default_rng(4)
    for shift, width in ((300, 64), (2 ** 20, 16)):
        rows = rng.integers(-shift + 1, shift, (5000, width))
        packed = negatives.PackedCandidates(rows, shift)
        for anchor in rows[:20]:
            assert (packed.scores(anchor) == rows @ anchor).all()
    with pytest.raises(ValueError):
        negatives.PackedCandidates(np.zeros((1, 64), np.int64), 2 ** 26)


def test_equal_average_search():
    rng = np.random.default_rng(5)
    for size, width in ((1, 3), (2, 1), (16, 8)):
        entries = rng.integers(-9, 9, (size, width))
        entries[-1] = entries[0]
        rows = rng.integers(-30, 30, (800, width))
        apart = ((rows[:, None] - entries) ** 2).sum(2)
        index, distance = codes.EqualAverageSearch(entries).nearest(rows)
        assert (index == apart.argmin(1)).all() and (distance == apart.min(1)).all()


def plain_codes(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    values = np.array([r[2] for r in rows])
    parts = values.reshape(len(rows), 8, -1)
    books = parts[:16].swapaxes(0, 1).copy()

    def assign():
        apart = ((parts[:, :, None] - books[None]) ** 2).sum(3)
        return apart.argmin(2), apart.min(2).sum(1)

    for _ in range(6):
        chosen, _ = assign()
        for p in range(8):
            for e in range(books.shape[1]):
                own = parts[chosen[:, p] == e, p]
                if len(own):
                    books[p, e] = [sum(map(int, c)) // len(own) for c in own.T]
    chosen, error = assign()
    label = collections.Counter()
    for r, x in zip(rows, error):
        label[r[1]] += int(x)
    return sorted((str(r[0]), str(r[1]), c.tolist(), int(x), label[r[1]])
                  for r, c, x in zip(rows, chosen, error)), books


@pytest.mark.parametrize("some", ["true", "vec_id < 9", "label is null"])
def test_vector_codes(vectors, some):
    few = vectors.where(some)
    expected, own = plain_codes(list(sound(few, 4096)))
    found, books = codes.compress_vectors(few)
    assert (books == own).all()
    assert sorted((str(r.vec_id), str(r.label), r.codes, r.error, r.label_error)
                  for r in found.collect()) == expected


def test_vector_codes_of_little(spark, vectors):
    found, books = codes.compress_vectors(vectors.where("false"))
    assert found.count() == 0 and books.size == 0
    uneven = spark.createDataFrame([(1, [1.0] * 9, 0), (2, [1.0], 0), (3, [], None), (4, None, 0)],
                                   "vec_id long, embedding array<double>, label int")
    found, books = codes.compress_vectors(uneven)
    assert books.shape == (8, 3, 2)
    assert {(r.vec_id, r.error) for r in found.collect()} == {(1, 0), (2, 0), (3, 0)}


# ---------------------------------------------------------------- mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, size int, __size int, taken string"


@pytest.fixture(scope="module")
def mixed_docs(spark):
    rng = random.Random(6)
    rows = []
    for i in range(700):
        source = "big" if i % 3 == 0 else rng.choice(["a", "B", "é", "tiny", None, "z"])
        n = rng.choice([0, 1, 3, 20, 60, 200])
        if source == "tiny":
            n = min(n, 3)
        rows.append((i, f"\t {i}" + " w\n" * n if n else None, source, 1, 2, "x"))
    rows += [rows[5], rows[5], (None, "no id", "a", 1, 2, None), (None, "no id", "a", 1, 2, None),
             (900, "long " * 30000, "z", 1, 2, None), (901, None, "void", 1, 2, None)]
    return spark.createDataFrame(rows, DOCS).repartition(6).cache()


def plain_targets(words):
    """By turns: what is over goes to the others by weight."""
    order = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        rest = sum(words.values()) - sum(3 * words[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        for s in order:
            target[s] = 3 * words[s] if s in capped else rest * weight[s] / free
        over = {s for s in order if s not in capped and target[s] > 3 * words[s]}
        if not over:
            return target
        capped |= over


def test_source_mix(mixed_docs):
    rows = mixed_docs.collect()
    words = collections.Counter()
    for r in rows:
        words[r.source] += len(WORD.findall(r.text or ""))
    target = plain_targets(words)
    docs = mixed_docs.withColumn("doc_id", F.struct("doc_id", "source"))
    found = mixing.mixed_words(docs).collect()
    assert len(found) == len(rows)
    taken = collections.Counter()
    for r in found:
        source = r.doc_id.source
        assert r.source_size == words[source]
        assert r.target == pytest.approx(target[source])
        assert 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    for source in words:
        assert abs(taken[source] - target[source]) <= 200, source
    assert sorted(map(str, found)) == sorted(map(str, mixing.mixed_words(docs.repartition(3)).collect()))


def test_mixed_blocks(mixed_docs):
    """The blocks themselves: whole words of their documents, each block at most three times."""
    options = {"block_words": 16, "shard_slots": 500}
    blocks = mixing.mixed_blocks(mixed_docs, **options).collect()
    by_doc = collections.Counter()
    for r in mixing.mixed_words(mixed_docs, **options).collect():
        by_doc[r.doc_id] += r.taken
    text = collections.defaultdict(str)
    for r in mixed_docs.collect():
        text[r.doc_id] += " " + (r.text or "")
    assert sum(b.n_words for b in blocks) == sum(by_doc.values())
    times = collections.Counter((b.source, b.block) for b in blocks)
    assert max(times.values()) <= 3
    assert len({(b.source, b.block, b.epoch) for b in blocks}) == len(blocks)
    shards = collections.defaultdict(list)
    for b in blocks:
        shards[b.shard].append(b.slot)
        got = b.text.split(" ")
        assert len(got) == b.n_words <= 16
        assert collections.Counter(got) <= collections.Counter(
            w for i in {*b.ids, *([None] if "id" in got else [])} for w in text[i].split())
    assert len(shards) > 5
    assert all(len(set(s)) == len(s) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 10


def test_source_mix_of_nothing(mixed_docs):
    assert mixing.mixed_words(mixed_docs.where("false")).count() == 0
    assert mixing.mixed_blocks(mixed_docs.where("false")).count() == 0
    void = mixing.mixed_words(mixed_docs.where("source = 'void'")).collect()
    assert [(r.doc_id, r.size, r.target, r.taken) for r in void] == [(901, 0, 0.0, 0)]


def test_permutation(spark):
    for n in (1, 2, 7, 1000):
        places = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"),
                                                       F.lit(5).cast("long")).alias("p"))
        assert sorted(r.p for r in places.collect()) == list(range(n))
