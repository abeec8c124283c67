"""Mixing sources to target weights: blocks of words, drawn shard by shard.

DataFrame functions only. All numbers that decide a row are whole numbers, so reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logstrata.llm.common import stored
from logstrata.operators.numbering import with_line_number
from logstrata.operators.skew import lookup_side

WEIGHTS = (5, 2, 1)          # of the sources in order, repeating
MOST = 3                     # times a source may be taken
BLOCK_WORDS = 64
SHARD_SLOTS = 16384          # blocks in one output shard, about
ROUNDS = 24                  # of the permutation of indexes
UNIT = 1 << 30               # one slot, in the fixed-point numbers of expected counts
BUCKET_ROWS = 8192
WORD, WHITE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"


def _whole(x) -> Column:
    return F.lit(x).cast("long")


def _quotient(x: Column, y: Column) -> Column:
    """x // y of whole numbers that are not negative, without a detour over doubles."""
    return F.call_function("div", x, y)


def permuted(x: Column, n: Column, seed: Column, rounds: int = ROUNDS) -> Column:
    """The place of index ``x`` in a pseudorandom permutation of 0 .. n - 1, told by ``seed``.

    Each round pairs x with key - x modulo n and swaps the two or not, by a bit that both share;
    so every round, and with it the whole, is one-to-one for any n.
    """
    def round_of(y: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(seed, r), n) - y, n)
        swap = F.xxhash64(seed, r, F.greatest(y, other)).bitwiseAND(_whole(1)) == 1
        return F.when(swap, other).otherwise(y)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("long"), round_of)


def running_before(rows: DataFrame, group: list[str], bucket: str, order: list, sums: dict[str, str]) -> DataFrame:
    """``rows`` with running sums of the rows before, in each group by bucket, then ``order``.

    ``sums`` tells the new columns' names by the summed ones. Only one bucket's rows and one
    group's bucket totals are ever in one window.
    """
    inside = Window.partitionBy(*group, bucket).orderBy(*order) \
        .rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*group, bucket).agg(*[F.sum(v).alias(f"__t_{v}") for v in sums])
    base = totals.select(*[F.col(c).alias(f"__of_{c}") for c in (*group, bucket)], *[
        F.coalesce(F.sum(f"__t_{v}").over(over), _whole(0)).alias(f"__base_{v}") for v in sums])
    same = F.lit(True)
    for c in (*group, bucket):
        same = same & (F.col(c) == F.col(f"__of_{c}"))
    local = rows.select("*", *[F.coalesce(F.sum(v).over(inside), _whole(0)).alias(f"__in_{v}")
                               for v in sums])
    return local.join(lookup_side(base), same).select(
        *rows.columns, *[(F.col(f"__base_{v}") + F.col(f"__in_{v}")).alias(n) for v, n in sums.items()])


# ---------------------------------------------------------------- targets

def source_targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(__no, __source, __words, __capped, __target) of every source of (__source, __size).

    Sources in code-point order, null last, weigh ``weights`` in turn and share all words by
    weight; a target stops at ``most`` times the source's words, and what is over goes to the
    others by weight until none is above. Every turn is one sum over the sources.
    """
    words = sized.groupBy("__source").agg(F.sum("__size").alias("__words"))
    place = F.element_at(F.array(*[_whole(w) for w in weights]),
                         (F.pmod(F.col("__no"), F.lit(len(weights))) + 1).cast("int"))
    told = stored(with_line_number(words, [F.asc_nulls_last("__source")], "__no", 0)
                  .withColumn("__weight", place), "sources")
    exact = "decimal(38,0)"
    limit = (F.col("__words") * most).cast(exact)
    total = told.agg(F.sum("__words")).first()[0] or 0
    # Of the others, the rest of the words and the weights: a source is at its limit if its share
    # of the rest is above. The others' share of the rest only grows, so it stays there.
    rest, weight, capped = total, None, F.lit(False)
    while True:
        free = told.where(~capped).agg(F.sum("__weight"), F.sum("__words")).first()
        taken = told.where(capped).agg(F.sum(limit)).first()[0] or 0
        state = total - int(taken), free[0] or 0
        if (rest, weight) == state:
            break
        rest, weight = state
        capped = capped if not weight else \
            (F.lit(rest).cast(exact) * F.col("__weight") > limit * F.lit(weight).cast(exact))
    share = F.lit(float(rest)) * F.col("__weight") / F.lit(float(weight or 1))
    return told.select("__no", "__source", "__words", capped.alias("__capped"),
                       F.when(capped, F.col("__words") * float(most)).otherwise(share)
                       .cast("double").alias("__target"))


# ---------------------------------------------------------------- blocks

def _segments(placed: DataFrame, block_words: int) -> DataFrame:
    """One row for each block that a document has words in: (__no, __block, __at, __from, __n).

    A source's documents lie one after another, ``__at`` being the place of a document's first
    word; block b holds the words b * block_words and following.
    """
    size, at = _whole(block_words), F.col("__at")
    last = at + F.col("__size")
    blocks = F.sequence(_quotient(at, size), _quotient(last - 1, size))
    rows = placed.where("__size > 0").select("*", F.explode(blocks).alias("__block"))
    begin = F.greatest(at, F.col("__block") * size)
    end = F.least(last, (F.col("__block") + 1) * size)
    return rows.select("*", (begin - at).alias("__from"), (end - begin).alias("__n"))


@dataclass
class Mix:
    """The parts of a mix: ``sized`` documents, ``sources`` and drawn ``slots``."""

    placed: DataFrame
    sources: DataFrame
    slots: DataFrame


def _draw_slots(sources: DataFrame, most: int, shard_slots: int, seed: int) -> DataFrame:
    """(__no, __blocks, __shard, __slot, __epoch, __block) of every slot of every output shard.

    A shard expects a part of each source's slots. The whole part of that count is certain; the
    shard's other slots are drawn, each for one source with the probabilities of the fractions.
    Slots of a source are numbered through all shards; a number names an epoch and, through the
    epoch's permutation, a block. Every block comes once in an epoch.
    """
    spark = sources.sparkSession
    expected = F.when(F.col("__capped"), F.col("__blocks") * float(most)).otherwise(
        F.when(F.col("__words") > 0, F.col("__target") * F.col("__blocks") / F.col("__words"))
        .otherwise(0.0))
    total = sources.agg(F.sum(F.ceil(expected))).first()[0] or 0
    shards = max(1, -(-int(total) // shard_slots))
    units = F.round(expected * float(UNIT) / shards).cast("long")
    parts = stored(sources.select("__no", "__blocks", _quotient(units, _whole(UNIT)).alias("__sure"),
                                  F.pmod(units, _whole(UNIT)).alias("__fraction"),
                                  _quotient(F.col("__no"), _whole(BUCKET_ROWS)).alias("__bucket"))
                   .where("__blocks > 0"), "shard-parts")
    every = F.explode(F.sequence(_whole(0), _whole(shards - 1))).alias("__shard")
    sure = parts.where("__sure > 0").select("__no", every, F.col("__sure").alias("__n"))

    # A draw is a point of the fractions laid end to end; both are looked up by whole units.
    fractions = int(parts.agg(F.sum("__fraction")).first()[0] or 0)
    k, rest = F.col("id"), _whole(fractions % UNIT)
    drawn_of = _quotient((k + 1) * rest, _whole(UNIT)) - _quotient(k * rest, _whole(UNIT)) \
        + fractions // UNIT
    draw = F.explode(F.sequence(_whole(1), F.col("__n"))).alias("__draw")
    draws = spark.range(shards).select(k.alias("__shard"), drawn_of.alias("__n")).where("__n > 0") \
        .select("__shard", draw).select("__shard", F.pmod(
            F.xxhash64(_whole(seed), F.col("__shard"), F.col("__draw")),
            _whole(max(fractions, 1))).alias("__point"))
    draws = draws.select("*", _quotient(F.col("__point"), _whole(UNIT)).alias("__unit"))
    ends = running_before(parts.withColumn("__all", F.lit(0)), ["__all"], "__bucket", ["__no"],
                          {"__fraction": "__begin"}).where("__fraction > 0")
    end = F.col("__begin") + F.col("__fraction")
    spans = ends.select("__no", "__begin", end.alias("__end"), F.explode(F.sequence(
        _quotient(F.col("__begin"), _whole(UNIT)), _quotient(end - 1, _whole(UNIT)))).alias("__in"))
    met = draws.join(spans, (F.col("__unit") == F.col("__in")) & (F.col("__point") >= F.col("__begin"))
                     & (F.col("__point") < F.col("__end"))).select("__no", "__shard", _whole(1).alias("__n"))
    counts = stored(sure.union(met).groupBy("__no", "__shard").agg(F.sum("__n").alias("__n")),
                    "shard-counts")

    # The number of each shard's first slot among its source's, and among the shard's.
    many = counts.withColumn("__bucket", _quotient(F.col("__shard"), _whole(BUCKET_ROWS)))
    first = running_before(many, ["__no"], "__bucket", ["__shard"], {"__n": "__before"})
    first = running_before(first.withColumn("__bucket", _quotient(F.col("__no"), _whole(BUCKET_ROWS))),
                           ["__shard"], "__bucket", ["__no"], {"__n": "__inside"}).drop("__bucket")
    size = counts.groupBy("__shard").agg(F.sum("__n").alias("__slots")) \
        .withColumnRenamed("__shard", "__of")
    first = first.join(lookup_side(size), F.col("__shard") == F.col("__of")).drop("__of")
    named = parts.select(F.col("__no").alias("__of"), "__blocks")
    first = first.join(lookup_side(named), F.col("__no") == F.col("__of")).drop("__of")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shards // 16))
    dealt = first.repartition(tasks, "__no", "__shard")
    numbered = dealt.select("*", F.explode(F.sequence(_whole(0), F.col("__n") - 1)).alias("__i"))
    number, blocks = F.col("__before") + F.col("__i"), F.col("__blocks")
    epoch = _quotient(number, blocks)
    return numbered.where(number < blocks * most).select(
        "__no", "__shard", epoch.alias("__epoch"),
        permuted(F.pmod(number, blocks), blocks,
                 F.xxhash64(_whole(seed), F.lit("block"), F.col("__no"), epoch)).alias("__block"),
        permuted(F.col("__inside") + F.col("__i"), F.col("__slots"),
                 F.xxhash64(_whole(seed), F.lit("slot"), F.col("__shard"))).alias("__slot"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source", weights=WEIGHTS, most: int = MOST,
             block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 0,
             with_text: bool = False) -> Mix:
    """Documents placed in their sources' rows of words, the sources, and the drawn slots."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    sized = stored(docs.select(
        F.col(f"`{id_col}`").alias("__id"), F.col(f"`{source_col}`").alias("__source"),
        words.alias("__size"), F.xxhash64(text).alias("__print"),
        *([text.alias("__text")] if with_text else [])), "sized")
    sources = source_targets(sized, weights, most)
    sources = stored(sources.withColumn("__blocks", _quotient(
        F.col("__words") + (block_words - 1), _whole(block_words))), "targets")
    named = sources.select("__no", F.col("__source").alias("__of"), "__words", "__target")
    rows = sized.join(lookup_side(named), F.col("__source").eqNullSafe(F.col("__of"))).drop("__of")
    # Documents without words have no place; all others are dealt into buckets by what they are.
    buckets = max(1, -(-sized.count() // BUCKET_ROWS))
    held = rows.where("__size > 0").withColumn("__bucket", F.pmod(
        F.xxhash64("__id", "__print"), _whole(buckets)))
    placed = running_before(held, ["__no"], "__bucket", ["__id", "__print", "__size"],
                            {"__size": "__at"}).drop("__bucket")
    rest = rows.where("__size = 0").withColumn("__at", _whole(-1))
    slots = _draw_slots(sources, most, shard_slots, seed)
    return Mix(stored(placed.unionByName(rest), "placed"), sources, slots)


def mixed_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", weights=WEIGHTS, most: int = MOST,
                block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS,
                seed: int = 0) -> DataFrame:
    """(id, size, source_size, target, taken) of every document; see ``mixed_blocks``.

    ``size`` counts the words between ASCII white space, ``source_size`` those of all documents
    of the source, ``target`` is how many of them the mix is to take, ``taken`` how many words
    of the document it takes, repeats counted. Documents of a null source are a source of their
    own, the last one; null and empty texts have no words and nothing is taken of them. Repeated
    rows are documents like others, null ids too. An empty table gives no rows. Other columns
    are not read, whatever their names. A document's words are taken at most ``most`` times.
    """
    mix = plan_mix(docs, id_col, text_col, source_col, weights, most, block_words, shard_slots, seed)
    held = _segments(mix.placed, block_words).select("__no", "__block", "__at", "__n")
    drawn = mix.slots.groupBy("__no", "__block").agg(F.count("*").alias("__times"))
    taken = held.join(drawn, ["__no", "__block"]).groupBy("__no", "__at").agg(
        F.sum(F.col("__n") * F.col("__times")).alias("__taken"))
    told = mix.placed.join(taken, ["__no", "__at"], "left")
    return told.select(F.col("__id").alias(id_col), F.col("__size").alias("size"),
                       F.col("__words").alias("source_size"), F.col("__target").alias("target"),
                       F.coalesce("__taken", _whole(0)).alias("taken"))


def mixed_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 source_col: str = "source", weights=WEIGHTS, most: int = MOST,
                 block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS,
                 seed: int = 0) -> DataFrame:
    """(shard, slot, source, epoch, block, ids, n_words, text): the mix itself.

    The words of each source's documents are packed end to end into blocks of ``block_words``
    words (the last one of a source may be shorter). Output shards have about ``shard_slots``
    slots of one block each; how many of them a source gets is drawn for every shard, by the
    sources' targets (see ``source_targets``). A source's slots, numbered through all shards, are
    mapped to blocks by a permutation for each time the source is gone through, and the blocks
    are joined by source and index. A block comes at most ``most`` times; slots drawn beyond that
    stay empty. ``slot`` places are permuted within a shard; ``ids`` are the documents of the
    words, in order, null ids left out. Order of a source's words: a hash of id and text.
    """
    mix = plan_mix(docs, id_col, text_col, source_col, weights, most, block_words, shard_slots,
                   seed, with_text=True)
    split = F.filter(F.split("__text", WHITE), lambda w: w != "")
    held = _segments(mix.placed.withColumn("__list", split).drop("__text"), block_words)
    piece = F.array_join(F.slice("__list", (F.col("__from") + 1).cast("int"), F.col("__n").cast("int")), " ")
    blocks = held.select("__no", "__block", F.struct(
        F.col("__at"), F.col("__id").alias("id"), F.col("__n").alias("n"), piece.alias("t")).alias("p")) \
        .groupBy("__no", "__block").agg(F.array_sort(F.collect_list("p")).alias("p"))
    named = mix.sources.select(F.col("__no").alias("__of"), F.col("__source").alias("source"))
    drawn = mix.slots.join(lookup_side(named), F.col("__no") == F.col("__of")).drop("__of")
    return drawn.join(blocks, ["__no", "__block"]).select(
        F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), "source",
        F.col("__epoch").alias("epoch"), F.col("__block").alias("block"),
        F.filter("p.id", lambda i: i.isNotNull()).alias("ids"),
        F.aggregate("p.n", _whole(0), lambda a, n: a + n).alias("n_words"),
        F.array_join("p.t", " ").alias("text"))
