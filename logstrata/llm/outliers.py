"""Quality rules: text statistics and robust multivariate outliers, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logstrata.llm.common import apart, together
from logstrata.operators.skew import lookup_side
from logstrata.session import cut_lineage

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
RUN = 5                  # words of a window that may be repeated
MIN_GROUP = 200          # fewer rows of a language and source join the rest of the language
KEPT_SHARE = 0.75        # share of a group that the estimate is made from
TRIAL_STEPS = 2          # concentration steps of every start
STEPS = 6                # most concentration steps of the best start
TOLERANCE = 1e-2         # it ends where no log determinant moves by more
MAX_GROUPS = 50_000      # above it the estimates are joined by a shuffle
TAIL = 1e-6              # false rejections: share of the rows of a normal group beyond the limit
# Added to the sizes of texts, so that short ones have statistics of about the same spread.
PRIOR_WORDS, PRIOR_CHARS, PRIOR_LINES = 50, 250, 5
LENGTH_WORDS = 1000
FEATURES = ("x_length", "x_symbols", "x_lines", "x_repeats")
# Logarithms of the numbers of units that a text's statistics are shares of. Half of the root of
# one unit is the sampling error of such a root, which is the least spread a group may have:
# where three quarters have no symbols at all, the estimate would be 0 and one symbol an outlier.
SIZES = ("z_length", "z_symbols", "z_lines", "z_repeats")
BINS_PER_UNIT = 200
QUARTILES = (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))


def chi2_cdf(x: float, even: int) -> float:
    half, term, total = x / 2, 1.0, 0.0
    for i in range(even // 2):
        total += term
        term *= half / (i + 1)
    return 1 - math.exp(-half) * total


def chi2_quantile(p: float, even: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, even) < p else (low, mid)
    return high


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once in each row."""
    return F.transform(F.array(value), use)[0]


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, and the counts of each whole text (see ``judge``)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spaced = F.translate(text, "\t\n\u000b\f\r", "     ")
    words = F.filter(F.split(spaced, " ", -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    first = docs.select("*", words.alias("__words"), lines.alias("__lines"))
    n = F.size("__words")
    # A hash for each window of words: that of its words' hashes, which are made once a word.
    hashed = F.transform(F.col("__words"), lambda w: F.xxhash64(w))
    windows = _let(hashed, lambda h: F.when(F.size(h) >= RUN, F.transform(
        F.sequence(F.lit(0), F.size(h) - RUN),
        lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(RUN)]))).otherwise(
            F.array().cast("array<bigint>")))
    second = first.select("*", windows.alias("__windows"))
    # Places of windows found twice or more: equal neighbours after a sort.
    marked = F.transform(F.col("__windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))

    def twice(s: Column) -> Column:
        def same(x: Column, i: Column, other: Column) -> Column:
            return F.coalesce(F.get(s, other)["h"] == x["h"], F.lit(False))
        found = F.filter(s, lambda x, i: same(x, i, i - 1) | same(x, i, i + 1))
        return F.array_sort(F.transform(found, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(RUN), x - F.coalesce(F.get(p, i - 1), x - RUN)))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    repeated = F.when(F.size("__windows") == F.size(F.array_distinct("__windows")), F.lit(0)) \
        .otherwise(_let(_let(F.sort_array(marked), twice), covered))
    n_lines = F.size("__lines")
    return second.select(
        *[f"`{c}`" for c in docs.columns if c != text_col],
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, "[#*$%&|<>]+", "")))
        .cast("long").alias("n_symbols"),
        (n_lines - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"), n_lines.cast("long").alias("__n_lines"))


def _features(stats: DataFrame) -> DataFrame:
    """``stats`` with the features but ``x_length``, which needs a median, and the sizes."""
    chars, lines = F.col("word_chars") + PRIOR_CHARS, F.col("__n_lines") + PRIOR_LINES
    words = F.col("n_words") + PRIOR_WORDS
    values = {"__length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) /
                                F.greatest(F.col("n_words"), F.lit(1))),
              "x_symbols": F.sqrt(F.col("n_symbols") / chars),
              "x_lines": F.sqrt(F.col("n_dup_lines") / lines),
              "x_repeats": F.sqrt(F.col("n_repeat_words") / words),
              # Words vary by about half of their length, so four words are one unit.
              "z_length": F.log(4.0 * (F.col("n_words") + LENGTH_WORDS)),
              "z_symbols": F.log(chars), "z_lines": F.log(lines),
              # The least repeat is two windows.
              "z_repeats": F.log(words / (2.0 * RUN))}
    return stats.select("*", *[v.alias(x) for x, v in values.items()])


def _grouped(rows: DataFrame, lang: str, source: str, min_group: int) -> DataFrame:
    """Rows with ``__g``, the group whose estimate judges them.

    A language and source with too few rows join the small ones of the language, and these, if
    too few together, all other small ones.
    """
    key = F.struct(F.col(lang).cast("string").alias("l"), F.col(source).cast("string").alias("s"))
    rows = rows.select("*", key.alias("__k"))
    counts = rows.groupBy("__k").agg(F.count("*").alias("__n"))
    small = F.when(F.col("__n") >= min_group, F.lit(0)).otherwise(F.lit(1))
    by_lang = Window.partitionBy(F.col("__k")["l"])
    rest = F.sum(F.when(small == 1, F.col("__n")).otherwise(0)).over(by_lang)
    level = F.when(small == 0, F.lit(0)).when(rest >= min_group, F.lit(1)).otherwise(F.lit(2))
    groups = counts.select(F.col("__k").alias("__key"), F.struct(
        level.alias("level"), F.when(level < 2, F.col("__k")["l"]).alias("l"),
        F.when(level < 1, F.col("__k")["s"]).alias("s")).alias("__g"))
    return _with_groups(rows, groups, rows["__k"].eqNullSafe(groups["__key"])).drop("__k", "__key")


def _with_groups(rows: DataFrame, groups: DataFrame, on: Column, count: int | None = None) -> DataFrame:
    """A join with one row for each group; sent to all only if there are few, as counted."""
    if count is not None and count <= MAX_GROUPS:
        return rows.join(F.broadcast(groups), on)
    return rows.join(lookup_side(groups), on)


def _bin_quantiles(rows: DataFrame, value: Column, key: list[str],
                   shares: tuple[tuple[str, float], ...]) -> DataFrame:
    """The least bins up to which a group has at least each share of its rows, by name.

    Exact on bins, so the same at any partitioning, and rows are counted before the shuffle.
    """
    bins = rows.select(*key, F.floor(value * BINS_PER_UNIT).alias("__bin")) \
        .groupBy(*key, "__bin").agg(F.count("*").alias("__c"))
    group = Window.partitionBy(*key)
    run = F.sum("__c").over(group.orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("__c").over(group)
    return (bins.select(*key, "__bin", run.alias("__r"), whole.alias("__t"))
            .groupBy(*key).agg(*[
                F.min(F.when(F.col("__r") >= F.ceil(F.col("__t") * share), F.col("__bin")))
                .alias(name) for name, share in shares]))


def _decorrelated(rows: DataFrame) -> DataFrame:
    """``rows`` with ``y_i``, the features from the centre ``m_i`` divided by the factor ``l_i_j``.
    One column after the other: nested, they would repeat one another."""
    for i, x in enumerate(FEATURES):
        rest = F.col(x) - F.col(f"m_{i}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}_{j}") * F.col(f"y_{j}")
        rows = rows.withColumn(f"y_{i}", rest / F.col(f"l_{i}_{i}"))
    return rows


def _with_distance(rows: DataFrame) -> DataFrame:
    """``rows`` with ``__far``, the squared Mahalanobis distance by the estimate beside them."""
    ys = [f"y_{i}" for i in range(len(FEATURES))]
    far = sum((F.col(y) * F.col(y) for y in ys), F.lit(0.0))
    return _decorrelated(rows).withColumn("__far", far).drop(*ys)


def _factored(groups: DataFrame) -> DataFrame:
    """``groups`` with the Cholesky factor ``l_i_j`` of the covariance ``v_i_j`` in its place, and
    ``__spread``, half the log determinant.

    What a feature spreads beyond the ones before it is at least ``f_i``; this alone is where the
    floors come in, so a spread above them is the estimate's own.
    """
    p = len(FEATURES)
    for i in range(p):
        for j in range(i + 1):
            rest = F.col(f"v_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            value = F.sqrt(F.greatest(rest, F.col(f"f_{i}") * F.col(f"f_{i}"))) if i == j \
                else rest / F.col(f"l_{j}_{j}")
            groups = groups.withColumn(f"l_{i}_{j}", value)
    spread = sum((F.log(f"l_{i}_{i}") for i in range(p)), F.lit(0.0))
    return groups.withColumn("__spread", spread) \
        .drop(*[f"v_{i}_{j}" for i in range(p) for j in range(i + 1)])


def _medians(rows: DataFrame, columns: tuple[str, ...],
             shares: tuple[tuple[str, float], ...] = (("q2", 0.5),),
             key: tuple[str, ...] = ("__g",)) -> DataFrame:
    """One row for each group: the quantiles of the columns, to half a bin."""
    long = rows.select(*key, F.explode(F.array(*[
        F.struct(F.lit(i).alias("f"), F.col(x).alias("v")) for i, x in enumerate(columns)
    ])).alias("e")).select(*key, "e.f", "e.v")
    found = _bin_quantiles(long, F.col("v"), [*key, "f"], shares)
    return found.groupBy(*key).agg(*[
        F.max(F.when(F.col("f") == i, (F.col(q) + 0.5) / BINS_PER_UNIT)).alias(f"{q}_{x}")
        for i, x in enumerate(columns) for q, _ in shares])


def _starts(rows: DataFrame) -> DataFrame:
    """Three first estimates of each group (``__s``).

    Around the medians, the spreads are the middle ranges of the features; the correlations are
    none, those of the directions from the median, and those told by the middle ranges of sums
    and differences of two features (Gnanadesikan and Kettenring).
    Centre and spread are then taken again as medians and middle ranges of the features so
    decorrelated, as outliers between correlated features are within the range of each.
    """
    p = len(FEATURES)
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    middle = _medians(rows, FEATURES, QUARTILES)
    sizes = _medians(rows, SIZES).withColumnRenamed("__g", "__h")
    middle = middle.join(sizes, F.col("__g").eqNullSafe(F.col("__h"))).drop("__h")
    floors = [(0.5 * F.exp(-0.5 * F.col(f"q2_{z}"))).alias(f"f_{i}") for i, z in enumerate(SIZES)]
    middle = middle.select("__g", *floors, *[
        F.col(f"q2_{x}").alias(f"c_{i}") for i, x in enumerate(FEATURES)], *[
        ((F.col(f"q3_{x}") - F.col(f"q1_{x}")) / 1.349).alias(f"r_{i}")
        for i, x in enumerate(FEATURES)])
    middle = cut_lineage(middle.select("*", *[
        F.greatest(f"r_{i}", f"f_{i}").alias(f"s_{i}") for i in range(p)]))
    n_groups = middle.count()
    scaled = _attach(rows, middle, n_groups).select("__g", *[
        ((F.col(x) - F.col(f"c_{i}")) / F.col(f"s_{i}")).alias(f"u_{i}")
        for i, x in enumerate(FEATURES)])
    norm = F.greatest(sum((F.col(f"u_{i}") * F.col(f"u_{i}") for i in range(1, p)),
                          F.col("u_0") * F.col("u_0")), F.lit(1e-12))
    moments = scaled.groupBy("__g").agg(
        *[F.avg(F.col(f"u_{i}") * F.col(f"u_{j}") / norm).alias(f"a_{i}_{j}") for i, j in pairs])
    crossed = [(i, j) for i, j in pairs if i != j]
    far = [(f"{sign}_{i}_{j}", F.col(f"u_{i}") + F.lit(k) * F.col(f"u_{j}"))
           for i, j in crossed for sign, k in (("plus", 1.0), ("minus", -1.0))]
    ranges = _medians(scaled.select("__g", *[
        F.least(F.greatest(v, F.lit(-1e4)), F.lit(1e4)).alias(c) for c, v in far]),
        tuple(c for c, _ in far), (QUARTILES[0], QUARTILES[2])).withColumnRenamed("__g", "__h")
    known = _attach(moments, middle, n_groups)
    known = known.join(ranges, known["__g"].eqNullSafe(ranges["__h"])).drop("__h")
    found = None
    for s in range(3):
        def covariance(i: int, j: int) -> Column:
            spread = F.col(f"s_{i}") * F.col(f"s_{j}")
            if i == j or s == 0:
                return spread if i == j else F.lit(0.0)
            if s == 1:
                part, whole = F.col(f"a_{i}_{j}"), F.sqrt(F.col(f"a_{i}_{i}") * F.col(f"a_{j}_{j}"))
            else:
                a, b = (F.pow(F.col(f"q3_{c}_{i}_{j}") - F.col(f"q1_{c}_{i}_{j}"), 2)
                        for c in ("plus", "minus"))
                part, whole = a - b, a + b
            return F.when(whole > 0, part / whole).otherwise(0.0) * spread
        part = known.select(
            "__g", F.lit(s).alias("__s"), *[f"f_{i}" for i in range(p)],
            *[F.col(f"c_{i}").alias(f"m_{i}") for i in range(p)],
            *[covariance(i, j).alias(f"v_{i}_{j}") for i, j in pairs])
        found = part if found is None else found.union(part)
    first = cut_lineage(_factored(found))
    ys = tuple(f"y_{i}" for i in range(p))
    again = _medians(_decorrelated(_attach(rows, first, n_groups)).select("__g", "__s", *[
        F.least(F.greatest(y, F.lit(-1e4)), F.lit(1e4)).alias(y) for y in ys]), ys, QUARTILES,
        ("__g", "__s")).withColumnsRenamed({"__g": "__h", "__s": "__t"})
    both = first.join(again, first["__g"].eqNullSafe(again["__h"]) & (F.col("__s") == F.col("__t")))
    ranges = [(F.col(f"q3_{y}") - F.col(f"q1_{y}")) / 1.349 for y in ys]
    factor = {(i, j): F.greatest(F.col(f"l_{i}_{j}") * ranges[j], F.col(f"f_{i}")) if i == j
              else F.col(f"l_{i}_{j}") * ranges[j] for i in range(p) for j in range(i + 1)}
    centre = [F.col(f"m_{i}") + sum((F.col(f"l_{i}_{j}") * F.col(f"q2_{ys[j]}")
                                     for j in range(i + 1)), F.lit(0.0)) for i in range(p)]
    return both.select("__g", "__s", *[f"f_{i}" for i in range(p)],
                       *[centre[i].alias(f"m_{i}") for i in range(p)],
                       *[c.alias(f"l_{i}_{j}") for (i, j), c in factor.items()], "__spread")


def _concentrate(rows: DataFrame, estimate: DataFrame, n_groups: int, kept_share: float) -> DataFrame:
    """One concentration step: mean and covariance of the nearest rows for each estimate.

    Bins are of the distance's logarithm, so there are a few thousand of them at most.
    """
    p = len(FEATURES)
    far = _with_distance(_attach(rows, estimate, n_groups)).select(
        "__g", "__s", *FEATURES, *[f"f_{i}" for i in range(p)], "__spread",
        F.log1p(F.least(F.col("__far"), F.lit(1e9))).alias("__d"))
    limit = _bin_quantiles(far, F.col("__d"), ["__g", "__s"], (("__limit", kept_share),)) \
        .select(F.col("__g").alias("__h"), F.col("__s").alias("__t"), "__limit")
    near = _with_groups(far, limit, far["__g"].eqNullSafe(limit["__h"])
                        & (far["__s"] == limit["__t"]), n_groups) \
        .where(F.floor(F.col("__d") * BINS_PER_UNIT) <= F.col("__limit"))
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    sums = near.groupBy("__g", "__s").agg(
        *[F.max(f"f_{i}").alias(f"f_{i}") for i in range(p)], F.max("__spread").alias("__before"),
        *[F.avg(x).alias(f"a_{i}") for i, x in enumerate(FEATURES)],
        *[F.avg(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"c_{i}_{j}") for i, j in pairs])
    # The nearest rows of a normal group spread less than the group; this undoes it.
    scale = kept_share / chi2_cdf(chi2_quantile(kept_share, p), p + 2)
    return _factored(sums.select(
        "__g", "__s", "__before", *[f"f_{i}" for i in range(p)],
        *[F.col(f"a_{i}").alias(f"m_{i}") for i in range(p)],
        *[((F.col(f"c_{i}_{j}") - F.col(f"a_{i}") * F.col(f"a_{j}")) * scale).alias(f"v_{i}_{j}")
          for i, j in pairs]))


def minimum_covariance(rows: DataFrame, kept_share: float = KEPT_SHARE,
                       steps: int = STEPS) -> tuple[DataFrame, int]:
    """The estimate of each group ``__g`` of rows with the features and sizes, and their number.

    Every start takes ``TRIAL_STEPS`` concentration steps; the one of least determinant in its
    group goes on until no determinant moves, or for ``steps`` steps. One number a step comes to
    the driver.
    """
    estimate = cut_lineage(_starts(rows))
    n_groups = estimate.count()
    for _ in range(TRIAL_STEPS):
        estimate = cut_lineage(_concentrate(rows, estimate, n_groups, kept_share))
    best = Window.partitionBy("__g").orderBy("__spread", "__s")
    estimate = cut_lineage(estimate.select("*", F.row_number().over(best).alias("__i"))
                           .where("__i = 1").drop("__i"))
    n_groups = estimate.count()
    for _ in range(steps):
        estimate = cut_lineage(_concentrate(rows, estimate, n_groups, kept_share))
        moved = estimate.agg(F.max(F.abs(F.col("__spread") - F.col("__before")))).first()[0]
        if moved is None or 2 * moved <= TOLERANCE:
            break
    return estimate.drop("__s", "__before", "__spread"), n_groups


def _attach(rows: DataFrame, estimate: DataFrame, n_groups: int) -> DataFrame:
    named = estimate.withColumnRenamed("__g", "__h")
    return _with_groups(rows, named, rows["__g"].eqNullSafe(named["__h"]), n_groups).drop("__h")


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source", min_group: int = MIN_GROUP, kept_share: float = KEPT_SHARE,
          steps: int = STEPS, tail: float = TAIL) -> DataFrame:
    """``docs`` without the text, with the statistics, ``distance``, ``base_failed`` and ``kept``.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_dup_lines`` (lines
    with a word that equal an earlier one) and ``n_repeat_words`` (words in windows of five that
    occur twice or more) are counted on whole texts. ``base_failed`` holds for fewer than ten
    ten words or more than 20 % repeated words. All other rows are judged by a vector of four
    transformed statistics: log mean word length from the group's median, weighted by the root of
    ``n / (n + 1000)``, and the roots of the shares of symbols, repeated lines and repeated words.
    For each language and source, location and covariance are estimated by minimum covariance
    determinant (``minimum_covariance``): concentration steps from three starts take the nearest
    ``kept_share`` of the rows and estimate anew. Rows whose Mahalanobis distance is beyond the
    chi-square limit of ``tail``, the share of falsely rejected rows in a normal group, are not
    kept. A feature spreads by its sampling error at least (see ``SIZES``). Small groups are
    judged together (see ``min_group``).

    A null or empty text has no words and fails the base rules; null languages and sources form
    groups of their own; repeated rows are judged alike; an empty table gives no rows; columns
    of ``docs`` named like a result are replaced. The statistics, without texts, are written to
    the checkpoint folder once; each step moves counts and sums of groups only.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "distance",
             "base_failed", "kept"]
    taken = {n.lower() for n in names}
    given = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in taken])
    used = [text_col, lang_col, source_col]
    stats = text_statistics(apart(given, used), text_col)
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = cut_lineage(_features(stats).select("*", failed.alias("base_failed")))
    asked = _grouped(rows, lang_col, source_col, min_group)
    usual = _medians(asked.where(~F.col("base_failed")), ("__length",)).withColumnRenamed("__g", "__h")
    weight = F.sqrt(F.col("n_words") / (F.col("n_words") + float(LENGTH_WORDS)))
    asked = cut_lineage(
        asked.join(lookup_side(usual), asked["__g"].eqNullSafe(usual["__h"]), "left")
        .withColumn("x_length", (F.col("__length") - F.col("q2___length")) * weight)
        .drop("__h", "__length", "q2___length"))
    sound = asked.where(~F.col("base_failed")).select("__g", *FEATURES, *SIZES)
    estimate, n_groups = minimum_covariance(sound, kept_share, steps)
    limit = chi2_quantile(1 - tail, len(FEATURES))
    named = estimate.withColumnRenamed("__g", "__h")
    on = asked["__g"].eqNullSafe(named["__h"])
    judged = asked.join(F.broadcast(named) if n_groups <= MAX_GROUPS else lookup_side(named),
                        on, "left")
    judged = _with_distance(judged)
    distance = F.when(~F.col("base_failed"), F.sqrt("__far"))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= math.sqrt(limit))
    return judged.select("*", distance.alias("distance")).select(
        *together([c for c in given.columns if c != text_col], used), *names[:6], "base_failed",
        kept.alias("kept"))


def keep_sound(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents that ``judge`` keeps, with their columns; verdicts join by id and text."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rid = F.xxhash64(F.col(f"`{id_col}`"), text)
    judged = judge(docs.select(rid.alias("__rid"), F.col(f"`{text_col}`").alias("text"),
                               F.col(f"`{lang_col}`").alias("lang"),
                               F.col(f"`{source_col}`").alias("source")))
    gone = judged.where("not kept").select(F.col("__rid").alias("__gone")).distinct()
    rows = docs.select(rid.alias("__rid"), F.struct("*").alias("__row"))
    return rows.join(lookup_side(gone), F.col("__rid") == F.col("__gone"), "left_anti") \
        .select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
