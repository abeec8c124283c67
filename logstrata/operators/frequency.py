"""Value frequencies: plain, per group, normalised, and as a matrix.

With n(g, v) the rows of value v in group g, T(g) the sum of n over the values and K(g) their
number: count is the sum of n, binary_count the number of groups with v,
binary_count_normalized the sum of 1 / K(g), aggregate_count_normalized the sum of n / T(g).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logstrata.operators.filters import any_of, except_rows, keep_rows
from logstrata.operators.numbering import with_line_number, with_runs
from logstrata.operators.skew import lookup_side, with_group_totals

VARIANTS = ["binary_count", "binary_count_normalized", "aggregate_count_normalized"]
MATRIX_VARIANTS = ["count", *VARIANTS]

Columns = Iterable[str] | Mapping[str, Iterable]


def _restriction(columns: Columns) -> Column | None:
    """Only the allowed values, where a mapping from column to values is given."""
    if not isinstance(columns, Mapping):
        return None
    return any_of([(F.col("column_name") == name) & F.col("value").isin(list(values))
                   for name, values in columns.items()])


def _long(df: DataFrame, columns: Columns, ids: list[str]) -> DataFrame:
    """One row per cell of the counted columns, NULL cells included.

    Exploding an array instead of an unpivot: the shuffle after it can then be shared by the
    two sides of a join.
    """
    names = list(columns)
    if any(name in ids for name in names):
        raise ValueError("a counted column cannot be the group column")
    if not names:
        none = F.lit(None).cast("string")
        return df.where("false").select(*ids, none.alias("column_name"), none.alias("value"))
    cells = [F.struct(F.lit(name).alias("column_name"), F.col(name).cast("string").alias("value"))
             for name in names]
    return df.select(*ids, F.explode(F.array(*cells)).alias("cell")).select(*ids, "cell.*")


def value_frequency(df: DataFrame, columns: Columns, keep: Mapping | None = None,
                    drop: Mapping | None = None) -> DataFrame:
    """column_name, value, count. A mapping counts only the listed values of each column."""
    cells = _long(except_rows(keep_rows(df, keep), drop), columns, [])
    allowed = _restriction(columns)
    if allowed is not None:
        cells = cells.filter(allowed)
    return cells.groupBy("column_name", "value").count()


def column_cardinality(frequency: DataFrame) -> DataFrame:
    """Distinct values per counted column, the largest first."""
    return (frequency.groupBy("column_name").agg(F.count("*").alias("n_distinct"))
            .orderBy(F.desc("n_distinct"), "column_name"))


def side_by_side(frequency: DataFrame) -> DataFrame:
    """The wide report: row i holds the i-th value of every column and its number.

    Columns with more values stand further left; values are ordered by falling count. The
    frequency is sorted and numbered once, over all columns; a column's first number makes its
    own numbers start at 1. Per counted column one row is collected: first number and size.
    """
    metric = [c for c in frequency.columns if c not in ("column_name", "value")][0]
    cells = frequency.select("column_name", "value", F.col(metric).alias("__metric"))
    numbered = with_line_number(cells, ["column_name", F.desc("__metric"), "value"], "__number")
    columns = (numbered.groupBy("column_name")
               .agg(F.min("__number").alias("first"), F.count("*").alias("n"))
               .orderBy(F.desc("n"), "column_name").collect())
    if not columns:
        return frequency.select(F.lit(0).cast("long").alias("row_number")).limit(0)
    first = F.create_map(*[F.lit(x) for row in columns for x in (row.column_name, row["first"])])
    placed = numbered.select((F.col("__number") - first[F.col("column_name")] + 1)
                             .alias("row_number"), "column_name", "value", "__metric")
    wide = (placed.groupBy("row_number").pivot("column_name", [c.column_name for c in columns])
            .agg(F.first("value").alias("value"), F.first("__metric").alias("metric")))
    return wide.toDF("row_number", *[name for c in columns
                                     for name in (c.column_name, f"{c.column_name}_value")])


def frequency_sub_group(df: DataFrame, group: str, sub: str, keep: Mapping | None = None,
                        sub_exceptions: Iterable | None = None) -> DataFrame:
    """For every value of ``group`` the frequency of ``sub``, some of its values left out."""
    rows = keep_rows(df, keep)
    if sub_exceptions:
        rows = except_rows(rows, {sub: list(sub_exceptions)})
    return rows.groupBy(group, F.col(sub).alias("value")).count()


def grouped_counter(df: DataFrame, columns: Columns, group: str,
                    keep: Mapping | None = None, run_order: str | None = None) -> DataFrame:
    """Counts per group, column and value: group, column_name, value, n.

    With ``run_order`` (a dense integer column) a group is a run of adjacent rows with equal
    keys, marked by run_start; a key that comes back opens a new group.
    """
    rows = keep_rows(df, keep)
    ids = [group]
    if run_order:
        rows = with_runs(rows, group, run_order)
        ids = [group, "run_start"]
    return (_long(rows, columns, ids).groupBy(*ids, "column_name", "value")
            .agg(F.count("*").alias("n")))


def _with_terms(counts: DataFrame, ids: list[str]) -> DataFrame:
    """The summands of each metric beside n."""
    sums = {"total": F.col("n"), "n_values": F.lit(1).cast("long")}
    rows = with_group_totals(counts, [*ids, "column_name"], ["value"], sums)
    return rows.select(
        *ids, "column_name", "value", F.col("n").alias("count"),
        F.lit(1).cast("long").alias("binary_count"),
        (F.lit(1.0) / F.col("n_values")).alias("binary_count_normalized"),
        (F.col("n") / F.col("total")).alias("aggregate_count_normalized"))


def normalized_frequency(df: DataFrame, columns: Columns, group: str,
                         keep: Mapping | None = None, binary: bool = True,
                         aggregate: bool = True, run_order: str | None = None) -> DataFrame:
    """column_name, value and one column per variant, summed over the groups.

    A mapping restricts the values reported; the denominators still count all values.
    """
    ids = [group, "run_start"] if run_order else [group]
    terms = _with_terms(grouped_counter(df, columns, group, keep, run_order), ids)
    allowed = _restriction(columns)
    if allowed is not None:
        terms = terms.filter(allowed)
    chosen = (VARIANTS[:2] if binary else []) + (VARIANTS[2:] if aggregate else [])
    if not chosen:
        raise ValueError("choose binary, aggregate or both")
    return terms.groupBy("column_name", "value").agg(*[F.sum(v).alias(v) for v in chosen])


def long_variants(frequency: DataFrame) -> DataFrame:
    """One row per variant: column_name, value, variant, metric."""
    variants = [v for v in frequency.columns if v in VARIANTS]
    cells = frequency.select("column_name", "value",
                             *[F.col(v).cast("double").alias(v) for v in variants])
    return cells.unpivot(["column_name", "value"], variants, "variant", "metric")


def frequency_cells(df: DataFrame, columns: Columns, group: str, keep: Mapping | None = None,
                    run_order: str | None = None) -> DataFrame:
    """The matrix in sparse form, for any number of values.

    One row per group, column and value that occurs: count, binary_count,
    binary_count_normalized and aggregate_count_normalized of that group alone.
    """
    ids = [group, "run_start"] if run_order else [group]
    terms = _with_terms(grouped_counter(df, columns, group, keep, run_order), ids)
    allowed = _restriction(columns)
    return terms if allowed is None else terms.filter(allowed)


def count_cells(df: DataFrame, columns: Columns, group: str, keep: Mapping | None = None) -> DataFrame:
    """The counts of :func:`frequency_cells` alone, which need no totals of the groups."""
    return grouped_counter(df, columns, group, keep).withColumnRenamed("n", "count")


def frequency_matrix(df: DataFrame, column: str, group: str, values: Iterable,
                     variant: str = "count", keep: Mapping | None = None) -> DataFrame:
    """One row per group, one column per value, zero where the value does not occur.

    The values are the caller's: any texts, also ones that differ in case only. NULL and the
    empty text share the column of the empty text. A value named like the group column is an
    error. The matrix over a whole vocabulary is :func:`frequency_cells`, at any size.
    """
    values = list(values)
    cells = matrix_cells(df, {column: values}, group, [variant], keep)
    return matrix_of_cells(cells, group, values, variant)


def matrix_cells(df: DataFrame, values: Mapping[str, Iterable], group: str,
                 variants: Iterable[str] = MATRIX_VARIANTS, keep: Mapping | None = None) -> DataFrame:
    """What the matrices of some columns show: the cells of their listed values alone.

    group, column_name, value and the variants. The other values of a group are one row without
    amounts, which keeps its group in the matrix and its share in the totals; so the totals are
    sums over few rows a group, and no cell of another value is moved or stored. Only
    binary_count_normalized needs each of the others once, to count them.
    """
    variants = list(variants)
    if set(variants) - set(MATRIX_VARIANTS):
        raise ValueError(f"variant must be one of {MATRIX_VARIANTS}")
    listed = any_of([(F.col("column_name") == name) & F.coalesce("value", F.lit("")).isin(
        [value or "" for value in of]) for name, of in values.items()])
    place = [group, "column_name", listed.alias("_listed"), F.when(listed, F.col("value")).alias("value")]
    if "binary_count_normalized" in variants:
        counts = grouped_counter(df, list(values), group, keep).groupBy(*place).agg(
            F.sum("n").alias("n"), F.count("*").alias("k"))
    else:
        counts = _long(keep_rows(df, keep), list(values), [group]).groupBy(*place).agg(
            F.count("*").alias("n"), F.lit(1).cast("long").alias("k"))
    whole = Window.partitionBy(group, "column_name")
    terms = {"count": F.col("n"), "binary_count": F.lit(1).cast("long"),
             "binary_count_normalized": F.lit(1.0) / F.sum("k").over(whole),
             "aggregate_count_normalized": F.col("n") / F.sum("n").over(whole)}
    return counts.select(group, "column_name", "value",
                         *[F.when(F.col("_listed"), terms[v]).alias(v) for v in variants])


def matrix_of_cells(cells: DataFrame, group: str, values: Iterable,
                    variant: str = "count") -> DataFrame:
    """The matrix of one column's :func:`frequency_cells`; see :func:`frequency_matrix`."""
    if variant not in MATRIX_VARIANTS:
        raise ValueError(f"variant must be one of {MATRIX_VARIANTS}")
    values = list(dict.fromkeys(value or "" for value in values))
    if group in values:
        raise ValueError(f"a value is named like the group column: {group}")
    # The others only keep their group in the matrix: one row a group, combined before any move.
    value = F.coalesce("value", F.lit(""))
    listed = value.isin(values)
    cells = cells.select(group, F.when(listed, value).alias("value"),
                         F.when(listed, F.col(variant)).alias(variant))
    # Columns go by place until the end: names of values may clash or need quoting.
    places = [f"__v{i}" for i in range(len(values))]
    wide = cells.groupBy(group).pivot("value", values).agg(F.sum(variant)).toDF("__group", *places)
    return wide.select("__group", *[F.coalesce(F.col(v), F.lit(0)) for v in places]).toDF(
        group, *values)


def vocabulary(cells: DataFrame) -> DataFrame:
    """(value, place): the distinct values of a column ``value`` in order, numbered from 0.

    NULL and the empty text are one value. The values are sorted and numbered by Spark, so a
    vocabulary of any size passes nothing but one offset a partition through the driver.
    """
    values = cells.select(F.coalesce("value", F.lit("")).alias("value")).distinct()
    return with_line_number(values, ["value"], "place", 0)


def sparse_matrix(cells: DataFrame, words: DataFrame, group: str, variant: str = "count") -> DataFrame:
    """The matrix over a whole vocabulary: one row per group with ``places`` and ``amounts``.

    ``cells`` as :func:`frequency_cells` gives them of one column (for the variant count,
    :func:`count_cells` will do), ``words`` its :func:`vocabulary`. ``places`` ascend; a place that is not among them is zero. A row holds
    what occurs in its group, not the vocabulary.
    """
    return _placed(cells, words, group, variant).groupBy(group).agg(
        F.array_sort(F.collect_list(F.struct("place", "amount"))).alias("c")).select(
            group, F.col("c.place").alias("places"), F.col("c.amount").alias("amounts"))


def _placed(cells: DataFrame, words: DataFrame, group: str, variant: str,
            *parts: Column) -> DataFrame:
    """(group, parts, place, amount), the cells of NULL and the empty text added up.

    The cells are brought together by group and ``parts``, which serves the sum and what the
    caller collects. A task holds its share of the vocabulary, one row for each value, so the
    cells need no sorting.
    """
    if variant not in MATRIX_VARIANTS:
        raise ValueError(f"variant must be one of {MATRIX_VARIANTS}")
    named = words.select(F.col("value").alias("_word"), "place")
    asked = cells.select(group, F.coalesce("value", F.lit("")).alias("value"), F.col(variant).alias("amount"))
    # A frequent value is a hot key of the cells: the vocabulary is the side with one row for each.
    met = asked.join(lookup_side(named).hint("shuffle_hash"), F.col("value") == F.col("_word"))
    met = met.select(group, *parts, "place", "amount")
    place = [c for c in met.columns if c not in ("place", "amount")]
    return met.repartition(*place).groupBy(*place, "place").agg(F.sum("amount").alias("amount"))


def column_blocks(cells: DataFrame, words: DataFrame, group: str, variant: str = "count",
                  width: int = 1000) -> DataFrame:
    """The matrix in blocks of ``width`` columns: group, block, ``amounts`` with its zeros.

    A block without any value of a group has no row.
    """
    block = F.floor(F.col("place") / width).alias("block")
    entry = F.struct((F.col("place") - F.col("block") * width).cast("int").alias("at"), "amount")
    held = _placed(cells, words, group, variant, block).groupBy(group, "block").agg(
        F.array_sort(F.collect_list(entry)).alias("c"))
    size = F.least(F.lit(width).cast("long"), F.lit(words.count()) - F.col("block") * width).cast("int")
    zero = F.lit(0).cast(held.schema["c"].dataType.elementType["amount"].dataType)
    # Each amount after the zeros before it, then the zeros behind the last one.
    filled = F.transform("c", lambda e, i: F.concat(F.array_repeat(
        zero, e["at"] - F.coalesce(F.get("c", i - 1)["at"] + 1, F.lit(0))), F.array(e["amount"])))
    rest = F.array_repeat(zero, size - F.element_at("c", -1)["at"] - 1)
    return held.select(group, "block", F.concat(F.flatten(filled), rest).alias("amounts"))
