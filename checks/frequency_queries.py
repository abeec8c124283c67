"""Frequencies over document tokens and runs over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from logstrata.operators import filters, frequency
from logstrata.session import stored

COLUMNS = ["token_content", "token_type"]
GROUP = "hex_hash"
# The values the restricted forms report.
ALLOWED = {"token_content": ["the", "de", "la", ".", ",", "ing", "que", "und", "en", "an"],
           "token_type": ["name", "number"]}

LONG = """
    select hex_hash, lexer_name, 'token_content' column_name, token_content "value"
    from fx_tokens
    union all select hex_hash, lexer_name, 'token_type', token_type from fx_tokens"""
COUNTED = """select hex_hash, column_name, "value", count(*) n from long_cells group by all"""
TERMS = """
    select *, sum(n) over (partition by hex_hash, column_name) total,
           count(*) over (partition by hex_hash, column_name) n_values
    from counted"""
NAMED = {"long_cells": LONG, "counted": COUNTED, "terms": TERMS}
IN_ALLOWED = " or ".join(
    "(column_name = '{}' and \"value\" in ({}))".format(
        name, ", ".join(f"'{value}'" for value in values)) for name, values in ALLOWED.items())
METRICS = """column_name, "value", count(*) binary_count,
    round(sum(1.0::double / n_values), 6) binary_count_normalized,
    round(sum(n / total), 6) aggregate_count_normalized"""


def _rounded(df):
    names = ["binary_count_normalized", "aggregate_count_normalized"]
    return df.select(*[F.round(c, 6).alias(c) if c in names else c for c in df.columns])


@query("tokens_kept", """select * from fx_tokens where lexer_name = 'en'
                         and token_type in ('name', 'number')""")
def tokens_kept(t):
    return filters.keep_rows(t("fx_tokens"), {"lexer_name": "en",
                                              "token_type": ["name", "number"]})


@query("tokens_excepted", """select * from fx_tokens where lexer_name <> 'en'
                             and token_type not in ('operator', 'number')""")
def tokens_excepted(t):
    return filters.except_rows(t("fx_tokens"), {"lexer_name": "en",
                                                "token_type": ["operator", "number"]})


@query("value_frequency", """select column_name, "value", count(*) "count" from long_cells
                             group by all""", long_cells=LONG)
def value_frequency(t):
    return frequency.value_frequency(t("fx_tokens"), COLUMNS)


@query("value_frequency_kept", """select column_name, "value", count(*) "count" from long_cells
       where lexer_name in ('en', 'fr') group by all""", long_cells=LONG)
def value_frequency_kept(t):
    return frequency.value_frequency(t("fx_tokens"), COLUMNS, {"lexer_name": ["en", "fr"]})


@query("value_frequency_of_allowed", f"""select column_name, "value", count(*) "count"
       from long_cells where {IN_ALLOWED} group by all""", long_cells=LONG)
def value_frequency_of_allowed(t):
    return frequency.value_frequency(t("fx_tokens"), ALLOWED)


@query("sub_group_frequency", """select token_type, token_content "value", count(*) "count"
       from fx_tokens where lexer_name = 'en' and token_content not in ('.', ',')
       group by all""")
def sub_group_frequency(t):
    return frequency.frequency_sub_group(t("fx_tokens"), "token_type", "token_content",
                                         {"lexer_name": "en"}, [".", ","])


@query("grouped_counter", 'select hex_hash, column_name, "value", n from counted',
       long_cells=LONG, counted=COUNTED)
def grouped_counter(t):
    return frequency.grouped_counter(t("fx_tokens"), COLUMNS, GROUP)


@query("binary_frequency", """select column_name, "value", count(*) binary_count,
       round(sum(1.0::double / n_values), 6) binary_count_normalized from terms group by all""",
       **NAMED)
def binary_frequency(t):
    return _rounded(frequency.normalized_frequency(t("fx_tokens"), COLUMNS, GROUP,
                                                   aggregate=False))


@query("aggregate_frequency", """select column_name, "value",
       round(sum(n / total), 6) aggregate_count_normalized from terms group by all""", **NAMED)
def aggregate_frequency(t):
    return _rounded(frequency.normalized_frequency(t("fx_tokens"), COLUMNS, GROUP,
                                                   binary=False))


@query("normalized_frequency", f"select {METRICS} from terms group by all", **NAMED)
def normalized_frequency(t):
    return _rounded(frequency.normalized_frequency(t("fx_tokens"), COLUMNS, GROUP))


@query("normalized_frequency_of_allowed",
       f"select {METRICS} from terms where {IN_ALLOWED} group by all", **NAMED)
def normalized_frequency_of_allowed(t):
    return _rounded(frequency.normalized_frequency(t("fx_tokens"), ALLOWED, GROUP))


@query("normalized_frequency_long", f"""
       select column_name, "value", variant, round(metric, 6) metric from (
           select column_name, "value", 'binary_count' variant, count(*)::double metric
           from terms group by all
           union all select column_name, "value", 'binary_count_normalized',
                            sum(1.0::double / n_values) from terms group by all
           union all select column_name, "value", 'aggregate_count_normalized',
                            sum(n / total) from terms group by all)""", **NAMED)
def normalized_frequency_long(t):
    wide = frequency.normalized_frequency(t("fx_tokens"), COLUMNS, GROUP)
    return (frequency.long_variants(wide)
            .select("column_name", "value", "variant", F.round("metric", 6).alias("metric")))


@query("frequency_cells", """select hex_hash, column_name, "value", n "count",
       cast(1 as bigint) binary_count,
       round(1.0::double / n_values, 6) binary_count_normalized,
       round(n / total, 6) aggregate_count_normalized from terms""", **NAMED)
def frequency_cells(t):
    return _rounded(frequency.frequency_cells(t("fx_tokens"), COLUMNS, GROUP))


MATRIX_TERMS = {"count": "n", "binary_count": "1",
                "binary_count_normalized": "1.0::double / n_values",
                "aggregate_count_normalized": "n / total"}


def _register_matrix(variant):
    whole = variant in ("count", "binary_count")
    kind = "bigint" if whole else "double"
    cells = ", ".join(
        "round(cast(coalesce(max(case when \"value\" = '{}' then {} end), 0) as {}), 6) \"{}\""
        .format(value, MATRIX_TERMS[variant], kind, value)
        for value in ALLOWED["token_content"])

    @query(f"frequency_matrix_{variant}", f"""select hex_hash, {cells} from terms
           where column_name = 'token_content' group by hex_hash""", **NAMED)
    def matrix(t):
        wide = frequency.frequency_matrix(t("fx_tokens"), "token_content", GROUP,
                                          ALLOWED["token_content"], variant)
        if whole:
            return wide
        return wide.select(GROUP, *[F.round(f"`{name}`", 6).alias(name)
                                    for name in wide.columns if name != GROUP])


for _variant in MATRIX_TERMS:
    _register_matrix(_variant)


@query("frequency_matrix_without_list", """
       select token_type, """ + ", ".join(
           f"count(*) filter (where lexer_name = '{v}') \"{v}\""
           for v in ("de", "en", "es", "fr")) + """
       from fx_tokens group by token_type""")
def frequency_matrix_without_list(t):
    """The values are the languages of the documents."""
    return frequency.frequency_matrix(t("fx_tokens"), "lexer_name", "token_type",
                                      ["de", "en", "es", "fr"])


MIXED = ["The", "the", "(", "`", "a b", "", "token_content"]


def _mixed_cells(variant):
    kind = "bigint" if variant in ("count", "binary_count") else "double"
    return ", ".join(
        "round(cast(coalesce(max(case when \"value\" = '{}' then {} end), 0) as {}), 6) \"c{}\""
        .format(value, MATRIX_TERMS[variant], kind, i) for i, value in enumerate(MIXED))


@query("frequency_matrix_mixed_case", " union all ".join(
       f"""select '{v}' variant, hex_hash, {_mixed_cells(v).replace(' as bigint', ' as double')}
       from terms where column_name = 'token_content' group by hex_hash"""
       for v in MATRIX_TERMS), **NAMED)
def frequency_matrix_mixed_case(t):
    """Values that differ in case only, or are no plain names; all variants of cells made once."""
    cells = stored(frequency.frequency_cells(t("fx_tokens"), ["token_content"], GROUP), "cells")
    found = None
    for variant in MATRIX_TERMS:
        wide = frequency.matrix_of_cells(cells, GROUP, MIXED, variant)
        names = [f"c{i}" for i in range(len(MIXED))]
        part = wide.toDF(GROUP, *names).select(
            F.lit(variant).alias("variant"), GROUP,
            *[F.round(F.col(n).cast("double"), 6).alias(n) for n in names])
        found = part if found is None else found.union(part)
    return found


@query("column_cardinality", """select column_name, count(*) n_distinct from (
       select distinct column_name, "value" from long_cells) group by all""", long_cells=LONG)
def column_cardinality(t):
    return frequency.column_cardinality(frequency.value_frequency(t("fx_tokens"), COLUMNS))


@query("side_by_side", """
       with by_value as (
           select column_name, "value", count(*) n from long_cells group by all),
       ranked as (
           select *, row_number() over (partition by column_name order by n desc, "value") i
           from by_value)
       select c.i row_number, c."value" token_content, c.n token_content_value,
              t."value" token_type, t.n token_type_value
       from (select * from ranked where column_name = 'token_content') c
       left join (select * from ranked where column_name = 'token_type') t on c.i = t.i""",
       long_cells=LONG)
def side_by_side(t):
    return frequency.side_by_side(frequency.value_frequency(t("fx_tokens"), COLUMNS))


RUNS = """
    select event_type, value, props, min(event_id) over (partition by run) run_start
    from (select *, sum(opens) over (order by event_id) run
          from (select *, case when event_type = lag(event_type) over (order by event_id)
                               then 0 else 1 end opens from events))"""


@query("runs_of_adjacent_keys", """select event_type, run_start, 'props' column_name,
       props "value", count(*) n from runs group by all""", runs=RUNS)
def runs_of_adjacent_keys(t):
    return frequency.grouped_counter(t("events"), ["props"], "event_type", run_order="event_id")


@query("normalized_frequency_by_run", """
       with counted as (select run_start, props, count(*) n from runs group by all),
       terms as (select *, sum(n) over (partition by run_start) total,
                        count(*) over (partition by run_start) n_values from counted)
       select 'props' column_name, props "value", count(*) binary_count,
              round(sum(1.0::double / n_values), 6) binary_count_normalized,
              round(sum(n / total), 6) aggregate_count_normalized
       from terms group by all""", runs=RUNS)
def normalized_frequency_by_run(t):
    return _rounded(frequency.normalized_frequency(t("events"), ["props"], "event_type",
                                                   run_order="event_id"))


def _counts_and_words(t):
    tokens = t("fx_tokens").select(GROUP, "token_content")
    # The texts are taken apart once: the cells are stored, and hold every value.
    cells = stored(frequency.count_cells(tokens, ["token_content"], GROUP), "cells")
    return cells, frequency.vocabulary(cells)


@query("sparse_matrix", f"""
       with places as (select token_content "value", row_number() over (order by token_content) - 1 place
                       from (select distinct token_content from fx_tokens))
       select hex_hash, string_agg(cast(place as varchar), ',' order by place) places,
              string_agg(cast(n as varchar), ',' order by place) amounts
       from (select hex_hash, token_content "value", count(*) n from fx_tokens group by all)
       join places using ("value") group by hex_hash""")
def sparse_matrix(t):
    """All values of a column, one row per group."""
    rows = frequency.sparse_matrix(*_counts_and_words(t), GROUP)
    shown = [F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
             for c in ("places", "amounts")]
    return rows.select(GROUP, *shown)


# About the root of a block's width.
RUN = 40


@query("matrix_column_blocks", f"""
       with places as (select token_content "value", row_number() over (order by token_content) - 1 place
                       from (select distinct token_content from fx_tokens)),
       cells as (select hex_hash, place, place // 2000 block, n
                 from (select hex_hash, token_content "value", count(*) n from fx_tokens group by all)
                 join places using ("value"))
       select hex_hash, block, cast(least(2000, (select count(*) from places) - block * 2000) as int) width,
              cast(sum(n) as bigint) total, cast(sum(n * (place % 2000 + 1)) as bigint) weighted
       from cells group by hex_hash, block""")
def matrix_column_blocks(t):
    """The dense blocks, told by their width, their sum and a sum weighted by the columns."""
    blocks = frequency.column_blocks(*_counts_and_words(t), GROUP, width=2000)
    # A block is mostly zeros. It is cut into runs of cells, and runs of nothing but zeros are left
    # before their cells become rows.
    zero, size = F.lit(0).cast("long"), F.size("amounts")
    runs = F.explode(F.sequence(F.lit(0), size - 1, F.lit(RUN))).alias("start")
    runs = blocks.select(GROUP, "block", size.alias("width"), "amounts", runs)
    runs = runs.select(GROUP, "block", "width", "start", F.slice(
        "amounts", F.col("start") + 1, F.lit(RUN)).alias("cells"))
    runs = runs.where(F.size(F.array_remove("cells", 0)) > 0)
    amounts = runs.select(GROUP, "block", "width", "start",
                          F.posexplode("cells").alias("at", "x")).where(F.col("x") != zero)
    amounts = amounts.withColumn("i", F.col("start") + F.col("at"))
    return amounts.groupBy(GROUP, "block", "width").agg(
        F.sum("x").alias("total"), F.sum(F.col("x") * (F.col("i") + 1)).alias("weighted"))
