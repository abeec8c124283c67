"""Writers. Partitioned output is rebalanced first: a hot partition is split over many tasks
and files, small ones do not leave a file per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstrata.functions.text import capitalized
from logstrata.operators.changes import commit_messages
from logstrata.operators.frequency import MATRIX_VARIANTS, matrix_cells, matrix_of_cells
from logstrata.session import scratch_path


def write_facts(df: DataFrame, path: str, output_format: str = "parquet",
                partition_by: list[str] | None = None, keep_others: bool = False) -> None:
    """gzip parquet, or CSV with a header.

    What is at ``path`` is replaced; with ``keep_others`` only the partitions that ``df`` has
    rows of, so that a rerun of one repository leaves the files of all others alone.
    """
    if output_format not in ("parquet", "csv"):
        raise ValueError("output_format must be parquet or csv")
    if partition_by:
        df = df.hint("rebalance", *[F.col(name) for name in partition_by])
    writer = df.write.mode("overwrite").partitionBy(*(partition_by or []))
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic" if keep_others else "static")
    if output_format == "parquet":
        writer.option("compression", "gzip").parquet(path)
    else:
        writer.option("header", True).option("escape", '"').csv(path)


def export_commit_messages(commits: DataFrame, path: str) -> None:
    """JSON lines with the keys in order."""
    messages = commit_messages(commits)
    messages.select(*sorted(messages.columns)).write.mode("overwrite").json(path)


def write_per_group(df: DataFrame, group: str, path: str) -> None:
    """One CSV folder per value of the group column."""
    write_facts(df, path, "csv", [group])


def write_matrices(df: DataFrame, columns: list[str], group: str, path: str,
                   values: dict[str, list], variants: list[str] | None = None,
                   keep: dict | None = None) -> list[str]:
    """One CSV folder per counted column and variant; the column list is the caller's.

    The rows are read and counted once: the cells of the listed values in all columns and variants
    are stored in the shared folder, and each folder is a pivot of its column's part of them.
    """
    store = scratch_path(df.sparkSession, "cells")
    values = {c: list(values[c]) for c in columns}
    cells = matrix_cells(df, values, group, variants or MATRIX_VARIANTS, keep)
    cells.write.partitionBy("column_name").parquet(store)
    cells = df.sparkSession.read.parquet(store)
    folders = []
    for column in columns:
        part = cells.filter(F.col("column_name") == column)
        for variant in variants or MATRIX_VARIANTS:
            folder = f"{path}_{column}_{variant}"
            write_facts(matrix_of_cells(part, group, values[column], variant), folder, "csv")
            folders.append(folder)
    return folders


def write_variants(long_frequency: DataFrame, path: str) -> None:
    """Long-form frequencies, one folder per variant."""
    write_facts(long_frequency, path, "csv", ["variant"])


def cohort_names(language: Column, repo: Column, cohort: Column) -> Column:
    """``Java_Elasticsearch_Fix`` and the like, as a column."""
    return F.concat_ws("_", capitalized(language), capitalized(repo), cohort)
