"""Readers for version-control tables, issue exports, fact tables and batch configurations.

A record that does not fit its schema never ends a job: scans come as (rows, rejects).
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logstrata.operators.cohorts import with_id_lists
from logstrata.schemas import (BATCH_CONFIG, BLAME_LINES, COMMIT_DIFFS, COMMITS, FILE_BLOBS,
                               ISSUE_ID_LISTS, ISSUES)

CORRUPT = "_corrupt_record"


class Scan(NamedTuple):
    """``rows`` that fit the schema; ``rejects``: repo, file, record, reason and stage."""

    rows: DataFrame
    rejects: DataFrame


def _file() -> Column:
    return F.col("_metadata.file_path").alias("file")


def _scan(spark: SparkSession, path: str, schema: T.StructType, required: list[str],
          fmt: str) -> Scan:
    """Records of one schema below ``path``; ``repo=<name>`` folders give the repository.

    JSON records that cannot be parsed, or have a value of another type, are rejects as they
    stand in the file (``malformed_record``); so are records without a key (``missing_key``).
    A filter on ``repo`` reads the folders of those repositories alone.
    """
    if fmt == "json":
        # Parsed as a whole whatever columns are asked for: a reader of records would parse only
        # these, and not see the others' errors.
        lines = spark.read.text(path)
        in_folders = "repo" in lines.columns
        if in_folders:
            lines = spark.read.schema("value string, repo string").text(path)
        given = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        parsed = lines.where("value <> ''").select("*", _file(), F.from_json(
            "value", given, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
        table = parsed.select(
            *[F.col("repo") if in_folders and name == "repo" else F.col(f"r.{name}")
              for name in schema.fieldNames()], "file", "value", F.col(f"r.{CORRUPT}").alias(CORRUPT))
        broken, record = F.col(CORRUPT).isNotNull(), F.col("value")
    elif fmt == "parquet":
        table, broken = spark.read.schema(schema).parquet(path).select("*", _file()), F.lit(False)
        record = F.to_json(F.struct(*schema.fieldNames()))
    else:
        raise ValueError("a table is json or parquet")
    keyless = F.lit(False)
    for name in required:
        keyless = keyless | F.col(name).isNull()
    rows = table.where(~broken & ~keyless).select(*schema.fieldNames())
    rejects = table.select("repo", "file", record.alias("record"), F.when(
        broken, "malformed_record").when(keyless, "missing_key").alias("reason")) \
        .where(F.col("reason").isNotNull()).withColumn("stage", F.lit("Scan"))
    return Scan(rows, rejects)


def read_commits(spark: SparkSession, path: str, fmt: str = "json") -> Scan:
    """Commits, told by ``commit_sha``."""
    return _scan(spark, path, COMMITS, ["commit_sha"], fmt)


def read_diffs(spark: SparkSession, path: str, fmt: str = "json") -> Scan:
    """Diff texts, one for each ``commit_sha``."""
    return _scan(spark, path, COMMIT_DIFFS, ["commit_sha"], fmt)


def read_blobs(spark: SparkSession, path: str, fmt: str = "json") -> Scan:
    """Texts of files, told by ``sha`` and ``path``."""
    return _scan(spark, path, FILE_BLOBS, ["sha", "path"], fmt)


def read_blame(spark: SparkSession, path: str, fmt: str = "json") -> Scan:
    """Origins of lines, told by ``commit_sha``, ``path`` and ``line_no``."""
    return _scan(spark, path, BLAME_LINES, ["commit_sha", "path", "line_no"], fmt)


def resolve_format(path: str, fmt: str | None = None) -> str:
    """The given format, else the one the file extension names."""
    fmt = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if fmt not in ("csv", "json"):
        raise ValueError(f"name the format of {path}: csv or json")
    return fmt


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("header", True).option("inferSchema", False)
            .option("multiLine", True).option("escape", '"').option("maxCharsPerColumn", -1)
            .csv(path).na.fill(""))


def _issue_lines(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(file, value): the lines of JSON exports but the first one of each file.

    The CSV reader with a single unquoted column drops the header line of every file.
    """
    return (spark.read.schema("value string").option("header", True)
            .option("enforceSchema", True).option("sep", "\x01").option("quote", "")
            .option("escape", "").option("maxCharsPerColumn", -1)
            .option("recursiveFileLookup", recursive).csv(path).select(_file(), "value"))


def _issue_scan(lines: DataFrame, repo: Column) -> Scan:
    """Issues of (file, value) lines; a line that is no issue record is a reject."""
    given = T.StructType([*ISSUES.fields, T.StructField(CORRUPT, T.StringType())])
    record = F.from_json("value", given, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    parsed = lines.select("*", record.alias("issue"))
    broken = F.col("issue").isNull() | F.col(f"issue.{CORRUPT}").isNotNull()
    rows = parsed.where(~broken).select(repo.alias("repo"), "issue.*").drop(CORRUPT)
    rejects = parsed.where(broken).select(
        repo.alias("repo"), "file", F.col("value").alias("record"),
        F.lit("malformed_record").alias("reason"), F.lit("Cohort").alias("stage"))
    return Scan(with_id_lists(rows), rejects)


def scan_issues(spark: SparkSession, path: str, fmt: str | None = None,
                list_separator: str = ",") -> Scan:
    """Issue records of one repository, one row each, and the lines that are none.

    Absent id lists are empty, absent labels are NULL. JSON lines: the first line of each file
    is a header and is dropped. CSV: the id lists are split at ``list_separator``; labels stay
    text, so label filters match substrings; every line fits, so there are no rejects.
    """
    none = F.lit(None).cast("string")
    if resolve_format(path, fmt) == "json":
        found = _issue_scan(_issue_lines(spark, path), none)
        return Scan(found.rows.drop("repo"), found.rejects)
    table = _csv(spark, path)
    for name in ISSUE_ID_LISTS:
        if name in table.columns:
            parts = F.transform(F.split(name, re.escape(list_separator)),
                                lambda part: F.trim(part))
            table = table.withColumn(name, F.filter(parts, lambda part: part != ""))
    rejects = spark.createDataFrame([], "repo string, file string, record string, reason string, "
                                        "stage string")
    return Scan(with_id_lists(table), rejects)


def read_issues(spark: SparkSession, path: str, fmt: str | None = None,
                list_separator: str = ",") -> DataFrame:
    """The rows of :func:`scan_issues`."""
    return scan_issues(spark, path, fmt, list_separator).rows


def _plain_path(file: Column) -> Column:
    """A file's path without scheme, decoded."""
    decoded = F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^[A-Za-z][A-Za-z0-9+.-]*:/+", "/")


def read_issue_files(spark: SparkSession, config: DataFrame) -> Scan:
    """The issues of all repositories of a batch configuration, each row with its ``repo``.

    One scan reads all files of the configuration's issue folder; the file a line comes from,
    or the folder directly below where an export has several parts, is joined to the
    ``issue_file_name`` of the repository. Files that no repository names are not parsed. A
    configured file that is absent or empty is a reject (``issue_file_missing``), with its name as
    ``file``; lines that are no issue records are rejects, too.
    """
    base = config.select("issue_base_address").first()
    if base is None:
        raise ValueError("the configuration names no repository")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base[0])
    whole = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()) \
        .makeQualified(folder).toString()
    root = F.regexp_replace(F.lit(whole), "^[A-Za-z][A-Za-z0-9+.-]*:/+", "/")

    def name_of(file: Column) -> Column:
        below = F.substr(_plain_path(file), F.length(root) + 2)
        return F.get(F.split(below, "/"), F.lit(0))

    wanted = config.select("repo", F.col("issue_file_name").alias("_name"))
    lines = _issue_lines(spark, base[0], recursive=True).withColumn("_name", name_of(F.col("file")))
    found = _issue_scan(lines.join(wanted, "_name"), F.col("repo"))
    # The listing alone: the content column is not read.
    there = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base[0])
             .select(name_of(F.col("path")).alias("_name")).distinct())
    absent = wanted.join(there, "_name", "left_anti").select(
        "repo", F.col("_name").alias("file"), F.lit(None).cast("string").alias("record"),
        F.lit("issue_file_missing").alias("reason"), F.lit("Cohort").alias("stage"))
    return Scan(found.rows, found.rejects.unionByName(absent))


def read_facts(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A fact table with a header, all columns text, empty cells empty text.

    Parquet keeps its own types.
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    return _csv(spark, path)


def read_batch_config(spark: SparkSession, path: str) -> DataFrame:
    """One row per repository with the settings all of them share.

    The record without a repository holds the shared settings. It is a single record, so it is
    fetched and put into the plan as constants.
    """
    shared_columns = [f.name for f in BATCH_CONFIG if f.name not in
                      ("repo_name", "issue_file_name", "bug_label")]
    records = spark.read.schema(BATCH_CONFIG).json(path)
    shared = records.filter(F.col("repo_name").isNull()
                            & F.col("language_label").isNotNull()).select(*shared_columns).first()
    if shared is None:
        raise ValueError(f"{path} has no record with the shared settings")
    repos = records.filter(F.col("repo_name").isNotNull())
    return repos.select(*[F.lit(shared[name]).alias(name) for name in shared_columns],
                        F.col("repo_name").alias("repo"), "issue_file_name", "bug_label")
