"""Facts about commits and the files they change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstrata.functions.text import author_local_asctime, not_blank, trimmed, utc_offset_label
from logstrata.operators.numbering import with_line_number
from logstrata.operators.skew import lookup_side
from logstrata.schemas import keys


def _header() -> list[Column]:
    return [F.col("author_name").alias("author"),
            F.coalesce("author_email", F.lit("")).alias("author_email"),
            author_local_asctime(F.col("authored_epoch"), F.col("author_tz_offset"))
            .alias("authored_date"),
            utc_offset_label(F.col("author_tz_offset")).alias("authored_time_zone_offset")]


def commit_header(commits: DataFrame, *further: Column) -> DataFrame:
    """Author, e-mail (empty if there is none), author-local date, zone label, id."""
    return commits.select(*keys(commits, "commit_sha"), *_header(), *further)


def time_commits(commits: DataFrame, numbered: bool = False) -> DataFrame:
    """One header row per commit of a cohort; ``numbered`` adds line_number by commit_seq."""
    if not numbered:
        return commit_header(commits)
    rows = commits.select(*keys(commits, "commit_seq", "commit_sha"), *_header())
    return with_line_number(rows, keys(commits, "commit_seq")).drop("commit_seq")


def commit_messages(commits: DataFrame) -> DataFrame:
    return commits.select(*keys(commits), F.col("commit_sha").alias("commit_hash"),
                          F.col("message").alias("commit_message"))


def line_counts(lines: DataFrame) -> DataFrame:
    """Per-file counts from a table of diff lines (op ``+``, ``-`` or space).

    The same count columns as :func:`logstrata.operators.diff.parse_unified_diff`, for users
    who keep lines instead of diff text. A file without changed lines keeps its zero row.
    """
    shown = not_blank(F.col("value"))
    added, removed = F.col("op") == "+", F.col("op") == "-"
    return lines.groupBy(*keys(lines, "commit_sha", "path")).agg(
        F.count_if(added).alias("adds"), F.count_if(removed).alias("deletes"),
        F.count_if(added & shown).alias("added_lines"),
        F.count_if(removed & shown).alias("deleted_lines"))


def commit_totals(counts: DataFrame) -> DataFrame:
    """Added and deleted lines of the whole commit, blank ones included."""
    return counts.groupBy(*keys(counts, "commit_sha")).agg(
        F.sum("adds").alias("total_added_lines"), F.sum("deletes").alias("total_deleted_lines"))


def of_cohort(table: DataFrame, commits: DataFrame | None) -> DataFrame:
    """The rows of a commit-keyed table whose commit is in the cohort; None means all."""
    if commits is None:
        return table
    key = keys(table, "commit_sha")
    return table.join(lookup_side(commits.select(*key)), key, "left_semi")


def limit_to_files(counts: DataFrame, files: DataFrame | None) -> DataFrame:
    """Rows whose path is in ``files``; no set given means no limit."""
    if files is None:
        return counts
    key = keys(counts, "path")
    return counts.join(lookup_side(files.select(*key).distinct()), key, "left_semi")


def count_changes(counts: DataFrame, commits: DataFrame | None = None,
                  files: DataFrame | None = None) -> DataFrame:
    """Added, deleted and changed lines per commit and file, blank lines included."""
    chosen = limit_to_files(of_cohort(counts, commits), files)
    return chosen.select(*keys(counts), F.col("commit_sha").alias("commit_SHA"), "path", "adds",
                         "deletes", (F.col("adds") + F.col("deletes")).alias("changes"))


def numbered_changes(counts: DataFrame, commits: DataFrame,
                     files: DataFrame | None = None) -> DataFrame:
    """:func:`count_changes` with commit_number and line_number.

    commit_number counts every commit of the cohort, those without facts included;
    line_number counts every file, those outside ``files`` included.
    """
    key = keys(commits, "commit_sha")
    order = keys(commits, "commit_seq")
    by_commit = with_line_number(commits.select(*key, "commit_seq"), order, "commit_number")
    place = "file_no" if "file_no" in counts.columns else "path"
    facts = counts.select(*dict.fromkeys([*key, "path", place, "adds", "deletes"]))
    rows = facts.join(by_commit, key)
    rows = with_line_number(rows, ["commit_number", place])
    rows = limit_to_files(rows, files)
    return rows.select("line_number", "commit_number", *keys(counts),
                       F.col("commit_sha").alias("commit_SHA"), "path", "adds", "deletes",
                       (F.col("adds") + F.col("deletes")).alias("changes"))


def user_behavior(counts: DataFrame, commits: DataFrame, *further: Column) -> DataFrame:
    """Header of the commit, and ``further`` columns of it, beside the lines it changed in each
    file, blank lines left out."""
    key = keys(counts, "commit_sha")
    facts = counts.select(*key, "deleted_lines", "added_lines", F.col("path").alias("file_paths"))
    return lookup_side(commit_header(commits, *further)).join(facts, key)


def changes_on_not_fixed_files(all_changes: DataFrame, fixed_changes: DataFrame) -> DataFrame:
    """Change rows whose path no fix touches; paths are compared without outer white space."""
    fixed = fixed_changes.select(*keys(fixed_changes), trimmed(F.col("path")).alias("_path"))
    rows = all_changes.withColumn("_path", trimmed(F.col("path")))
    fixed = lookup_side(fixed.distinct())
    return rows.join(fixed, keys(all_changes, "_path"), "left_anti").drop("_path")
