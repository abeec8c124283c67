"""Table schemas and the key-column convention.

Every table may carry a ``repo`` column. Where it does, it is part of every key, so many
repositories are analysed in one plan; where it does not, the table holds one repository.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_STRINGS = T.ArrayType(T.StringType())


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


ISSUES = T.StructType(
    _strings("number", "issue_number", "repository_name", "issue_title")
    + [T.StructField("issue_labels", _STRINGS),
       T.StructField("issue_commit_id", _STRINGS),
       T.StructField("issue_closed_commit_id", _STRINGS),
       T.StructField("commit_id_similar_to_issue_title", _STRINGS)]
    + _strings("diff_url", "html_url", "patch_url"))

ISSUE_ID_LISTS = ["issue_closed_commit_id", "issue_commit_id", "commit_id_similar_to_issue_title"]

COMMITS = T.StructType(
    _strings("repo", "commit_sha")
    + [T.StructField("parent_shas", _STRINGS)]
    + _strings("author_name", "author_email")
    + [T.StructField("authored_epoch", T.LongType()),
       T.StructField("author_tz_offset", T.LongType()),
       T.StructField("message", T.StringType()),
       T.StructField("commit_seq", T.LongType())])

COMMIT_DIFFS = T.StructType(
    _strings("repo", "commit_sha")
    + [T.StructField("n_parents", T.IntegerType()), T.StructField("diff_text", T.StringType())])

FILE_BLOBS = T.StructType(_strings("repo", "sha", "path", "text"))

BLAME_LINES = T.StructType(
    _strings("repo", "commit_sha", "path")
    + [T.StructField("line_no", T.LongType())]
    + _strings("blame_commit_sha", "content"))

BATCH_CONFIG = T.StructType(
    _strings("language_label", "repo_base_address", "issue_base_address", "output_folder")
    + [T.StructField("retrieve_other_commit_id_from_issue_tracker", T.BooleanType()),
       T.StructField("consider_issues_without_labels_as_other", T.BooleanType()),
       T.StructField("log_flag", T.BooleanType())]
    + _strings("repo_name", "issue_file_name", "bug_label"))


def keys(df: DataFrame, *names: str) -> list[str]:
    """``names``, preceded by ``repo`` where the table has one."""
    return (["repo"] if "repo" in df.columns else []) + list(names)
