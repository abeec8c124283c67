"""Fix, non-fix and all cohorts of commits.

One pass over the issues turns them into an id table with two flags (named by a bug issue,
named by another issue); one join puts the flags on the commits. All three cohorts are then
plain filters, so neither input is read again for the next cohort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstrata.operators.filters import label_condition
from logstrata.schemas import ISSUE_ID_LISTS, keys

SIMILAR_LIMIT = 10
LABELS = "issue_labels"


def with_id_lists(issues: DataFrame) -> DataFrame:
    """Absent id lists become empty; labels stay NULL where the issue has none."""
    for name in ISSUE_ID_LISTS:
        value = F.col(name) if name in issues.columns else F.lit(None).cast("array<string>")
        issues = issues.withColumn(name, F.coalesce(value, F.array().cast("array<string>")))
    return issues


def _all_ids(similar_limit: int | None) -> Column:
    closed, named, similar = (F.col(name) for name in ISSUE_ID_LISTS)
    if similar_limit is None:
        return F.concat(closed, named, similar)
    empty = F.array().cast("array<string>")
    return F.concat(closed, named,
                    F.when(F.size(similar) > similar_limit, empty).otherwise(similar))


def similar_lists_left_out(issues: DataFrame,
                           similar_limit: int | None = SIMILAR_LIMIT) -> DataFrame:
    """The issues whose list of similar ids the limit leaves out, with the list's size."""
    size = F.size(ISSUE_ID_LISTS[2]).cast("long")
    over = F.lit(False) if similar_limit is None else size > similar_limit
    return with_id_lists(issues).filter(over).select(
        *keys(issues, "issue_number"), size.alias("list_size"),
        F.lit("similar_list_over_limit").alias("reason"), F.lit("Cohort").alias("stage"))


def issue_commit_ids(issues: DataFrame, similar_limit: int | None = SIMILAR_LIMIT) -> DataFrame:
    """Distinct commit ids the issues name. A list of more than ``similar_limit`` similar ids is
    noise and is left out as a whole (see :func:`similar_lists_left_out`); None keeps all."""
    ids = with_id_lists(issues).select(
        *keys(issues), F.explode_outer(_all_ids(similar_limit)).alias("commit_sha"))
    return ids.filter(F.col("commit_sha").isNotNull()).distinct()


def message_has(keyword: str) -> Column:
    """The message holds the keyword after a space, whatever the case."""
    return F.coalesce(F.contains(F.lower("message"), F.lit(" " + keyword.lower())), F.lit(False))


def search_commits(commits: DataFrame, keyword: str) -> DataFrame:
    return commits.filter(message_has(keyword))


def fix_commit_ids(issues: DataFrame, commits: DataFrame, label: Column | str,
                   attribute: str = LABELS, keyword: str | None = "fix",
                   similar_limit: int | None = SIMILAR_LIMIT) -> DataFrame:
    """Ids named by issues with the label, and ids of commits whose message has the keyword."""
    ids = issue_commit_ids(issues.filter(label_condition(issues, attribute, label)),
                           similar_limit)
    if keyword:
        found = search_commits(commits, keyword).select(*keys(commits, "commit_sha"))
        ids = ids.unionByName(found).distinct()
    return ids


def non_fix_commit_ids(issues: DataFrame, commits: DataFrame, label: Column | str,
                       attribute: str = LABELS, keyword: str | None = "fix",
                       unlabelled_as_other: bool = True,
                       similar_limit: int | None = SIMILAR_LIMIT) -> DataFrame:
    """Ids named by the other issues, without the fix ids."""
    other = issues.filter(label_condition(issues, attribute, label, keep=False,
                                          drop_missing=not unlabelled_as_other))
    fix = fix_commit_ids(issues, commits, label, attribute, keyword, similar_limit)
    return issue_commit_ids(other, similar_limit).join(fix, keys(commits, "commit_sha"), "left_anti")


def commits_by_ids(commits: DataFrame, ids: DataFrame) -> DataFrame:
    """The commits with one of the ids; ids are compared as full text."""
    return commits.join(ids, keys(commits, "commit_sha"), "left_semi")


def unresolved_ids(ids: DataFrame, commits: DataFrame) -> DataFrame:
    """The ids that name no commit."""
    return ids.join(commits, keys(commits, "commit_sha"), "left_anti")


def issue_id_flags(issues: DataFrame, label: Column | str, attribute: str = LABELS,
                   unlabelled_as_other: Column | bool = True,
                   similar_limit: int | None = SIMILAR_LIMIT) -> DataFrame:
    """One row per id: named by a bug issue, named by another issue.

    ``unlabelled_as_other`` may be a column of the issues.
    """
    bug = label_condition(issues, attribute, label)
    labelled, every = (label_condition(issues, attribute, label, keep=False, drop_missing=drop)
                       for drop in (True, False))
    policy = unlabelled_as_other if isinstance(unlabelled_as_other, Column) \
        else F.lit(unlabelled_as_other)
    other = F.when(F.coalesce(policy, F.lit(False)), every).otherwise(labelled)
    flagged = with_id_lists(issues).select(
        *keys(issues), bug.alias("in_bug"), other.alias("in_other"),
        F.explode_outer(_all_ids(similar_limit)).alias("commit_sha"))
    return (flagged.filter(F.col("commit_sha").isNotNull())
            .groupBy(*keys(issues, "commit_sha"))
            .agg(F.max("in_bug").alias("in_bug"), F.max("in_other").alias("in_other")))


def tag_cohorts(commits: DataFrame, issues: DataFrame, label: Column | str,
                attribute: str = LABELS, keyword: str | None = "fix",
                mode: Column | str = "repository", unlabelled_as_other: Column | bool = True,
                similar_limit: int | None = SIMILAR_LIMIT) -> DataFrame:
    """Commits with ``is_fix`` and ``is_non_fix``.

    ``mode='repository'``: every commit that is no fix. ``mode='tracker'``: only those an
    issue without the label names; such commits may be neither. ``mode`` may be a column of the
    commits, ``unlabelled_as_other`` one of the issues.
    """
    if not isinstance(mode, Column) and mode not in ("repository", "tracker"):
        raise ValueError(f"unknown mode: {mode}")
    mode = mode if isinstance(mode, Column) else F.lit(mode)
    flags = issue_id_flags(issues, label, attribute, unlabelled_as_other, similar_limit)
    false = F.lit(False)
    is_fix = F.coalesce("in_bug", false)
    if keyword:
        is_fix = is_fix | message_has(keyword)
    is_other = (mode == "repository") | F.coalesce("in_other", false)
    return (commits.join(flags, keys(commits, "commit_sha"), "left")
            .withColumn("is_fix", is_fix)
            .withColumn("is_non_fix", is_other & ~F.col("is_fix"))
            .drop("in_bug", "in_other"))


def cohort(tagged: DataFrame, name: str) -> DataFrame:
    """``all``, ``fix`` or ``non_fix`` of :func:`tag_cohorts`."""
    conditions = {"all": F.lit(True), "fix": F.col("is_fix"), "non_fix": F.col("is_non_fix")}
    if name not in conditions:
        raise ValueError(f"unknown cohort: {name}")
    return tagged.filter(conditions[name]).drop("is_fix", "is_non_fix")


def fix_commits(commits: DataFrame, issues: DataFrame, label: Column | str,
                **options) -> DataFrame:
    return cohort(tag_cohorts(commits, issues, label, **options), "fix")


def non_fix_commits(commits: DataFrame, issues: DataFrame, label: Column | str,
                    mode: str = "repository", **options) -> DataFrame:
    return cohort(tag_cohorts(commits, issues, label, mode=mode, **options), "non_fix")


def count_commits(commits: DataFrame) -> DataFrame:
    grouping = keys(commits)
    return commits.groupBy(*grouping).agg(F.count("*").alias("n_commits"))
