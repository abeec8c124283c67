"""The cohort matrix: every fact builder over all, fix or non-fix commits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstrata.operators import blame, changes, cohorts, diff, tokens
from logstrata.operators.numbering import with_line_number
from logstrata.schemas import keys
from logstrata.session import cut_lineage


@dataclass
class History:
    """The tables of one or many repositories and how to tell a fix.

    ``diffs`` holds the diff text of each commit; ``lines`` may be given instead, where diffs
    are kept as lines already. ``label`` may be a column of ``issues``.
    """

    commits: DataFrame
    issues: DataFrame | None = None
    label: Column | str | None = None
    diffs: DataFrame | None = None
    lines: DataFrame | None = None
    blame_lines: DataFrame | None = None
    blobs: DataFrame | None = None
    keyword: str | None = "fix"
    mode: Column | str = "repository"
    unlabelled_as_other: Column | bool = True
    similar_limit: int | None = cohorts.SIMILAR_LIMIT

    def tagged(self) -> DataFrame:
        return cohorts.tag_cohorts(self.commits, self.issues, self.label, keyword=self.keyword,
                                   mode=self.mode, unlabelled_as_other=self.unlabelled_as_other,
                                   similar_limit=self.similar_limit)

    def cohort(self, name: str = "all") -> DataFrame:
        if name == "all":
            return self.commits
        return cohorts.cohort(self.tagged(), name)

    def patches(self) -> DataFrame:
        return diff.parse_unified_diff(self.diffs)

    def counts(self) -> DataFrame:
        return self.patches() if self.diffs is not None else changes.line_counts(self.lines)

    def _blame_input(self, name: str, commits: DataFrame | None = None) -> DataFrame:
        if self.diffs is None:
            lines = self.lines
        else:
            _, lines = self._from_tagged(diff.tagged_diffs(self.diffs.filter(diff.has_diff()), "removed"))
        if name == "all":
            return lines
        return changes.of_cohort(lines, self.cohort(name) if commits is None else commits)

    def time_commits(self, name: str = "all", numbered: bool = False) -> DataFrame:
        return changes.time_commits(self.cohort(name), numbered)

    def commit_messages(self, name: str = "all") -> DataFrame:
        return changes.commit_messages(self.cohort(name))

    def count_changes(self, name: str = "all", files: DataFrame | None = None) -> DataFrame:
        commits = None if name == "all" else self.cohort(name)
        return changes.count_changes(self.counts(), commits, files)

    def touched_files(self, name: str = "fix") -> DataFrame:
        if self.diffs is None:
            table = self.lines.select(*keys(self.lines, "commit_sha", "path"))
            return (changes.of_cohort(table, self.cohort(name))
                    .select(*keys(table, "path")).distinct())
        return diff.touched_files(changes.of_cohort(self.patches(), self.cohort(name)))

    def count_changes_limited_files(self) -> DataFrame:
        """Non-fix changes of files that a fix touches."""
        return self.count_changes("non_fix", self.touched_files("fix"))

    def user_behavior(self, name: str = "all") -> DataFrame:
        return changes.user_behavior(self.counts(), self.cohort(name))

    def deleted_lines_behavior(self, name: str = "fix", commits: DataFrame | None = None) -> DataFrame:
        """``commits`` may be the cohort, where it is known already."""
        return blame.deleted_lines_behavior(self._blame_input(name, commits), self.blame_lines,
                                            self.commits)

    def time_deleted_lines(self, name: str = "fix", numbered: bool = False) -> DataFrame:
        facts = blame.time_deleted_lines(self._blame_input(name), self.blame_lines, self.commits,
                                         ("commit_seq",) if numbered else ())
        if not numbered:
            return facts
        # In the order of the history, then of the origins.
        place = [*keys(facts), "commit_seq", "fix_commit_sha", "blame_commit_sha"]
        return with_line_number(facts, place).drop("commit_seq")

    def content_tokens(self, name: str = "fix", analyze_part: str = "deleted",
                       numbered: bool = False) -> DataFrame:
        column, _ = tokens.SIDES[analyze_part]
        patches = diff.patches_of(diff.tagged_diffs(self.diffs.filter(diff.has_diff()),
                                                    f"{column}_numbers"))
        return tokens.content_tokens(patches, self.blobs, self.cohort(name), analyze_part, numbered)

    def _from_tagged(self, tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Patches, and the lines blame is asked for, of commits that were parsed before."""
        patches = diff.patches_of(tagged)
        return patches, diff.removed_lines(patches)

    def rejects(self, analyze_part: str = "deleted") -> DataFrame:
        """What gives no facts: stage, commit and reason, for the stages whose tables are given.

        A commit without parent or diff, or with a broken hunk, fails every stage that reads
        diffs; these are parsed once, whatever the number of stages. ``analyze_part`` is the side
        whose file texts the Content stage looks for. A list of similar ids that the limit leaves
        out names its ``issue_number`` in place of a commit.
        """
        found = []
        patches, removed = None, self.lines
        if self.diffs is not None:
            shown = "all" if self.blobs is not None else "removed"
            tagged = cut_lineage(diff.tagged_diffs(self.diffs, shown))
            patches, removed = self._from_tagged(tagged)
            stages = ["User behavior"] + ["Blame"] * (self.blame_lines is not None) \
                + ["Content"] * (self.blobs is not None)
            found.append(diff.rejects_of(tagged, "").withColumn(
                "stage", F.explode(F.array(*[F.lit(stage) for stage in stages]))))
            if self.blobs is not None:
                found.append(tokens.content_rejects(patches, self.blobs, self.commits,
                                                    analyze_part))
        if self.blame_lines is not None and removed is not None:
            verdicts = blame.verdicts(removed, self.blame_lines, self.commits)
            found.append(verdicts.filter(F.col("verdict").endswith("_missing")).select(
                *keys(removed, "commit_sha"), F.col("verdict").alias("reason"),
                F.lit("Blame").alias("stage")))
        if self.issues is not None:
            ids = cohorts.issue_commit_ids(self.issues, self.similar_limit)
            missing = cohorts.unresolved_ids(ids, self.commits)
            found.append(missing.withColumn("reason", F.lit("unresolved_commit"))
                         .withColumn("stage", F.lit("Cohort")))
            lists = cohorts.similar_lists_left_out(self.issues, self.similar_limit)
            found.append(lists.drop("list_size").withColumn(
                "issue_number", F.col("issue_number").cast("string")))
        none = F.lit(None).cast("string")
        union = self.commits.where("false").select(
            *keys(self.commits, "commit_sha"), none.alias("issue_number"), none.alias("reason"),
            none.alias("stage"))
        for part in found:
            union = union.unionByName(part, allowMissingColumns=True)
        return union

    def outcomes(self) -> DataFrame:
        """Every commit with a diff once in each stage that reads diffs: ``facts``, the reason of
        its reject, or ``nothing`` for a commit that has no line the stage asks for."""
        tagged = cut_lineage(diff.tagged_diffs(self.diffs, "removed"))
        key = keys(tagged, "commit_sha")
        state = tagged.select(*key, F.coalesce("reason", F.lit("facts")).alias("outcome"))
        stages = [state.withColumn("stage", F.lit("User behavior"))]
        if self.blame_lines is not None:
            _, removed = self._from_tagged(tagged)
            verdicts = blame.verdicts(removed, self.blame_lines, self.commits)
            told = F.when(F.col("outcome") != "facts", F.col("outcome")).otherwise(
                F.coalesce("verdict", F.lit("nothing")))
            judged = state.join(verdicts, key, "left")
            stages.append(judged.select(*key, told.alias("outcome"), F.lit("Blame").alias("stage")))
        union = stages[0]
        for part in stages[1:]:
            union = union.unionByName(part)
        return union
