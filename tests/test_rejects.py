"""Rows that give no facts are named, with the reason."""

from logstrata.operators import cohorts, diff


def test_rename_only_commits_are_empty(spark):
    rename = ("diff --git a/x b/y\nsimilarity index 90%\nrename from x\nrename to y\n"
              "--- a/x\n+++ b/y\n@@ -1 +1 @@\n-a\n+b\n")
    plain = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n"
    diffs = spark.createDataFrame([("c1", 1, rename), ("c2", 1, plain), ("c3", 0, plain), ("c4", 1, "")],
                                  "commit_sha string, n_parents int, diff_text string")
    found = {(r.commit_sha, r.reason) for r in diff.diff_rejects(diffs, "User behavior").collect()}
    assert found == {("c1", "empty_diff"), ("c3", "no_parent"), ("c4", "empty_diff")}


def test_similar_lists_over_the_limit(spark):
    issues = spark.createDataFrame([("1", ["a", "b", "c"]), ("2", ["d"])],
                                   "issue_number string, commit_id_similar_to_issue_title array<string>")
    left_out = cohorts.similar_lists_left_out(issues, 2).collect()
    assert [(r.issue_number, r.list_size) for r in left_out] == [("1", 3)]
    assert {r.commit_sha for r in cohorts.issue_commit_ids(issues, 2).collect()} == {"d"}
    assert cohorts.issue_commit_ids(issues, None).count() == 4
    assert cohorts.similar_lists_left_out(issues, None).count() == 0
