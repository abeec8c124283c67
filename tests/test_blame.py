import pytest
from pyspark.sql import functions as F

from logstrata.operators import blame, changes, diff
from logstrata.plans.batch import run_batch, write_batch
from logstrata.plans.history import History
from logstrata.session import scratch_path
from logstrata.sources import readers

DIFF = """diff --git a/f b/f
--- a/f
+++ b/f
@@ -1,3 +1,2 @@
-one
-
-three
+x
 four
diff --git a/g b/g
--- a/g
+++ b/g
@@ -7 +7 @@
-seven
+7
""".replace("@@ -1,3 +1,2 @@", "@@ -1,4 +1,2 @@")


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(repo, sha, 1, DIFF) for repo in ("r1", "r2") for sha in ("c2", "c3")]
    rows += [("r1", "c1", 0, None), ("r2", "c1", 0, None)]
    diffs = spark.createDataFrame(rows, "repo string, commit_sha string, n_parents int,"
                                        " diff_text string")
    commits = spark.createDataFrame(
        [(repo, sha, [], sha.upper(), None, 1000 * i, 0, "do fix" if sha == "c2" else "do", i)
         for repo in ("r1", "r2") for i, sha in enumerate(("c0", "c1", "c2", "c3"))],
        "repo string, commit_sha string, parent_shas array<string>, author_name string,"
        " author_email string, authored_epoch long, author_tz_offset long, message string,"
        " commit_seq long")
    known = []
    for repo, sha in (("r1", "c2"), ("r1", "c3"), ("r2", "c2"), ("r2", "c3")):
        known += [(repo, sha, "f", 1, "c0", "one"), (repo, sha, "f", 2, "c1", ""),
                  (repo, sha, "g", 7, "c0", "seven")]
        if (repo, sha) != ("r2", "c2"):
            known.append((repo, sha, "f", 3, "c0", "three"))
    lines = spark.createDataFrame(known, "repo string, commit_sha string, path string,"
                                         " line_no long, blame_commit_sha string, content string")
    return commits, diffs, lines


def test_blame_of_both_inputs(tables):
    commits, diffs, blamed = tables
    patches = diff.parse_unified_diff(diffs)
    expected = {(repo, sha, "c0", "f", 2, 4, 2) for repo, sha in
                (("r1", "c2"), ("r1", "c3"), ("r2", "c3"))}
    expected |= {(repo, sha, "c1", "f", 1, 4, 2) for repo, sha, *_ in expected}
    expected |= {(repo, sha, "c0", "g", 1, 4, 2) for repo, sha, *_ in expected}
    for lines in (diff.removed_lines(patches), diff.diff_lines(patches)):
        got = blame.deleted_lines_behavior(lines, blamed, commits).collect()
        assert {(r.repo, r.fix_commit_sha, r.blame_commit_sha, r.file_paths,
                 r.number_of_related_deleted_lines, r.total_deleted_lines, r.total_added_lines)
                for r in got} == expected
        assert len(got) == len(expected)
        per_commit = blame.time_deleted_lines(lines, blamed, commits).collect()
        assert {(r.repo, r.fix_commit_sha, r.blame_commit_sha,
                 r.number_of_related_deleted_lines) for r in per_commit} == {
            (repo, sha, origin, n) for repo, sha in (("r1", "c2"), ("r1", "c3"), ("r2", "c3"))
            for origin, n in (("c0", 3), ("c1", 1))}
        rejected = blame.blame_rejects(lines, blamed).collect()
        assert [(r.repo, r.commit_sha, r.reason) for r in rejected] == [
            ("r2", "c2", "blame_line_missing")]


def test_nested_form_has_real_line_numbers(tables):
    _, diffs, blamed = tables
    lines = diff.diff_lines(diff.parse_unified_diff(diffs))
    rows = {(r.repo, r.commit_sha, r.blame_commit_sha): r.file_path__line_number_content
            for r in blame.blame_details(lines, blamed).collect()}
    assert {path: [tuple(x) for x in cells] for path, cells in rows["r1", "c2", "c0"].items()} == {
        "f": [(1, "one"), (3, "three")], "g": [(7, "seven")]}
    assert ("r2", "c2", "c0") not in rows


def test_user_behavior_counts_lines_that_are_not_blank(tables):
    commits, diffs, _ = tables
    rows = changes.user_behavior(diff.parse_unified_diff(diffs), commits).collect()
    assert {(r.file_paths, r.deleted_lines, r.added_lines) for r in rows} == {("f", 2, 1),
                                                                             ("g", 1, 1)}
    assert len(rows) == 8


def test_numbers_count_rejected_commits_and_filtered_files(spark, tables):
    commits, diffs, _ = tables
    files = spark.createDataFrame([("r1", "g"), ("r2", "g")], "repo string, path string")
    one = commits.filter("repo = 'r1'")
    rows = changes.numbered_changes(diff.parse_unified_diff(diffs), one, files).collect()
    assert sorted((r.line_number, r.commit_number, r.commit_SHA, r.path) for r in rows) == [
        (2, 3, "c2", "g"), (4, 4, "c3", "g")]


def test_batch_of_two_repositories(spark, tables):
    commits, diffs, blamed = tables
    issues = spark.createDataFrame(
        [("r1", "1", ["Bug"], ["c3"]), ("r2", "1", ["Bug"], ["c3"]), ("r2", "2", None, ["c1"])],
        "repo string, issue_number string, issue_labels array<string>,"
        " issue_closed_commit_id array<string>")
    config = spark.createDataFrame(
        [("java", "r1", "Bug", True, True), ("java", "r2", "T:Bug", True, True)],
        "language_label string, repo string, bug_label string,"
        " retrieve_other_commit_id_from_issue_tracker boolean,"
        " consider_issues_without_labels_as_other boolean")
    fix, behavior = run_batch(config, commits, issues, blamed, diffs=diffs)
    assert {(r.repo, r.fix_commit_sha, r.output_name) for r in fix.collect()} == {
        ("r1", "c2", "Java_R1_Fix"), ("r1", "c3", "Java_R1_Fix")}
    rows = {(r.repo, r.cohort, r.commit_sha) for r in behavior.collect()}
    assert rows == {(repo, "AllCommits", sha) for repo in ("r1", "r2") for sha in ("c2", "c3")} | {
        ("r2", "NonFix", "c3")}
    # Where no issue names a commit, only the setting without the tracker finds the others.
    few = issues.filter("repo = 'r1'")
    for tracker, expected in ((True, set()), (False, {("r2", "c3")})):
        settings = config.withColumn("retrieve_other_commit_id_from_issue_tracker", F.lit(tracker))
        found = run_batch(settings, commits, few, blamed, diffs=diffs)[1]
        assert {(r.repo, r.commit_sha)
                for r in found.filter("cohort = 'NonFix'").collect()} == expected
    path = scratch_path(spark, "batch")
    write_batch(fix, behavior, path)
    assert readers.read_facts(spark, f"{path}/deleted_lines").count() == fix.count()


def test_history_rejects(tables):
    commits, diffs, blamed = tables
    rows = History(commits, diffs=diffs, blame_lines=blamed).rejects().collect()
    assert {(r.repo, r.commit_sha, r.stage, r.reason) for r in rows} == {
        ("r1", "c1", "User behavior", "no_parent"), ("r2", "c1", "User behavior", "no_parent"),
        ("r1", "c1", "Blame", "no_parent"), ("r2", "c1", "Blame", "no_parent"),
        ("r2", "c2", "Blame", "blame_line_missing")}


def test_totals_count_lines_of_the_diff_where_a_line_number_repeats(spark):
    rows = [("c2", "f", "-", 1), ("c2", "f", "-", 1), ("c2", "f", "+", 1), ("c2", "g", "-", 5),
            ("c2", "g", " ", 6), ("c2", "h", "+", 2)]
    lines = spark.createDataFrame([(*row, "x") for row in rows], "commit_sha string, path string,"
                                  " op string, line_no long, value string")
    known = spark.createDataFrame([("c2", "f", 1, "c0", "x"), ("c2", "f", 1, "c1", "x"),
                                   ("c2", "g", 5, "c0", "x")],
                                  "commit_sha string, path string, line_no long,"
                                  " blame_commit_sha string, content string")
    commits = spark.createDataFrame([("c0", "A", None, 0, 0), ("c1", "B", None, 1, 0)],
                                    "commit_sha string, author_name string, author_email string,"
                                    " authored_epoch long, author_tz_offset long")
    got = blame.deleted_lines_behavior(lines, known, commits).collect()
    assert sorted((r.blame_commit_sha, r.file_paths, r.number_of_related_deleted_lines,
                   r.total_deleted_lines, r.total_added_lines) for r in got) == [
        ("c0", "f", 2, 3, 2), ("c0", "g", 1, 3, 2), ("c1", "f", 2, 3, 2)]
    per_commit = blame.time_deleted_lines(lines, known, commits).collect()
    assert sorted((r.blame_commit_sha, r.number_of_related_deleted_lines, r.total_deleted_lines,
                   r.total_added_lines) for r in per_commit) == [("c0", 3, 3, 2), ("c1", 2, 3, 2)]


def test_batch_counts_each_deleted_line_once(spark, tmp_path):
    """Parts 100,000 apart meet in one line number of a commit's file."""
    from checks.batch_queries import batch_deleted_lines
    from checks.views import Tables

    tables = {
        "region": "select 0 r_regionkey",
        "nation": "select 0 n_nationkey, 'PERU' n_name, 1 n_regionkey",
        "customer": "select 1L c_custkey, 'C#1' c_name, 0 c_nationkey, 'X' c_mktsegment",
        "orders": "select id o_orderkey, 1L o_custkey, timestamp'1996-01-02' o_orderdate"
                  " from range(8, 10)",
        "part": "select 7L p_partkey, 0 p_size",
        "lineitem": "select 9L l_orderkey, 100007L - 100000L * id l_partkey, 3L l_suppkey,"
                    " cast(id + 1 as int) l_linenumber, 'R' l_returnflag from range(2)"}
    for name, text in tables.items():
        spark.sql(text).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = batch_deleted_lines(Tables(spark, str(tmp_path))).collect()
    assert [(r.number_of_related_deleted_lines, r.total_deleted_lines) for r in rows] == [(2, 2)]


def test_batch_joins_facts_once_for_all_cohorts(spark, tables):
    """The diffs are parsed once for the cohorts together, whose ids are not worked out again."""
    commits, diffs, blamed = tables
    issues = spark.createDataFrame([("r1", "1", ["Bug"], ["c3"])],
                                   "repo string, issue_number string, issue_labels array<string>,"
                                   " issue_closed_commit_id array<string>")
    config = spark.createDataFrame(
        [("java", "r1", "Bug", False, True)],
        "language_label string, repo string, bug_label string,"
        " retrieve_other_commit_id_from_issue_tracker boolean,"
        " consider_issues_without_labels_as_other boolean")
    fix, behavior = run_batch(config, commits, issues, blamed, diffs=diffs)
    for facts in (fix, behavior):
        plan = facts._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("@@ -") == 1 and "issue_closed_commit_id" not in plan
    assert {r.cohort for r in behavior.collect()} == {"AllCommits"}
