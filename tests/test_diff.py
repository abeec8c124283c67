from pyspark.sql import functions as F

from logstrata.operators import diff

TEXT = """diff --git a/x.java b/x.java
index 1..2 100644
--- a/x.java
+++ b/x.java
@@ -1,3 +1,3 @@ class X
 a
---y;
+++z;
 c
@@ -10 +10,2 @@
-old
+new1
+   
\\ No newline at end of file
diff --git a/new.txt b/new.txt
new file mode 100644
--- /dev/null
+++ b/new.txt
@@ -0,0 +1,2 @@
+n1
+n2
diff --git a/r.txt b/s.txt
similarity index 90%
rename from r.txt
rename to s.txt
--- a/r.txt
+++ b/s.txt
@@ -1 +1 @@
-a
+b
diff --git a/logo.png b/logo.png
Binary files a/logo.png and b/logo.png differ
diff --git a/gone b/gone
deleted file mode 100644
--- a/gone
+++ /dev/null
@@ -1,3 +0,0 @@
-g1

-
"""
# A bare empty line inside a hunk is an empty context line: it counts for both sides.
BARE = """diff --git a/b.c b/b.c
--- a/b.c
+++ b/b.c
@@ -4,3 +4,4 @@
 x

+y
 z
"""
LINK = """diff --git a/l b/l
deleted file mode 100644
--- a/l
+++ /dev/null
@@ -1 +0,0 @@
-text
diff --git a/l b/l
new file mode 120000
--- /dev/null
+++ b/l
@@ -0,0 +1 @@
+target
diff --git a/sub b/sub
index 1111111..2222222 160000
--- a/sub
+++ b/sub
@@ -1 +1 @@
-Subproject commit 1
+Subproject commit 2
"""


def _diffs(spark, **texts):
    rows = [(sha, 1, text) for sha, text in texts.items()]
    return spark.createDataFrame(rows, "commit_sha string, n_parents int, diff_text string")


def _lines(spark, **texts):
    patches = diff.parse_unified_diff(_diffs(spark, **texts))
    return {(r.path, r.op, r.line_no, r.value) for r in diff.diff_lines(patches).collect()}


def test_lines_have_their_numbers(spark):
    text = TEXT.replace("@@ -1,3 +0,0 @@\n-g1\n\n-", "@@ -1,2 +0,0 @@\n-g1\n-")
    assert _lines(spark, c=text) == {
        ("x.java", "-", 2, "--y;"), ("x.java", "+", 2, "++z;"),
        ("x.java", "-", 10, "old"), ("x.java", "+", 10, "new1"), ("x.java", "+", 11, "   "),
        ("new.txt", "+", 1, "n1"), ("new.txt", "+", 2, "n2"),
        ("gone", "-", 1, "g1"), ("gone", "-", 2, "")}


def test_bare_empty_line_is_context(spark):
    assert _lines(spark, c=BARE) == {("b.c", "+", 6, "y")}


def test_type_changes_and_submodules_are_left_out(spark):
    assert _lines(spark, c=LINK) == set()


def test_counts_and_totals(spark):
    text = TEXT.replace("@@ -1,3 +0,0 @@\n-g1\n\n-", "@@ -1,2 +0,0 @@\n-g1\n-")
    rows = {r.path: r for r in diff.parse_unified_diff(_diffs(spark, c=text)).collect()}
    assert sorted(rows) == ["gone", "new.txt", "x.java"]
    assert (rows["x.java"].adds, rows["x.java"].added_lines) == (3, 2)
    assert (rows["gone"].deletes, rows["gone"].deleted_lines) == (2, 1)
    assert {(r.commit_adds, r.commit_deletes) for r in rows.values()} == {(5, 4)}


def test_rejects(spark):
    diffs = spark.createDataFrame(
        [("root", 0, "x"), ("empty", 1, ""), ("none", 1, None), ("fine", 1, BARE),
         ("short", 1, "diff --git a/b b/b\n--- a/b\n+++ b/b\n@@ -1,5 +1 @@\n-a\n"),
         ("head", 1, "diff --git a/b b/b\n--- a/b\n+++ b/b\n@@ -1,x +1 @@\n-a\n")],
        "commit_sha string, n_parents int, diff_text string")
    found = {r.commit_sha: r.reason for r in diff.diff_rejects(diffs, "Content").collect()}
    assert found == {"root": "no_parent", "empty": "empty_diff", "none": "empty_diff",
                     "short": "broken_hunk", "head": "broken_hunk"}
    assert {r.commit_sha for r in diff.parse_unified_diff(diffs).collect()} == {"fine"}


def test_touched_files_and_numbers(spark):
    patches = diff.parse_unified_diff(_diffs(spark, c=BARE, d=LINK.split("diff --git a/sub")[0]
                                             .split("diff --git a/l b/l\nnew")[0]))
    assert {r.path for r in diff.touched_files(patches).collect()} == {"b.c", "l"}
    rows = {r.path: (r.added_line_number, r.deleted_line_number)
            for r in diff.affected_lines(patches).collect()}
    assert rows == {"b.c": ([6], []), "l": ([], [1])}


def test_parsing_needs_no_shuffle_and_parses_once(spark):
    plan = diff.diff_lines(diff.parse_unified_diff(_diffs(spark, c=BARE)))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text
    assert text.count("diff --git") == 1


def test_analysed_part_is_checked(spark):
    lines = diff.diff_lines(diff.parse_unified_diff(_diffs(spark, c=BARE)))
    assert diff.analysed_lines(lines, "added").count() == 1
    try:
        diff.analysed_lines(lines, "moved")
    except ValueError:
        return
    raise AssertionError("an unknown part must be refused")


def test_large_hunk(spark):
    n = 200_000
    body = "".join(f"+line {i}\n" for i in range(n))
    text = f"diff --git a/f b/f\n--- /dev/null\n+++ b/f\n@@ -0,0 +1,{n} @@\n{body}"
    lines = diff.diff_lines(diff.parse_unified_diff(_diffs(spark, c=text)))
    row = lines.agg(F.count("*").alias("n"), F.max("line_no").alias("last"),
                    F.count_if(F.col("value") == F.concat(
                        F.lit("line "), (F.col("line_no") - 1).cast("string"))).alias("right"))
    assert tuple(row.first()) == (n, n, n)


def test_reason_is_told_by_one_parse(spark):
    """Neither the filter on the reason nor the joins of blame parse the text again."""
    from logstrata.plans.history import History

    text = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-old\n+new\n"
    diffs = spark.createDataFrame([("a", 1, text), ("b", 0, text), ("c", 1, "")],
                                  "commit_sha string, n_parents int, diff_text string")
    rejects = diff.diff_rejects(diffs, "s")
    assert rejects._jdf.queryExecution().optimizedPlan().toString().count("@@ -") == 1
    assert {(r.commit_sha, r.reason) for r in rejects.collect()} == {
        ("b", "no_parent"), ("c", "empty_diff")}
    commits = spark.createDataFrame([("a", "n", "e", 0, 0), ("o", "n", "e", 0, 0)],
                                    "commit_sha string, author_name string, author_email string, "
                                    "authored_epoch long, author_tz_offset long")
    known = spark.createDataFrame([("a", "x", 1, "o", "old")], "commit_sha string, path string, "
                                  "line_no long, blame_commit_sha string, content string")
    facts = History(commits, diffs=diffs, blame_lines=known).time_deleted_lines("all")
    assert facts._jdf.queryExecution().optimizedPlan().toString().count("@@ -") == 1
    assert [(r.fix_commit_sha, r.blame_commit_sha, r.total_added_lines) for r in facts.collect()] \
        == [("a", "o", 1)]
