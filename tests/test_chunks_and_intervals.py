"""Diffs in chunks against the cell form; joins of intervals against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from logstrata.operators import diff, diff_chunks, numbering, tokens
from logstrata.operators.intervals import overlap_join

HEAD = "diff --git a/{0} b/{0}\n"
TEXTS = {
    "two files": HEAD.format("f") + "index 1..2\n--- a/f\n+++ b/f\n@@ -1,3 +1,3 @@ x\n one\n-two\n"
    "+--- two\n three\n@@ -9 +9,2 @@\n--- nine\n+nine\n+\n" + HEAD.format("g")
    + "new file mode 100644\n--- /dev/null\n+++ b/g\n@@ -0,0 +1,2 @@\n+@@ -1 +1 @@\n+diff --git\n"
    "\\ No newline at end of file\n",
    "rename": HEAD.format("f") + "rename from e\nrename to f\n--- a/e\n+++ b/f\n@@ -1 +1 @@\n-a\n+b\n"
    + HEAD.format("h") + "--- a/h\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-x\n-\n",
    "type": HEAD.format("t") + "--- a/t\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n" + HEAD.format("t")
    + "--- /dev/null\n+++ b/t\n@@ -0,0 +1 @@\n+y\n" + HEAD.format("u")
    + "--- a/u\n+++ b/u\n@@ -2 +2 @@\n-p\n+q",
    "broken": HEAD.format("f") + "--- a/f\n+++ b/f\n@@ -1,9 +1 @@\n-a\n+b\n",
    "head": HEAD.format("f") + "--- a/f\n+++ b/f\n@@ -1 +1 zz\n-a\n+b\n",
    "binary": HEAD.format("f") + "Binary files a/f and b/f differ\n",
    "empty": "", "prose": "no diff at all\n\n",
    "bare": HEAD.format("f") + "--- a/f\n+++ b/f\n@@ -1,3 +1,3 @@\n\n-a\n+b\n\n",
}


@pytest.mark.parametrize("block_rows", [3, 1 << 16])
def test_chunks_give_the_rows_of_cells(spark, block_rows, monkeypatch):
    monkeypatch.setattr(diff_chunks, "running_before", lambda *a: numbering.running_before(
        *a, block_rows=block_rows))
    rng = random.Random(block_rows)
    cells = [("r", name, 0 if name == "none" else 1, text) for name, text in TEXTS.items()]
    cells += [("s", "none", 0, TEXTS["two files"]), ("s", "two files", 2, TEXTS["rename"])]
    chunks = []
    for repo, name, parents, text in cells:
        at, no = 0, 0
        while at < len(text) or no == 0:
            size = rng.choice([1, 2, 5, 17, 60])
            chunks.append((repo, name, parents, no, text[at:at + size]))
            at, no = at + size, no + 1
    one = spark.createDataFrame(cells, "repo string, commit_sha string, n_parents int, diff_text string")
    many = spark.createDataFrame(chunks, "repo string, commit_sha string, n_parents int, "
                                         "chunk_no long, text string").repartition(3)
    expected = diff.diff_lines(diff.parse_unified_diff(one)).select(
        "repo", "commit_sha", "path", "op", "line_no", "value").collect()
    found = diff_chunks.chunked_diff_lines(many).collect()
    assert len(expected) > 12
    assert sorted(map(tuple, found)) == sorted(map(tuple, expected))


@pytest.mark.parametrize("cell_chunks, chunk_bytes", [(1, 4096), (3, 4096), (256, 4096), (256, 20)])
def test_chunks_of_small_and_large_commits(spark, cell_chunks, chunk_bytes, monkeypatch):
    monkeypatch.setattr(diff_chunks, "CHUNK_BYTES", chunk_bytes)
    monkeypatch.setattr(diff_chunks, "running_before", lambda *a: numbering.running_before(
        *a, block_rows=3))
    rng = random.Random(cell_chunks)
    cells = [("r", name, 1, text) for name, text in TEXTS.items()] + [("s", "two files", 2, TEXTS["bare"])]
    chunks = []
    for repo, name, parents, text in cells:
        at, no = 0, 0
        while at < len(text) or no == 0:
            size = rng.choice([1, 5, 17, 60])
            chunks.append((repo, name, parents, no, text[at:at + size]))
            at, no = at + size, no + 1
    rng.shuffle(chunks)
    one = spark.createDataFrame(cells, "repo string, commit_sha string, n_parents int, diff_text string")
    many = spark.createDataFrame(chunks, "repo string, commit_sha string, n_parents int, "
                                         "chunk_no long, text string")
    expected = diff.diff_lines(diff.parse_unified_diff(one)).select(
        "repo", "commit_sha", "path", "op", "line_no", "value").collect()
    found = diff_chunks.chunked_diff_lines(many, cell_chunks)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected))


def test_small_commits_are_not_joined_line_by_line(spark, monkeypatch):
    asked = []
    whole = diff_chunks._joined_diff_lines
    monkeypatch.setattr(diff_chunks, "_joined_diff_lines",
                        lambda rest: asked.append(rest.count()) or whole(rest))
    chunks = spark.createDataFrame([("c", 1, 0, TEXTS["bare"][:9]), ("c", 1, 1, TEXTS["bare"][9:])],
                                   "commit_sha string, n_parents int, chunk_no long, text string")
    assert diff_chunks.chunked_diff_lines(chunks).count() == 2 and asked == [0]


def test_commits_without_a_countable_file(spark):
    rows = [(name, 1, text) for name, text in TEXTS.items()]
    diffs = spark.createDataFrame(rows, "commit_sha string, n_parents int, diff_text string")
    assert {r.commit_sha: r.reason for r in diff.tagged_diffs(diffs).collect()} == {
        "two files": None, "rename": None, "type": None, "bare": None, "broken": "broken_hunk",
        "head": "broken_hunk", "binary": "no_file", "prose": "no_file", "empty": "empty_diff"}


def test_overlap_join(spark):
    rng = random.Random(2)
    sides = []
    for _ in range(2):
        rows = [(rng.choice(["f", "g", None]), start := rng.randrange(300),
                 start + rng.choice([-1, 0, 3, 90]), i) for i in range(120)]
        rows.append(("f", None, 5, 500))
        sides.append(rows)
    left = spark.createDataFrame(sides[0], "f string, a long, b long, i int")
    right = spark.createDataFrame(sides[1], "f string, c long, d long, j int")
    met = overlap_join(left, right, ["f"], ("a", "b"), ("c", "d"), width=16)
    expected = {(x[3], y[3]) for x in sides[0] for y in sides[1]
                if x[0] is not None and x[0] == y[0] and None not in (x[1], y[1])
                and x[1] <= x[2] and y[1] <= y[2] and x[1] <= y[2] and y[1] <= x[2]}
    found = [(r.i, r.j) for r in met.collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


TEXT = "int a; // one\n\n/* two\nlines */ b = \"x\";\r\n// last\n"


def test_joined_tokens_equal_those_in_the_row(spark):
    rows = [("s", "A.java", TEXT), ("s", "b.py", "# c\n\nx = 1"), ("t", "A.java", ""), ("t", "C.java", "x")]
    blobs = spark.createDataFrame(rows, "sha string, path string, text string")
    every = blobs.select("*", F.sequence(F.lit(1), F.lit(9)).alias("line_numbers"))
    columns = ["sha", "path", "lexer_name", "code_line_number", "line_content", "number_of_tokens",
               "token_content", "token_type"]
    expected = tokens.line_tokens(every).select(*columns).collect()
    found = tokens.join_line_tokens(tokens.tokenize(blobs), tokens.text_lines(blobs),
                                    ["sha", "path"]).select(*columns).collect()
    assert len(expected) > 15
    assert sorted(map(tuple, found)) == sorted(map(tuple, expected))
