from pyspark.sql import functions as F

from logstrata.functions.languages import JAVA_KEYWORDS, java_keywords, lexer_name, lexer_of_file
from logstrata.operators import tokens

CODE = """import java.util.List; // first
/* two
 lines */ class A {
  String s = "a /* b // c"; char c = '\\'';
  public void run(int n) { this.go(n); } /* one */ int x = 0x1F;

  @Override int y = 1.5f;
}"""


def _lines(spark, text, numbers, path="A.java"):
    df = spark.createDataFrame([(path, text, numbers)],
                               "path string, text string, line_numbers array<int>")
    out = {}
    for row in tokens.line_tokens(df).collect():
        out.setdefault(row.code_line_number, []).append((row.token_content, row.token_type))
    return out


def _plain(found):
    return {line: [t for t, _ in items] for line, items in found.items()}


def test_comments_belong_to_every_line_they_touch(spark):
    found = _plain(_lines(spark, CODE, list(range(1, 9))))
    block = "/* two\n lines */"
    assert found[1] == ["import", "java", ".", "util", ".", "List", ";", "// first\n"]
    assert found[2] == ["// first\n", block]
    assert found[3] == [block, "class", "A", "{"]
    assert found[4][3] == '"a /* b // c"' and found[4][-2] == "'\\''"
    assert 6 not in found
    assert found[8] == ["}"]


def test_types(spark):
    found = _lines(spark, CODE, [1, 3, 5, 7])
    types = dict(item for items in found.values() for item in items)
    assert types["import"] == "Token.Keyword.Namespace"
    assert types["java"] == "Token.Name.Namespace"
    assert types["class"] == "Token.Keyword.Declaration"
    assert types["A"] == "Token.Name.Class"
    assert types["run"] == "Token.Name.Function"
    assert types["go"] == "Token.Name.Attribute"
    assert types["void"] == "Token.Keyword.Type"
    assert types["this"] == "Token.Keyword"
    assert types["/* one */"] == "Token.Comment.Multiline"
    assert types["// first\n"] == "Token.Comment.Single"
    assert types["0x1F"] == "Token.Literal.Number"
    assert types["@Override"] == "Token.Name.Decorator"
    assert types["{"] == "Token.Operator"


def _overlapping(rows, text):
    """The closed interval rule on offsets, by brute force."""
    out, start = {}, 0
    for number, line in enumerate(text.split("\n"), 1):
        end = start + len(line) + 1
        found = [r.token_content for r in rows
                 if r.token_start < end and r.token_start + len(r.token_content) >= start]
        if found:
            out[number] = found
        start = end
    return out


def test_slices_equal_the_interval_rule(spark):
    text = CODE + "\n\n// a\n// b\n\n/* x */ /* y\n\n z */ q // end\n"
    blobs = spark.createDataFrame([("s", "A.java", text)], "sha string, path string, text string")
    rows = sorted(tokens.tokenize(blobs).collect(), key=lambda r: r.token_start)
    assert all(text[r.token_start:r.token_start + len(r.token_content)] == r.token_content
               for r in rows)
    n = text.count("\n") + 1
    assert _plain(_lines(spark, text, list(range(1, n + 1)))) == _overlapping(rows, text)


def test_odd_characters_and_neighbours_across_lines(spark):
    text = ("class\n\n  B {\n int \xa0 go\n // c \x02\n\n( \x02\x03 x\xa0. y\n"
            "/* a\x02\n b */ import\n z; // end")
    files = spark.createDataFrame([("A.java", text, list(range(1, 11)))],
                                  "path string, text string, line_numbers array<int>")
    # The block comment turns the whole text to the slower cut; without it the rest is the same.
    plain = files.withColumn("text", F.regexp_replace("text", r"(?s)/\*(.*?)\*/", ""))
    for given in (files, plain):
        rows = {(r.code_line_number, r.token_position): r for r in tokens.line_tokens(given).collect()}
        types = {place: (r.token_content, r.token_type) for place, r in rows.items()}
        assert types[3, 0] == ("B", "Token.Name.Class")
        assert types[4, 0] == ("int", "Token.Keyword.Type")
        # The blank token is no row and no token of the line, but it is a neighbour.
        assert types[4, 1] == ("go", "Token.Name") and rows[4, 1].number_of_tokens == 2
        comment = ("// c \x02\n", "Token.Comment.Single")
        assert types[5, 0] == types[6, 0] == comment and rows[6, 0].line_content == "\n"
        assert [types[7, i][0] for i in range(6)] == ["(", "\x02", "\x03", "x", ".", "y"]
        assert types[7, 3][1] == "Token.Name" and types[7, 5][1] == "Token.Name.Attribute"
        last = max(n for n, _ in types)
        assert types[last, 0] == ("z", "Token.Name.Namespace")
        assert types[last, 2] == ("// end", "Token.Comment.Single")


def test_windows_line_ends_and_lines_beyond_the_text(spark):
    assert _plain(_lines(spark, "a\r\nb\r\n", [1, 2, 3, 9])) == {1: ["a"], 2: ["b"]}


def test_long_strings_and_comments_do_not_overflow(spark):
    text = 'x = "' + "ab\\\"" * 200_000 + '";\n/*' + " * line\n" * 100_000 + "*/ y"
    found = _plain(_lines(spark, text, [1]))
    assert len(found[1]) == 4 and len(found[1][2]) == 800_002


def test_one_line_file(spark):
    text = "a;" * 200_000
    row = tokens.line_tokens(spark.createDataFrame(
        [("A.java", text, [1])], "path string, text string, line_numbers array<int>")).agg(
            F.count("*").alias("n"), F.max("number_of_tokens").alias("m")).first()
    assert (row.n, row.m) == (400_000, 400_000)


def test_other_languages(spark):
    assert _plain(_lines(spark, "# c // d\nx = 1", [1, 2], "a.py")) == {
        1: ["# c // d\n"], 2: ["# c // d\n", "x", "=", "1"]}
    found = _lines(spark, "http://x", [1], "a.txt")
    assert [t for t, _ in found[1]] == ["http", ":", "/", "/", "x"]
    names = spark.createDataFrame([("A.JAVA",), ("b/Makefile",), ("x.y/c.py",), ("d.",)],
                                  "p string")
    assert [r[0] for r in names.select(lexer_name(F.col("p"))).collect()] == [
        "Java", "Text only", "Python", "Text only"]


def test_keywords(spark):
    assert java_keywords(spark).count() == 50 == len(set(JAVA_KEYWORDS))


def test_content_tokens_take_the_version_of_the_side(spark):
    from logstrata.operators.diff import parse_unified_diff

    text = ("diff --git a/A.java b/A.java\n--- a/A.java\n+++ b/A.java\n@@ -1,2 +1,2 @@\n"
            " int a;\n-int b;\n+int c; int d;\n")
    diffs = spark.createDataFrame([("c1", 1, text)],
                                  "commit_sha string, n_parents int, diff_text string")
    commits = spark.createDataFrame([("c1", ["p1"])],
                                    "commit_sha string, parent_shas array<string>")
    blobs = spark.createDataFrame([("c1", "A.java", "int a;\nint c; int d;"),
                                   ("p1", "A.java", "int a;\nint b;")],
                                  "sha string, path string, text string")
    patches = parse_unified_diff(diffs)
    added = tokens.content_tokens(patches, blobs, commits, "added").collect()
    seq = commits.withColumn("commit_seq", F.lit(1))
    numbered = tokens.content_tokens(patches, blobs, seq, "added", numbered=True).collect()
    assert [(r.line_number, r.token_content) for r in numbered] == list(
        enumerate(["int", "c", ";", "int", "d", ";"], 1))
    gone = tokens.content_tokens(patches, blobs, commits, "deleted").collect()
    assert [r.token_content for r in added] == ["int", "c", ";", "int", "d", ";"]
    assert [r.token_content for r in gone] == ["int", "b", ";"]
    assert {(r.number_of_tokens, r.number_of_changes, r.code_line_number) for r in added} == {
        (6, 1, 2)}
    lost = tokens.content_rejects(patches, blobs.filter("sha = 'c1'"), commits, "deleted")
    assert [r.reason for r in lost.collect()] == ["content_missing"]


def test_a_diff_is_parsed_once_for_counts_and_tokens(spark):
    from logstrata.plans.history import History

    text = ("diff --git a/A.java b/A.java\n--- a/A.java\n+++ b/A.java\n@@ -1,2 +1,5 @@\n"
            " int a;\n-int b;\n+int c;\n+ \xa0\n+\n+\xe9 d;\n")
    commits = spark.createDataFrame([("c1", ["p1"]), ("c2", ["c1"])],
                                    "commit_sha string, parent_shas array<string>")
    diffs = spark.createDataFrame([("c1", 1, text), ("c2", 1, text)],
                                  "commit_sha string, n_parents int, diff_text string")
    blobs = spark.createDataFrame([("c1", "A.java", "int a;\nint c;\n \xa0\n\n\xe9 d;"),
                                   ("p1", "A.java", "int a;\nint b;")],
                                  "sha string, path string, text string")
    history = History(commits, diffs=diffs, blobs=blobs)
    for part, want in (("added", {2, 5}), ("deleted", {2})):
        found = history.content_tokens("all", part)
        assert "diff_text" not in found._jdf.queryExecution().optimizedPlan().toString()
        rows = [r for r in found.collect() if r.hex_hash == "c1"]
        lines = {r.code_line_number for r in rows}
        assert lines == want and {r.number_of_changes for r in rows} == {len(want)}


def test_languages_by_content_where_the_name_tells_nothing(spark):
    cases = [
        ("run", "#!/usr/bin/env python3\nx", "Python"), ("run", "#!/bin/bash -e\nx", "Bash"),
        ("run", "#!/usr/bin/pythonic\nx", "Text only"), ("run", "x\n#!/bin/sh\n", "Text only"),
        ("run", "#!/usr/bin/perl", "Perl"), ("doc", " \n<?xml version='1.0'?><a/>", "XML"),
        ("doc", "<!DOCTYPE html><p>", "HTML"), ("doc", "<?php echo 1;", "PHP"),
        ("a", "// -*- C++ -*-\nint x;", "C++"), ("a", "\n# vim: set ft=python :\n", "Python"),
        ("a", "\n\n# vim: set ft=python :\n", "Text only"),
        # An interpreter line outweighs a mode line, and both outweigh typical lines.
        ("a", "#!/bin/sh\nimport os\ndef f():\ndef g():\n", "Bash"),
        ("a", "#!/bin/sh\n# -*- mode: python -*-\n", "Bash"),
        ("a", "package a.b;\nclass A {}", "Java"), ("a", "package main\nfunc main() {", "Go"),
        ("a", "import os\n", "Text only"), ("a", "import os\ndef f():\n  pass", "Python"),
        ("a", "all: x\n\techo", "Makefile"), ("a", "def f\nend", "Ruby"),
        # Equal sums: three for each.
        ("a", "import os\ndef f():\npackage a.b;", "Java"),
        ("a", "Plain words, end of story.\nNo code here.", "Text only"),
        ("a", None, "Text only"), ("a", "", "Text only"), (None, "#!/bin/sh", "Bash"),
        ("a.txt", "#!/bin/sh\n", "Text only"), ("a.java", "#include <x>\n", "Java"),
        ("a.unknown", "#include <x>\n", "C"), ("Makefile", "x = 1", "Text only"),
        ("long", "word " * 400_000 + "\n#include <x>\n", "C"),
    ]
    rows = spark.createDataFrame([(i, p, x) for i, (p, x, _) in enumerate(cases)],
                                 "i int, path string, text string")
    found = {r.i: r.l for r in rows.select(
        "i", lexer_of_file(F.col("path"), F.col("text")).alias("l")).collect()}
    assert [(c[0], (c[1] or "")[:40], found[i]) for i, c in enumerate(cases)] == \
        [(p, (x or "")[:40], want) for p, x, want in cases]


def test_numbered_content_tokens_of_lines_that_come_twice(spark):
    """Equal files of a commit take turns, token by token, and only lines are stored."""
    from pyspark.sql import functions as F

    from logstrata.operators import tokens

    texts = ["a b c\n// x\n\nd", "a b c\n// x\n\nd", "e\nf g"]
    rows = [(seq, no, f"p{no}.java", texts[k]) for seq, no, k in
            [(2, 0, 0), (2, 0, 1), (1, 1, 2), (1, 0, 0), (None, 0, 2)]]
    files = spark.createDataFrame(rows, "commit_seq long, file_no int, path string, text string") \
        .withColumn("line_numbers", F.sequence(F.lit(1), F.lit(4)))
    lines = tokens._with_first_number(tokens._lines_in(files), ["commit_seq", "file_no"])
    assert "token_content" not in lines.columns and lines.count() == 16
    patches = files.select(F.col("commit_seq").cast("string").alias("commit_sha"), "path", "file_no",
                           F.sequence(F.lit(1), F.lit(4)).alias("added_numbers")).distinct()
    blobs = files.select(F.col("commit_seq").cast("string").alias("sha"), "path", "text")
    commits = files.select(F.col("commit_seq").cast("string").alias("commit_sha"), "commit_seq").distinct()
    found = tokens.content_tokens(patches, blobs, commits, "added", numbered=True)
    plain = tokens.content_tokens(patches, blobs, commits, "added")
    assert found.drop("line_number").exceptAll(plain).isEmpty()
    got = found.orderBy("line_number").collect()
    assert [r.line_number for r in got] == list(range(1, plain.count() + 1))
    place = [(int(r.hex_hash), r.file_name, r.code_line_number) for r in got]
    assert place == sorted(place)
    assert [r.token_content for r in got if r.hex_hash == "2"][:6] == ["a", "a", "b", "b", "c", "c"]
