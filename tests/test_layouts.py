"""Typed scans with rejects, issue files of a configuration, reruns of one repository."""

import os

from pyspark.sql import functions as F

from logstrata.operators import frequency
from logstrata.plans.history import History
from logstrata.sources import readers, writers

COMMITS = {
    "r1": ['{"commit_sha": "a", "authored_epoch": 5, "message": "x"}', '{"commit_sha": "b"',
           '{"message": "no id"}', ""],
    "02": ['{"commit_sha": "c", "authored_epoch": "soon"}', '{"commit_sha": "d", "more": 1}'],
}


def _folders(tmp_path, records):
    for repo, lines in records.items():
        folder = tmp_path / "table" / f"repo={repo}"
        folder.mkdir(parents=True)
        (folder / "part.json").write_text("\n".join(lines))
    return str(tmp_path / "table")


def test_commits_with_rejects(spark, tmp_path):
    scan = readers.read_commits(spark, _folders(tmp_path, COMMITS))
    assert {(r.repo, r.commit_sha, r.authored_epoch) for r in scan.rows.collect()} == {
        ("r1", "a", 5), ("02", "d", None)}
    assert {(r.repo, r.record, r.reason, r.stage) for r in scan.rejects.collect()} == {
        ("r1", COMMITS["r1"][1], "malformed_record", "Scan"),
        ("r1", COMMITS["r1"][2], "missing_key", "Scan"),
        ("02", COMMITS["02"][0], "malformed_record", "Scan")}
    # A value of another type is seen whatever columns are asked for.
    assert scan.rows.select("commit_sha").count() == scan.rows.count() == 2
    assert all(r.file.endswith("part.json") for r in scan.rejects.collect())


def test_a_filter_on_the_repository_prunes_folders(spark, tmp_path):
    scan = readers.read_commits(spark, _folders(tmp_path, COMMITS))
    plan = scan.rows.where("repo = 'r1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(repo" in plan


def test_tables_without_folders(spark, tmp_path):
    path = tmp_path / "diffs.json"
    path.write_text('{"repo": "r", "commit_sha": "a", "n_parents": 1, "diff_text": "d"}\n{"repo": "r"}\n')
    scan = readers.read_diffs(spark, str(path))
    assert [tuple(r) for r in scan.rows.collect()] == [("r", "a", 1, "d")]
    assert [(r.repo, r.reason) for r in scan.rejects.collect()] == [("r", "missing_key")]
    stored = str(tmp_path / "stored")
    scan.rows.write.parquet(stored)
    again = readers.read_diffs(spark, stored, "parquet")
    assert again.rows.collect() == scan.rows.collect() and again.rejects.isEmpty()


def _config(spark, base, names):
    return spark.createDataFrame([(base, repo, name) for repo, name in names.items()],
                                 "issue_base_address string, repo string, issue_file_name string")


def test_issue_files(spark, tmp_path):
    base = tmp_path / "the issues+"
    base.mkdir()
    (base / "one.json").write_text('head\n{"issue_number": "1"}\n{"issue_number": "2"}\n')
    (base / "two 2.json").write_text('head\n{"issue_number": "1"\n')
    (base / "other.json").write_text("head\nnot of this batch\n")
    (base / "empty.json").write_text("")
    names = {"r1": "one.json", "r2": "two 2.json", "r3": "gone.json", "r4": "empty.json"}
    scan = readers.read_issue_files(spark, _config(spark, str(base), names))
    assert {(r.repo, r.issue_number) for r in scan.rows.collect()} == {("r1", "1"), ("r1", "2")}
    assert {(r.repo, r.reason, r.record) for r in scan.rejects.collect()} == {
        ("r2", "malformed_record", '{"issue_number": "1"'), ("r3", "issue_file_missing", None),
        ("r4", "issue_file_missing", None)}


def _files(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns
            for d, _, names in os.walk(path) for n in names if n.startswith("part-")}


def test_a_rerun_leaves_other_repositories(spark, tmp_path):
    path = str(tmp_path / "facts")
    facts = spark.createDataFrame([("r1", 1), ("r1", 2), ("r2", 3)], "repo string, n int")
    writers.write_facts(facts, path, "parquet", ["repo"], keep_others=True)
    before = {f: t for f, t in _files(path).items() if "repo=r1" in f}
    writers.write_facts(facts.where("repo = 'r2'").withColumn("n", F.lit(9)), path, "parquet",
                        ["repo"], keep_others=True)
    after = _files(path)
    assert before and before == {f: t for f, t in after.items() if "repo=r1" in f}
    assert {tuple(r) for r in spark.read.parquet(path).select("repo", "n").collect()} == {
        ("r1", 1), ("r1", 2), ("r2", 9)}
    writers.write_facts(facts.where("repo = 'r2'"), path, "parquet", ["repo"])
    assert not any("repo=r1" in f for f in _files(path))


def test_commits_alone_have_no_rejects(spark):
    commits = spark.createDataFrame([("a",)], "commit_sha string")
    assert History(commits).rejects().isEmpty()


def test_similar_lists_are_rejects(spark):
    commits = spark.createDataFrame([("a",)], "commit_sha string")
    issues = spark.createDataFrame([("7", None, ["a"], [], ["a"] * 11)],
                                   "issue_number string, issue_labels array<string>, "
                                   "issue_closed_commit_id array<string>, issue_commit_id array<string>, "
                                   "commit_id_similar_to_issue_title array<string>")
    rows = History(commits, issues, "bug").rejects().collect()
    assert [(r.commit_sha, r.issue_number, r.reason, r.stage) for r in rows] == [
        (None, "7", "similar_list_over_limit", "Cohort")]


def test_sparse_rows_and_column_blocks(spark):
    rows = [("g1", "b"), ("g1", "b"), ("g1", ""), ("g1", None), ("g2", "B"), ("g2", "z"), (None, "b")]
    table = spark.createDataFrame(rows, "g string, v string")
    cells = frequency.frequency_cells(table, ["v"], "g")
    words = frequency.vocabulary(cells)
    assert {r.value: r.place for r in words.collect()} == {"": 0, "B": 1, "b": 2, "z": 3}
    found = {r.g: (r.places, r.amounts) for r in frequency.sparse_matrix(cells, words, "g").collect()}
    assert found == {"g1": ([0, 2], [2, 2]), "g2": ([1, 3], [1, 1]), None: ([2], [1])}
    blocks = frequency.column_blocks(cells, words, "g", width=3).collect()
    assert {(r.g, r.block): r.amounts for r in blocks} == {
        ("g1", 0): [2, 0, 2], ("g2", 0): [0, 1, 0], ("g2", 1): [1], (None, 0): [0, 0, 1]}


def test_no_counted_columns(spark):
    table = spark.createDataFrame([("g1", "b")], "g string, v string")
    assert frequency.value_frequency(table, {}).isEmpty()
    assert frequency.value_frequency(table, {"v": []}).isEmpty()
