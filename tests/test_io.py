import pytest
from pyspark.sql import functions as F

from logstrata.plans.history import History
from logstrata.session import cut_lineage, scratch_path, shared_folder
from logstrata.sources import readers, writers

HEAD = '"issue_number":"%s","number":%s,"repository_name":"r","issue_title":"t"'


def _write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_issues_json(spark, tmp_path):
    path = _write(tmp_path, "i.json", "header\n" + "".join([
        "{" + HEAD % (1, 5) + ',"issue_labels":["bug","é \\" x"],"issue_commit_id":["a"]}\n',
        "{" + HEAD % (2, 6) + ',"issue_labels":[]}\n', "{" + HEAD % (3, 7) + "}\n"]))
    rows = {r.issue_number: r for r in readers.read_issues(spark, path).collect()}
    assert sorted(rows) == ["1", "2", "3"]
    assert rows["1"].number == "5" and rows["1"].issue_labels == ["bug", 'é " x']
    assert rows["2"].issue_labels == [] and rows["3"].issue_labels is None
    assert rows["1"].issue_commit_id == ["a"] and rows["3"].issue_closed_commit_id == []


def test_broken_json_is_a_reject(spark, tmp_path):
    path = _write(tmp_path, "issues.json",
                  'header\n{"issue_number": "1"}\n{"issue_number": "2"\nnot json\n{"issue_labels": "x"}\n')
    scan = readers.scan_issues(spark, path)
    assert [r.issue_number for r in scan.rows.collect()] == ["1"]
    assert {(r.record, r.reason) for r in scan.rejects.collect()} == {
        (line, "malformed_record")
        for line in ('{"issue_number": "2"', "not json", '{"issue_labels": "x"}')}
    assert scan.rows.select("issue_number").count() == 1


def test_issues_csv(spark, tmp_path):
    path = _write(tmp_path, "i.csv",
                  "number,issue_number,repository_name,issue_title,issue_labels,issue_commit_id\n"
                  '1,1,r,"a ""b"", c","bug,ui","x, y"\n2,2,r,t,,\n')
    rows = {r.issue_number: r for r in readers.read_issues(spark, path).collect()}
    assert rows["1"].issue_title == 'a "b", c' and rows["1"].issue_labels == "bug,ui"
    assert rows["1"].issue_commit_id == ["x", "y"]
    assert rows["2"].issue_labels == "" and rows["2"].issue_commit_id == []


def test_format_resolution():
    assert readers.resolve_format("a/b.JSON") == "json"
    assert readers.resolve_format("a/b", "csv") == "csv"
    for path in ("a/b", "b.xml"):
        with pytest.raises(ValueError):
            readers.resolve_format(path)


def test_batch_config(spark, tmp_path):
    path = _write(tmp_path, "c.json", "\n".join([
        '{"language_label":"java","output_folder":"o",'
        '"retrieve_other_commit_id_from_issue_tracker":true,'
        '"consider_issues_without_labels_as_other":false,"log_flag":true}', "",
        '{"repo_name":"one","issue_file_name":"1.json","bug_label":">bug"}',
        '{"repo_name":"two","issue_file_name":"2.json","bug_label":"type: bug"}', ""]))
    rows = {r.repo: r for r in readers.read_batch_config(spark, path).collect()}
    assert sorted(rows) == ["one", "two"]
    assert rows["two"].bug_label == "type: bug" and rows["two"].language_label == "java"
    assert rows["one"].consider_issues_without_labels_as_other is False


def test_csv_facts_keep_quotes_commas_and_line_breaks(spark):
    df = spark.createDataFrame([("a,b", 'say "x"', "l1\nl2"), ("c", "back\\slash", "é")],
                               "a string, b string, c string")
    path = scratch_path(spark, "facts")
    writers.write_facts(df, path, "csv")
    assert sorted(map(tuple, readers.read_facts(spark, path).collect())) == sorted(
        map(tuple, df.collect()))


def test_output_formats(spark):
    df = spark.range(3)
    path = scratch_path(spark, "gz")
    writers.write_facts(df, path)
    assert readers.read_facts(spark, path, "parquet").count() == 3
    with pytest.raises(ValueError):
        writers.write_facts(df, path, "xml")


def test_shared_folder_is_the_configured_one(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder
    assert scratch_path(spark, "x").startswith(folder)
    kept = cut_lineage(spark.range(5).withColumn("r", F.rand()))
    assert kept.collect() == kept.collect()


def test_unknown_cohort(spark):
    commits = spark.createDataFrame([("a", "m")], "commit_sha string, message string")
    issues = spark.createDataFrame([("1", ["bug"])], "issue_number string,"
                                                     " issue_labels array<string>")
    with pytest.raises(ValueError):
        History(commits, issues, "bug").cohort("some")
    with pytest.raises(ValueError):
        History(commits, issues, "bug", mode="other").cohort("fix")
