from pyspark.sql import functions as F

from logstrata.functions import text as X
from logstrata.operators import changes, cohorts, filters
from logstrata.operators.filters import except_rows, keep_rows

ISSUE = ("issue_number string, issue_labels array<string>, issue_closed_commit_id array<string>,"
         " issue_commit_id array<string>, commit_id_similar_to_issue_title array<string>")


def _issues(spark):
    ten, eleven = [f"s{i}" for i in range(10)], [f"t{i}" for i in range(11)]
    return spark.createDataFrame(
        [("1", ["bug"], ["a"], [], None), ("2", [], ["b"], ["c"], ten), ("3", None, ["d"], [], []),
         ("4", ["bugfix"], ["a", "e"], None, eleven)], ISSUE)


def _commits(spark):
    return spark.createDataFrame(
        [("a", "init"), ("b", "Fix x"), ("c", "a FIX"), ("d", "suffix"), ("e", "a fixture"),
         ("f", "docs")], "commit_sha string, message string")


def _numbers(df):
    return {r.issue_number for r in df.collect()}


def test_label_filter_modes(spark):
    issues = _issues(spark)

    def run(keep, drop):
        return _numbers(filters.filter_issues(issues, "issue_labels", "bug", keep, drop))

    assert run(True, True) == {"1"}
    assert run(True, False) == {"1", "3"}
    assert run(False, True) == {"2", "4"}
    assert run(False, False) == {"2", "3", "4"}
    text = issues.withColumn("issue_labels", F.array_join("issue_labels", ","))
    assert _numbers(filters.filter_issues(text, "issue_labels", "bug")) == {"1", "4"}
    assert _numbers(filters.filter_issues(issues, "absent", "bug")) == set()
    assert len(_numbers(filters.filter_issues(issues, "absent", "bug", False, False))) == 4


def test_similar_ids_are_capped_per_issue(spark):
    ids = {r.commit_sha for r in cohorts.issue_commit_ids(_issues(spark)).collect()}
    assert ids == {"a", "b", "c", "d", "e", *[f"s{i}" for i in range(10)]}


def test_keyword_follows_a_space(spark):
    found = {r.commit_sha for r in cohorts.search_commits(_commits(spark), "fix").collect()}
    assert found == {"c", "e"}


def test_cohorts(spark):
    issues, commits = _issues(spark), _commits(spark)

    def shas(df):
        return sorted(r.commit_sha for r in df.collect())

    fix = shas(cohorts.fix_commits(commits, issues, "bug"))
    rest = shas(cohorts.non_fix_commits(commits, issues, "bug"))
    assert fix == ["a", "c", "e"]
    assert rest == ["b", "d", "f"]
    assert shas(cohorts.non_fix_commits(commits, issues, "bug", "tracker")) == ["b", "d"]
    assert shas(cohorts.non_fix_commits(commits, issues, "bug", "tracker",
                                        unlabelled_as_other=False)) == ["b"]
    ids = cohorts.non_fix_commit_ids(issues, commits, "bug")
    assert shas(ids) == sorted(["b", "d", *[f"s{i}" for i in range(10)]])
    missing = cohorts.unresolved_ids(cohorts.issue_commit_ids(issues), commits)
    assert shas(missing) == sorted(f"s{i}" for i in range(10))


def test_keep_and_except(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, n int")
    assert keep_rows(df, {"k": ["a", "b"], "n": 2}).count() == 1
    assert {r.n for r in except_rows(df, {"k": ["a"]}).collect()} == {2, 3}
    assert except_rows(df, {"k": []}).count() == 3


def test_time_text_in_any_session_zone(spark):
    cases = {-19800: "+5:30", 14400: "-4:0", 0: "+0:0", 12600: "-3:30", -12600: "+3:30"}
    df = spark.createDataFrame([(k,) for k in cases], "s long")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            got = {r.s: r.t for r in df.select("s", X.utc_offset_label(F.col("s")).alias("t"))
                   .collect()}
            assert got == cases
            row = df.limit(1).select(
                X.author_local_asctime(F.lit(1556928000), F.lit(0)).alias("a"),
                X.author_local_asctime(F.lit(-1), F.lit(0)).alias("before"),
                X.hour_of_day_utc(F.lit("Tue Apr 30 05:30:00 2019"), F.lit("+5:30")).alias("p"),
                X.hour_of_day_utc(F.lit("Sat May  4 00:00:00 2019"), F.lit("-4:0")).alias("m"),
                X.hour_of_day_utc(F.lit("Sat May  4 01:00:00 2019"), F.lit("2:0")).alias("u"),
                X.hour_of_day_utc(F.lit("yesterday"), F.lit("2:0")).alias("n")).first()
            assert row.a == "Sat May  4 00:00:00 2019"
            assert row.before == "Wed Dec 31 23:59:59 1969"
            assert (row.p, row.m, row.u, row.n) == (0, 4, 23, None)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_blank_and_trim(spark):
    df = spark.createDataFrame([(" \t　 \x1c",), (" x ",), ("",)], "v string")
    rows = df.select(X.not_blank(F.col("v")).alias("b"), X.trimmed(F.col("v")).alias("t"))
    assert [tuple(r) for r in rows.collect()] == [(False, ""), (True, "x"), (False, "")]


def test_missing_email_is_empty(spark):
    commits = spark.createDataFrame([("a", "N", None, 0, 0)],
                                    "commit_sha string, author_name string, author_email string,"
                                    " authored_epoch long, author_tz_offset long")
    assert changes.commit_header(commits).first().author_email == ""


def test_not_fixed_files(spark):
    every = spark.createDataFrame([(" a ",), ("b",)], "path string")
    fixed = spark.createDataFrame([("a",), ("a ",)], "path string")
    assert [r.path for r in changes.changes_on_not_fixed_files(every, fixed).collect()] == ["b"]
