"""What is moved and stored: each row once where once will do, and the same rows as before."""

from pyspark.sql import functions as F

from checks import cohort_queries, frequency_queries, token_queries, views  # noqa: F401
from checks.registry import QUERIES
from logstrata.operators import blame, frequency

LINES = """l_orderkey bigint, l_partkey bigint, l_linenumber int, l_suppkey bigint,
           l_returnflag string"""


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _lineitem(spark):
    flags = [None, "R", "A", "N", "B", "", "Z"]
    rows = [(i % 5 or None, i % 3 or None, (i % 8) or None, i % 4 or None, flags[i * i % 7])
            for i in range(400)]
    return spark.createDataFrame(rows + rows[:50], LINES)


def test_spark_forms_of_views_give_the_rows_of_the_shared_text(spark):
    rows = _lineitem(spark)
    for name in ["lineitem", "lineitem_of_orders", "lineitem_of_parts"]:
        rows.createOrReplaceTempView(name)
    for name in views.SPARK_FORMS:
        shared = spark.sql(views.VIEWS[name].replace("{{TEXT}}", "string"))
        form = spark.sql(views._text(name, "spark"))
        assert shared.count() > 100 or name == "fx_issue_links"
        assert form.select(shared.columns).exceptAll(shared).isEmpty()
        assert shared.exceptAll(form.select(shared.columns)).isEmpty()
    full = spark.sql(views._text("sp_full_links", "spark"))
    whole = spark.sql(views._text("fx_issue_links", "spark")).where("length(commit_sha) = 32")
    named = full.where("commit_seq is not null").select(
        "issue_number", "link_kind", F.md5(F.col("commit_seq").cast("string")).alias("commit_sha"))
    assert named.exceptAll(whole).isEmpty() and whole.exceptAll(named).isEmpty()


def test_diff_lines_are_moved_once_and_not_sorted(spark, tmp_path):
    _lineitem(spark).write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = _plan(views.Tables(spark, str(tmp_path))("fx_diff_lines"))
    assert plan.count("Exchange ") == 1 and "Sort" not in plan


def test_texts_of_both_versions_come_from_one_read(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a\nb", "en", "s"), (1, "a\nb", "en", "s"), (None, "c", "de", "s")],
                                 "doc_id bigint, text string, lang string, source string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    found = views.Tables(spark, str(tmp_path))("sp_blobs")
    assert _plan(found).count("FileScan parquet") == 1
    assert found.count() == 6 and found.where("sha is null").count() == 2
    assert found.select("sha").distinct().count() == 3


def test_blame_facts_meet_the_totals_of_their_commit_without_a_union(spark):
    lines = spark.createDataFrame(
        [("c", "p", "-", 1), ("c", "p", "-", 2), ("c", "q", "+", 1), ("d", "p", "-", 1),
         ("d", "p", "-", 9), (None, "p", "-", 1), ("e", "p", "+", 1)],
        "commit_sha string, path string, op string, line_no bigint")
    known = spark.createDataFrame(
        [("c", "p", 1, "a"), ("c", "p", 2, "a"), ("c", "p", 2, "a"), ("d", "p", 1, "a")],
        "commit_sha string, path string, line_no bigint, blame_commit_sha string").withColumn(
            "content", F.lit("x"))
    facts = blame._per_file(lines, known)
    assert "Union" not in _plan(facts)
    assert [(r.commit_sha, r.path, r.blame_commit_sha, r.n_lines, r.total_deleted_lines,
             r.total_added_lines) for r in facts.collect()] == [("c", "p", "a", 3, 2, 1)]


def test_numbered_origins_get_their_order_where_they_lie(spark):
    commits = spark.createDataFrame([("c", 2), ("d", 1)], "commit_sha string, commit_seq bigint") \
        .selectExpr("*", "'n' author_name", "'m' author_email", "0L authored_epoch",
                    "0L author_tz_offset")
    lines = spark.createDataFrame([("c", "p", "-", 1), ("d", "p", "-", 1)],
                                  "commit_sha string, path string, op string, line_no bigint")
    known = lines.selectExpr("commit_sha", "path", "line_no", "'d' blame_commit_sha", "'x' content")
    facts = blame.time_deleted_lines(lines, known, commits, ("commit_seq",))
    assert {(r.fix_commit_sha, r.commit_seq) for r in facts.collect()} == {("c", 2), ("d", 1)}


def test_cells_of_other_values_are_combined_before_the_pivot(spark):
    cells = spark.createDataFrame(
        [("g", "x", 2), ("g", "other", 5), ("g", "", 1), ("g", None, 3), ("h", "third", 4)],
        "g string, value string, count bigint")
    wide = frequency.matrix_of_cells(cells, "g", ["x", ""])
    assert "CASE WHEN" in wide._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, wide.collect())) == [("g", 2, 4), ("h", 0, 0)]


def test_dense_blocks_are_told_without_a_row_for_each_zero(spark, tmp_path):
    words = [chr(97 + i % 26) + str(i // 26 % 7) for i in range(500)]
    text = [(i, " ".join(words[i:i * 9 + 3] * 2)) for i in range(12)] + [(None, "a1 a1"), (3, None)]
    spark.createDataFrame(text, "doc_id bigint, text string").selectExpr(
        "*", "'en' lang", "'s' source").write.parquet(f"{tmp_path}/documents.parquet")
    t = views.Tables(spark, str(tmp_path))
    found = QUERIES["matrix_column_blocks"](spark, str(tmp_path))
    assert "slice(" in _plan(found)
    held = t("fx_tokens").groupBy("hex_hash", "token_content").count()
    places = {r.value: r.place for r in frequency.vocabulary(
        held.select(F.col("token_content").alias("value"))).collect()}
    expected = {}
    for r in held.collect():
        total, weighted = expected.get(r.hex_hash, (0, 0))
        expected[r.hex_hash] = (total + r["count"], weighted + r["count"] * (places[r.token_content] + 1))
    assert {r.hex_hash: (r.total, r.weighted) for r in found.collect()} == expected
    assert {r.width for r in found.collect()} == {len(places)}
    assert len(places) > 100


def test_tokens_at_offsets_are_read_from_parts_of_the_text(spark, tmp_path):
    texts = ["\U0001f600 word " * 400 + '"' + "long " * 600 + '" end', "a\n\nb", "", None]
    spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "doc_id bigint, text string") \
        .selectExpr("*", "'en' lang", "'s' source").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["token_offsets"](spark, str(tmp_path))
    assert "substring(text" not in _plan(found)
    made = QUERIES["tokenize"](spark, str(tmp_path)).select(found.columns)
    assert made.count() > 800 and made.agg(F.max(F.length("token_content"))).first()[0] > 3000
    assert found.exceptAll(made).isEmpty() and made.exceptAll(found).isEmpty()
