"""One commit, path or group with a third of all rows: results stay whole, joins are split."""

import pytest
from pyspark.sql import functions as F

from logstrata.operators import changes, frequency
from logstrata.operators.skew import with_group_totals

SMALL = {"spark.sql.autoBroadcastJoinThreshold": "-1",
         "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
         "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
         "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
         "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
         "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
         "spark.sql.shuffle.partitions": "16"}
N = 120_000


@pytest.fixture
def hot(spark):
    old = {k: spark.conf.get(k, None) for k in SMALL}
    for key, value in SMALL.items():
        spark.conf.set(key, value)
    row = F.col("id")
    sha = F.when(row % 3 == 0, "hot").otherwise((row % 5000).cast("string"))
    yield spark.range(N, numPartitions=8).select(
        sha.alias("commit_sha"), F.concat(F.lit("p"), row.cast("string")).alias("path"),
        F.md5(row.cast("string")).alias("value"), F.lit(1).cast("long").alias("adds"),
        F.lit(2).cast("long").alias("deletes"), F.lit(1).cast("long").alias("added_lines"),
        F.lit(1).cast("long").alias("deleted_lines"))
    for key, value in old.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _commits(spark):
    shas = spark.range(5000).select(F.col("id").cast("string").alias("commit_sha"))
    shas = shas.unionByName(spark.createDataFrame([("hot",)], "commit_sha string"))
    # A cohort is the result of a join, hence already partitioned by the commit.
    other = shas.withColumn("flag", F.lit(1)).groupBy("commit_sha").agg(F.max("flag"))
    return shas.join(other, "commit_sha", "left").select(
        "commit_sha", F.lit("n").alias("author_name"), F.lit(None).cast("string")
        .alias("author_email"), F.lit(0).alias("authored_epoch"), F.lit(0)
        .alias("author_tz_offset"))


def _checked(df, column):
    result = df.agg(F.count("*").alias("n"), F.max(column))
    row = result.collect()[0]
    plan = result._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    return row.n, "skew=true" in plan


def test_cohort_filter_splits_the_hot_commit(spark, hot):
    assert _checked(changes.of_cohort(hot, _commits(spark)), "value") == (N, True)


def test_user_behavior_splits_the_hot_commit(spark, hot):
    facts = hot.select("commit_sha", F.concat("path", "value").alias("path"), "added_lines",
                       "deleted_lines")
    assert _checked(changes.user_behavior(facts, _commits(spark)), "file_paths") == (N, True)


def test_not_fixed_files_splits_the_hot_path(spark, hot):
    rows = hot.select(F.col("commit_sha").alias("path"), "value")
    fixed = spark.range(0, 5000, 2).select(F.col("id").cast("string").alias("path"))
    expected = rows.filter((F.col("path") == "hot")
                           | (F.col("path").try_cast("int") % 2 == 1)).count()
    result = changes.changes_on_not_fixed_files(rows, fixed.unionByName(fixed))
    assert _checked(result, "value") == (expected, True)


def test_normalised_terms_of_a_hot_group(spark, hot):
    rows = hot.select("commit_sha", "path")
    got = frequency.frequency_cells(rows, ["path"], "commit_sha").groupBy("commit_sha").agg(
        F.count("*").alias("n"), F.sum("aggregate_count_normalized").alias("s"),
        F.max("binary_count_normalized").alias("b")).collect()
    assert sum(r.n for r in got) == N
    for r in got:
        assert r.s == pytest.approx(1) and r.b == pytest.approx(1 / r.n)


def test_rows_meet_their_totals_unsorted(spark):
    rows = spark.range(50_000).selectExpr("id % 900 g", "id % 7 v", "1L n")
    found = with_group_totals(rows, ["g"], ["v"], {"total": F.col("n")})
    assert found.where("total not in (55, 56)").isEmpty() and found.count() == 50_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
