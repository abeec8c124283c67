"""Where deleted lines came from.

``blame_lines`` is the blame of the version before the commit. A commit with a deleted line
that has no blame line is rejected as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logstrata.operators.changes import commit_header
from logstrata.operators.skew import lookup_side
from logstrata.schemas import keys

CARRIED = {"commit_adds": "total_added_lines", "commit_deletes": "total_deleted_lines"}


def removed_only(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("op") == "-") if "op" in lines.columns else lines


def blamed_lines(lines: DataFrame, blame_lines: DataFrame) -> DataFrame:
    """Each removed line with its origin; blame_commit_sha is NULL where there is none."""
    key = keys(lines, "commit_sha", "path", "line_no")
    origin = blame_lines.select(*key, "blame_commit_sha", "content")
    return removed_only(lines).join(origin, key, "left")


def _per_file(lines: DataFrame, blame_lines: DataFrame) -> DataFrame:
    """Lines per commit, origin and file of the commits that are not rejected.

    The verdict on a commit is taken over per-file counts and its totals are summed before they
    are moved, so nothing of line size is grouped by commit. Lines that carry their commit's totals (as
    :func:`logstrata.operators.diff.removed_lines` gives them) need only the verdict; such a
    commit was one cell, so a window holds its counts, and its diff is not parsed for a second
    input of a join.
    """
    key = keys(lines, "commit_sha")
    carried = [name for name in CARRIED if name in lines.columns]
    # An unknown origin is an empty id: were it NULL, the joins that follow would let the
    # optimizer drop it early for the facts but not for the verdict, and join the lines twice.
    counts = (blamed_lines(lines, blame_lines)
              .withColumn("blame_commit_sha", F.coalesce("blame_commit_sha", F.lit("")))
              .groupBy(*key, "path", "blame_commit_sha", *carried)
              .agg(F.count("*").alias("n_lines")))
    if carried:
        for name, total in CARRIED.items():
            counts = counts.withColumnRenamed(name, total)
        missing = F.when(F.col("blame_commit_sha") == "", F.col("n_lines")).otherwise(0)
        commit = Window.partitionBy(*key)
        return counts.withColumn("n_missing", F.sum(missing).over(commit)).filter("n_missing = 0")
    # Blame may know a line twice; a commit's totals count the lines of its diff. The rejected
    # commits and the totals, a row for each commit, meet the facts by commit: these are moved once.
    totals = lines.filter(F.col("op").isin("-", "+")).groupBy(*key).agg(
        F.count_if(F.col("op") == "-").alias("total_deleted_lines"),
        F.count_if(F.col("op") == "+").alias("total_added_lines"))
    lost = counts.filter(F.col("blame_commit_sha") == "").select(*key).distinct()
    return (counts.join(lookup_side(lost), key, "left_anti")
            .join(lookup_side(totals), key))


def blame_rejects(lines: DataFrame, blame_lines: DataFrame) -> DataFrame:
    """Commits with a removed line that blame does not know."""
    key = keys(lines, "commit_sha")
    unknown = removed_only(lines).join(blame_lines, [*key, "path", "line_no"], "left_anti")
    return (unknown.select(*key).distinct()
            .select(*key, F.lit("blame_line_missing").alias("reason"),
                    F.lit("Blame").alias("stage")))


def origin_rejects(lines: DataFrame, blame_lines: DataFrame, commits: DataFrame) -> DataFrame:
    """Commits with a removed line whose origin is not among the commits."""
    facts = _per_file(lines, blame_lines)
    known = commits.select(*keys(commits), F.col("commit_sha").alias("blame_commit_sha"))
    lost = facts.join(known, keys(facts, "blame_commit_sha"), "left_anti")
    return lost.select(*keys(lost, "commit_sha"), F.lit("origin_missing").alias("reason"),
                       F.lit("Blame").alias("stage")).distinct()


def verdicts(lines: DataFrame, blame_lines: DataFrame, commits: DataFrame) -> DataFrame:
    """Every commit with a removed line: blame_line_missing, origin_missing, ``nothing`` (blame
    has a line without origin) or ``facts``; the reasons of :func:`blame_rejects` and
    :func:`origin_rejects`, for which the lines meet their blame once."""
    key = keys(lines, "commit_sha")
    place = [*key, "path", "line_no"]
    origin = blame_lines.select(*place, "blame_commit_sha", F.lit(True).alias("_met"))
    met = removed_only(lines).select(*place).join(origin, place, "left").select(
        *key, F.coalesce("blame_commit_sha", F.lit("")).alias("blame_commit_sha"),
        F.coalesce("_met", F.lit(False)).alias("_met")).distinct()
    known = commits.select(*keys(commits), F.col("commit_sha").alias("blame_commit_sha"),
                           F.lit(True).alias("_known")).distinct()
    state = F.when(~F.col("_met"), 0).when(F.col("blame_commit_sha") == "", 1).when(
        F.col("_known").isNull(), 2).otherwise(3)
    worst = met.join(lookup_side(known), keys(met, "blame_commit_sha"), "left").groupBy(*key).agg(
        F.min(state).alias("_worst"))
    named = F.array(*[F.lit(x) for x in ("blame_line_missing", "nothing", "origin_missing", "facts")])
    return worst.select(*key, named[F.col("_worst")].alias("verdict"))


def _origin(commits: DataFrame) -> DataFrame:
    return commit_header(commits).withColumnRenamed("commit_sha", "blame_commit_sha")


HEADER = ["author", "author_email", "authored_date", "authored_time_zone_offset"]
COUNTS = ["number_of_related_deleted_lines", "total_deleted_lines", "total_added_lines"]


def deleted_lines_behavior(lines: DataFrame, blame_lines: DataFrame,
                           commits: DataFrame) -> DataFrame:
    """One row per commit, origin commit and file, with the header of the origin.

    ``lines`` are the diff lines of the cohort (all of them, blank ones included), or its
    removed lines with their commit's totals; ``commits`` are all commits.
    """
    facts = (_per_file(lines, blame_lines)
             .withColumnRenamed("n_lines", "number_of_related_deleted_lines"))
    joined = facts.join(_origin(commits), keys(facts, "blame_commit_sha"))
    return joined.select(*keys(facts), *HEADER, *COUNTS,
                         F.col("commit_sha").alias("fix_commit_sha"), "blame_commit_sha",
                         F.col("path").alias("file_paths"))


def time_deleted_lines(lines: DataFrame, blame_lines: DataFrame, commits: DataFrame,
                       further: tuple[str, ...] = ()) -> DataFrame:
    """One row per commit and origin commit; ``further`` are columns of the commit to add."""
    per_file = _per_file(lines, blame_lines)
    facts = per_file.groupBy(*keys(per_file, "commit_sha", "blame_commit_sha")).agg(
        F.sum("n_lines").alias(COUNTS[0]),
        *[F.max(name).alias(name) for name in COUNTS[1:]])
    if further:  # while the facts lie by commit
        own = commits.select(*keys(commits, "commit_sha"), *further)
        facts = facts.join(lookup_side(own), keys(facts, "commit_sha"))
    joined = facts.join(_origin(commits), keys(facts, "blame_commit_sha"))
    return joined.select(*keys(facts), F.col("commit_sha").alias("fix_commit_sha"),
                         "blame_commit_sha", *HEADER, *COUNTS, *further)


def max_deleted_line(lines: DataFrame) -> DataFrame:
    """The last deleted line of each file: blame is not needed beyond it."""
    return (removed_only(lines).groupBy(*keys(lines, "commit_sha", "path"))
            .agg(F.max("line_no").alias("max_deleted_line")))


def blame_details(lines: DataFrame, blame_lines: DataFrame) -> DataFrame:
    """The nested form: per commit and origin a map from path to its lines.

    Each map holds lines of one commit's diff, which was one text cell before; for lines in
    bulk use the flat forms above or :func:`blame_pages`.
    """
    key = keys(lines, "commit_sha")
    rejected = blame_rejects(lines, blame_lines)
    per_path = (blamed_lines(lines, blame_lines).join(lookup_side(rejected), key, "left_anti")
                .groupBy(*key, "blame_commit_sha", "path")
                .agg(F.sort_array(F.collect_list(F.struct("line_no", "content")))
                     .alias("lines")))
    return per_path.groupBy(*key, "blame_commit_sha").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", "lines"))))
        .alias("file_path__line_number_content"))


PAGE_BYTES, PAGE_LINES = 1 << 20, 65536


def blame_pages(lines: DataFrame, blame_lines: DataFrame, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """:func:`blame_details` in pages: ``page_no`` (from 0) and a map of one path to its lines.

    A page ends where the bytes of its lines reach ``page_bytes``, and where the next block of
    ``PAGE_LINES`` line numbers begins, so a commit with very many lines is many bounded rows.
    Pages of a commit and origin are numbered by path and line; one after another they hold the
    lines of the nested form. Only the pages' names are numbered together, not what they hold.
    """
    key = keys(lines, "commit_sha")
    rejected = blame_rejects(lines, blame_lines)
    rows = (blamed_lines(lines, blame_lines).join(lookup_side(rejected), key, "left_anti")
            .select(*key, "blame_commit_sha", "path", "line_no", "content",
                    F.floor(F.col("line_no") / PAGE_LINES).alias("_block")))
    place = [*key, "blame_commit_sha", "path", "_block"]
    before = (Window.partitionBy(*place).orderBy("line_no", "content")
              .rowsBetween(Window.unboundedPreceding, -1))
    held = F.coalesce(F.sum(F.octet_length("content") + 16).over(before), F.lit(0))
    rows = rows.withColumn("_part", F.floor(held / page_bytes))
    pages = rows.groupBy(*place, "_part").agg(
        F.sort_array(F.collect_list(F.struct("line_no", "content"))).alias("lines"))
    origin = Window.partitionBy(*key, "blame_commit_sha").orderBy("path", "_block", "_part")
    names = rows.groupBy(*place, "_part").agg(F.count("*").alias("_n")).select(
        *[F.col(c).alias(f"_of_{c}") for c in [*place, "_part"]],
        (F.row_number().over(origin) - 1).cast("long").alias("page_no"))
    same = F.lit(True)
    for c in [*place, "_part"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return pages.join(lookup_side(names), same).select(
        *key, "blame_commit_sha", "page_no",
        F.create_map("path", "lines").alias("file_path__line_number_content"))
