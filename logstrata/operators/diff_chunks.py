"""Unified diffs that are larger than a cell: texts that come as numbered chunks.

A chunk may end anywhere, in a line or in a head. Lines are put together again at the seams,
numbered through the commit, and told apart by how many file starts, hunk heads and lines of
either side come before them; these counts are running sums over blocks of lines. So a commit of
any size is many tasks. The rows are those of :mod:`logstrata.operators.diff`, which also parses
the commits whose chunks make one cell: their lines need not be moved one by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstrata.operators.diff import (FILE_START, HUNK_START, NEW_NAME, NO_FILE, OLD_NAME,
                                      RENAMED_OR_COPIED, SUBMODULE, _path, _range, diff_lines,
                                      parse_unified_diff)
from logstrata.operators.numbering import running_before
from logstrata.operators.skew import lookup_side
from logstrata.schemas import keys
from logstrata.session import scratch_path

# The most chunks, and bytes of each of them, of a commit that is put together as one cell.
CELL_CHUNKS, CHUNK_BYTES = 256, 4096
FILE_LINE, HUNK_LINE = FILE_START[1:], HUNK_START[1:]


def _on(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x) == F.col(y) for x, y in zip(left, right)])


def chunk_lines(chunks: DataFrame) -> DataFrame:
    """(commit_sha, n, line): the lines of each commit's text, numbered from 0.

    ``chunks`` has commit_sha, chunk_no (from 0) and text. Only what lies beside a seam is
    grouped; a line that runs over many chunks is one value in the end.
    """
    key = keys(chunks, "commit_sha")
    text = F.coalesce("text", F.lit(""))
    breaks = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long")
    placed = running_before(chunks.select(*key, "chunk_no", text.alias("text"), breaks.alias("_breaks")),
                            key, "chunk_no", {"_breaks": "_first"})
    pieces = placed.select(*key, "chunk_no", "_first", "_breaks", F.posexplode(F.split("text", "\n"))
                           .alias("i", "line"))
    n = (F.col("_first") + F.col("i")).alias("n")
    seam = (F.col("i") == 0) | (F.col("i") == F.col("_breaks"))
    ends = pieces.where(seam).select(*key, n, F.struct("chunk_no", "line").alias("p")) \
        .groupBy(*key, "n").agg(F.array_sort(F.collect_list("p")).alias("p"))
    whole = pieces.where(~seam).select(*key, n, "line")
    return whole.unionByName(ends.select(*key, "n", F.array_join("p.line", "").alias("line")))


def _hunks(lines: DataFrame, key: list[str]) -> DataFrame:
    """One row per hunk head: its number, its file, its ranges and the side lines before it."""
    head = F.split(F.substr("line", F.lit(len(HUNK_LINE) + 1)), " ")
    return lines.where("_is_hunk").select(
        *[F.col(k).alias(f"_of_{k}") for k in key], (F.col("_hunk") + 1).alias("_of_hunk"),
        F.col("_file").alias("_of_file"), F.col("_old").alias("_old_before"),
        F.col("_new").alias("_new_before"),
        _range(F.get(head, F.lit(0))).alias("_old_range"),
        _range(F.substr(F.get(head, F.lit(1)), F.lit(2))).alias("_new_range"),
        F.coalesce(F.startswith(F.get(head, F.lit(1)), F.lit("+"))
                   & (F.get(head, F.lit(2)) == "@@"), F.lit(False)).alias("_headed"))


def chunked_diff_lines(chunks: DataFrame, cell_chunks: int = CELL_CHUNKS) -> DataFrame:
    """The rows of ``diff_lines(parse_unified_diff(diffs))`` for diffs that come in chunks.

    ``chunks``: commit_sha, n_parents, chunk_no (consecutive from 0) and text. Commits without
    parent, with a broken hunk or without text give no rows; renames, copies, submodules and
    files of changed type are left out, as in the form with one cell for each commit.

    The chunks are brought together in groups of ``cell_chunks`` and stored once. A commit of one
    group is a cell; the lines of all others are numbered and joined. A chunk above
    ``CHUNK_BYTES`` is a group of its own, so no group is larger than the two bounds allow.
    """
    key = keys(chunks, "commit_sha")
    number = F.col("chunk_no")
    large = F.coalesce(F.octet_length("text") > CHUNK_BYTES, F.lit(False))
    group = F.when(large, -1 - number).otherwise(F.floor(number / cell_chunks))
    path = scratch_path(chunks.sparkSession, "chunks")
    (chunks.where("n_parents > 0").groupBy(*key, group.alias("_group"))
     .agg(F.array_sort(F.collect_list(F.struct("chunk_no", "text"))).alias("_chunks"))
     .write.parquet(path))
    groups = chunks.sparkSession.read.schema(
        chunks.select(*key, F.lit(0).cast("long").alias("_group"), F.array(
            F.struct("chunk_no", "text")).alias("_chunks")).schema).parquet(path)
    many = groups.where("_group <> 0").select(*key).distinct()
    cells = groups.where("_group = 0").join(many, key, "left_anti").where(
        reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key]))
    diffs = cells.select(*key, F.lit(1).alias("n_parents"),
                         F.array_join("_chunks.text", "").alias("diff_text"))
    rest = groups.join(many, key, "left_semi").select(*key, F.explode("_chunks").alias("c")) \
        .select(*key, "c.*")
    return diff_lines(parse_unified_diff(diffs)).select(
        *key, "path", "op", "line_no", "value").unionByName(_joined_diff_lines(rest))


def _joined_diff_lines(chunks: DataFrame) -> DataFrame:
    """The rows of commits of any size."""
    key = keys(chunks, "commit_sha")
    text, first = F.col("line"), F.col("n") > 0
    is_file = first & F.startswith(text, F.lit(FILE_LINE))
    is_hunk = first & F.startswith(text, F.lit(HUNK_LINE))
    marked = F.startswith(text, F.lit("\\"))
    tagged = chunk_lines(chunks).select(
        "*", is_file.alias("_is_file"), is_hunk.alias("_is_hunk"),
        (~is_hunk & ~marked & ~F.startswith(text, F.lit("+"))).alias("_is_old"),
        (~is_hunk & ~marked & ~F.startswith(text, F.lit("-"))).alias("_is_new"))
    one = [F.col(f"_is_{c}").cast("long").alias(f"_one_{c}") for c in ("file", "hunk", "old", "new")]
    lines = running_before(tagged.select("*", *one), key, "n", {
        f"_one_{c}": f"_{c}" for c in ("file", "hunk", "old", "new")})
    # A line that starts a file belongs to it; a head belongs to the hunks before it.
    lines = lines.withColumn("_file", F.col("_file") + F.col("_one_file"))

    hunks = _hunks(lines, key)
    here = [f"_of_{k}" for k in key]
    met = lines.where("not _is_hunk").join(
        lookup_side(hunks), _on([*key, "_hunk"], [*here, "_of_hunk"])
        & (F.col("_file") == F.col("_of_file")), "left")
    header = met.where(F.col("_of_hunk").isNull()).groupBy(*key, "_file").agg(
        *[F.min(F.when(text.rlike(rx), F.struct("n", F.regexp_extract("line", rx, 1).alias("v"))))
          .getField("v").alias(name) for rx, name in ((OLD_NAME, "source"), (NEW_NAME, "target"))],
        F.max(text.rlike(RENAMED_OR_COPIED) | text.rlike(SUBMODULE)).alias("excluded"))
    files = header.where("source is not null").select(
        *key, "_file", F.coalesce("target", F.lit("")).alias("target"), "source", "excluded") \
        .withColumn("path", _path(F.col("source"), F.col("target")))

    inside = met.where(F.col("_of_hunk").isNotNull())
    sizes = inside.groupBy(*key, "_file", "_hunk").agg(
        F.sum("_one_old").alias("n_old"), F.sum("_one_new").alias("n_new"))
    known = files.select(*[F.col(k).alias(f"_in_{k}") for k in [*key, "_file"]])
    named = hunks.join(known, _on([*here, "_of_file"], [f"_in_{k}" for k in [*key, "_file"]]), "left_semi")
    judged = named.join(sizes, _on([*here, "_of_hunk"], [*key, "_hunk"]), "left")
    old, new = F.col("_old_range"), F.col("_new_range")
    sound = (F.col("_headed") & (old["start"] >= 0) & (new["start"] >= 0)
             & (F.coalesce("n_old", F.lit(0)) >= old["length"])
             & (F.coalesce("n_new", F.lit(0)) >= new["length"]))
    broken = judged.where(~F.coalesce(sound, F.lit(False))).select(
        *[F.col(f"_of_{k}").alias(k) for k in key]).distinct()
    retyped = files.groupBy(*key, "path").agg(
        F.max(F.col("target") == NO_FILE).alias("gone"), F.max(F.col("source") == NO_FILE).alias("new")) \
        .where("gone and new").select(*key, "path")
    counted = files.where("not excluded").join(retyped, [*key, "path"], "left_anti") \
        .join(broken, key, "left_anti")
    wanted = counted.select(*[F.col(k).alias(f"_in_{k}") for k in [*key, "_file"]], "path")

    op = F.substring("line", 1, 1)
    at = F.when(op == "-", old["start"] + F.col("_old") - F.col("_old_before")).otherwise(
        new["start"] + F.col("_new") - F.col("_new_before"))
    end = F.when(op == "-", old["start"] + old["length"]).otherwise(new["start"] + new["length"])
    changed = inside.where(op.isin("-", "+")).select(
        *key, "_file", op.alias("op"), at.alias("line_no"), end.alias("_end"),
        F.substr("line", F.lit(2)).alias("value")).where("line_no < _end")
    return changed.join(lookup_side(wanted), _on([*key, "_file"], [f"_in_{k}" for k in [*key, "_file"]])) \
        .select(*key, "path", "op", "line_no", "value")
