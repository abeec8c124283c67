"""Unified diffs as tables.

A commit's diff against its first parent is one text cell, so it is parsed where it lies:
array expressions turn the cell into files, hunks and numbered lines inside the row. Nothing
is shuffled, and per-file or per-commit counts need no aggregation afterwards.

Line numbers come from positions in filtered lists. Among the lines a hunk shows of the old
file (all but ``+``) the i-th has number *start + i*; the same holds for the new file and ``-``.
The declared lengths of the hunk bound both lists, which also drops trailing text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstrata.functions.text import not_blank
from logstrata.schemas import keys

# The shapes of unified-diff text. No line of a file's content can start like
# the first two, because content lines start with a mark.
FILE_START = "\ndiff --git "
HUNK_START = "\n@@ -"
OLD_NAME = r"(?dm)^--- ([^\t\n]+)"
NEW_NAME = r"(?dm)^\+\+\+ ([^\t\n]+)"
RENAMED_OR_COPIED = r"(?dm)^(?:rename|copy) (?:from|to) "
SUBMODULE = r"(?dm)^(?:(?:new file |deleted file |old |new )mode 160000|index \S+ 160000)"
NO_FILE = "/dev/null"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: a lambda's variable is never written out
    again at each place that names it, as the columns of a projection are."""
    return F.transform(F.array(value), body)[0]


def _range(text: Column) -> Column:
    """``start,length``; a missing length means one line."""
    return _let(F.split(text, ","), lambda parts: F.struct(
        F.get(parts, F.lit(0)).try_cast("long").alias("start"),
        F.coalesce(F.get(parts, F.lit(1)), F.lit("1")).try_cast("long").alias("length")))


def _hunk(lines: Column) -> Column:
    """Ranges and sides of a hunk from its lines; the first is ``1,3 +1,4 @@ ...``.

    A side holds the lines the hunk shows of one version, context included. A line without
    any mark is an empty context line.
    """
    def side(other: str) -> Column:
        return F.filter(lines, lambda line, i: (i > 0) & ~F.startswith(line, F.lit(other))
                        & ~F.startswith(line, F.lit("\\")))

    return _let(F.split(lines[0], " ", 4), lambda head: F.struct(
        _range(F.get(head, F.lit(0))).alias("old"),
        _range(F.substr(F.get(head, F.lit(1)), F.lit(2))).alias("new"),
        F.coalesce(F.startswith(F.get(head, F.lit(1)), F.lit("+"))
                   & (F.get(head, F.lit(2)) == "@@"), F.lit(False)).alias("headed"),
        side("+").alias("old_side"), side("-").alias("new_side")))


def _changed(hunk: Column, op: str) -> Column:
    lines, where = ((hunk["old_side"], hunk["old"]) if op == "-"
                    else (hunk["new_side"], hunk["new"]))
    numbered = F.transform(lines, lambda line, i: F.struct((where["start"] + i).alias("line_no"),
                                                          line.alias("line")))
    marked = F.filter(numbered, lambda item: F.startswith(item["line"], F.lit(op))
                      & (item["line_no"] < where["start"] + where["length"]))
    return F.transform(marked, lambda item: F.struct(
        item["line_no"].alias("line_no"),
        F.substr(item["line"], F.lit(2)).alias("value")))


def _shown_numbers(hunk: Column, op: str) -> Column:
    """The numbers of the lines of :func:`_changed` that are not blank."""
    lines, where = ((hunk["old_side"], hunk["old"]) if op == "-"
                    else (hunk["new_side"], hunk["new"]))
    def shown(line: Column) -> Column:  # mostly the first character tells
        return F.substring(line, 2, 1).between("!", "~") | not_blank(F.substr(line, F.lit(2)))

    numbers = F.transform(lines, lambda line, i: F.when(
        F.startswith(line, F.lit(op)) & (i < where["length"]) & shown(line), where["start"] + i))
    return F.filter(numbers, lambda number: number.isNotNull())


LISTS = {
    "added": lambda hunk: _changed(hunk, "+"), "removed": lambda hunk: _changed(hunk, "-"),
    "added_numbers": lambda hunk: _shown_numbers(hunk, "+"),
    "removed_numbers": lambda hunk: _shown_numbers(hunk, "-"),
}


def _hunk_changes(hunk: Column, lists: tuple[str, ...]) -> Column:
    """Changed lines within the declared lengths; sound if the hunk is no shorter."""
    sound = (hunk["headed"] & (hunk["old"]["start"] >= 0) & (hunk["new"]["start"] >= 0)
             & (F.size(hunk["old_side"]) >= hunk["old"]["length"])
             & (F.size(hunk["new_side"]) >= hunk["new"]["length"]))
    return F.struct(F.coalesce(sound, F.lit(False)).alias("sound"),
                    *[LISTS[name](hunk).alias(name) for name in lists])


def _excluded(header: Column) -> Column:
    """Renames, copies and submodules; a plain search keeps most headers from the patterns."""
    def named(words: list[str], pattern: str) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(header, F.lit(w)) for w in words]) \
            & header.rlike(pattern)

    return named(["rename ", "copy "], RENAMED_OR_COPIED) | named(["160000"], SUBMODULE)


def _file(parts: Column, lists: tuple[str, ...]) -> Column:
    """The header's names and the changes of the hunks."""
    header = parts[0]
    hunks = F.transform(F.slice(parts, 2, F.size(parts)), lambda text: F.split(text, "\n"))
    return F.struct(
        F.regexp_extract(header, OLD_NAME, 1).alias("source_file"),
        F.regexp_extract(header, NEW_NAME, 1).alias("target_file"),
        _excluded(header).alias("excluded"),
        F.transform(F.transform(hunks, _hunk), lambda h: _hunk_changes(h, lists)).alias("hunks"))


def _path(source: Column, target: Column) -> Column:
    """The name without its two-character prefix; of the old file unless there is none."""
    old, new = F.startswith(source, F.lit("a/")), F.startswith(target, F.lit("b/"))
    return (F.when(old & (new | (target == NO_FILE)), F.substr(source, F.lit(3)))
            .when(new & (source == NO_FILE), F.substr(target, F.lit(3)))
            .otherwise(source))


def _patch(file: Column, lists: tuple[str, ...]) -> Column:
    sides = [F.flatten(F.transform(file["hunks"], lambda h: h[name])).alias(name)
             for name in lists]
    return F.struct(
        file["source_file"].alias("source_file"), file["target_file"].alias("target_file"),
        _path(file["source_file"], file["target_file"]).alias("path"),
        file["excluded"].alias("excluded"),
        F.forall(file["hunks"], lambda h: h["sound"]).alias("sound"), *sides)


def has_diff() -> Column:
    return (F.col("n_parents") > 0) & (F.coalesce("diff_text", F.lit("")) != "")


def _parsed(text: Column, lists: tuple[str, ...]) -> Column:
    """The list of patches of a commit."""
    parts = F.transform(F.split(text, FILE_START), lambda chunk: F.split(chunk, HUNK_START))
    patches = F.transform(F.transform(parts, lambda p: _file(p, lists)),
                          lambda f: _patch(f, lists))
    # Binary and mode-only patches name no file.
    return F.filter(patches, lambda p: p["source_file"] != "")


def _retyped(patches: Column) -> Column:
    """Paths whose file type changed: they show as one deleted and one new file."""
    def paths(no_file: str) -> Column:
        gone = F.filter(patches, lambda p: p[no_file] == NO_FILE)
        return F.transform(gone, lambda p: p["path"])

    return F.array_intersect(paths("target_file"), paths("source_file"))


def _removed(p: Column) -> Column:
    """What blame asks of a file."""
    return F.struct(p["path"].alias("path"), p["removed"].alias("removed"),
                    F.size(p["added"]).cast("long").alias("adds"),
                    F.size(p["removed"]).cast("long").alias("deletes"))


def _counted(p: Column) -> Column:
    return F.struct(
        p["source_file"].alias("source_file"), p["target_file"].alias("target_file"),
        p["path"].alias("path"), p["added"].alias("added"), p["removed"].alias("removed"),
        F.size(p["added"]).cast("long").alias("adds"),
        F.size(p["removed"]).cast("long").alias("deletes"),
        F.size(F.filter(p["added"], lambda l: not_blank(l["value"]))).cast("long")
        .alias("added_lines"),
        F.size(F.filter(p["removed"], lambda l: not_blank(l["value"]))).cast("long")
        .alias("deleted_lines"))


def _numbered(name: str) -> Callable[[Column], Column]:
    """What content tokens ask of a file."""
    return lambda p: F.struct(p["path"].alias("path"), p[name].alias(name))


# What is shown of a file, and the lists that are made for it.
SHOWN = {"all": (_counted, ("added", "removed")), "removed": (_removed, ("added", "removed")),
         "paths": (lambda p: p["path"], ()),
         "added_numbers": (_numbered("added_numbers"), ("added_numbers",)),
         "removed_numbers": (_numbered("removed_numbers"), ("removed_numbers",))}


def _told(patches: Column, shown: Callable[[Column], Column]) -> Column:
    """Whether a commit's patches are sound and name a file, and the files to count."""
    countable = _let(_retyped(patches), lambda retyped: F.filter(
        patches, lambda p: ~p["excluded"] & ~F.array_contains(retyped, p["path"])))
    return F.struct((F.size(patches) > 0).alias("named"),
                    F.when(F.forall(patches, lambda p: p["sound"]),
                           F.transform(countable, shown)).alias("files"))


def tagged_diffs(diffs: DataFrame, shown: str = "all") -> DataFrame:
    """Every commit of ``diffs`` once, parsed once: its files, or the reason why it has none.

    ``reason`` is NULL where there are files to count, else no_parent, empty_diff (no text, or
    nothing but renames, copies, submodules and changed file types), no_file (nothing but
    binary files and modes) or broken_hunk. The files may be shown by their ``removed`` lines and
    numbers of lines, by the ``added_numbers`` or ``removed_numbers`` of their lines that are not
    blank, or by their ``paths`` alone, where no more is read of them.
    """
    key = keys(diffs, "commit_sha")
    missing = F.when(F.col("n_parents") <= 0, "no_parent").when(
        F.coalesce("diff_text", F.lit("")) == "", "empty_diff")
    # A diff that is not to be read is not parsed.
    show, lists = SHOWN[shown]
    told = F.when(has_diff(), _let(_parsed(F.col("diff_text"), lists),
                                     lambda patches: _told(patches, show)))
    # A generated column is worked out once, whatever reads it: neither a filter on the reason nor
    # a projection is moved below, where it would parse again.
    parsed = diffs.select(*key, missing.alias("_missing"),
                          F.explode_outer(F.array(told)).alias("_told"))
    files = F.col("_told.files")
    reason = F.coalesce("_missing", F.when(files.isNull(), "broken_hunk").when(
        ~F.col("_told.named"), "no_file").when(F.size(files) == 0, "empty_diff"))
    # Where the text was not read the list is empty, as of an empty text.
    files = F.when(F.col("_missing").isNotNull(), F.coalesce(files, F.array())).otherwise(files)
    return parsed.select(*key, reason.alias("reason"), files.alias("files"))


def patches_of(tagged: DataFrame) -> DataFrame:
    """The rows of :func:`parse_unified_diff` of parsed commits."""
    key = keys(tagged, "commit_sha")

    def total(name: str) -> Column:
        return F.aggregate("files", F.lit(0).cast("long"), lambda acc, f: acc + f[name])

    known = tagged.schema["files"].dataType.elementType.names
    names = [n for n in ("adds", "deletes", "added_lines", "deleted_lines") if n in known]
    totals = [total(name).alias(f"commit_{name}") for name in names]
    # The outer form keeps the optimizer from testing the list, that is from parsing twice.
    rows = tagged.select(*key, *totals, F.posexplode_outer("files").alias("file_no", "file"))
    return (rows.filter(F.col("file").isNotNull())
            .select(*key, "file_no", "file.*", *[f"commit_{name}" for name in names]))


def rejects_of(tagged: DataFrame, stage: str) -> DataFrame:
    """Parsed commits without facts, with the reason."""
    return tagged.filter(F.col("reason").isNotNull()).select(
        *keys(tagged, "commit_sha"), "reason", F.lit(stage).alias("stage"))


def parse_unified_diff(diffs: DataFrame) -> DataFrame:
    """One row per commit and changed file, with the added and removed lines as lists.

    Columns: source_file, target_file, path, file_no, added, removed (lists of line_no and
    value), adds, deletes (all lines), added_lines, deleted_lines (those not blank), and the
    commit's totals commit_adds, commit_deletes, commit_added_lines, commit_deleted_lines.
    Commits without parent, without diff or with a broken hunk are left to
    :func:`diff_rejects`.
    """
    return patches_of(tagged_diffs(diffs.filter(has_diff())))


def diff_lines(patches: DataFrame) -> DataFrame:
    """One row per added or removed line: op, line_no (of the new or the old file), value."""
    def tagged(column: str, op: str) -> Column:
        return F.transform(column, lambda l: F.struct(
            F.lit(op).alias("op"), l["line_no"].alias("line_no"), l["value"].alias("value")))

    lines = F.concat(tagged("removed", "-"), tagged("added", "+"))
    exploded = patches.select(*keys(patches, "commit_sha", "path"),
                              F.explode_outer(lines).alias("line"))
    return (exploded.filter(F.col("line").isNotNull())
            .select(*keys(patches, "commit_sha", "path"), "line.*"))


def removed_lines(patches: DataFrame) -> DataFrame:
    """The removed lines of :func:`diff_lines`, with the totals of their commit."""
    key = keys(patches, "commit_sha", "path")
    totals = ["commit_adds", "commit_deletes"]
    exploded = patches.select(*key, *totals, F.explode_outer("removed").alias("line"))
    return (exploded.filter(F.col("line").isNotNull())
            .select(*key, "line.*", *totals))


def diff_rejects(diffs: DataFrame, stage: str) -> DataFrame:
    """Commits whose diff gives no facts, with the reason."""
    return rejects_of(tagged_diffs(diffs, "paths"), stage)


def not_blank_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(not_blank(F.col("value")))


ANALYSED = {"added": "+", "deleted": "-"}


def analysed_lines(lines: DataFrame, analyze_part: str = "deleted") -> DataFrame:
    """The lines of one side that are not blank."""
    if analyze_part not in ANALYSED:
        raise ValueError(f"analyze_part must be one of {sorted(ANALYSED)}")
    return not_blank_lines(lines.filter(F.col("op") == ANALYSED[analyze_part])).drop("op")


def changed_files(patches: DataFrame) -> DataFrame:
    return patches.select(*keys(patches, "commit_sha", "path"))


def affected_lines(patches: DataFrame) -> DataFrame:
    """Per file the numbers of its added and removed lines that are not blank."""
    def numbers(column: str) -> Column:
        shown = F.filter(column, lambda l: not_blank(l["value"]))
        return F.transform(shown, lambda l: l["line_no"])

    return patches.select(*keys(patches, "commit_sha", "path"),
                          numbers("added").alias("added_line_number"),
                          numbers("removed").alias("deleted_line_number"))


def file_changes(patches: DataFrame) -> DataFrame:
    """The changed-file record: names, line lists and their sizes."""
    return patches.select(
        *keys(patches, "commit_sha"),
        F.col("source_file").alias("old_file_name"), F.col("target_file").alias("new_file_name"),
        F.col("added").alias("added_lines"), F.col("removed").alias("deleted_lines"),
        F.col("adds").alias("number_added_lines"), F.col("deletes").alias("number_deleted_lines"),
        (F.col("adds") + F.col("deletes")).alias("number_changed_lines"))


def touched_files(patches: DataFrame) -> DataFrame:
    """Distinct old and new names without their prefix."""
    names = F.filter(F.array("source_file", "target_file"), lambda name: name != NO_FILE)
    names = F.transform(names, lambda name: F.substr(name, F.lit(3)))
    exploded = patches.select(*keys(patches), F.explode_outer(names).alias("path"))
    return exploded.filter(F.col("path").isNotNull()).distinct()
