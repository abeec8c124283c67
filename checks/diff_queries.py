"""Facts from diff text: parsing, counts, blame."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.change_queries import (CHANGES, COHORTS, BEHAVIOR, COUNTS, PER_COMMIT, PER_FILE_NAMED,
                                   WITH_BLAME, WITH_COUNTS)
from checks.cohort_queries import ALL_IDS, history
from checks.registry import query
from logstrata.operators import diff, diff_chunks

# Commits without a parent have no diff to look at.
PARENTED = "commit_sha in (select commit_sha from fx_commits where n_parents > 0)"


def text_history(t, **options):
    return history(t, diffs=t("sp_diffs"), blame_lines=t("fx_blame_lines"), **options)


@query("diff_lines_from_text", f"""select commit_sha, path, op, line_no, value
       from fx_diff_lines where op <> ' ' and {PARENTED}""")
def diff_lines_from_text(t):
    return diff.diff_lines(diff.parse_unified_diff(t("sp_diffs")))


@query("diff_lines_from_chunks", f"""select commit_sha, path, op, line_no, value
       from fx_diff_lines where op <> ' ' and {PARENTED}""")
def diff_lines_from_chunks(t):
    """The same texts in chunks that end in the middle of lines and heads."""
    start = F.explode(F.sequence(F.lit(0), F.floor(F.length("diff_text") / 97)))
    chunks = t("sp_diffs").select("commit_sha", "n_parents", "diff_text", start.alias("chunk_no"))
    text = F.substr("diff_text", (F.col("chunk_no") * 97 + 1).cast("int"), F.lit(97))
    return diff_chunks.chunked_diff_lines(chunks.select("commit_sha", "n_parents", "chunk_no",
                                                        text.alias("text")))


@query("patches_from_text", f"""
       select commit_sha, path, 'a/' || path source_file, 'b/' || path target_file,
              adds, deletes, added_lines, deleted_lines,
              cast(sum(adds) over (partition by commit_sha) as bigint) commit_adds,
              cast(sum(deletes) over (partition by commit_sha) as bigint) commit_deletes
       from counts where {PARENTED}""", counts=COUNTS)
def patches_from_text(t):
    return diff.parse_unified_diff(t("sp_diffs")).drop(
        "file_no", "added", "removed", "commit_added_lines", "commit_deleted_lines")


def _document_sql(op):
    return f"""select commit_sha, path, '{op}' op,
        unnest(string_split(text, chr(10))) as value,
        unnest(generate_series(1, length(text) - length(replace(text, chr(10), '')) + 1)) line_no
        from fx_files"""


@query("added_files_from_text", _document_sql("+"))
def added_files_from_text(t):
    return diff.diff_lines(diff.parse_unified_diff(t("sp_file_diffs_added")))


@query("deleted_files_from_text", _document_sql("-"))
def deleted_files_from_text(t):
    return diff.diff_lines(diff.parse_unified_diff(t("sp_file_diffs_deleted")))


@query("diff_rejects", """select commit_sha, case when n_parents = 0 then 'no_parent'
              else 'empty_diff' end reason, 'User behavior' stage from fx_commits
       where n_parents = 0 or commit_sha not in (select commit_sha from fx_diff_lines)""")
def diff_rejects(t):
    return diff.diff_rejects(t("sp_diffs"), "User behavior")


@query("changed_files", f"select distinct commit_sha, path from fx_diff_lines where {PARENTED}")
def changed_files(t):
    return diff.changed_files(diff.parse_unified_diff(t("sp_diffs")))


@query("affected_lines", f"""
       select commit_sha, path,
              coalesce(string_agg(case when op = '+' then line_no end, ',' order by line_no), '')
              added, coalesce(string_agg(case when op = '-' then line_no end, ','
              order by line_no), '') deleted
       from (select commit_sha, path, op, line_no from fx_diff_lines
             where regexp_matches(value, '\\S') and op <> ' '
             union all select distinct commit_sha, path, ' ', 0 from fx_diff_lines)
       where {PARENTED} group by all""")
def affected_lines(t):
    lines = diff.affected_lines(diff.parse_unified_diff(t("sp_diffs")))
    return lines.select("commit_sha", "path",
                        F.array_join("added_line_number", ",").alias("added"),
                        F.array_join("deleted_line_number", ",").alias("deleted"))


@query("file_changes", f"""
       select commit_sha, 'a/' || path old_file_name, 'b/' || path new_file_name,
              adds number_added_lines, deletes number_deleted_lines,
              adds + deletes number_changed_lines
       from counts where {PARENTED}""", counts=COUNTS)
def file_changes(t):
    return diff.file_changes(diff.parse_unified_diff(t("sp_diffs"))).drop("added_lines",
                                                                          "deleted_lines")




@query("countable_patches", """select md5(cast(p_partkey as varchar)) commit_sha, p_name path
       from part where p_size not in (select s_nationkey from supplier)""")
def countable_patches(t):
    """Parts whose size equals some supplier's nation are shown as renames."""
    diffs = t.sql(r"""
        select md5(cast(p_partkey as string)) commit_sha, 1 n_parents,
               concat('diff --git a/', p_name, ' b/', p_name, '\n',
                      case when s_nationkey is not null
                           then 'similarity index 90%\nrename from x\nrename to y\n'
                           else '' end,
                      '--- a/', p_name, '\t\n+++ b/', p_name, '\t\n@@ -1 +1 @@\n-',
                      p_brand, '\n+', p_type, '\n') diff_text
        from part left join (select distinct s_nationkey from supplier) s
        on p_size = s_nationkey""")
    return diff.changed_files(diff.parse_unified_diff(diffs))


@query("touched_files_from_text", f"""
       select distinct path from fx_diff_lines
       where commit_sha in (select commit_sha from fix_ids) and {PARENTED}""", **ALL_IDS)
def touched_files_from_text(t):
    return text_history(t).touched_files("fix")


for _cohort, _where in COHORTS.items():
    def _register(cohort, where):
        @query(f"text_count_changes_{cohort}", f"{CHANGES}{where} and {PARENTED}", **WITH_COUNTS)
        def count_changes(t):
            return text_history(t).count_changes(cohort)

        @query(f"text_user_behavior_{cohort}", f"{BEHAVIOR}{where} and {PARENTED}",
               **WITH_COUNTS)
        def user_behavior(t):
            return text_history(t).user_behavior(cohort)

        @query(f"text_deleted_lines_behavior_{cohort}",
               PER_FILE_NAMED.format(where=f"{where} and {PARENTED}"), **WITH_BLAME)
        def deleted_lines_behavior(t):
            return text_history(t).deleted_lines_behavior(cohort)

        @query(f"text_time_deleted_lines_{cohort}",
               PER_COMMIT.format(where=f"{where} and {PARENTED}"), **WITH_BLAME)
        def time_deleted_lines(t):
            return text_history(t).time_deleted_lines(cohort)

    _register(_cohort, _where)
