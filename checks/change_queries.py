"""Facts from tables of diff lines and blame lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.cohort_queries import ALL_IDS, FIX_WHERE, HEADER, IDS, NON_FIX_WHERE, history
from checks.registry import query
from logstrata.operators import blame, changes, cohorts, diff

COUNTS = """
    select commit_sha, path, count(*) filter (where op = '+') adds,
           count(*) filter (where op = '-') deletes,
           count(*) filter (where op = '+' and regexp_matches(value, '\\S')) added_lines,
           count(*) filter (where op = '-' and regexp_matches(value, '\\S')) deleted_lines
    from fx_diff_lines group by commit_sha, path"""
WITH_COUNTS = {**ALL_IDS, "counts": COUNTS}
COHORTS = {"all": "true", "fix": FIX_WHERE, "non_fix": NON_FIX_WHERE}
TRACKER = "commit_sha in (select commit_sha from other_ids)"

JOINED = """
    select d.commit_sha, d.path, d.line_no, b.blame_commit_sha, b.content
    from fx_diff_lines d left join fx_blame_lines b
    on d.commit_sha = b.commit_sha and d.path = b.path and d.line_no = b.line_no
    where d.op = '-'"""
BLAMED = """
    select * from joined where commit_sha not in (
        select commit_sha from joined where blame_commit_sha is null)"""
TOTALS = """
    select commit_sha, count(*) filter (where op = '-') total_deleted_lines,
           count(*) filter (where op = '+') total_added_lines
    from fx_diff_lines group by commit_sha"""
ORIGINS = f"select commit_sha blame_commit_sha, {HEADER} from fx_commits"
WITH_BLAME = {**ALL_IDS, "joined": JOINED, "blamed": BLAMED, "totals": TOTALS,
              "origins": ORIGINS}


def lines_of(t):
    return t("fx_diff_lines").select("commit_sha", "path", "op", "line_no", "value")


def lines_history(t, **options):
    return history(t, lines=lines_of(t), blame_lines=t("fx_blame_lines"), **options)


@query("added_lines_not_blank", """select commit_sha, path, line_no, value from fx_diff_lines
       where op = '+' and regexp_matches(value, '\\S')""")
def added_lines_not_blank(t):
    return diff.analysed_lines(lines_of(t), "added")


@query("deleted_lines_not_blank", """select commit_sha, path, line_no, value from fx_diff_lines
       where op = '-' and regexp_matches(value, '\\S')""")
def deleted_lines_not_blank(t):
    return diff.analysed_lines(lines_of(t), "deleted")


@query("line_counts_per_file", "select * from counts", **WITH_COUNTS)
def line_counts_per_file(t):
    return changes.line_counts(lines_of(t))


@query("commit_line_totals", "select * from totals", totals=TOTALS)
def commit_line_totals(t):
    return changes.commit_totals(changes.line_counts(lines_of(t)))


CHANGES = """select commit_sha "commit_SHA", path, adds, deletes, adds + deletes changes
             from counts where """
BEHAVIOR = f"""select c.*, deleted_lines, added_lines, path file_paths
    from counts join (select commit_sha, {HEADER} from fx_commits) c using (commit_sha) where """
PER_FILE_NAMED = """select author, author_email, authored_date, authored_time_zone_offset,
        count(*) number_of_related_deleted_lines, total_deleted_lines, total_added_lines,
        commit_sha fix_commit_sha, blame_commit_sha, path file_paths
    from blamed join totals using (commit_sha) join origins using (blame_commit_sha)
    where {where} group by all"""
PER_COMMIT = """select commit_sha fix_commit_sha, blame_commit_sha, author, author_email,
        authored_date, authored_time_zone_offset, count(*) number_of_related_deleted_lines,
        total_deleted_lines, total_added_lines
    from blamed join totals using (commit_sha) join origins using (blame_commit_sha)
    where {where} group by all"""


def _register(cohort, where, suffix=None, **options):
    suffix = suffix or cohort

    @query(f"count_changes_{suffix}", CHANGES + where, **WITH_COUNTS)
    def count_changes(t):
        return lines_history(t, **options).count_changes(cohort)

    @query(f"user_behavior_{suffix}", BEHAVIOR + where, **WITH_COUNTS)
    def user_behavior(t):
        return lines_history(t, **options).user_behavior(cohort)

    @query(f"deleted_lines_behavior_{suffix}", PER_FILE_NAMED.format(where=where), **WITH_BLAME)
    def deleted_lines_behavior(t):
        return lines_history(t, **options).deleted_lines_behavior(cohort)

    @query(f"time_deleted_lines_{suffix}", PER_COMMIT.format(where=where), **WITH_BLAME)
    def time_deleted_lines(t):
        return lines_history(t, **options).time_deleted_lines(cohort)


for _cohort, _where in COHORTS.items():
    _register(_cohort, _where)
_register("non_fix", TRACKER, "non_fix_tracker", mode="tracker")


@query("count_changes_on_fixed_files", CHANGES + NON_FIX_WHERE + """
       and path in (select path from fx_diff_lines where commit_sha in
                    (select commit_sha from fix_ids))""", **WITH_COUNTS)
def count_changes_on_fixed_files(t):
    return lines_history(t).count_changes_limited_files()


@query("count_changes_in_given_files", CHANGES + """path in
       (select 'src/f' || cast(n_nationkey as varchar) || '.java' from nation)""", **WITH_COUNTS)
def count_changes_in_given_files(t):
    files = t.sql("select 'src/f' || cast(n_nationkey as string) || '.java' path from nation")
    return lines_history(t).count_changes("all", files)


@query("touched_files_fix", """select distinct path from fx_diff_lines
       where commit_sha in (select commit_sha from fix_ids)""", **IDS)
def touched_files_fix(t):
    return lines_history(t).touched_files("fix")


@query("numbered_changes_non_fix", f"""
       select row_number() over (order by commit_number, path) line_number, commit_number,
              commit_sha "commit_SHA", path, adds, deletes, adds + deletes changes
       from counts join (select commit_sha, row_number() over (order by commit_seq)
                                commit_number
                         from fx_commits where {NON_FIX_WHERE}) using (commit_sha)""",
       **WITH_COUNTS)
def numbered_changes_non_fix(t):
    h = lines_history(t)
    return changes.numbered_changes(h.counts(), h.cohort("non_fix"))


@query("numbered_changes_in_given_files", f"""
       select * from (
           select row_number() over (order by commit_number, path) line_number, commit_number,
                  commit_sha "commit_SHA", path, adds, deletes, adds + deletes changes
           from counts join (select commit_sha, row_number() over (order by commit_seq)
                                    commit_number
                             from fx_commits where {NON_FIX_WHERE}) using (commit_sha))
       where path in (select 'src/f' || cast(n_nationkey as varchar) || '.java' from nation)""",
       **WITH_COUNTS)
def numbered_changes_in_given_files(t):
    """The numbers also count the files that are left out."""
    files = t.sql("select 'src/f' || cast(n_nationkey as string) || '.java' path from nation")
    h = lines_history(t)
    return changes.numbered_changes(h.counts(), h.cohort("non_fix"), files)


@query("changes_on_not_fixed_files", f"""
       select distinct 'p' || cast(l_partkey as varchar) || '.java  ' path, commit_sha
       from (select l_partkey, md5(cast(l_orderkey as varchar)) commit_sha from lineitem)
       where l_partkey not in (
           select l_partkey from lineitem where l_returnflag = 'R' and l_suppkey in
               (select s_suppkey from supplier where s_acctbal > 9000))""")
def changes_on_not_fixed_files(t):
    every = t.sql("""select distinct 'p' || cast(l_partkey as string) || '.java  ' path,
                            md5(cast(l_orderkey as string)) commit_sha from lineitem""")
    fixed = t.sql("""select '  p' || cast(l_partkey as string) || '.java' path from lineitem
                     join supplier on l_suppkey = s_suppkey
                     where l_returnflag = 'R' and s_acctbal > 9000""")
    return changes.changes_on_not_fixed_files(every, fixed)


@query("time_deleted_lines_numbered", f"""
       select row_number() over (order by commit_seq, blame_commit_sha) line_number, f.*
       from ({PER_COMMIT.format(where='true')}) f
       join (select commit_sha, commit_seq from fx_commits) c on fix_commit_sha = c.commit_sha""",
       **WITH_BLAME)
def time_deleted_lines_numbered(t):
    return lines_history(t).time_deleted_lines("all", numbered=True)


@query("blamed_lines", "select * from joined", joined=JOINED)
def blamed_lines(t):
    return (blame.blamed_lines(lines_of(t), t("fx_blame_lines"))
            .select("commit_sha", "path", "line_no", "blame_commit_sha", "content"))


@query("blame_rejects", """select distinct commit_sha, 'blame_line_missing' reason, 'Blame' stage
       from joined where blame_commit_sha is null""", joined=JOINED)
def blame_rejects(t):
    return blame.blame_rejects(lines_of(t), t("fx_blame_lines"))


@query("last_deleted_line", """select commit_sha, path, max(line_no) max_deleted_line
       from fx_diff_lines where op = '-' group by all""")
def last_deleted_line(t):
    return blame.max_deleted_line(lines_of(t))


@query("blame_details", """
       select commit_sha, blame_commit_sha, count(*) n_paths,
              string_agg(path, ',' order by path) paths,
              string_agg(cells, ';' order by path) lines
       from (select commit_sha, blame_commit_sha, path,
                    string_agg(cast(line_no as varchar) || '=' || content, ','
                               order by line_no) cells
             from blamed group by all) group by all""",
       joined=JOINED, blamed=BLAMED)
def blame_details(t):
    nested = blame.blame_details(lines_of(t), t("fx_blame_lines"))
    by_path = F.col("file_path__line_number_content")
    paths = F.map_keys(by_path)
    cells = F.transform(F.map_values(by_path), lambda lines: F.array_join(F.transform(
        lines, lambda l: F.concat(l["line_no"].cast("string"), F.lit("="), l["content"])), ","))
    return nested.select("commit_sha", "blame_commit_sha",
                         F.size(paths).cast("long").alias("n_paths"),
                         F.array_join(paths, ",").alias("paths"),
                         F.array_join(cells, ";").alias("lines"))


@query("blame_pages", """
       select commit_sha, blame_commit_sha, path, line_no, content, true in_order from blamed""",
       joined=JOINED, blamed=BLAMED)
def blame_pages(t):
    """Pages of a few lines, taken apart again: every line once, pages in the order of the lines."""
    pages = blame.blame_pages(lines_of(t), t("fx_blame_lines"), page_bytes=40)
    rows = pages.select("commit_sha", "blame_commit_sha", "page_no",
                        F.explode("file_path__line_number_content").alias("path", "lines"))
    rows = rows.select("commit_sha", "blame_commit_sha", "page_no", "path", F.explode("lines").alias("l"))
    rows = rows.select("commit_sha", "blame_commit_sha", "path", "l.line_no", "l.content", "page_no")
    last = F.lag("page_no").over(Window.partitionBy("commit_sha", "blame_commit_sha")
                                 .orderBy("path", "line_no"))
    step = F.col("page_no") - F.coalesce(last, F.lit(0))
    return rows.select("*", step.isin(0, 1).alias("in_order")).drop("page_no")


@query("history_rejects", """
       select commit_sha, null::varchar issue_number, 'no_parent' reason, stage
       from fx_commits, (values ('User behavior'), ('Blame')) stages(stage)
       where n_parents = 0
       union all select commit_sha, null, 'empty_diff', stage
       from fx_commits, (values ('User behavior'), ('Blame')) stages(stage)
       where n_parents > 0 and commit_sha not in (select commit_sha from fx_diff_lines)
       union all select distinct d.commit_sha, null, 'blame_line_missing', 'Blame'
       from joined d join fx_commits using (commit_sha)
       where blame_commit_sha is null and n_parents > 0
       union all select distinct commit_sha, null, 'unresolved_commit', 'Cohort' from issue_ids
       where commit_sha not in (select commit_sha from fx_commits)
       union all select null, cast(issue_number as varchar), 'similar_list_over_limit', 'Cohort'
       from fx_issues join fx_issue_links using (issue_number) where link_kind = 'similar'
       group by issue_number having count(*) > 10""",
       issue_ids=ALL_IDS["issue_ids"], joined=JOINED)
def history_rejects(t):
    return history(t, diffs=t("sp_diffs"), blame_lines=t("fx_blame_lines")).rejects()


@query("stage_outcomes", """
       select commit_sha, stage, case when n_parents = 0 then 'no_parent'
              when n_lines is null then 'empty_diff' when stage = 'User behavior' then 'facts'
              when n_lost > 0 then 'blame_line_missing' when n_removed > 0 then 'facts'
              else 'nothing' end outcome
       from fx_commits left join (
           select commit_sha, count(*) n_lines from fx_diff_lines group by 1) using (commit_sha)
       left join (select commit_sha, count(*) n_removed,
                         count(*) filter (where blame_commit_sha is null) n_lost
                  from joined group by 1) using (commit_sha),
       (values ('User behavior'), ('Blame')) stages(stage)""", joined=JOINED)
def stage_outcomes(t):
    return history(t, diffs=t("sp_diffs"), blame_lines=t("fx_blame_lines")).outcomes()
