"""Issue filters, id sets, cohorts, commit headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import Tables
from logstrata.functions.text import hour_of_day_utc
from logstrata.operators import changes, cohorts, filters
from logstrata.plans.history import History

LABEL = "bug"

ISSUE_IDS = """
    select issue_number, commit_sha from fx_issue_links
    where link_kind <> 'similar' or issue_number not in (
        select issue_number from fx_issue_links where link_kind = 'similar'
        group by issue_number having count(*) > 10)"""
FIX_IDS = """
    select commit_sha from issue_ids join fx_issues using (issue_number)
    where issue_labels is not null and {{HAS}}(issue_labels, 'bug')
    union select commit_sha from fx_commits where contains(lower(message), ' fix')"""
OTHER_IDS = """
    select commit_sha from issue_ids join fx_issues using (issue_number)
    where issue_labels is null or not {{HAS}}(issue_labels, 'bug')
    except select commit_sha from fix_ids"""
IDS = {"issue_ids": ISSUE_IDS, "fix_ids": FIX_IDS}
ALL_IDS = {**IDS, "other_ids": OTHER_IDS}

FIX_WHERE = "commit_sha in (select commit_sha from fix_ids)"
NON_FIX_WHERE = "commit_sha not in (select commit_sha from fix_ids)"

ASCTIME = """strftime(make_timestamp((authored_epoch - author_tz_offset) * 1000000), '%a %b ')
    || lpad(cast(day(make_timestamp((authored_epoch - author_tz_offset) * 1000000))
                 as varchar), 2, ' ')
    || strftime(make_timestamp((authored_epoch - author_tz_offset) * 1000000), ' %H:%M:%S %Y')"""
HEADER = f"""author_name author, coalesce(author_email, '') author_email,
    {ASCTIME} authored_date,
    case when author_tz_offset > 0 then '-' else '+' end
    || cast(abs(author_tz_offset) // 3600 as varchar) || ':'
    || cast(abs(author_tz_offset) // 60 % 60 as varchar) authored_time_zone_offset"""


def history(t: Tables, **options) -> History:
    return History(t("fx_commits"), t("sp_issues"), LABEL, **options)


def _flat(issues):
    return issues.select("issue_number", F.array_join("issue_labels", "|").alias("labels"))


FLAT = "select issue_number, array_to_string(issue_labels, '|') labels from fx_issues"
LABELLED = "list_contains(issue_labels, 'bug')"


@query("issues_with_label", f"{FLAT} where issue_labels is not null and {LABELLED}")
def issues_with_label(t):
    return _flat(filters.filter_issues(t("fx_issues"), "issue_labels", LABEL))


@query("issues_without_label", f"{FLAT} where issue_labels is not null and not {LABELLED}")
def issues_without_label(t):
    return _flat(filters.filter_issues(t("fx_issues"), "issue_labels", LABEL, keep=False))


@query("issues_with_label_or_unlabelled", f"{FLAT} where issue_labels is null or {LABELLED}")
def issues_with_label_or_unlabelled(t):
    return _flat(filters.filter_issues(t("fx_issues"), "issue_labels", LABEL,
                                       drop_missing=False))


@query("issues_without_label_or_unlabelled",
       f"{FLAT} where issue_labels is null or not {LABELLED}")
def issues_without_label_or_unlabelled(t):
    return _flat(filters.filter_issues(t("fx_issues"), "issue_labels", LABEL, keep=False,
                                       drop_missing=False))


@query("issues_label_text", "select p_partkey, p_type from part where contains(p_type, 'ECO')")
def issues_label_text(t):
    return filters.filter_issues(t("part").select("p_partkey", "p_type"), "p_type", "ECO")


@query("commits_by_keyword", """select commit_sha, message from fx_commits
                                where contains(lower(message), ' fix')""")
def commits_by_keyword(t):
    return cohorts.search_commits(t("fx_commits"), "fix").select("commit_sha", "message")


@query("issue_commit_ids", "select distinct commit_sha from issue_ids", issue_ids=ISSUE_IDS)
def issue_commit_ids(t):
    return cohorts.issue_commit_ids(t("sp_issues"))


@query("similar_lists_left_out", """select issue_number, count(*) list_size,
       'similar_list_over_limit' reason, 'Cohort' stage from fx_issue_links
       where link_kind = 'similar' group by issue_number having count(*) > 10""")
def similar_lists_left_out(t):
    return cohorts.similar_lists_left_out(t("sp_issues"))


@query("fix_commit_ids", "select commit_sha from fix_ids", **IDS)
def fix_commit_ids(t):
    return cohorts.fix_commit_ids(t("sp_issues"), t("fx_commits"), LABEL)


@query("non_fix_commit_ids", "select commit_sha from other_ids", **ALL_IDS)
def non_fix_commit_ids(t):
    return cohorts.non_fix_commit_ids(t("sp_issues"), t("fx_commits"), LABEL)


@query("commits_by_issue_ids", """select commit_sha, commit_seq, message from fx_commits
       where commit_sha in (select commit_sha from issue_ids)""", issue_ids=ISSUE_IDS)
def commits_by_issue_ids(t):
    ids = cohorts.issue_commit_ids(t("sp_issues"))
    return cohorts.commits_by_ids(t("fx_commits"), ids).select("commit_sha", "commit_seq",
                                                               "message")


@query("unresolved_commit_ids", """select distinct commit_sha from issue_ids
       where commit_sha not in (select commit_sha from fx_commits)""", issue_ids=ISSUE_IDS)
def unresolved_commit_ids(t):
    return cohorts.unresolved_ids(cohorts.issue_commit_ids(t("sp_issues")), t("fx_commits"))


def _register_cohort(name, sql, cohort, mode="repository", **options):
    @query(name, f"select commit_sha, commit_seq, message from fx_commits where {sql}",
           **ALL_IDS)
    def build(t):
        commits = history(t, mode=mode, **options).cohort(cohort)
        return commits.select("commit_sha", "commit_seq", "message")


_register_cohort("fix_commits", FIX_WHERE, "fix")
_register_cohort("non_fix_commits_repository", NON_FIX_WHERE, "non_fix")
_register_cohort("non_fix_commits_tracker", "commit_sha in (select commit_sha from other_ids)",
                 "non_fix", "tracker")


@query("fix_commits_without_keyword", """select commit_sha, commit_seq, message from fx_commits
       where commit_sha in (select commit_sha from issue_ids join fx_issues using (issue_number)
                            where issue_labels is not null
                              and list_contains(issue_labels, 'bug'))""", issue_ids=ISSUE_IDS)
def fix_commits_without_keyword(t):
    return history(t, keyword=None).cohort("fix").select("commit_sha", "commit_seq", "message")


@query("commit_count", "select count(*) n_commits from orders join customer on o_custkey = c_custkey")
def commit_count(t):
    return cohorts.count_commits(t("fx_commits"))


@query("commit_header", f"select commit_sha, {HEADER} from fx_commits")
def commit_header(t):
    return changes.commit_header(t("fx_commits"))


@query("commit_hour_utc", """select commit_sha, (authored_epoch % 86400) // 3600 as h
                             from fx_commits""")
def commit_hour_utc(t):
    header = changes.commit_header(t("fx_commits"))
    hour = hour_of_day_utc(F.col("authored_date"), F.col("authored_time_zone_offset"))
    return header.select("commit_sha", hour.alias("h"))


def _register_time(cohort, where):
    @query(f"time_commits_{cohort}", f"select commit_sha, {HEADER} from fx_commits{where}", **IDS)
    def build(t):
        return history(t).time_commits(cohort)


_register_time("all", "")
_register_time("fix", f" where {FIX_WHERE}")
_register_time("non_fix", f" where {NON_FIX_WHERE}")


@query("time_commits_numbered", f"""
       select row_number() over (order by commit_seq) line_number, commit_sha, {HEADER}
       from fx_commits""")
def time_commits_numbered(t):
    return history(t).time_commits("all", numbered=True)


def _register_messages(cohort, where):
    @query(f"commit_messages_{cohort}", f"""select commit_sha commit_hash, message commit_message
           from fx_commits{where}""", **IDS)
    def build(t):
        return history(t).commit_messages(cohort)


_register_messages("all", "")
_register_messages("fix", f" where {FIX_WHERE}")
_register_messages("non_fix", f" where {NON_FIX_WHERE}")
