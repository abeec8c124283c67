"""Many repositories in one plan: every nation is a repository."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.cohort_queries import HEADER
from checks.registry import query
from logstrata.plans import batch
from logstrata.session import scratch_path, stored
from logstrata.sources import readers

# A customer's commits belong to the customer's nation; a deleted line comes from the first
# commit of its author.
_REPO = """
    select n_name repo, c.commit_sha, c.commit_seq, c.author_name, c.author_email,
           c.authored_epoch, c.author_tz_offset, c.message,
           md5(cast(min(o_orderkey) over (partition by o_custkey) as {text})) first_sha
    from fx_commits c join orders on commit_seq = o_orderkey
    join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"""
_LABEL = "case when n_regionkey = 0 then 'ui' else 'bug' end"
_LINKS = """
    select r.repo, l.issue_number, l.link_kind, l.commit_sha
    from fx_issue_links l join repo_commits r on l.commit_sha = r.commit_sha"""
NAMED = {
    "repo_commits": _REPO.format(text="varchar"),
    "repo_links": _LINKS,
    "wide_lists": """select repo, issue_number from repo_links where link_kind = 'similar'
                     group by all having count(*) > 10""",
    "named_ids": """select l.repo, l.commit_sha, l.issue_number from repo_links l
                    left join wide_lists w
                    on l.repo = w.repo and l.issue_number = w.issue_number
                    where link_kind <> 'similar' or w.repo is null""",
    "flagged": f"""select i.repo, i.commit_sha,
                          coalesce(list_contains(issue_labels, {_LABEL}), false) bug,
                          issue_labels is not null labelled
                   from named_ids i join fx_issues using (issue_number)
                   join nation on repo = n_name""",
    "tagged": """select c.*, contains(lower(message), ' fix') or coalesce(f.bug, false) is_fix,
                        coalesce(f.other, false) other,
                        coalesce(f.other_labelled, false) other_labelled
                 from repo_commits c left join (
                     select repo, commit_sha, bool_or(bug) bug, bool_or(not bug) other,
                            bool_or(labelled and not bug) other_labelled
                     from flagged group by all) f
                 on c.repo = f.repo and c.commit_sha = f.commit_sha""",
    "lines": """select r.repo, r.first_sha, d.commit_sha, d.path, d.op, d.line_no, d.value
                from fx_diff_lines d join repo_commits r on d.commit_sha = r.commit_sha""",
}
_NAME = """'Java_' || upper(substr(repo, 1, 1)) || lower(substr(repo, 2)) || '_' || cohort
           output_name"""

CONFIG = """
    select n_name repo, concat(lower(n_name), '.json') issue_file_name,
           case when n_regionkey = 0 then 'ui' else 'bug' end bug_label from nation"""


def _config(t, tracker=True, unlabelled=True, base="issues", folder=""):
    """Write the configuration as JSON lines, shared settings first, and read it."""
    path = scratch_path(t.spark, "config")
    shared = t.sql(f"""select 0 place, to_json(named_struct(
        'language_label', 'java', 'repo_base_address', 'repos', 'issue_base_address', '{base}',
        'output_folder', 'out', 'retrieve_other_commit_id_from_issue_tracker', {tracker},
        'consider_issues_without_labels_as_other', {unlabelled}, 'log_flag', false)) value
        from (select count(*) from region)""")
    repos = t.sql(f"""select 1 place, to_json(named_struct('repo_name', repo,
        'issue_file_name', concat('{folder}', issue_file_name), 'bug_label', bug_label)) value from ({CONFIG})""")
    lines = shared.unionByName(repos).orderBy("place").select("value")
    lines.write.text(path)
    return readers.read_batch_config(t.spark, path)


@query("batch_config", CONFIG.replace("concat(lower(n_name), '.json')",
                                      "lower(n_name) || '.json'").strip()
       .replace("select n_name repo", """select 'java' language_label, 'repos' repo_base_address,
       'issues' issue_base_address, 'out' output_folder,
       true retrieve_other_commit_id_from_issue_tracker,
       true consider_issues_without_labels_as_other, false log_flag, n_name repo"""))
def batch_config(t):
    return _config(t)


def _issues(t, commits=None):
    """``commits`` names the view of the repositories' commits, where they are stored already."""
    text = f"select * from {commits}" if commits else _REPO.format(text="string")
    # Only ids in full meet a commit; they are gathered as numbers and written out afterwards.
    ids = {kind: f"""transform(collect_set(case link_kind when '{kind}' then commit_seq end),
                               n -> md5(cast(n as string)))""" for kind in
           ("closed", "commit", "similar")}
    return t.sql(f"""
        select repo, issue_number, issue_labels,
               {ids['closed']} issue_closed_commit_id, {ids['commit']} issue_commit_id,
               {ids['similar']} commit_id_similar_to_issue_title
        from (select r.repo, l.issue_number, l.link_kind, l.commit_seq
              from sp_full_links l join ({text}) r on l.commit_seq = r.commit_seq)
        join fx_issues using (issue_number)
        group by repo, issue_number, issue_labels""")


def _inputs(t, issues=_issues):
    """Commits, issues, lines and blame. The facts read them several times, so the views behind
    them are worked out once."""
    found = stored(t.sql(_REPO.format(text="string")), "commits")
    view = f"stored_commits_{uuid.uuid4().hex}"
    found.createOrReplaceTempView(view)
    commits = found.drop("first_sha")
    lines = stored(t.sql(f"""select r.repo, r.first_sha, r.commit_sha, d.path, d.op, d.line_no, d.value
                      from fx_diff_lines d join {view} r on d.commit_seq = r.commit_seq"""), "lines")
    # Part numbers beyond 100,000 give lines of one file the same number: blame has it once.
    blame = lines.filter("op = '-'").groupBy("repo", "commit_sha", "path", "line_no").agg(
        F.min("first_sha").alias("blame_commit_sha"), F.min("value").alias("content"))
    return commits, issues and issues(t, view), lines.drop("first_sha"), blame


def _run(t, issues=_issues, inputs=None, **settings):
    commits, issues, lines, blame = inputs or _inputs(t, issues)
    return batch.run_batch(_config(t, **settings), commits, issues, blame, lines=lines)


_DELETED = (f"""
       select l.repo, o.author, o.author_email, o.authored_date, o.authored_time_zone_offset,
              count(*) number_of_related_deleted_lines, t.total_deleted_lines,
              t.total_added_lines, l.commit_sha fix_commit_sha, l.first_sha blame_commit_sha,
              l.path file_paths, 'java' "language", 'Fix' cohort, {_NAME.replace('cohort', "'Fix'")}
       from lines l join tagged g on l.repo = g.repo and l.commit_sha = g.commit_sha
       join (select repo, commit_sha, {HEADER} from repo_commits) o
       on l.repo = o.repo and l.first_sha = o.commit_sha
       join (select repo, commit_sha, count(*) filter (where op = '-') total_deleted_lines,
                    count(*) filter (where op = '+') total_added_lines
             from lines group by all) t
       on l.repo = t.repo and l.commit_sha = t.commit_sha
       where l.op = '-' and g.is_fix group by all""".replace("select l.repo,", "select l.repo repo,")
       .replace("upper(substr(repo", "upper(substr(l.repo")
       .replace("lower(substr(repo", "lower(substr(l.repo"))


@query("batch_deleted_lines", _DELETED, **NAMED)
def batch_deleted_lines(t):
    return _run(t)[0]


_BEHAVIOR = f"""
       select repo, commit_sha, {HEADER}, deleted_lines, added_lines, path file_paths,
              'java' "language", cohort, {_NAME}
       from (select l.repo, l.commit_sha, l.path,
                    count(*) filter (where op = '+' and regexp_matches(value, '\\S')) added_lines,
                    count(*) filter (where op = '-' and regexp_matches(value, '\\S')) deleted_lines
             from lines l group by all)
       join (select *, 'AllCommits' cohort from tagged
             union all select *, 'NonFix' from tagged where other and not is_fix)
       using (repo, commit_sha)"""


@query("batch_user_behavior", _BEHAVIOR, **NAMED)
def batch_user_behavior(t):
    return _run(t)[1]


@query("batch_user_behavior_repository",
       _BEHAVIOR.replace("other and not is_fix", "not is_fix"), **NAMED)
def batch_user_behavior_repository(t):
    """The configuration asks for all commits that are no fix."""
    return _run(t, tracker=False)[1]


@query("batch_user_behavior_labelled",
       _BEHAVIOR.replace("other and not is_fix", "other_labelled and not is_fix"), **NAMED)
def batch_user_behavior_labelled(t):
    """The configuration does not take issues without labels for others."""
    return _run(t, unlabelled=False)[1]


@query("batch_written", """select repo, cohort, count(*) n from (
       select l.repo, l.commit_sha, l.path from lines l group by all)
       join (select repo, commit_sha, 'AllCommits' cohort from tagged
             union all select repo, commit_sha, 'NonFix' from tagged where other and not is_fix)
       using (repo, commit_sha) group by all""", **NAMED)
def batch_written(t):
    path = scratch_path(t.spark, "batch")
    fix, behavior = _run(t)
    batch.write_batch(fix, behavior, path)
    rows = readers.read_facts(t.spark, f"{path}/user_behavior")
    return rows.groupBy("repo", "cohort").agg(F.count("*").alias("n"))


def _issue_files(t, issues, extra=None):
    """One export for each repository, a header line first; ``extra`` are further lines."""
    path = scratch_path(t.spark, "issue-files")
    fields = [c for c in issues.columns if c != "repo"]
    named = F.concat(F.lower("repo"), F.lit(".json")).alias("file")
    lines = issues.withColumn("issue_number", F.col("issue_number").cast("string")).select(
        named, F.to_json(F.struct(*fields)).alias("header line"))
    if extra is not None:
        lines = lines.unionByName(extra.select(named, F.col("value").alias("header line")))
    (lines.write.option("header", True).option("sep", "\x01").option("quote", "\x00")
     .option("escapeQuotes", False).partitionBy("file").csv(path))
    return path


@query("batch_deleted_lines_from_files", _DELETED, **NAMED)
def batch_deleted_lines_from_files(t):
    """The batch starts from the configuration, which names the issue files."""
    return _run(t, issues=None, base=_issue_files(t, _issues(t)), folder="file=")[0]


@query("issue_files_rejects", """
       select n_name repo, 'issue_file_missing' reason, 1 n from nation where n_regionkey = 4
       union all select r.repo, 'malformed_record', count(distinct r.issue_number)
       from repo_links r join fx_issues using (issue_number)
       join nation on r.repo = n_name where issue_number % 50 = 0 and n_regionkey <> 4 group by 1""",
       **NAMED)
def issue_files_rejects(t):
    """Exports with lines that were cut; those of one region are absent."""
    here = t.sql("select n_name repo from nation where n_regionkey <> 4")
    issues = _issues(t).join(here, "repo")
    fields = [c for c in issues.columns if c != "repo"]
    cut = issues.where("issue_number % 50 = 0").select(
        "repo", F.substr(F.to_json(F.struct(*fields)), F.lit(1), F.lit(20)).alias("value"))
    base = _issue_files(t, issues, cut)
    rejects = readers.read_issue_files(t.spark, _config(t, base=base, folder="file=")).rejects
    return rejects.groupBy("repo", "reason").agg(F.count("*").alias("n"))


@query("batch_rerun", _BEHAVIOR.replace("other and not is_fix", """
       (case when repo like 'I%' then other_labelled else other end) and not is_fix"""), **NAMED)
def batch_rerun(t):
    """Some repositories are run again by another rule; the folders of the others stay."""
    path = scratch_path(t.spark, "batch")
    commits, issues, lines, blame = _inputs(t)
    inputs = commits, stored(issues, "issues"), lines, blame
    fix, behavior = _run(t, inputs=inputs)
    batch.write_batch(fix, behavior, path, "parquet")
    again = [facts.where("repo like 'I%'") for facts in _run(t, inputs=inputs, unlabelled=False)]
    batch.write_batch(*again, path, "parquet")
    return readers.read_facts(t.spark, f"{path}/user_behavior", "parquet")
