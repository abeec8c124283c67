"""Readers and writers: each query writes to the shared folder and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.change_queries import COUNTS, lines_history
from checks.cohort_queries import HEADER
from checks.frequency_queries import ALLOWED, GROUP, LONG, METRICS, NAMED, _rounded
from checks.registry import query
from logstrata.operators import changes, frequency
from logstrata.schemas import ISSUE_ID_LISTS
from logstrata.session import scratch_path
from logstrata.sources import readers, writers

_ISSUE_SQL = """
    select cast(issue_number as varchar) issue_number, {labels} labels,
           coalesce(string_agg(case when link_kind = 'closed' then commit_sha end, ','
                               order by commit_sha), '') closed,
           coalesce(string_agg(case when link_kind = 'commit' then commit_sha end, ','
                               order by commit_sha), '') named,
           coalesce(string_agg(case when link_kind = 'similar' then commit_sha end, ','
                               order by commit_sha), '') similar_ids
    from fx_issues left join fx_issue_links using (issue_number)
    group by issue_number, issue_labels"""


def _issue_records(t):
    return t("sp_issues").select(
        F.col("issue_number").cast("string").alias("number"),
        F.col("issue_number").cast("string").alias("issue_number"),
        F.lit("sample").alias("repository_name"), F.lit("a, \"title\"").alias("issue_title"),
        "issue_labels", *ISSUE_ID_LISTS)


def _shown(issues, labels):
    ids = [F.array_join(F.sort_array(name), ",").alias(alias)
           for name, alias in zip(ISSUE_ID_LISTS, ["closed", "named", "similar_ids"])]
    return issues.select("issue_number", labels.alias("labels"), *ids)


@query("issue_scan_json", _ISSUE_SQL.format(labels="array_to_string(issue_labels, '|')"))
def issue_scan_json(t):
    path = scratch_path(t.spark, "issues-json")
    records = _issue_records(t)
    lines = records.select(F.to_json(F.struct(*records.columns)).alias("header line"))
    (lines.write.option("header", True).option("sep", "\x01").option("quote", "\x00")
     .option("escapeQuotes", False).csv(path))
    return _shown(readers.read_issues(t.spark, path, "json"), F.array_join("issue_labels", "|"))


@query("issue_scan_csv",
       _ISSUE_SQL.format(labels="coalesce(array_to_string(issue_labels, '|'), '')"))
def issue_scan_csv(t):
    path = scratch_path(t.spark, "issues-csv")
    records = _issue_records(t)
    lists = ["issue_labels", *ISSUE_ID_LISTS]
    flat = records.select(*[F.coalesce(F.array_join(c, "|" if c == "issue_labels" else ","),
                                       F.lit("")).alias(c) if c in lists else c
                            for c in records.columns])
    writers.write_facts(flat, path, "csv")
    return _shown(readers.read_issues(t.spark, path, "csv"), F.col("issue_labels"))


@query("facts_csv_round_trip", f"""select commit_sha, cast(deleted_lines as varchar) deleted_lines,
       cast(added_lines as varchar) added_lines, path file_paths,
       author_email, authored_date, authored_time_zone_offset, author
       from counts join (select commit_sha, {HEADER} from fx_commits) c using (commit_sha)""",
       counts=COUNTS)
def facts_csv_round_trip(t):
    path = scratch_path(t.spark, "facts-csv")
    writers.write_facts(lines_history(t).user_behavior("all"), path, "csv")
    return readers.read_facts(t.spark, path)


@query("facts_parquet_round_trip", """select commit_sha "commit_SHA", path, adds, deletes,
       adds + deletes changes from counts""", counts=COUNTS)
def facts_parquet_round_trip(t):
    path = scratch_path(t.spark, "facts-parquet")
    writers.write_facts(lines_history(t).count_changes("all"), path, "parquet")
    return readers.read_facts(t.spark, path, "parquet")


@query("commit_messages_json", "select commit_sha commit_hash, message commit_message from fx_commits")
def commit_messages_json(t):
    path = scratch_path(t.spark, "messages")
    writers.export_commit_messages(t("fx_commits"), path)
    return t.spark.read.schema("commit_hash string, commit_message string").json(path)


@query("token_line_csv_round_trip", """select path, cast(line_no as varchar) line_no, line
       from (select path, unnest(string_split(text, chr(10))) line,
                    unnest(generate_series(1, length(text)
                                              - length(replace(text, chr(10), '')) + 1)) line_no
             from fx_files)""")
def token_line_csv_round_trip(t):
    """Lines of text with quotes and commas, and empty ones, survive the CSV writer and reader."""
    path = scratch_path(t.spark, "lines-csv")
    lines = t("fx_files").select("path", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    lines = lines.select("path", (F.col("i") + 1).alias("line_no"), "line")
    writers.write_facts(lines, path, "csv")
    return readers.read_facts(t.spark, path)


@query("per_group_folders", """select token_content "value", cast(count(*) as varchar) n,
       token_type from fx_tokens group by all""")
def per_group_folders(t):
    path = scratch_path(t.spark, "groups")
    counted = t("fx_tokens").groupBy("token_type", F.col("token_content").alias("value")).agg(
        F.count("*").alias("n"))
    writers.write_per_group(counted, "token_type", path)
    return readers.read_facts(t.spark, path).select("value", "n", "token_type")


@query("variant_folders", """select "value", variant, round(metric, 6) metric from (
       select "value", 'binary_count' variant, count(*)::double metric
       from terms where column_name = 'token_type' group by all
       union all select "value", 'binary_count_normalized', sum(1.0::double / n_values)
       from terms where column_name = 'token_type' group by all
       union all select "value", 'aggregate_count_normalized', sum(n / total)
       from terms where column_name = 'token_type' group by all)""", **NAMED)
def variant_folders(t):
    path = scratch_path(t.spark, "variants")
    wide = frequency.normalized_frequency(t("fx_tokens"), ["token_type"], GROUP)
    writers.write_variants(frequency.long_variants(wide), path)
    return readers.read_facts(t.spark, path).select(
        "value", "variant", F.round(F.col("metric").cast("double"), 6).alias("metric"))


_PLAIN = [v for v in ALLOWED["token_content"] if v not in (".", ",")]


@query("matrix_folders", " union all ".join(
    f"select '{variant}' variant, hex_hash::varchar hex_hash, " + ", ".join(
        f"cast({cell.format(v)} as varchar) \"{v}\"" for v in _PLAIN) +
    " from fx_tokens group by hex_hash" for variant, cell in (
        ("count", "count(*) filter (where token_content = '{}')"),
        ("binary_count", "max(case when token_content = '{}' then 1 else 0 end)"))))
def matrix_folders(t):
    path = scratch_path(t.spark, "matrix")
    variants = ["count", "binary_count"]
    folders = writers.write_matrices(t("fx_tokens"), ["token_content"], GROUP, path,
                                     {"token_content": _PLAIN}, variants)
    one, two = (readers.read_facts(t.spark, folder).withColumn("variant", F.lit(variant))
                for folder, variant in zip(folders, variants))
    return one.unionByName(two)


_REPO = "'r' || cast(commit_seq % 7 as {text})"


def _layout(t, table, lines):
    """JSON records in a folder for each repository, and further lines among them."""
    path = scratch_path(t.spark, "layout")
    table.write.partitionBy("repo").json(path)
    lines.write.mode("append").partitionBy("repo").text(path)
    return path


def _commit_scan(t):
    commits = t.sql(f"""select {_REPO.format(text='string')} repo, commit_sha,
        array(md5(commit_sha)) parent_shas, author_name, author_email, authored_epoch,
        author_tz_offset, message, commit_seq from fx_commits""")
    fields = [F.col(c) for c in commits.columns if c != "repo"]
    whole = F.to_json(F.struct(*fields))
    keyless = F.to_json(F.struct(*[f for f in fields if "commit_sha" not in str(f)]))
    other = F.to_json(F.struct("commit_sha", F.lit("soon").alias("authored_epoch")))
    kind = F.col("commit_seq") % 20
    bad = commits.where(kind < 3).select("repo", F.when(kind == 0, F.substr(whole, F.lit(1), F.lit(30)))
                                         .when(kind == 1, keyless).otherwise(other).alias("value"))
    return readers.read_commits(t.spark, _layout(t, commits, bad))


@query("commits_scan", f"""select {_REPO.format(text='varchar')} repo, commit_sha,
       md5(commit_sha) parent_sha, author_name, author_email, authored_epoch, author_tz_offset,
       message, commit_seq from fx_commits""")
def commits_scan(t):
    rows = _commit_scan(t).rows
    return rows.withColumn("parent_sha", F.get("parent_shas", F.lit(0))).drop("parent_shas")


@query("commits_scan_rejects", f"""select {_REPO.format(text='varchar')} repo,
       case when commit_seq % 20 = 1 then 'missing_key' else 'malformed_record' end reason,
       count(*) n from fx_commits where commit_seq % 20 < 3 group by all""")
def commits_scan_rejects(t):
    return _commit_scan(t).rejects.groupBy("repo", "reason").agg(F.count("*").alias("n"))


def _cut(table, name):
    """A line for every hundredth record that ends before it should."""
    fields = [c for c in table.columns if c != "repo"]
    return table.where(F.pmod(F.crc32(F.encode(name, "UTF-8")), F.lit(100)) == 0).select(
        "repo", F.substr(F.to_json(F.struct(*fields)), F.lit(1), F.lit(25)).alias("value"))


@query("diffs_scan", """select 'r' || cast(commit_seq % 7 as varchar) repo, commit_sha, n_parents,
       n_lines from fx_commits join (
           select commit_sha, count(*) n_lines from fx_diff_lines group by 1) using (commit_sha)""")
def diffs_scan(t):
    """Diffs read back from their folders among broken lines; each hunk has one line here."""
    diffs = t.sql(f"""select {_REPO.format(text='string')} repo, d.* from sp_diffs d
        join (select commit_sha, commit_seq from fx_commits) c using (commit_sha)""")
    scan = readers.read_diffs(t.spark, _layout(t, diffs, _cut(diffs, "commit_sha")))
    n_lines = F.regexp_count("diff_text", F.lit("(?m)^@@ ")).cast("long")
    return scan.rows.select("repo", "commit_sha", "n_parents", n_lines.alias("n_lines")).where("n_lines > 0")


@query("blobs_scan", f"select {_REPO.format(text='varchar')} repo, commit_sha sha, path, text from fx_files")
def blobs_scan(t):
    blobs = t.sql(f"select {_REPO.format(text='string')} repo, commit_sha sha, path, text from fx_files")
    return readers.read_blobs(t.spark, _layout(t, blobs, _cut(blobs, "path"))).rows


@query("blame_scan", """select 'r' || substr(commit_sha, 1, 1) repo, commit_sha, path, line_no,
       blame_commit_sha, content from fx_blame_lines""")
def blame_scan(t):
    blame = t("fx_blame_lines").select(F.concat(F.lit("r"), F.substring("commit_sha", 1, 1)).alias("repo"), "*")
    return readers.read_blame(t.spark, _layout(t, blame, _cut(blame, "content"))).rows
