"""Version-control inputs derived from the given tables, for Spark and for DuckDB.

Each view is one SELECT over whole tables. The text is shared; the spots in double braces
differ between the engines. Views under SPARK_ONLY shape the same rows the way the readers
expect them (lists in issue records, diff text per commit).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Tables that grow with the scale factor in rows or text, and the columns they are dealt by. Rows
# that are grouped by (more than) these columns are moved once, by the deal.
FACTS = {"orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_partkey", "l_linenumber"],
         "events": ["event_id"], "documents": ["doc_id"]}
# Other deals of a table: name, table, columns.
DEALS = {"lineitem_of_orders": ("lineitem", ["l_orderkey"]),
         "lineitem_of_parts": ("lineitem", ["l_partkey"])}

DIALECTS = {
    "spark": {"EPOCH": "cast(unix_date(cast(o_orderdate as date)) as bigint) * 86400",
              "SPLIT": "split(l, '[|]')", "EMPTY": "cast(array() as array<string>)",
              "HAS": "array_contains", "TEXT": "string",
              "TOKENS": "explode(regexp_extract_all(text, r'{rx}', 0))"},
    "duckdb": {"EPOCH": "cast(epoch(o_orderdate) as bigint)",
               "SPLIT": "string_split(l, '|')", "EMPTY": "cast([] as varchar[])",
               "HAS": "list_contains", "TEXT": "varchar",
               "TOKENS": "unnest(regexp_extract_all(text, '{rx}', 0))"},
}

WORD_PIECES = r'"[^"\n]*"|[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\sA-Za-z0-9_]'

VIEWS = {
    # One row per commit: roots and merges, NULL e-mails, half-hour offsets.
    "fx_commits": """
        select md5(cast(o_orderkey as {{TEXT}})) commit_sha, o_orderkey commit_seq,
               case when o_orderkey % 50 = 0 then 0 when o_orderkey % 20 = 1 then 2 else 1 end
               n_parents, c_name author_name,
               case when o_custkey % 97 = 0 then null
                    else lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment)
                         || '.example' end author_email,
               {{EPOCH}} + (o_orderkey * 7919) % 86400 authored_epoch,
               (cast(c_nationkey as bigint) - 12) * 3600
               + case when c_nationkey % 5 = 0 then 1800 else 0 end author_tz_offset,
               case o_orderkey % 8 when 0 then 'Fix crash in parser'
                    when 1 then 'Small FIX for overflow' when 2 then 'Rename suffix helper'
                    when 3 then 'Add fixture loader' when 4 then 'We fixed the build'
                    when 5 then 'Refactor' when 6 then 'Docs: prefix rules'
                    else 'Merge branch' end message
        from orders join customer on o_custkey = c_custkey""",
    # Labels present, empty or missing.
    "fx_issues": """
        select issue_number, case when l = '-' then null when l = '' then {{EMPTY}}
                                  else {{SPLIT}} end issue_labels
        from (select p_partkey issue_number,
                     case p_size % 5 when 0 then 'bug' when 1 then 'enhancement'
                          when 2 then 'bug|ui' when 3 then '' else '-' end l
              from part) x""",
    # The id lists of the issues, one row per entry; some ids are abbreviated.
    "fx_issue_links": """
        select distinct l_partkey issue_number,
               case l_returnflag when 'R' then 'closed' when 'A' then 'commit'
                    else 'similar' end link_kind,
               case when l_linenumber = 7 then substr(md5(cast(l_orderkey as {{TEXT}})), 1, 7)
                    else md5(cast(l_orderkey as {{TEXT}})) end commit_sha
        from lineitem""",
    # Unique on commit, path and line number; some lines are blank.
    "fx_diff_lines": """
        select md5(cast(l_orderkey as {{TEXT}})) commit_sha, l_orderkey commit_seq,
               'src/f' || cast(l_partkey % 40 as {{TEXT}}) || '.java' path,
               case min(l_returnflag) when 'R' then '-' when 'A' then '+' else ' ' end op,
               cast(l_linenumber as bigint) * 100000 + l_partkey line_no,
               case when min(l_suppkey) % 7 = 0 then '  '
                    else 'int v' || cast(min(l_suppkey) as {{TEXT}}) || ' = 1;' end value,
               min(l_suppkey) k
        from lineitem group by l_orderkey, l_partkey, l_linenumber""",
    # Origins of the removed lines; blame knows nothing of supplier 0.
    "fx_blame_lines": """
        select commit_sha, path, line_no,
               md5(cast(greatest(commit_seq - 1 - (k % 7), 0) as {{TEXT}})) blame_commit_sha,
               value content
        from fx_diff_lines where op = '-' and k <> 0""",
    "fx_tokens": """
        select hex_hash, lexer_name, token_content,
               case when substr(token_content, 1, 1) between '0' and '9' then 'number'
                    when substr(token_content, 1, 1) = '"' and length(token_content) > 1
                    then 'string'
                    when lower(substr(token_content, 1, 1)) between 'a' and 'z'
                         or substr(token_content, 1, 1) = '_' then 'name'
                    else 'operator' end token_type
        from (select doc_id hex_hash, lang lexer_name, {{TOKENS}} token_content
              from documents) x""",
    # One commit per document: it adds the file in full, the next one deletes it.
    "fx_files": """
        select md5(cast(doc_id as {{TEXT}})) commit_sha, doc_id commit_seq,
               source || '/d' || cast(doc_id as {{TEXT}})
               || case lang when 'en' then '.java' when 'de' then '.md' else '.txt' end path,
               text
        from documents""",
}

# The rows of the view, in words that need no strings as states of sums (Spark sorts for these) and
# move whole numbers in place of their digests.
_DIFF_LINES = """
    select md5(cast(l_orderkey as string)) commit_sha, l_orderkey commit_seq,
           'src/f' || cast(l_partkey % 40 as string) || '.java' path,
           case when is_r and not below_r then '-' when is_a and not below_a then '+' else ' ' end op,
           cast(l_linenumber as bigint) * 100000 + l_partkey line_no,
           case when k % 7 = 0 then '  ' else 'int v' || cast(k as string) || ' = 1;' end value, k
    from (select l_orderkey, l_partkey, l_linenumber, min(l_suppkey) k,
                 bool_or(l_returnflag = 'R') is_r, bool_or(l_returnflag < 'R') below_r,
                 bool_or(l_returnflag = 'A') is_a, bool_or(l_returnflag < 'A') below_a
          from {lineitem} group by l_orderkey, l_partkey, l_linenumber)"""
_LINK_KIND = """case l_returnflag when 'R' then 'closed' when 'A' then 'commit' else 'similar' end"""
SPARK_FORMS = {
    "fx_diff_lines": _DIFF_LINES.format(lineitem="lineitem"),
    "fx_issue_links": f"""
        select issue_number, link_kind,
               coalesce(short_sha, md5(cast(commit_seq as string))) commit_sha
        from (select distinct l_partkey issue_number, {_LINK_KIND} link_kind,
                     case when l_linenumber = 7 then null else l_orderkey end commit_seq,
                     case when l_linenumber = 7
                          then substr(md5(cast(l_orderkey as string)), 1, 7) end short_sha
              from lineitem_of_parts)""",
}

SPARK_ONLY = {
    # The lines of a commit together: its diff text is one cell in any case.
    "sp_commit_lines": _DIFF_LINES.format(lineitem="lineitem_of_orders"),
    # The links by ids in full; a shortened id is no commit's.
    "sp_full_links": f"""
        select distinct l_partkey issue_number, {_LINK_KIND} link_kind, l_orderkey commit_seq
        from lineitem_of_parts where not coalesce(l_linenumber = 7, false)""",
    "sp_issues": """
        select i.issue_number, i.issue_labels,
               links.issue_closed_commit_id, links.issue_commit_id,
               links.commit_id_similar_to_issue_title
        from fx_issues i left join (
            select issue_number,
                   collect_set(case link_kind when 'closed' then commit_sha end)
                   issue_closed_commit_id,
                   collect_set(case link_kind when 'commit' then commit_sha end)
                   issue_commit_id,
                   collect_set(case link_kind when 'similar' then commit_sha end)
                   commit_id_similar_to_issue_title
            from fx_issue_links group by issue_number) links
        on i.issue_number = links.issue_number""",
    # Diff text with one hunk per line; commits without lines have an empty diff.
    "sp_diffs": r"""
        select c.commit_sha, c.n_parents, coalesce(d.diff_text, '') diff_text
        from fx_commits c left join (
            select commit_seq, array_join(transform(array_sort(collect_list(
                       struct(path, patch))), p -> p.patch), '') diff_text
            from (select commit_seq, path,
                         concat('diff --git a/', path, ' b/', path, '\n--- a/', path,
                                '\n+++ b/', path, '\n',
                                array_join(transform(
                                    array_sort(collect_list(struct(line_no, op, value))),
                                    l -> concat('@@ -', l.line_no,
                                                if(l.op = '+', ',0', ''), ' +', l.line_no,
                                                if(l.op = '-', ',0', ''), ' @@\n',
                                                l.op, l.value, '\n')), '')) patch
                  from sp_commit_lines group by commit_seq, path) p
            group by commit_seq) d on c.commit_seq = d.commit_seq""",
    "sp_file_diffs_added": r"""
        select commit_sha, 1 n_parents,
               concat('diff --git a/', path, ' b/', path, '\nnew file mode 100644\n',
                      '--- /dev/null\n+++ b/', path, '\n@@ -0,0 +1,',
                      size(split(text, '\n')), ' @@\n+', replace(text, '\n', '\n+'),
                      '\n\\ No newline at end of file\n') diff_text
        from fx_files""",
    "sp_file_diffs_deleted": r"""
        select commit_sha, 1 n_parents,
               concat('diff --git a/', path, ' b/', path, '\ndeleted file mode 100644\n',
                      '--- a/', path, '\n+++ /dev/null\n@@ -1,',
                      size(split(text, '\n')), ' +0,0 @@\n-', replace(text, '\n', '\n-'),
                      '\n\\ No newline at end of file\n') diff_text
        from fx_files""",
    # The version before a deletion is named after the commit.
    "sp_blobs": """
        select explode(array(commit_sha, md5(commit_sha))) sha, path, text from fx_files""",
    "sp_file_commits": """
        select commit_sha, commit_seq, array(md5(commit_sha)) parent_shas from fx_files""",
}


def _source(name: str, engine: str) -> str:
    forms = {**VIEWS, **SPARK_ONLY, **(SPARK_FORMS if engine == "spark" else {})}
    return forms[name]


def _text(name: str, engine: str) -> str:
    text = _source(name, engine)
    for spot, value in DIALECTS[engine].items():
        text = text.replace("{{" + spot + "}}", value.replace("{rx}", WORD_PIECES))
    return text


def _needed(text: str, found: list[str], engine: str) -> list[str]:
    """The views a text names, each after those it needs itself."""
    for name in [*VIEWS, *SPARK_ONLY]:
        if re.search(rf"\b{name}\b", text) and name not in found:
            _needed(_source(name, engine), found, engine)
            found.append(name)
    return found


def with_views(body: str, engine: str = "duckdb", extra: dict[str, str] | None = None) -> str:
    """``body`` preceded by the views it names; ``extra`` are further named queries."""
    parts = {}
    for name in _needed(" ".join([*(extra or {}).values(), body]), [], engine):
        parts[name] = _text(name, engine)
    for name, text in (extra or {}).items():
        for spot, value in DIALECTS[engine].items():
            text = text.replace("{{" + spot + "}}", value)
        parts[name] = text
    clause = ",\n".join(f"{name} as ({text})" for name, text in parts.items())
    if not clause:
        return body
    if body.lstrip().startswith("with "):
        return f"with {clause},\n{body.lstrip()[len('with '):]}"
    return f"with {clause}\n{body}"


# Parts for each split of a scan, so that what a task makes of its part (the tokens of texts are
# many times their size) stays in memory; and up to how many parts Spark writes without sorting.
PARTS, MOST_PARTS = 8, 200


def spread(df: DataFrame, by: list[str]) -> DataFrame:
    """The rows dealt to all cores by ``by``: the fixtures are stored in one piece each."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = min(MOST_PARTS, PARTS * df.rdd.getNumPartitions())
    return df.repartition(max(cores, parts), *by)


class Tables:
    """The given tables and the views over them as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _base(self, name: str) -> DataFrame:
        name, by = DEALS.get(name) or (name, FACTS.get(name))
        table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(table, by) if by else table

    def sql(self, body: str) -> DataFrame:
        text = with_views(body, "spark")
        for name in [*BASE, *DEALS]:
            if re.search(rf"\b{name}\b", text):
                self._base(name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    def __call__(self, name: str) -> DataFrame:
        return self._base(name) if name in BASE else self.sql(f"select * from {name}")
