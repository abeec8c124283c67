"""Tokens of documents taken as files, and of the lines a commit changed in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.cohort_queries import ISSUE_IDS, LABEL
from checks.registry import query
from logstrata.functions.languages import (JAVA_KEYWORDS, JAVA_WORD_TYPES, is_keyword,
                                           java_keywords, lexer_name, lexer_of_file)
from logstrata.operators import diff, tokens
from logstrata.plans.history import History


def _quoted(words):
    return ", ".join("'" + word + "'" for word in words)


def _duckdb_rx(grammar):
    """The same grammar without possessive loops, as a quoted literal."""
    return "'" + tokens.GRAMMARS[grammar].replace("*+", "*").replace("'", "''") + "'"


LINES = """
    select commit_sha, path, unnest(string_split(text, chr(10))) line,
           unnest(generate_series(1, length(text) - length(replace(text, chr(10), '')) + 1))
           line_no,
           length(text) - length(replace(text, chr(10), '')) + 1 n_lines
    from fx_files"""
LINE_TOKENS = f"""
    select commit_sha, path, line_no, n_lines, line, unnest(found) token_content,
           unnest(generate_series(1, len(found))) pos, len(found) number_of_tokens
    from (select *, case when path like '%.java'
                         then regexp_extract_all(line, {_duckdb_rx('slash')})
                         else regexp_extract_all(line, {_duckdb_rx('plain')}) end found
          from doc_lines)"""
_TYPE_NAMES = "\n".join(
    f"when java and token_content in ({_quoted(words)}) then '{name}'"
    for name, words in JAVA_WORD_TYPES.items())
_NOT_TYPES = _quoted(w for w in JAVA_KEYWORDS
                     if w not in JAVA_WORD_TYPES["Token.Keyword.Type"])
TYPED = f"""
    select commit_sha, path, line_no, n_lines, line, token_content, number_of_tokens,
           token_no, case when java then 'Java' when path like '%.md' then 'markdown'
                          else 'Text only' end lexer_name,
           case when regexp_matches(token_content, '^".') then 'Token.Literal.String'
                when regexp_matches(token_content, '^''.') then 'Token.Literal.String.Char'
                when regexp_matches(token_content, '^@.') then 'Token.Name.Decorator'
                {_TYPE_NAMES}
                when java and token_content in ({_quoted(JAVA_KEYWORDS)}) then 'Token.Keyword'
                when java and word and before in ('class', 'interface', 'enum')
                then 'Token.Name.Class'
                when java and word and before in ('import', 'package')
                then 'Token.Name.Namespace'
                when java and word and before = '.' then 'Token.Name.Attribute'
                when java and word and after = '('
                     and regexp_matches(before, '^[\\p{{L}}_$>\\]]')
                     and before not in ({_NOT_TYPES}) then 'Token.Name.Function'
                when word then 'Token.Name'
                when regexp_matches(token_content, '^[0-9]') then 'Token.Literal.Number'
                when token_content in ({_quoted(tokens.OPERATORS)}) then 'Token.Operator'
                else 'Token.Error' end token_type
    from (select *, path like '%.java' java,
                 regexp_matches(token_content, '^[\\p{{L}}_$]') word,
                 coalesce(lag(token_content) over file_order, '') before,
                 coalesce(lead(token_content) over file_order, '') after,
                 row_number() over file_order - 1 token_no
          from line_tok window file_order as
               (partition by commit_sha, path order by line_no, pos))"""
NAMED = {"doc_lines": LINES, "line_tok": LINE_TOKENS, "typed": TYPED}


def _blobs(t):
    return t.sql("select commit_sha sha, path, text from fx_files")


@query("lexer_names", """select path, case when path like '%.java' then 'Java'
       when path like '%.md' then 'markdown' else 'Text only' end lexer_name from fx_files""")
def lexer_names(t):
    return t("fx_files").select("path", lexer_name(F.col("path")).alias("lexer_name"))


UNNAMED = """
    select source || '/d' || cast(doc_id as {{TEXT}})
           || case when doc_id % 11 = 9 then '.java' else '' end path,
           case doc_id % 11
                when 0 then '#!/usr/bin/env python3' when 1 then '#!/bin/sh'
                when 2 then '<?xml version="1.0"?>' when 3 then '# -*- mode: ruby -*-'
                when 4 then '/* vim: set ft=c: */'
                when 5 then concat('package a.b;', {{LF}}, 'import java.util.List;')
                when 6 then concat('import os', {{LF}}, 'def f(x):')
                when 7 then '#include <stdio.h>' when 8 then concat('def f', {{LF}}, 'end')
                else '' end || {{LF}} || coalesce(text, '') text
    from documents"""
# A table of its own: typical lines with weights; place decides between equal sums.
LINE_RULES = r"""
    select * from (values
        ('Python', 1, '^[ \t]*def [A-Za-z0-9_]+\(.*:[ \t]*$', 2),
        ('Python', 1, '^[ \t]*class [A-Za-z0-9_]+.*:[ \t]*$', 1),
        ('Python', 1, '^import [A-Za-z0-9_.]+$', 1),
        ('Python', 1, '^from [A-Za-z0-9_.]+ import .*$', 1),
        ('Bash', 6, '; (then|do)$', 2), ('Bash', 6, '^[ \t]*(fi|done|esac)$', 1),
        ('Ruby', 4, '^require [''"]', 2), ('Ruby', 4, '^[ \t]*def [A-Za-z0-9_]+(\(.*\))?$', 2),
        ('Ruby', 4, '^[ \t]*end$', 1),
        ('JavaScript', 5, '^[ \t]*(const|let|var) [A-Za-z0-9_]+ = ', 1),
        ('JavaScript', 5, '^(export )?function [A-Za-z0-9_]+\(', 2),
        ('Java', 0, '^package [A-Za-z0-9_.]+;', 3),
        ('Java', 0, '^import (static )?[A-Za-z0-9_.]+(\.\*)?;', 2),
        ('Java', 0, '^[ \t]*(public|private|protected) [^;{=]*[;{=]', 1),
        ('C', 2, '^#include [<"]', 3), ('C', 2, '^#(define|ifdef|ifndef|endif)\b', 2),
        ('Go', 3, '^package [A-Za-z0-9_]+$', 3), ('Go', 3, '^func [(A-Za-z0-9_]', 2),
        ('Makefile', 7, '^[A-Za-z0-9_.-]+:[^=\n]*\n\t', 3),
        ('SQL', 8, '^(SELECT|CREATE TABLE|INSERT INTO|UPDATE|DELETE FROM) ', 2))
        rules(language, place, mark, weight)"""


@query("lexer_names_by_content", """
       select path, case when path like '%.java' then 'Java'
           when starts_with(text, '#!/usr/bin/env python3') then 'Python'
           when starts_with(text, '#!/bin/sh') then 'Bash'
           when starts_with(text, '<?xml ') then 'XML'
           when starts_with(text, '# -*- mode: ruby') then 'Ruby'
           when starts_with(text, '/* vim: set ft=c') then 'C'
           else coalesce(language, 'Text only') end lexer_name
       from unnamed left join (
           select path p, language from (
               select path, language, place, sum(weight * len(regexp_extract_all(
                          text, '(?m)' || mark))) score
               from unnamed, line_rules group by all)
           where score >= 3
           qualify row_number() over (partition by path order by score desc, place) = 1)
       on path = p""", unnamed=UNNAMED.replace("{{TEXT}}", "varchar").replace("{{LF}}", "chr(10)"),
       line_rules=LINE_RULES)
def lexer_names_by_content(t):
    """Files without an extension, with every kind of evidence, and named ones among them."""
    files = t.sql(UNNAMED.replace("{{TEXT}}", "string").replace("{{LF}}", "char(10)"))
    return files.select("path", lexer_of_file(F.col("path"), F.col("text")).alias("lexer_name"))


@query("tokenize", """select commit_sha sha, path, lexer_name, token_no, token_content,
                             token_type from typed""", **NAMED)
def tokenize(t):
    return tokens.tokenize(_blobs(t), offsets=False)


PART = 1024  # characters


@query("token_offsets", """select commit_sha sha, path, token_no, token_content from typed""",
       **NAMED)
def token_offsets(t):
    """What the file holds at the offset of each token."""
    found = tokens.tokenize(_blobs(t)).select(
        "sha", "path", "token_no", "token_start", F.length("token_content").alias("size"))
    # A text is cut into parts of equal length, so that no token is looked for from its beginning.
    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)).alias("parts")
    first = F.floor(F.col("token_start") / PART).cast("int")
    last = F.floor((F.col("token_start") + F.col("size") - 1) / PART).cast("int")
    held = F.when(first == last, F.get("parts", first)).otherwise(
        F.array_join(F.slice("parts", first + 1, last - first + 1), ""))
    # A task holds its share of the files; their tokens need no sorting.
    files = _blobs(t).select("sha", "path", parts)
    return found.join(files.hint("shuffle_hash"), ["sha", "path"]).select(
        "sha", "path", "token_no",
        F.substring(held, (F.col("token_start") % PART).cast("int") + 1, F.col("size"))
        .alias("token_content"))


@query("tokens_of_lines", """select path, lexer_name, line_no code_line_number,
       case when line_no < n_lines then line || chr(10) else line end line_content,
       number_of_tokens, token_content, token_type from typed""", **NAMED)
def tokens_of_lines(t):
    files = t("fx_files").select("path", "text", F.sequence(
        F.lit(1), F.size(F.split("text", "\n"))).alias("line_numbers"))
    return tokens.line_tokens(files).drop("token_position")


@query("tokens_of_lines_joined", """select path, lexer_name, line_no code_line_number,
       case when line_no < n_lines then line || chr(10) else line end line_content,
       number_of_tokens, token_content, token_type from typed""", **NAMED)
def tokens_of_lines_joined(t):
    """The same by a join of a table of tokens with a table of lines."""
    found = tokens.tokenize(_blobs(t))
    lines = tokens.text_lines(_blobs(t))
    return tokens.join_line_tokens(found, lines, ["sha", "path"]).drop("sha")


CONTENT = """
    select commit_sha hex_hash, lexer_name, line_no code_line_number, path file_name,
           token_content, token_type,
           case when line_no < n_lines then line || chr(10) else line end line_content,
           number_of_tokens, number_of_changes
    from typed join (select commit_sha, count(*) number_of_changes from doc_lines
                     where regexp_matches(line, '\\S') group by 1) using (commit_sha)
    where regexp_matches(line, '\\S')"""


def _file_history(t, part):
    return History(t("sp_file_commits"), diffs=t(f"sp_file_diffs_{part}"), blobs=t("sp_blobs"))


@query("content_tokens_added", CONTENT, **NAMED)
def content_tokens_added(t):
    return _file_history(t, "added").content_tokens("all", "added")


@query("content_tokens_deleted", CONTENT, **NAMED)
def content_tokens_deleted(t):
    return _file_history(t, "deleted").content_tokens("all", "deleted")


_BUG_IDS = """(select commit_sha from issue_ids join fx_issues using (issue_number)
    where issue_labels is not null and list_contains(issue_labels, 'bug'))"""


def _register_content(cohort, part):
    inside = "in" if cohort == "fix" else "not in"

    @query(f"content_tokens_{cohort}_{part}", f"{CONTENT} and commit_sha {inside} {_BUG_IDS}",
           **NAMED, issue_ids=ISSUE_IDS)
    def content(t):
        history = History(t("sp_file_commits"), t("sp_issues"), LABEL, keyword=None,
                          diffs=t(f"sp_file_diffs_{part}"), blobs=t("sp_blobs"))
        return history.content_tokens(cohort, part)


for _cohort in ("fix", "non_fix"):
    for _part in ("added", "deleted"):
        _register_content(_cohort, _part)


@query("content_tokens_kept",CONTENT + """ and lexer_name = 'Java' and token_type in
       ('Token.Keyword.Declaration', 'Token.Keyword.Namespace', 'Token.Keyword',
        'Token.Keyword.Type')""", **NAMED)
def content_tokens_kept(t):
    from logstrata.operators.filters import keep_rows

    return keep_rows(_file_history(t, "added").content_tokens("all", "added"), {
        "lexer_name": "Java",
        "token_type": ["Token.Keyword.Declaration", "Token.Keyword.Namespace", "Token.Keyword",
                       "Token.Keyword.Type"]})


@query("content_tokens_numbered", f"""
       select row_number() over (order by doc_id, line_no, token_no) line_number, hex_hash,
              lexer_name, code_line_number, file_name, token_content, token_type, line_content,
              number_of_tokens, number_of_changes
       from ({CONTENT.replace('select commit_sha hex_hash', 'select line_no, token_no, commit_sha hex_hash')})
       join (select commit_seq doc_id, commit_sha hex_hash from fx_files) using (hex_hash)""",
       **NAMED)
def content_tokens_numbered(t):
    return _file_history(t, "added").content_tokens("all", "added", numbered=True)


@query("content_rejects", """select md5(cast(doc_id as varchar)) commit_sha,
       'content_missing' reason, 'Content' stage from documents
       where doc_id not in (select doc_id from labels)
         and regexp_matches(text, '\\S')""")
def content_rejects(t):
    """Only labelled documents are among the blobs."""
    patches = diff.parse_unified_diff(t("sp_file_diffs_added"))
    blobs = t.sql("""select f.* from sp_blobs f left semi join
                     (select md5(cast(doc_id as string)) sha from labels) l on f.sha = l.sha""")
    return tokens.content_rejects(patches, blobs, t("sp_file_commits"), "added")


@query("keyword_frequency", f"""select token_content, count(*) n from fx_tokens
       where token_content in ({_quoted(JAVA_KEYWORDS)}) group by all""")
def keyword_frequency(t):
    words = java_keywords(t.spark)
    return (t("fx_tokens").join(words, "token_content", "left_semi")
            .groupBy("token_content").agg(F.count("*").alias("n")))


@query("keyword_share", f"""select hex_hash, count(*) n_tokens,
       count(*) filter (where token_content in ({_quoted(JAVA_KEYWORDS)})) n_keywords
       from fx_tokens group by all""")
def keyword_share(t):
    return t("fx_tokens").groupBy("hex_hash").agg(
        F.count("*").alias("n_tokens"),
        F.count_if(is_keyword(F.col("token_content"))).alias("n_keywords"))
