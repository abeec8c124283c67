"""Languages by file name, and the words with a role of their own."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Lexer names by file extension.
LEXERS = {
    "Java": ["java"], "Kotlin": ["kt", "kts"], "Scala": ["scala"], "Groovy": ["groovy", "gradle"],
    "C": ["c", "h", "idc"], "C++": ["cc", "cpp", "cxx", "hh", "hpp"], "C#": ["cs"], "Go": ["go"],
    "Rust": ["rs"], "Swift": ["swift"], "JavaScript": ["js", "jsm", "mjs"], "TypeScript": ["ts"],
    "PHP": ["php", "inc"], "CSS": ["css"], "Protocol Buffer": ["proto"], "Dart": ["dart"],
    "Python": ["py", "pyw"], "Ruby": ["rb", "gemspec", "rake"], "Perl": ["pl", "pm"],
    "Bash": ["sh", "bash", "zsh"], "YAML": ["yaml", "yml"], "Makefile": ["mk", "mak"],
    "Properties": ["properties"], "INI": ["ini", "cfg"], "Docker": ["docker"],
    "XML": ["xml", "xsl", "xsd", "wsdl"], "HTML": ["html", "htm", "xhtml"], "JSON": ["json"],
    "SQL": ["sql"], "markdown": ["md"], "reStructuredText": ["rst", "rest"],
    "Text only": ["txt"],
}
HASH_COMMENTS = ["Python", "Ruby", "Perl", "Bash", "YAML", "Makefile", "Properties", "INI",
                 "Docker"]
NO_COMMENTS = ["XML", "HTML", "JSON", "SQL", "markdown", "reStructuredText", "Text only"]
UNKNOWN = "Text only"

# Evidence in the text of a file whose name tells no language.
INTERPRETERS = {
    "Python": "python[0-9.]*", "Bash": "(?:ba|z|da|k)?sh", "Perl": "perl", "Ruby": "ruby",
    "PHP": "php", "JavaScript": "node(?:js)?", "Groovy": "groovy", "Scala": "scala",
}
PROLOGS = {"XML": r"<\?xml\b", "HTML": r"(?:<!doctype html|<html)\b", "PHP": r"<\?php\b"}
MARKS = {  # lines that are typical of a language, each with its weight
    "Java": [(r"^package [\w.]+;", 3), (r"^import (?:static )?[\w.]+(?:\.\*)?;", 2),
             (r"^[ \t]*(?:public|private|protected) [^;{=]*[;{=]", 1)],
    "Python": [(r"^[ \t]*def \w+\(.*:[ \t]*$", 2), (r"^[ \t]*class \w+.*:[ \t]*$", 1),
               (r"^(?:import [\w.]+|from [\w.]+ import .*)$", 1)],
    "C": [(r"^#include [<\"]", 3), (r"^#(?:define|ifdef|ifndef|endif)\b", 2)],
    "Go": [(r"^package \w+$", 3), (r"^func [(\w]", 2)],
    "Ruby": [(r"^require ['\"]", 2), (r"^[ \t]*def \w+(?:\(.*\))?$", 2), (r"^[ \t]*end$", 1)],
    "JavaScript": [(r"^[ \t]*(?:const|let|var) \w+ = ", 1), (r"^(?:export )?function \w+\(", 2)],
    "Bash": [(r"; (?:then|do)$", 2), (r"^[ \t]*(?:fi|done|esac)$", 1)],
    "Makefile": [(r"^[\w.-]+:[^=\n]*\n\t", 3)],
    "SQL": [(r"^(?:SELECT|CREATE TABLE|INSERT INTO|UPDATE|DELETE FROM) ", 2)],
}
LEAST = 3   # less evidence than this is none

# The reserved words of Java.
JAVA_KEYWORDS = """
abstract assert boolean break byte case catch char class const
continue default do double else enum extends final finally float
for goto if implements import instanceof int interface long native
new package private protected public return short static strictfp super
switch synchronized this throw throws transient try void volatile while
""".split()

# The token types of Java words; the other reserved words are Token.Keyword.
JAVA_WORD_TYPES = {
    "Token.Keyword.Declaration":
        "abstract class const enum extends final implements interface native private protected "
        "public static strictfp super synchronized throws transient volatile".split(),
    "Token.Keyword.Type": "boolean byte char double float int long short void".split(),
    "Token.Keyword.Namespace": "import package".split(),
    "Token.Keyword.Constant": "false null true".split(),
}


def lexer_name(path: Column) -> Column:
    """The language by the extension of the file name; other names are plain text."""
    return F.coalesce(_by_extension(path), F.lit(UNKNOWN))


def _by_extension(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    by_extension = F.create_map(*chain.from_iterable(
        (F.lit(extension), F.lit(lexer))
        for lexer, extensions in LEXERS.items() for extension in extensions))
    return by_extension[extension]


def lexer_by_content(text: Column) -> Column:
    """The language with most evidence in a text; plain text if there is little, or none.

    An interpreter line decides, else a prolog, else a mode line (Emacs or Vim, in the first line
    or the second), else the typical lines, which add their weights (``MARKS``): of equal sums the
    language named first wins. Null and empty texts are plain text.
    """
    text = F.coalesce(text, F.lit(""))
    signs = [(language, rf"^#![^\n]*[/ ]{name}(?:[ \r\n]|$)") for language, name in INTERPRETERS.items()]
    signs += [(language, rf"(?i)^\s*{prolog}") for language, prolog in PROLOGS.items()]
    modes = F.create_map(*chain.from_iterable(
        (F.lit(mode), F.lit(language)) for language, extensions in LEXERS.items()
        for mode in dict.fromkeys([language.lower(), *extensions])))
    second = r"^(?:[^\n]*\n)?[^\n]*"
    emacs = F.lower(F.regexp_extract(
        text, second + r"-\*-[ \t]*(?:mode:[ \t]*)?([\w+#]+)[^\n]*-\*-", 1))
    vim = F.lower(F.regexp_extract(text, second + r"\bvim?:[^\n]*\b(?:ft|filetype)=(\w+)", 1))
    sums = [F.struct(sum((F.regexp_count(text, F.lit(f"(?m){mark}")) * weight
                          for mark, weight in marks), F.lit(0)).alias("sum"),
                     F.lit(-place).alias("place"), F.lit(language).alias("language"))
            for place, (language, marks) in enumerate(MARKS.items())]
    typical = F.transform(F.array(F.array_max(F.array(*sums))),
                          lambda best: F.when(best["sum"] >= LEAST, best["language"]))[0]
    return F.coalesce(*[F.when(text.rlike(sign), language) for language, sign in signs],
                      modes[emacs], modes[vim], typical, F.lit(UNKNOWN))


def lexer_of_file(path: Column, text: Column) -> Column:
    """The language by the file name, or where that tells nothing by the text."""
    return F.coalesce(_by_extension(path), lexer_by_content(text))


def java_keywords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(word,) for word in JAVA_KEYWORDS], "token_content string")


def is_keyword(token: Column) -> Column:
    return token.isin(JAVA_KEYWORDS)
