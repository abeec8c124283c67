"""Text and time expressions. None of them depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters counted as white space when a line is tested for being blank.
WHITE_SPACE = (r"\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{180e}\x{2000}-\x{200a}"
               r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")


def not_blank(text: Column) -> Column:
    """True where the text has a character that is not white space."""
    return text.rlike(f"[^{WHITE_SPACE}]")


def trimmed(text: Column) -> Column:
    """The text without white space at either end."""
    return F.regexp_replace(text, f"^[{WHITE_SPACE}]+|[{WHITE_SPACE}]+$", "")


def capitalized(text: Column) -> Column:
    """First character in upper case, the rest in lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def utc_offset_label(seconds_west: Column) -> Column:
    """``+5:30`` for -19800 seconds west of UTC; hours and minutes are not padded."""
    minutes = F.floor(F.abs(seconds_west) / 60)
    return F.concat(F.when(seconds_west > 0, "-").otherwise("+"),
                    F.floor(minutes / 60).cast("string"), F.lit(":"),
                    (minutes % 60).cast("string"))


def author_local_asctime(epoch: Column, seconds_west: Column) -> Column:
    """The author's wall clock as ``Sat May  4 00:00:00 2019``."""
    local = epoch - seconds_west
    day = F.date_from_unix_date(F.floor(local / 86400).cast("int"))
    second = F.pmod(local, F.lit(86400)).cast("long")

    def two(value: Column, pad: str = "0") -> Column:
        return F.lpad(value.cast("string"), 2, pad)

    clock = F.concat_ws(":", two(F.floor(second / 3600)), two(F.floor(second / 60) % 60),
                        two(second % 60))
    return F.concat(F.date_format(day, "EEE MMM "), two(F.dayofmonth(day), " "), F.lit(" "),
                    clock, F.lit(" "), F.year(day).cast("string"))


def hour_of_day_utc(authored_date: Column, offset_label: Column) -> Column:
    """Hour of the day in UTC from asctime text and an offset label.

    A label without a sign counts as positive. Text of another shape gives NULL.
    """
    def part(text: Column, pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast("long")

    clock = r"(?:^| )(\d{1,2}):(\d{2}):(\d{2}) \d{4}$"
    offset = r"^([+-]?)(\d{1,2}):(\d{1,2})$"
    local = (part(authored_date, clock, 1) * 3600 + part(authored_date, clock, 2) * 60
             + part(authored_date, clock, 3))
    sign = F.when(F.regexp_extract(offset_label, offset, 1) == "-", -1).otherwise(1)
    ahead = sign * (part(offset_label, offset, 2) * 3600 + part(offset_label, offset, 3) * 60)
    return F.floor(F.pmod(local - ahead, F.lit(86400)) / 3600)
