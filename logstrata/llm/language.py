"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logstrata.llm.common import append_columns, sliced

PROFILE = 400       # n-grams of a language profile and of a document
LONGEST = 3         # characters of the longest n-gram
MAX_LANGUAGES = 5_000
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")
_BITS = np.int64(21)


def letter_words(text: str | None) -> list[str]:
    """The runs of letters of a text; digits, numerals and marks are none."""
    found = _WORD.findall(text.lower()) if text else []
    if not found or "".join(found).isalpha():
        return found
    return "".join(c if c.isalpha() else " " for c in " ".join(found)).split()


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code of every n-gram of every word in order, first n-gram of each word and the end).

    A word stands between two blanks; an n-gram has 1 to 3 characters, of which a single blank
    is left out. The code holds the characters, 21 bits each, the first one highest.
    """
    points = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le"), "<u4").astype(np.int64)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    end = np.cumsum(size)
    word_of = np.repeat(np.arange(len(words)), size)
    left = end[word_of] - np.arange(len(points))
    codes, owners = [], []
    code = np.zeros(len(points), np.int64)
    for n in range(1, LONGEST + 1):
        ok = np.flatnonzero(left >= n)
        following = np.zeros(len(points), np.int64)
        following[:len(points) - n + 1] = points[n - 1:]
        code = (code << _BITS) | following
        if n == 1:
            ok = ok[points[ok] != 32]
        codes.append(code[ok])
        owners.append(word_of[ok])
    code, owner = np.concatenate(codes), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return code[order], np.searchsorted(owner[order], np.arange(len(words) + 1))


def spelled(code: int) -> str:
    out = ""
    while code:
        out = chr(code & 0x1FFFFF) + out
        code >>= 21
    return out


class GramCounter:
    """n-gram counts of the texts of one Arrow batch, from counts of their distinct words."""

    def __init__(self, texts: list[str | None]):
        words = [letter_words(t) for t in texts]
        self.bounds = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
        coded = pa.array([w for one in words for w in one], pa.string()).dictionary_encode()
        self.words = coded.indices.to_numpy().astype(np.int64)
        grams, self.begin = word_grams(coded.dictionary.to_pylist())
        self.codes, place = np.unique(grams, return_inverse=True)
        self.place = place.astype(np.int64)

    def counts(self, weights: np.ndarray) -> np.ndarray:
        """Count of each n-gram, given how often each distinct word occurs."""
        used = np.flatnonzero(weights)
        size = self.begin[used + 1] - self.begin[used]
        total = int(size.sum())
        shift = np.repeat(self.begin[used] - np.concatenate(([0], np.cumsum(size)[:-1])), size)
        return np.bincount(self.place[shift + np.arange(total)], np.repeat(weights[used], size),
                           len(self.codes)).astype(np.int64)

    def text_grams(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, counts) of the n-grams of one text."""
        words, times = np.unique(self.words[self.bounds[i]:self.bounds[i + 1]], return_counts=True)
        size = self.begin[words + 1] - self.begin[words]
        total = int(size.sum())
        shift = np.repeat(self.begin[words] - np.concatenate(([0], np.cumsum(size)[:-1])), size)
        found = np.bincount(self.place[shift + np.arange(total)], np.repeat(times, size),
                            len(self.codes))
        used = np.flatnonzero(found)
        return used, found[used]


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Codes by falling count, equal counts by code, the first ``size``."""
    if len(codes) > 4 * size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))[:size]]


def language_profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang",
                      size: int = PROFILE) -> DataFrame:
    """The ``size`` most frequent n-grams of each language: ``lang``, ``rank`` from 0, ``code``.

    All labelled texts count; rows without a language, and texts without a letter, add nothing.
    Counts are summed per Arrow batch before the shuffle, so a language with most of the rows
    sends one count of an n-gram for each batch. Equal counts are ranked by code.
    """
    rows = labelled.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def count(batches):
        for batch in (part for whole in batches for part in sliced(whole, 1)):
            langs = np.array(batch.column(0).to_pylist(), object)
            counter = GramCounter(batch.column(1).to_pylist())
            text_of = np.repeat(np.arange(len(langs)), np.diff(counter.bounds))
            for lang in sorted(set(langs)):
                mine = counter.words[langs[text_of] == lang] if len(text_of) else text_of
                if len(mine):
                    found = counter.counts(np.bincount(mine, minlength=len(counter.begin) - 1))
                    used = np.flatnonzero(found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(used), pa.string()), pa.array(counter.codes[used]),
                         pa.array(found[used])], ["lang", "code", "n"])

    total = (rows.mapInArrow(count, "lang string, code long, n long")
             .groupBy("lang", "code").agg(F.sum("n").alias("n")))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    return (total.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size)
            .select("lang", "rank", "code"))


def collect_profiles(profiles: DataFrame, size: int = PROFILE,
                     max_languages: int = MAX_LANGUAGES) -> dict[str, list[int]]:
    """The profiles on the driver: at most ``size`` numbers for each language.

    More than ``max_languages`` distinct labels are an error: such labels name no languages.
    """
    rows = profiles.limit(size * max_languages + 1).collect()
    if len(rows) > size * max_languages:
        raise ValueError(f"more than {max_languages} languages among the labels")
    found: dict[str, list[int]] = {}
    for row in sorted(rows, key=lambda r: (r.lang, r.rank)):
        found.setdefault(row.lang, []).append(row.code)
    return found


def _scorer(profiles: dict[str, list[int]], size: int) -> Callable:
    """Out-of-place distances of ranked codes to every language, in one look-up."""
    langs = sorted(profiles)
    codes = np.array(sorted({c for p in profiles.values() for c in p}), np.int64)
    rank = np.full((len(codes) + 1, len(langs)), -1, np.int64)
    for j, lang in enumerate(langs):
        rank[np.searchsorted(codes, profiles[lang]), j] = np.arange(len(profiles[lang]))

    def distances(own: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
        at = np.where(codes[at] == own, at, len(codes))
        theirs = rank[at]
        gap = np.abs(theirs - np.arange(len(own))[:, None])
        return np.where(theirs < 0, size, np.minimum(gap, size)).sum(0)

    return langs, distances


def identify_language(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text",
                      size: int = PROFILE) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``.

    The most frequent n-grams of a whole text, in order, are compared with each profile: an
    n-gram costs the distance between its two ranks, or ``size`` if the profile lacks it. The
    nearest language wins, the first by name of equally near ones. The score is 1 less the cost
    as a share of the largest possible one. Null, empty and letterless texts are ``und`` with
    score 0, and so are all texts if there is no profile. Columns of these names are replaced.
    """
    def compute():
        langs, distances = _scorer(profiles, size) if profiles else ([], None)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            counter = GramCounter(batch.column(0).to_pylist())
            names, scores = [], []
            for i in range(batch.num_rows):
                if not langs or counter.bounds[i] == counter.bounds[i + 1]:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                used, found = counter.text_grams(i)
                own = ranked(counter.codes[used], found, size)
                cost = distances(own)
                best = int(np.argmin(cost))
                names.append(langs[best])
                scores.append(1.0 - float(cost[best]) / (size * len(own)))
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
        return work

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return append_columns(docs, fields, compute, [text_col])
