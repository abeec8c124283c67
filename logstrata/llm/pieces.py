"""SentencePiece encoding and decoding for merge-type vocabularies."""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from logstrata.llm.common import append_columns

SPACE = "▁"
UNKNOWN = " ⁇ "
NO_PIECE = float("-inf")
# Bytes, about, that a Python worker remembers words with; when full, the memory starts anew.
REMEMBERED = 64 << 20
PARTS = 8                    # their parts take one of so many parts of it besides
# Bytes of text that are unpacked and looked up at once.
TEXT_BYTES = 1 << 20
# Longest segment whose pairs are kept in place, where the best is found by looking at all.
SHORT = 64
_LETTER = re.compile(r"[^\W\d_]")


class MergeCodec:
    """Encodes and decodes with the pieces and scores of a merge-type model file.

    It expects what such models have when their normaliser is the identity: a leading space mark,
    spaces written as marks, and bytes for characters without a piece. ``check`` compares with the
    library, which serves as the reference; models with another normaliser are refused there.
    """

    def __init__(self, model_path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        lib, n = self.library, len(self.library)
        self.piece = [lib.id_to_piece(i) for i in range(n)]
        usable = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i)
                                              or lib.is_byte(i) or lib.is_unused(i))]
        self.id_of = {self.piece[i]: i for i in usable}
        self.score = {self.piece[i]: lib.get_score(i) for i in usable}
        self.written = [str(i) for i in range(n)]
        self.unknown = lib.unk_id()
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        self.byte_value = {i: b for b, i in self.byte.items()}
        self.plain = {i: self.piece[i].replace(SPACE, " ") for i in usable}
        self.hidden = {i for i in range(n) if lib.is_control(i)}
        # No merge crosses a boundary that no piece contains: before a space mark that follows
        # another character, beside a line break, between a letter and another character. Letters
        # that stand beside another character in some piece are not taken for letters here.
        longer = [p for p in self.id_of if len(p) > 1]
        self.words_apart = not any(SPACE in p.lstrip(SPACE) for p in longer)
        odd = {c for p in longer for pair in zip(p, p[1:]) if SPACE not in pair
               and bool(_LETTER.match(pair[0])) != bool(_LETTER.match(pair[1]))
               for c in pair if _LETTER.match(c)}
        alone = "".join(re.escape(c) for c in "\n\t" if not any(c in p for p in longer))
        self.letters_whole = self.words_apart and len(odd) < 50 and not any(map(str.isalpha, odd))
        letter, odd = r"(?:(?![S_\dO])\w)".replace("O", re.escape("".join(sorted(odd)))), len(odd) < 50
        self.parts = re.compile((f"[{alone}]|" if alone else "") + (
            f"S*(?:{letter})+|S*(?:(?!{letter})[^S{alone}])+|S+" if odd
            else f"S+[^S{alone}]*|[^S{alone}]+").replace("S", SPACE))
        self.known: dict[str, tuple[int, ...]] = {}
        self.known_bytes = self.facts_bytes = 0
        self.facts: dict[str, tuple[str, int, str]] = {}
        self.old: dict[str, tuple[str, int, str]] = {}

    def merge(self, segment: str) -> tuple[int, ...]:
        """Ids of one segment: an agenda of adjacent symbol pairs, best score first, leftmost
        of equal ones first. That of a short segment lies in the order of its symbols, that of a
        long one is a heap, where a pair whose symbols have changed meanwhile is skipped."""
        symbols: list[str] = list(segment)
        n = len(symbols)
        if n <= SHORT:
            return self._ids(self._merge_short(symbols))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        score, agenda = self.score, []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in score:
                agenda.append((-score[pair], i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            j = after[i]
            if not symbols[i] or j >= n or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                right = pair + symbols[k]
                if right in score:
                    heapq.heappush(agenda, (-score[right], i, right))
            h = before[i]
            if h >= 0:
                left = symbols[h] + pair
                if left in score:
                    heapq.heappush(agenda, (-score[left], h, left))
        return self._ids(symbols)

    def _merge_short(self, symbols: list[str]) -> list[str]:
        score = self.score.get
        agenda = [score(a + b, NO_PIECE) for a, b in pairwise(symbols)]
        while agenda:
            best = max(agenda)
            if best == NO_PIECE:
                break
            i = agenda.index(best)
            pair = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = score(pair + symbols[i + 1], NO_PIECE)
            if i:
                agenda[i - 1] = score(symbols[i - 1] + pair, NO_PIECE)
        return symbols

    def _ids(self, symbols: list[str]) -> tuple[int, ...]:
        ids: list[int] = []
        for symbol in symbols:
            if symbol:
                known = self.id_of.get(symbol)
                if known is not None:
                    ids.append(known)
                elif self.byte:
                    ids += [self.byte[b] for b in symbol.encode()]
                else:
                    ids.append(self.unknown)
        return tuple(ids)

    def _parts_of(self, word: str) -> list[str]:
        if not self.words_apart or self.letters_whole and word.isalpha():
            return [SPACE + word]
        return self.parts.findall(SPACE + word)

    def words(self, text: str) -> list[str]:
        """The words of a text, each without the space mark it begins with."""
        if not text:
            return []
        if not self.words_apart:
            return [text.replace(" ", SPACE)]
        if SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
            marked = SPACE + text.replace(" ", SPACE)
            return [s[1:] for s in re.findall(f"{SPACE}+[^{SPACE}]*", marked)]
        return text.split(" ")

    def learn(self, words: set[str]) -> None:
        """Encode words not met before and check them against the library, all at once."""
        known, written, fresh, found = self.known, self.written, list(words), []
        for word in fresh:
            ids: list[int] = []
            for part in self._parts_of(word):
                got = known.get(part)
                if got is None:
                    if self.known_bytes > REMEMBERED // PARTS:
                        known.clear()
                        self.known_bytes = 0
                    got = known[part] = self.merge(part)
                    self.known_bytes += 250 + len(part) + 40 * len(got)
                ids += got
            self.facts[word] = (",".join([written[i] for i in ids]), len(ids), self.spell(ids))
            found.append(ids)
        for word, mine, ids in zip(fresh, found, self.library.encode(fresh, num_threads=1)):
            if word and ids != mine:
                raise ValueError(f"not the library's ids for {word!r}: {self.facts[word][0]}")

    def look_up(self, texts: list[str]) -> list[list[tuple[str, int, str]]]:
        """(ids in writing, their number, spelling) of each word of each text.

        Two generations are remembered: when the young one is full it becomes the old one, and
        words found there are taken over, so frequent words stay. New words of all texts are
        encoded, and given to the library, together.
        """
        with _without_collection():
            return self._look_up([self.words(t) for t in texts])

    def _look_up(self, words: list[list[str]]) -> list[list[tuple[str, int, str]]]:
        missing = set().union(*words).difference(self.facts)
        more = sum(map(_held, missing))
        if self.facts_bytes + more > REMEMBERED:
            self.old, self.facts, self.facts_bytes = self.facts, {}, 0
            missing = set().union(*words)
            more = sum(map(_held, missing))
        self.facts_bytes += more
        old = self.old
        kept = {w: old[w] for w in missing if w in old}
        self.facts.update(kept)
        self.learn(missing.difference(kept))
        fact = self.facts.__getitem__
        return [list(map(fact, one)) for one in words]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [[int(i) for f in facts for i in f[0].split(",")] for facts in self.look_up(texts)]

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text the number of ids, the ids as decimals joined by commas, and the decoded
        text. A word holds whole characters, so a text's spelling is that of its words in a row.
        """
        found = []
        for facts in self.look_up(texts):
            if facts:
                listed, counts, spelled = zip(*facts)
                found.append((sum(counts), ",".join(listed), "".join(spelled)[1:]))
            else:
                found.append((0, "", ""))
        return found

    def digest(self, text: str) -> tuple[int, str, str]:
        return self.digests([text])[0]

    def spell(self, ids) -> str:
        """The characters of ids: marks become spaces, bytes become characters, and each byte
        that is no part of a valid character becomes a replacement character."""
        try:
            return "".join(map(self.plain.__getitem__, ids))
        except KeyError:  # bytes, unknown or control ids
            out, raw = [], bytearray()
        for i in ids:
            b = self.byte_value.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(_characters(raw))
                raw = bytearray()
            if i not in self.hidden:
                out.append(self.plain.get(i, UNKNOWN))
        if raw:
            out.append(_characters(raw))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; of a space at the very beginning, one goes."""
        first = next((i for i in ids if i not in self.hidden), None)
        text = self.spell(ids)
        return text[1:] if first in self.plain and text[:1] == " " else text


@contextmanager
def _without_collection() -> Iterator[None]:
    """Words and their facts form no cycles; looking for some costs more than the agenda."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _held(word: str) -> int:
    """Bytes, about, that a word's facts take: the word, its ids in writing, its spelling."""
    return 350 + 8 * len(word)


def _characters(raw: bytearray) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        pass
    out, i = [], 0
    while i < len(raw):
        for size in (1, 2, 3, 4, 0):
            try:
                out.append(raw[i:i + size].decode() if size else "\ufffd")
                break
            except UnicodeDecodeError:
                continue
        i += size or 1
    return "".join(out)


_codecs: dict[str, MergeCodec] = {}


def codec(model_path: str) -> MergeCodec:
    if model_path not in _codecs:
        _codecs[model_path] = MergeCodec(model_path)
    return _codecs[model_path]


def encode_pieces(docs: DataFrame, model_path: str, text_col: str = "text",
                  ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text (array of int), without begin or end ids.

    Null and empty texts have no ids. Every distinct word a worker meets is encoded by the merge
    agenda once and compared with the library's result. Repeated rows are encoded alike, an empty
    table stays empty, a column named like the result is replaced.
    """
    def compute():
        c = codec(model_path)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            return [pa.array(c.encode_batch(texts), pa.list_(pa.int32()))]
        return work

    field = T.StructField(ids_col, T.ArrayType(T.IntegerType()))
    return append_columns(docs, [field], compute, [text_col], TEXT_BYTES)


def round_trip(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids",
               count_col: str = "n_tokens", same_col: str = "decodes") -> DataFrame:
    """``docs`` with the ids of each text, their number, and whether decoding gives the text.

    Encoding, decoding and the comparison are one pass of one worker. Null and empty texts have
    no ids and decode to an empty text; columns named like a result are replaced.
    """
    def compute():
        c = codec(model_path)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            counts, listed, same = [], [], []
            for text, (n, ids, decoded) in zip(texts, c.digests(texts)):
                counts.append(n)
                listed.append(np.array(ids.split(","), np.int32) if n else np.zeros(0, np.int32))
                same.append(decoded == text)
            return [pa.array(listed, pa.list_(pa.int32())), pa.array(counts, pa.int64()),
                    pa.array(same)]
        return work

    fields = [T.StructField(ids_col, T.ArrayType(T.IntegerType())),
              T.StructField(count_col, T.LongType()), T.StructField(same_col, T.BooleanType())]
    return append_columns(docs, fields, compute, [text_col], TEXT_BYTES)


def decode_pieces(rows: DataFrame, model_path: str, ids_col: str = "ids",
                  text_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of each list of ids; null and empty lists give an empty text."""
    def compute():
        c = codec(model_path)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([c.decode(ids or []) for ids in batch.column(0).to_pylist()],
                             pa.string())]
        return work

    return append_columns(rows, [T.StructField(text_col, T.StringType())], compute, [ids_col])


def piece_digests(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each text.

    The same as encoding, decoding and hashing, without a list of ids beside every text.
    """
    def compute():
        c = codec(model_path)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            counts, ids_hex, text_hex = [], [], []
            for n, ids, decoded in c.digests([t or "" for t in batch.column(0).to_pylist()]):
                counts.append(n)
                ids_hex.append(hashlib.sha256(ids.encode()).hexdigest())
                text_hex.append(hashlib.sha256(decoded.encode()).hexdigest())
            return [pa.array(counts, pa.int64()), pa.array(ids_hex), pa.array(text_hex)]
        return work

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
              T.StructField("decoded_sha256", T.StringType())]
    return append_columns(docs, fields, compute, [text_col], TEXT_BYTES)
