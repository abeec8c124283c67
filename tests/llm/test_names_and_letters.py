"""Columns named like those an operator uses inside; what counts as a letter."""

from logstrata.llm import decontamination, language, outliers, substrings

NAMES = ["size", "rid", "key", "x_length", "x_symbols", "m_0", "l_0_0", "hot"]


def test_numerals_are_no_letters():
    assert language.letter_words("² ½ Ⅷ 3 _") == []
    assert language.letter_words("Ab²c d1e") == ["ab", "c", "d", "e"]
    assert language.letter_words(None) == language.letter_words("") == []


def test_columns_with_names_from_inside(spark):
    words = " ".join(f"w{i}" for i in range(50))
    rows = [(i, words if i < 2 else f"{i} " + "other words of this text here and there again " * i,
             "en", "s", *range(len(NAMES))) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, "
                                 + ", ".join(f"{n} int" for n in NAMES))
    shorter = substrings.without_repeats(docs)
    assert shorter.columns == docs.columns
    assert {r.doc_id for r in shorter.collect() if not r.text} == {0, 1}
    judged = outliers.judge(docs)
    assert judged.count() == 6 and set(NAMES) <= set(judged.columns)
    assert outliers.keep_sound(docs).columns == docs.columns


def test_another_block_is_not_taken_for_the_last_one():
    for text, found in ((b"one two", True), (b"three four", False)):
        built = decontamination._cached([("a", text)], 10)
        assert bool(list(built.iter(" one two "))) == found


def test_short_segments_are_merged_in_place_as_by_the_heap(monkeypatch):
    import random

    from logstrata.llm import pieces, queries

    codec, rng = pieces.MergeCodec(queries.tokenizer_path()), random.Random(3)
    segments = ["▁" + "".join(rng.choice("aeionrstlé漢 ▁\n.1") for _ in range(rng.randrange(60)))
                for _ in range(400)] + ["", "▁", "▁" + "a" * 50, "▁" + "ab" * 25]
    short = [codec.merge(s) for s in segments]
    monkeypatch.setattr(pieces, "SHORT", 0)
    assert [codec.merge(s) for s in segments] == short


def test_words_of_letters_are_one_part(monkeypatch):
    from logstrata.llm import pieces, queries

    codec = pieces.MergeCodec(queries.tokenizer_path())
    for word in ("a", "straße", "漢字", "ªº", "ʰk", "naïve", "x²", "a1", "_a", "", "é́", "नमस्ते"):
        assert codec._parts_of(word) == codec.parts.findall("▁" + word)


def test_the_memory_of_words_is_bounded_and_changes_nothing(monkeypatch):
    from logstrata.llm import pieces, queries

    texts = [" ".join(f"w{i * j}x" for j in range(300)) for i in range(40)]
    wide = pieces.MergeCodec(queries.tokenizer_path()).digests(texts)
    monkeypatch.setattr(pieces, "REMEMBERED", 200_000)
    narrow = pieces.MergeCodec(queries.tokenizer_path())
    assert [narrow.digest(t) for t in texts] == wide
    assert narrow.facts_bytes <= 200_000 and narrow.known_bytes <= 200_000 // pieces.PARTS + 2000
