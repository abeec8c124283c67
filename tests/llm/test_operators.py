"""Brute-force versions and edge cases of the training-data operators."""

import collections
import hashlib
import mmap
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logstrata.llm import (decontamination, html_text, language, ngram_trie, outliers, pieces,
                           probminhash, queries, sharding, substrings, warc)
from logstrata.session import scratch_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, n) for n in (3, 40, 80, 200, 500, 1500, 4)]
    passage = prose(rng, 60)
    near = []
    for i in range(6):
        words = base[4].split()
        for k in rng.sample(range(len(words)), 3 * i):
            words[k] = f"x{i}{k}"
        near.append(" ".join(words))
    rows = [*base, *near, base[3], base[3], base[3].upper(), None, "", "  \n\t ",
            prose(rng, 30) + " " + passage + "\n" + prose(rng, 20),
            prose(rng, 10) + " " + passage, "a " * 3000, "é ß 日本 " * 9, "x" * 200_000]
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 3 else None, "s", 1, 7) for i, t in texts]
    rows.append((None, "no id at all here", None, None, None, None))
    rows.append(rows[4])  # a repeated row
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_benchmark_text(spark, docs):
    own = dict(rows_of(docs))
    long = " ".join(own[4].split()[20:45])
    items = spark.createDataFrame(
        [(1, long.upper()), (2, "W1, w2"), (3, None), (4, "!!"), (12, long), (None, "w3")],
        "item_id long, text string")
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

    def words(t):
        return word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))

    for block in (10 ** 6, 100):  # one automaton, and one for each of several blocks
        found = decontamination.find_benchmark_text(docs, items, block_bytes=block).collect()
        for r in found:
            w, hit, named = words(r.text), set(), set()
            for item, t in ((1, long), (2, "w1 w2"), (12, long)):
                iw = words(t)
                k = min(10, len(iw))
                windows = {tuple(iw[i:i + k]) for i in range(len(iw) - k + 1)}
                for i in range(len(w) - k + 1):
                    if tuple(w[i:i + k]) in windows:
                        hit |= set(range(i, i + k))
                        named.add(str(item))
            assert (r.n_words, r.n_hit, r["items"]) == (len(w), len(hit), sorted(named))
            inside = [x for s in r.spans for x in words(r.text[s.begin:s.end])]
            assert inside == [w[i] for i in sorted(hit)]
    empty = decontamination.find_benchmark_text(docs, items.limit(0))
    assert empty.where("n_hit > 0").count() == 0 and empty.count() == docs.count()
    assert decontamination.find_benchmark_text(docs.limit(0), items).count() == 0


def test_sharding(spark, docs):
    rows = spark.range(0, 1003).select(F.col("id").alias("doc_id"), F.lit(1).alias("slot"))
    for bucket in (10 ** 6, 7):
        placed = sharding.shuffle_into_shards(rows, 40, bucket_rows=bucket).collect()
        slots = collections.defaultdict(list)
        for r in placed:
            slots[r.shard].append(r.slot)
        assert sorted(r.doc_id for r in placed) == list(range(1003))
        assert len(slots) == 40 and {len(s) for s in slots.values()} == {25, 26}
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shuffle_into_shards(rows.limit(0), 3).count() == 0
    assert sharding.shuffle_into_shards(docs, 3).count() == docs.count()


def test_communication_matrix():
    before, sizes = [0, 5, 5, 30, 41], np.array([11, 10, 10, 10])
    for seed in range(50):
        rows = [sharding.draw_row(before, sizes, p, seed) for p in range(4)]
        assert [int(r.sum()) for r in rows] == [5, 0, 25, 11]
        assert (sum(rows) == sizes).all()
    rng = np.random.default_rng(1)
    drawn = [sharding.hypergeometric(rng, 3 * 10 ** 9, 10 ** 9, 400) for _ in range(3000)]
    assert abs(np.mean(drawn) - 300) < 1 and abs(np.var(drawn) - 75) < 8


def test_warc_round_trip_and_salvage(spark):
    pages = spark.createDataFrame(
        [(3, "http://a/", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "http://b/\r\nX: y", None),
         (7, "u", ""), (None, "u", "z"), (9, "u", "WARC/1.1\r\n\r\n" * 3)],
        "page_id long, url string, html string")
    path = scratch_path(spark, "warc")
    warc.write_warc(pages, path)
    found = {r.record_id: r for r in warc.read_warc(spark, path).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in found.items()} == {
        "1": ("response", None), "3": ("revisit", "1"), "2": ("response", None),
        "7": ("revisit", "2"), "null": ("response", None), "9": ("response", None)}
    assert found["3"].payload_bytes == 9 and found["3"].payload_digest == found["1"].payload_digest
    assert found["9"].payload.decode() == "WARC/1.1\r\n\r\n" * 3
    members = [warc.member(str(i), "u", bytes([65 + i]) * 500, None, None, "d") for i in range(5)]
    plain = zlib.decompress(members[4], 31)
    cut = bytearray(members[1])
    cut[len(cut) // 2] ^= 255
    data = members[0] + bytes(cut) + b"junk" + members[2] + members[3][:60] + plain
    found = list(warc.salvage(data))
    assert [r["record_id"] for _, _, why, r in found if not why] == ["0", "2", "4"]
    assert [(o, n) for o, n, why, _ in found if why] == [
        (len(members[0]), len(cut) + 4), (len(members[0]) + len(cut) + 4 + len(members[2]), 60)]
    assert list(warc.salvage(b"")) == [] and list(warc.salvage(b"x"))[0][2]
    warc.write_warc(pages.limit(0), path + "-none")
    assert warc.read_warc(spark, path + "-none").where("kind = 'record'").count() == 0


def test_salvage_inside_a_member():
    plain = [zlib.decompress(warc.member(str(i), "u", bytes([65 + i]) * 500, None, None, "d"), 31)
             for i in range(4)]

    def packed(*parts):
        pack = zlib.compressobj(wbits=31)
        return pack.compress(b"".join(parts)) + pack.flush()

    alone = warc.member("9", "u", b"z", None, None, "d")
    whole = packed(*plain)
    found = list(warc.salvage(whole + alone))
    assert [(o, n, why, r["record_id"]) for o, n, why, r in found] == [
        *[(0, len(whole), None, str(i)) for i in range(4)], (len(whole), len(alone), None, "9")]
    broken = plain[1].replace(b"B" * 500, b"B" * 499 + b"?")
    for parts, ids in (((plain[0], broken, plain[2]), "02"), ((broken, plain[2]), "2")):
        data = packed(*parts)
        found = list(warc.salvage(b"junk" + data + alone))
        assert [r["record_id"] for _, _, why, r in found if not why] == [*ids, "9"]
        gaps = [(o, n, why) for o, n, why, _ in found if why]
        assert gaps[0][:2] == (0, 4) and [g[:2] for g in gaps[1:]] == [(4, len(data))]
        place = 0 if parts[0] is broken else len(plain[0])
        assert gaps[1][2].endswith(f"; {len(broken)} bytes at {place} of the unpacked member")


def weighted(text):
    w = (text or "").encode().lower().split()
    return collections.Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def similarity(x, y):
    every = set(x) | set(y)
    return sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in every) for d in set(x) & set(y))


def test_near_duplicates(docs):
    rows = [(i, t) for i, t in rows_of(docs) if t != "a " * 3000]
    sets = [weighted(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and similarity(sets[a], sets[b]) >= 0.8 - 1e-9:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    expected = {}
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[k] and rows[j][0] is not None]
        expected[i] = min(ids) if ids else None
    found = {r.doc_id: r.class_id for r in probminhash.near_duplicates(docs).collect()}
    assert {k: v for k, v in found.items() if k in expected} == expected
    left = probminhash.one_of_each(docs)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert len(ids) == len(set(ids)) and set(expected.values()) <= set(ids)
    assert probminhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_within_a_template_family(spark):
    rng = random.Random(11)
    template = prose(rng, 350, 10 ** 9)

    def document(*tails):
        return " ".join((template, *tails))

    # Two of the family are alike at 346 / 445 = 0.777, twins at 351 / 437 = 0.803.
    rows = [document(prose(rng, 50, 10 ** 9)) for _ in range(500)]
    for _ in range(20):
        both = prose(rng, 7, 10 ** 9)
        rows += [document(both, prose(rng, 43, 10 ** 9)) for _ in range(2)]
    sets = [weighted(t) for t in rows]
    assert similarity(sets[0], sets[1]) < 0.8 <= similarity(sets[500], sets[501])
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in probminhash.near_duplicates(table).collect()}
    assert found == {i: i - (i - 500) % 2 if i >= 500 else i for i in range(540)}


def test_near_misses_make_no_rows_of_pairs(spark, monkeypatch):
    rng = random.Random(12)
    template = prose(rng, 350, 10 ** 9)
    # Each is 0.777 alike with each other, the last two are 0.803 alike.
    rows = [f"{template} {prose(rng, 50, 10 ** 9)}" for _ in range(150)]
    both = prose(rng, 7, 10 ** 9)
    rows += [f"{template} {both} {prose(rng, 43, 10 ** 9)}" for _ in range(2)]
    monkeypatch.setattr(probminhash, "SIGNED_BLOCK", 40, raising=False)
    monkeypatch.setattr(probminhash, "TEXT_BLOCK", 15, raising=False)
    written, keep = {}, probminhash.stored

    def stored(df, name):
        kept = keep(df, name)
        written[name] = max(written.get(name, 0), kept.count())
        return kept

    monkeypatch.setattr(probminhash, "stored", stored)
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in probminhash.near_duplicates(table).collect()}
    assert found == {i: min(i, 150) for i in range(152)}
    assert max(written.values()) <= probminhash.BANDS * len(rows)


def test_a_component_meets_hubs_without_a_link(spark):
    rows = [(1, 10, 10), (1, 11, 10), (1, 12, 12)]
    members = spark.createDataFrame(rows, "key long, node long, root long") \
        .withColumn("size", F.when(F.col("root") == 10, 2).otherwise(0))
    drawn = [{(r.a, r.b) for r in probminhash._rest(members, turn).collect()} for turn in range(1, 9)]
    assert any({(10, 12), (11, 12)} <= pairs for pairs in drawn)


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(3)
    elements = rng.integers(1, 2 ** 62, 300).astype(np.uint64)
    x, y = rng.integers(0, 4, 300), rng.integers(0, 4, 300)
    one, two = (np.flatnonzero(v) for v in (x, y))
    text = np.concatenate((np.zeros(len(one), np.int64), np.ones(len(two), np.int64)))
    won = probminhash.prob_min_hash(text, np.concatenate((elements[one], elements[two])),
                                    np.concatenate((x[one], y[two])).astype(float), 2, 4000)
    order = np.argsort(elements)
    exact = probminhash.probability_jaccard(
        (elements[order][x[order] > 0], x[order][x[order] > 0].astype(float)),
        (elements[order][y[order] > 0], y[order][y[order] > 0].astype(float)))
    slow = similarity(collections.Counter({i: int(c) for i, c in enumerate(x) if c}),
                      collections.Counter({i: int(c) for i, c in enumerate(y) if c}))
    assert exact == pytest.approx(slow)
    assert abs((won[0] == won[1]).mean() - exact) < 0.04


def test_quality_statistics_and_outliers(spark, docs):
    plain = {r.doc_id: r for r in outliers.judge(docs).collect()}
    for i, t in rows_of(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        count = collections.Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        cover = {k + j for k in range(len(w) - 4) if count[tuple(w[k:k + 5])] > 1 for j in range(5)}
        r = plain[i]
        failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                r.base_failed) == (len(w), sum(map(len, w)),
                                   len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover), failed)
        assert not (r.base_failed and r.kept)
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(20, 300), 5000), "en", "s") for i in range(400)]
    rows += [(1000 + i, " ".join(f"w{rng.randrange(9999)}***" for _ in range(100)), "en", "s")
             for i in range(20)]
    judged = outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert {r.doc_id for r in judged.where("not kept").collect()} == set(range(1000, 1020))
    assert outliers.judge(docs.limit(0)).count() == 0
    assert outliers.keep_sound(docs).columns == docs.columns


def test_trie_and_scores(spark, docs):
    values = np.sort(np.random.default_rng(1).integers(0, 10 ** 9, 5000)).astype(np.uint64)
    for v in (values, values[:1], values[:0], np.zeros(9, np.uint64)):
        assert (ngram_trie.EliasFano.of(v).values() == v).all()
    rows = docs.withColumn("held", F.col("doc_id") % 4 == 1)
    found = ngram_trie.score_texts(rows, "held").collect()
    tokens = [(r.doc_id, bool(r.held), [w.lower() for w in (r.text or "").encode().split()] + [None])
              for r in rows.collect()]
    c, cv, cb = collections.Counter(), collections.Counter(), collections.Counter()
    for _, held, t in tokens:
        if not held:
            c.update(t)
            cv.update(["<s>"] + t[:-1])
            cb.update(zip(["<s>"] + t, t))
    n, v = sum(c.values()), len(c)
    base = {i: (sum(np.log10((c[w] + .1) / (n + .1 * (v + 1))) for w in t), sum(
        np.log10(cb[a, b] / (cv[a] + 2)) if cb[a, b] else
        np.log10(2 / (cv[a] + 2) * (c[b] + .1) / (n + .1 * (v + 1)))
        for a, b in zip(["<s>"] + t, t)), sum(c[w] > 0 for w in t), len(t)) for i, _, t in tokens}
    assert len(found) == len(tokens)
    for r in found:
        b, s, known, size = base[r.doc_id]
        assert (r.n_known, r.n_tokens, r.train_tokens) == (known, size, n)
        assert r.base_score == pytest.approx(b) and abs(r.score - s) < 0.02 * size
    assert ngram_trie.score_texts(rows.limit(0), "held").count() == 0


def test_trie_in_mapped_memory(tmp_path):
    v, w = np.array([5, 5, 9], np.uint64), np.array([2, 9, 5], np.uint64)
    trie = ngram_trie.Trie.of(v, w, np.array([-1., -2., -3.]), np.array([5, 9], np.uint64), np.array([-.5, -.7]))
    (tmp_path / "t").write_bytes(trie.to_bytes())
    with open(tmp_path / "t", "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as m:
        known, weight, log_p = ngram_trie.Trie.from_buffer(bytes(m)).look_up(
            np.array([5, 9, 9, 7], np.uint64), np.array([9, 5, 9, 9], np.uint64))
    assert known.tolist() == [True, True, True, False]
    assert log_p[:2] == pytest.approx([-2, -3], abs=0.02) and np.isnan(log_p[2:]).all()


def test_main_text(spark):
    page = ("<html><head><title>T</title><script>x</script></head><body><nav><a>m</a></nav>"
            "<div class='cookie-notice'>c</div><article><h1>H&amp;</h1><p><b>One  two<br><p>x</p>"
            "<form>f</form><section id=comments><p>no</p></section></article><footer>f</footer>")
    assert html_text.main_text(page) == "H&\nOne two\nx"
    assert html_text.main_text(None) == html_text.main_text("") == ""
    pages = spark.createDataFrame([(1, page, 5), (2, None, 5), (3, "", 5), (4, "<p", 5)],
                                  "page_id long, html string, n_chars int")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract_main_text(pages).collect()}
    assert got[1] == ("H&\nOne two\nx", 12) and got[2] == got[3] == ("", 0)


@pytest.mark.parametrize("opening, closing", [
    ("<div class='layout has-sidebar'>", "</div>"), ("<div id='page-with-comments'>", "</div>"),
    ("<div class='search-result post'>", "</div>"), ("<div class='hidden-xs hasNavbar'>", "</div>"),
    ("<form action='/'>", "</form>"), ("<div role='form'><form>", "</form></div>")])
def test_main_text_in_wrappers_named_like_furniture(opening, closing):
    nav = "<nav><a>home</a><a>more</a></nav><div class='sidebar'><p>aside</p></div>"
    words = " ".join(f"w{i}" for i in range(60))
    inner = f"<div class='post-header'><h1>Title</h1></div><p>{words}</p><div class='share'>s</div>"
    page = f"<body>{opening}{nav}<article>{inner}</article>{closing}<footer>f</footer></body>"
    assert html_text.main_text(page) == f"Title\n{words}"
    plain = f"<body>{opening}{nav}<p>{words}</p><p>{words}</p>{closing}<footer>f</footer></body>"
    assert html_text.main_text(plain) == f"{words}\n{words}"


def test_main_text_without_an_article():
    words = [" ".join(f"w{k}{i}" for i in range(40)) for k in range(4)]
    links = "".join(f"<li><a href=/{i}>l{i}</a></li>" for i in range(12))
    text = "".join(f"<p>{w}</p>" for w in words)
    page = f"<body><div><ul>{links}</ul></div><div>{text}</div><div><ul>{links}</ul></div></body>"
    assert html_text.main_text(page) == "\n".join(words)
    flat = f"<body><ul>{links}</ul>{text}<ul>{links}</ul></body>"
    lines = html_text.main_text(flat).split("\n")
    assert [t for t in lines if t in words] == words and len(lines) <= 8


@pytest.mark.parametrize("group", [4000, 1])
def test_repeats(docs, group):
    found = substrings.find_repeats(docs, group=group).collect()
    words = [(r.text or "").encode().split() for r in found]
    count = collections.Counter(tuple(w[i:i + 35]) for w in words for i in range(len(w) - 34))
    for r, w in zip(found, words):
        gone = {i + k for i in range(len(w) - 34) if count[tuple(w[i:i + 35])] > 1 for k in range(35)}
        assert {k for s in r.repeats for k in range(s.first, s.end)} == gone
    shorter = substrings.without_repeats(docs)
    assert shorter.columns == docs.columns and shorter.count() == docs.count()
    assert substrings.find_repeats(docs.limit(0)).count() == 0


def test_pieces(spark, docs):
    model = queries.tokenizer_path()
    lib = pieces.codec(model).library
    rng = random.Random(4)
    odd = ["".join(rng.choice(" ▁\n\t\rab thé日\x00ﬃ😀*1'") for _ in range(rng.randint(0, 25)))
           for _ in range(500)]
    table = docs.select("doc_id", "text").union(
        spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"))
    coded = pieces.decode_pieces(pieces.encode_pieces(table, model), model)
    for r in pieces.piece_digests(coded, model).collect():
        ids = lib.encode(r.text or "")
        assert r.ids == ids and r.decoded == lib.decode(ids) and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_languages(spark, docs):
    rows = [(i, t, lang) for i in range(30) for t, lang in (
        ("the cat and the dog with this thing", "en"), ("der hund und die katze mit diesem", "de"))]
    learnt = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language.collect_profiles(language.language_profiles(learnt))
    code, n = " ".join(t for _, t, lang in rows if lang == "de"), collections.Counter()
    for w in re.findall(r"[^\W\d_]+", code):
        for k in (1, 2, 3):
            n.update(g for g in (f" {w} "[i:i + k] for i in range(len(w) + 3 - k)) if g != " ")
    best = sorted(n, key=lambda g: (-n[g], sum(
        ord(x) << 21 * (len(g) - 1 - j) for j, x in enumerate(g))))[:400]
    assert [language.spelled(c) for c in profiles["de"]] == best
    told = {r.text: (r.lang_pred, r.score) for r in language.identify_language(docs.select(
        "doc_id", "text").union(learnt.select("doc_id", "text")), profiles).collect()}
    assert told[rows[0][1]][0] == "en" and told[rows[1][1]][0] == "de"
    assert told[None] == told[""] == ("und", 0.0) and all(0 <= s <= 1 for _, s in told.values())
    assert language.identify_language(docs, {}).where("lang_pred <> 'und'").count() == 0


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    good = [(100 + i, prose(rng, 120, 9000), "en", "s", 1) for i in range(30)]
    leak = prose(rng, 30, 9000)
    shared = prose(rng, 60, 9000)
    rows = good + [(200, prose(rng, 50, 9000) + " " + leak, "en", "s", 1),
                   (201, good[0][1], "en", "s", 1), (202, good[1][1] + " tail", "en", "s", 1),
                   (203, "too short", "en", "s", 1), (204, None, None, None, None),
                   (205, prose(rng, 90, 9000) + " " + shared, "en", "s", 1),
                   (206, shared + " " + prose(rng, 90, 9000), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in good} | {205, 206}
    assert all(got[i].text == t for i, t, *_ in good) and all(r.decodes for r in got.values())
    for i in (205, 206):
        assert len(got[i].text.split()) == 90 and shared[:40] not in got[i].text
        assert got[i].n_chars == len(got[i].text)
