"""Registered queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logstrata.llm import (codes, decontamination, html_text, language, mixing, negatives,
                           ngram_trie, outliers, pieces, probminhash, sharding, substrings, warc)
from logstrata.llm.common import append_columns, byte_texts, documents
from logstrata.session import scratch_path

N_SHARDS = 40


def tokenizer_path() -> str:
    """The vocabulary file; LOGSTRATA_PIECE_MODEL names another one."""
    named = os.environ.get("LOGSTRATA_PIECE_MODEL")
    if named:
        return named
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def id_remainder(modulus: int):
    """crc32 of the id as text, by a modulus; an id that is null counts as empty text."""
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % modulus


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = decontamination.find_benchmark_text(docs, documents(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    rows = documents(spark, sf_dir).select(
        "doc_id", (F.length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"))
    placed = sharding.shuffle_into_shards(rows, N_SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                         F.col("slot").cast("long").alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(documents(spark, sf_dir, "pages"), path)
    read = warc.read_warc(spark, path).where("kind = 'record'")
    return read.select(F.expr("try_cast(record_id as bigint)").alias("page_id"), "payload_bytes",
                       "payload_digest", "record_type",
                       F.col("refers_to").cast("long").alias("refers_to"))


def op4_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    return outliers.judge(docs).drop("lang", "source")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text",
                                           (id_remainder(10) == 0).alias("held_out"))
    return ngram_trie.score_texts(docs, "held_out")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = documents(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract_main_text(pages).select("page_id", "url", "text", "n_chars")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")

    def digest():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            found = [substrings.kept_words(text, runs) for text, runs in
                     zip(byte_texts(batch.column(0)), batch.column(1).to_pylist())]
            return [pa.array([f[0] for f in found], pa.int64()),
                    pa.array([f[1] for f in found], pa.int64()),
                    pa.array([hashlib.sha256(f[2]).hexdigest() for f in found], pa.string())]
        return work

    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
              T.StructField("kept_sha256", T.StringType())]
    marked = append_columns(substrings.find_repeats(docs), fields, digest, ["text", "repeats"])
    return marked.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pieces.piece_digests(docs, tokenizer_path()).drop("text")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang",
                                           (id_remainder(4) == 2).alias("held_out"))
    learnt = language.language_profiles(docs.where("not held_out"))
    profiles = language.collect_profiles(learnt)
    told = language.identify_language(docs.select("doc_id", "held_out", "text"), profiles)
    return told.select("doc_id", "held_out", "lang_pred", "score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    coded, books = codes.compress_vectors(rows)
    hex_of = F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0")))
    return coded.select("vec_id", F.array_join(hex_of, "").alias("code"), "error", "label_error",
                        F.lit(codes.codebooks_digest(books)).alias("codebooks_sha256"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_words(documents(spark, sf_dir).select("doc_id", "text", "source"))


QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_sharding, op3_warc, op4_probminhash, op5_quality_rules, op6_lm_scoring,
    op7_html_extraction,
    op8_substring_dedup, op9_sentencepiece, op10_language_id, op11_hard_negatives,
    op12_vector_codes, op13_source_mix)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = (f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

_SOUND = """embedding IS NOT NULL
                  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


def _whole_sql(factor: int) -> str:
    return f"list_transform(embedding, lambda x: CAST(floor({factor} * CAST(x AS DOUBLE)) AS BIGINT))"


def _codes_sql() -> str:
    """The rounds of op12 as one statement; vectors have one length, which 8 divides."""
    square = "list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for k in range(codes.ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
            SELECT r, x.p, e, CAST(d AS BIGINT) AS d, x.v FROM (
                SELECT x.r, x.p, c.e, x.v, {square} AS d FROM x JOIN c{k} c ON x.p = c.p) x
            QUALIFY row_number() OVER (PARTITION BY r, x.p ORDER BY d, e) = 1)""")
        if k < codes.ROUNDS:
            steps.append(f"""c{k + 1} AS MATERIALIZED (
            SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN (
                SELECT p, e, list(g ORDER BY j) AS v FROM (
                    SELECT p, e, j, CAST(floor(sum(w) / count(*)) AS BIGINT) AS g FROM (
                        SELECT p, e, unnest(v) AS w, unnest(range(1, len(v) + 1)) AS j FROM a{k})
                    GROUP BY p, e, j) GROUP BY p, e) m ON c.p = m.p AND c.e = m.e)""")
    last = f"a{codes.ROUNDS}"
    return f"""
        WITH v AS (
            SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, {_whole_sql(4096)} AS q
            FROM embeddings WHERE {_SOUND}),
        x AS MATERIALIZED (
            SELECT r, p, q[p * (len(q) // 8) + 1:(p + 1) * (len(q) // 8)] AS v
            FROM v, range(0, 8) t(p)),
        c0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM x WHERE r <= 16),
        {", ".join(steps)},
        coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code,
                         CAST(sum(d) AS BIGINT) AS error FROM {last} GROUP BY r),
        books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h
                  FROM c{codes.ROUNDS})
        SELECT vec_id, code, error,
               CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               h AS codebooks_sha256
        FROM v JOIN coded USING (r), books"""


ORACLES = {
    "op1_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        win AS (
            SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM (
                SELECT item_id, w, least(10, len(w)) AS k,
                       unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p
                FROM i WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT k FROM win),
        dw AS (
            SELECT r, k, p, array_to_string(w[p:p + k - 1], ' ') AS s FROM (
                SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p
                FROM d JOIN sizes ON len(w) >= k)),
        hit AS (SELECT r, item_id, dw.k, p FROM dw JOIN win ON dw.k = win.k AND dw.s = win.s),
        covered AS (
            SELECT r, count(DISTINCT q) AS n FROM (
                SELECT r, unnest(range(p, p + k)) AS q FROM hit) GROUP BY r),
        named AS (
            SELECT r, count(*) AS n, string_agg(t, ',' ORDER BY t) AS s FROM (
                SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS t FROM hit) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(m.n, 0) AS BIGINT) AS n_items,
               sha256(coalesce(m.s, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered c USING (r) LEFT JOIN named m USING (r)""",
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        f AS (SELECT page_id, body, min(page_id) OVER (PARTITION BY body) AS first FROM p),
        h AS (SELECT *, sha1(body) AS x FROM f)
        SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda q: substr(
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
                       (CAST('0x' || substr(x, CAST(q // 4 AS BIGINT) * 5 + 1, 5) AS BIGINT)
                        >> (15 - 5 * (q % 4))) & 31 AS BIGINT), 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM h""",
    "op8_substring_dedup": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(
                coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        win AS (
            SELECT r, p, sha256(array_to_string(w[p:p + 34], ' ')) AS s FROM (
                SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
        twice AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
        gone AS (
            SELECT DISTINCT r, unnest(range(p, p + 35)) AS q FROM win SEMI JOIN twice USING (s)),
        words AS (SELECT r, unnest(range(1, len(w) + 1)) AS q, unnest(w) AS x FROM d),
        kept AS (
            SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY q) AS t
            FROM words ANTI JOIN gone USING (r, q) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
               CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (r)""",
    "op11_hard_negatives": f"""
        WITH e AS (
            SELECT vec_id AS i, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l,
                   {_whole_sql(256)} AS q
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_SOUND}),
        s AS (
            SELECT a.i AS a, a.l AS al, b.i AS b, b.l AS bl, CAST(list_sum(list_transform(
                       list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS s
            FROM e a JOIN e b ON a.i % 100 = 0),
        p AS (
            SELECT a, al, b, s FROM s WHERE al = bl AND a <> b
            QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
        SELECT p.a AS anchor_id, p.b AS positive_id,
               CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS INT) AS "rank",
               s.b AS negative_id, p.s AS positive_score, s.s AS negative_score
        FROM p JOIN s ON p.a = s.a AND s.bl <> s.al
                     AND 80 * p.s <= 100 * s.s AND 100 * s.s <= 100 * p.s
        QUALIFY "rank" <= 5""",
    "op12_vector_codes": _codes_sql(),
}
