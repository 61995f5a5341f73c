"""Registered queries of this subpackage: one thin query per operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peptarium.llm import (
    bbit_minhash,
    bit_whitening,
    complement_packing,
    language_id,
    line_runs,
    mixing,
    pii_crf,
    rendezvous,
    rule_ledger,
    scaled_sketch,
    spill_alignment,
    super_kmers,
    warc_index,
)
from peptarium.llm.common import table

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query(
    "op2_line_runs",
    r"""
WITH lines AS (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN [''] ELSE string_split(text, chr(10)) END AS l FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), judged AS (
  SELECT *, length(k) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY k) AS late FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (late) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT late), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_runs.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


@query("op4_scaled_sketch")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_sketch.fingerprints_with_edits(table(spark, sf_dir, "documents"))


@query("op6_complement_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complement_packing.pack(table(spark, sf_dir, "documents"), tokenizer())


@query(
    "op7_rule_ledger",
    r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), words AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM t
), tri AS (
  SELECT doc_id, p, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY p)
), hit AS (
  SELECT doc_id, p, z IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, x, y, z) > 1 AS h FROM tri
), covered AS (
  SELECT doc_id, h OR coalesce(lag(h, 1) OVER o, false) OR coalesce(lag(h, 2) OVER o, false) AS c FROM hit WINDOW o AS (PARTITION BY doc_id ORDER BY p)
), repeats AS (
  SELECT doc_id, count(*) FILTER (c) AS n FROM covered GROUP BY doc_id
), lines AS (
  SELECT doc_id, line, count(*) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line
), line_counts AS (
  SELECT doc_id, sum(k)::BIGINT AS n_lines, sum(k - 1)::BIGINT AS n_dup_lines FROM lines GROUP BY doc_id
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(r.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_ascii_letters
  FROM t LEFT JOIN repeats r USING (doc_id) LEFT JOIN line_counts USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 != 0 AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
  + CASE WHEN n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 60 * n_lines THEN 8 ELSE 0 END
  + CASE WHEN 100 * n_upper > 60 * n_ascii_letters THEN 16 ELSE 0 END
  + CASE WHEN word_chars > 20 * n_words OR 2 * word_chars < 3 * n_words THEN 32 ELSE 0 END)::INTEGER AS fail_bits FROM m)
""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = rule_ledger.ledger(table(spark, sf_dir, "documents"))
    return entries.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~rule_ledger.passes("base")).alias("base_failed"),
        rule_ledger.passes().alias("kept"),
        "fail_bits",
    )


@query("op9_word_first_language")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.detect(docs, language_id.train(docs))


@query("op5_super_kmers")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = super_kmers.cut_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


@query(
    "op10_bbit_minhash",
    r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM t
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, doc_id = c AS kept
FROM (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x) LEFT JOIN sizes USING (doc_id)
""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbit_minhash.near_duplicate_report(table(spark, sf_dir, "documents"))


@query(
    "op3_capture_index",
    r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), r AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS best FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN best > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN best > page_id THEN best END AS refers_to
FROM r
""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_index.round_trip(table(spark, sf_dir, "pages"))


@query("op8_temperature_mixing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "mix_epoch", "mix_block", "mix_weight")


@query("op1_skip_chain_pii")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_crf.find_personal_data(table(spark, sf_dir, "documents"))
    counts = [f"n_{k}" for k in pii_crf.KINDS]
    return found.select("doc_id", *counts, F.sha2(F.col("base_spans"), 256).alias("base_sha256"), "spans")


@query("op11_bit_sliced_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_whitening.whitening_report(table(spark, sf_dir, "embeddings"))


@query(
    "op12_rendezvous_shards",
    r"""
WITH crc AS (
  SELECT list(list_reduce([n] || range(1, 9), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
  FROM (SELECT unnest(range(256)) AS n)
), d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id::VARCHAR, '') AS k, strlen(coalesce(text, '')) + 1 AS size,
         xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, crc
), race AS (
  SELECT r, s, -ln((('0x' || substr(md5(k || ':' || s), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496) AS time
  FROM (SELECT r, k, unnest(range(9)) AS s FROM d)
), won AS (
  SELECT r, arg_min(s, time) FILTER (s < 8) AS shard, arg_min(s, time) AS grown_shard FROM race GROUP BY r
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard, grown_shard::INTEGER AS grown_shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot
FROM d JOIN won USING (r)
""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendezvous.shard_records(table(spark, sf_dir, "documents")).withColumn("law", F.lit("key"))


@query("op13_spill_counting")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return spill_alignment.alignment_report(docs, tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))
