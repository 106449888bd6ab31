"""One query for each operator, over its whole table, and the SQL where SQL can express it."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuadre.llm import ann, bpe, exact_dedup, langid, merkle, minhash, mixing, ngram_join, phrases, pii, ppm, preference, training_order
from cuadre.llm.common import documents, stage
from cuadre.llm.sql import OP11_SQL, OP12_SQL, OP13_SQL
from cuadre.session import ensure_checkpoint_dir

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PPM and unigram scores of every document, learned from four fifths of them."""
    return ppm.score(documents(spark, sf_dir))


def op2_bpe(spark: SparkSession, sf_dir: str, vocab_path: str = VOCABULARY) -> DataFrame:
    """Ids of every document by the pair occurrence index, and the text they decode to, as digests."""
    return bpe.digests(bpe.encode_documents(documents(spark, sf_dir), vocab_path))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates in place of its entities."""
    return pii.replace(documents(spark, sf_dir))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of at least 0.8 Jaccard on 5-word shingles."""
    return ngram_join.components_of(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op5_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as the chosen one of a pair: prompt, completions and masks."""
    pairs = preference.pairs_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return preference.format_pairs(pairs, ("chosen_id", "rejected_id"))


def op6_training_order(spark: SparkSession, sf_dir: str, vocab_path: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """Shards of the token ids of every document, written under ``folder`` (in the checkpoint folder unless given); slot
    and place of every sequence written, and the digest of its ids."""
    with open(vocab_path, "rb") as f:
        vocab = bpe.Vocabulary(f.read())
    end, pad = training_order.marks(vocab)
    id_bytes = 2 if max(end, pad) < 1 << 16 else 4
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    made = training_order.write_shards(documents(spark, sf_dir), folder, rows=True, encode=bpe.encoding(spark, vocab_path, id_bytes),
                                       id_bytes=id_bytes, end_id=end, pad_id=pad)
    return stage(made, "written")  # once, whatever is read of it


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four fifths of them."""
    docs = documents(spark, sf_dir)
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || 'mix-1') AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS INTEGER) + 1] AS DOUBLE) AS weight,
         source_size * 2.0::DOUBLE AS cap FROM s),
f AS (
  SELECT *, cap / weight AS level,
         ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE
          - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS flat
  FROM w),
x AS (SELECT level AS l0, flat AS f0 FROM f WHERE flat <= level ORDER BY level, source IS NULL, encode(source) LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN l0 IS NULL OR level < l0 THEN cap ELSE least(weight * f0, cap) END AS target,
         CAST(('0x' || substr(md5(coalesce(source, '') || 'mix-1'), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS shift
  FROM f LEFT JOIN x ON true),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.shift,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.key, d.doc_id) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST((floor(k * rate + shift) - floor((k - 1) * rate + shift)) AS BIGINT) * CAST(size AS BIGINT) AS taken
FROM r
"""


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document stays for every document, with the group's size."""
    return exact_dedup.dedup(documents(spark, sf_dir)).drop("row")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS size,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY size DESC, doc_id)
"""


def op10_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest other vectors of every twentieth vector."""
    found = ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 20 == 0, k=20)
    return found.withColumnRenamed("id", "vec_id")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of every language."""
    return phrases.collocations(documents(spark, sf_dir))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of at least 0.85 Jaccard on 5-word shingles."""
    return minhash.near_copies(documents(spark, sf_dir))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and verdict of every document, a fifth of them tampered with."""
    return merkle.manifest(documents(spark, sf_dir))


QUERIES = {"op1_ppm": op1_ppm, "op2_bpe": op2_bpe, "op3_pii": op3_pii, "op4_ngram_join": op4_ngram_join,
           "op5_preference": op5_preference, "op6_training_order": op6_training_order, "op7_langid": op7_langid,
           "op8_mixing": op8_mixing, "op9_exact_dedup": op9_exact_dedup, "op10_curves": op10_curves,
           "op11_phrases": op11_phrases, "op12_minhash": op12_minhash, "op13_merkle": op13_merkle}
ORACLES = {"op8_mixing": OP8_SQL, "op9_exact_dedup": OP9_SQL, "op11_phrases": OP11_SQL,
           "op12_minhash": OP12_SQL, "op13_merkle": OP13_SQL}
