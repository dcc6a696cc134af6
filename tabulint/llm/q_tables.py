"""Queries that apply each operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulint.llm import contextmix, curriculum, decontaminate, features, langid, neardup, quality, secrets, substrings, tokens, transport

TOKENIZER = "byte_bpe_50k.json"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near copies over 2-word shingles at 80 percent."""
    return neardup.classes(documents(spark, sf_dir), shingle=2, percent=80)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with the item: a row a pair.
    Documents without one have no row."""
    found = decontaminate.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumn("contaminated", F.lit(True))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 1, 2, 3, ... by source, in training order;
    `position` is the first of a document's positions, null if it is not taken."""
    out = curriculum.assign(documents(spark, sf_dir))
    return (
        out.select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position"))
        .repartitionByRange(F.col("position").asc_nulls_last(), F.col("doc_id"))
        .sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")
    )


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS ord
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, CAST(rank % 3 + 1 AS DOUBLE) AS weight FROM r),
l AS (
  SELECT *, source_size / weight AS fill,
    (sum(source_size) OVER () - 3.0::DOUBLE * coalesce(sum(source_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS level
  FROM w WINDOW b AS (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT level FROM l WHERE level * weight <= 3.0 * source_size ORDER BY fill, rank LIMIT 1),
t AS (SELECT source, rank, source_size, CAST(coalesce(least(3.0 * source_size, (SELECT level FROM f) * weight), 3.0 * source_size) AS DOUBLE) AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.rank, t.source_size, t.target,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2 AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE (middle < target)::INT + (source_size + middle < target)::INT + (2 * source_size + middle < target)::INT END AS copies,
    middle / target AS share
  FROM p)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken,
  CASE WHEN copies = 0 THEN NULL
       WHEN rank % 3 = 0 THEN 2 * share / (0.5 + sqrt(0.25 + 2 * share))
       WHEN rank % 3 = 1 THEN share
       WHEN share <= 0.625 THEN 2 * share / (1.5 + sqrt(2.25 - 2 * share))
       ELSE 0.5 + 2 * (share - 0.625) / (1 + sqrt(greatest(1 - 2 * (share - 0.625), 0))) END AS position
FROM c
"""


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    out = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"), secrets.default_samples(spark))
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = secrets.written(F.filter("secrets", lambda s: s["kind"] != "markov"))
    return out.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(base, 256).alias("base_sha256"), secrets.written(F.col("secrets")).alias("spans"), of("markov"))


def op5_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Tokens of every document; SQL has no byte-pair encoding, so the tests
    compare with the tokenizers library."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    return tokens.token_counts(documents(spark, sf_dir), tokenizer, limit=1024)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those outside the held-out quarter."""
    docs = documents(spark, sf_dir).withColumn("held_out", features.bucket("doc_id", 4) == 2)
    return langid.identify(docs, docs.filter("not held_out"), keep=("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score")


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels outside the held-out fifth."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").filter(features.bucket("doc_id", 5) != 0)


#: Score from which a document counts as good.
GOOD = 0.3


def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document, learned outside the held-out fifth."""
    docs = documents(spark, sf_dir).withColumn("held_out", features.bucket("doc_id", 5) == 1).withColumn("learn", ~F.col("held_out"))
    out = contextmix.score(docs, "learn", keep=("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op9_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without words of 20-word windows that occur earlier."""
    return substrings.without_repeats(documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels outside the held-out fifth."""
    docs = documents(spark, sf_dir)
    out = quality.scores(docs.withColumn("held_out", features.bucket("doc_id", 5) == 0), quality_labels(spark, sf_dir), "quality", keep=("doc_id", "held_out"))
    return out.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def op7_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a transport stream and read back."""
    return transport.stream_digests(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_near_duplicates, op2_decontamination, op3_mixing, op4_secrets, op5_token_counts, op6_language_id, op7_transport_streams, op8_context_mixing, op9_repeated_spans, op10_quality)}
ORACLES: dict[str, str] = {"op3_mixing": OP3_SQL}
