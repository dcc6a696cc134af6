"""A training-corpus pipeline: five stages from documents to a training order.

Every stage works on all that the stage before kept and is written as Parquet
before the next reads it.  Decisions are made on rows, never on ids, so rows that
share a doc_id or have none are judged apart; further columns are carried along
whatever their names.  The last stage gives a row for each time the mix takes a
document, in training order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulint.llm import curriculum, decontaminate, neardup, q_tables, quality, secrets
from tabulint.plans.durable import saved, trimmed

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def lean(stage: Stage) -> Stage:
    """The stage, begun without what the stages before left in the driver's memory."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        trimmed(spark)
        return stage(spark, docs, sf_dir)

    return run


def held(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): whole rows beside what an operator reads, so that no name
    of a column can clash with the operator's."""
    return docs.select(F.struct("*").alias("row"), "doc_id", "text")


def numbered(docs: DataFrame) -> DataFrame:
    """(row, number) in a table of its own, so that every reading has the same numbers."""
    return saved(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("number")), "numbered")


@lean
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled neighbours vote for.  Null and empty texts
    get the sample's share of good ones; without labels every document stays."""
    found = quality.scores(held(docs), q_tables.quality_labels(spark, sf_dir), "quality", keep=("row",))
    return found.filter(F.col("score") >= q_tables.GOOD).select("row.*")


@lean
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies over 5-word shingles, the first row of
    it; texts without words stay."""
    rows = numbered(docs)
    kept = neardup.classes(rows.select("number", F.col("row.text").alias("text")), shingle=5, percent=80, doc_id="number").filter("kept").select("doc_id")
    return rows.join(kept, F.col("number") == F.col("doc_id"), "left_semi").select("row.*")


@lean
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.without(held(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=("row",)).select("row.*")


@lean
def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark in the text; n_chars follows."""
    marked = secrets.scan(held(docs), secrets.default_samples(spark))
    text = F.when(F.col("text").isNotNull(), secrets.redact(F.col("text"), F.col("secrets")))
    size = F.when(F.size("secrets") > 0, F.char_length(text).cast("long")).otherwise(F.col("row.n_chars"))
    return marked.select(F.col("row").withField("text", text).withField("n_chars", size).alias("row")).select("row.*")


@lean
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document, range-sorted by training position;
    documents that it does not take go.  Columns of the mix that the documents have too
    are not added."""
    taken = curriculum.training_order(curriculum.assign(docs.select("doc_id", "text", "source", F.struct("*").alias("row")), keep=("row",)))
    return taken.select("row.*", *[c for c in ("size", "source_size", "target", "taken", "copy", "position") if c not in docs.columns])


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
]
#: Trained models and sketches have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
