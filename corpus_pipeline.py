"""The corpus pipeline: five stages over documents, each on all that its predecessor kept.

Language ID rejects documents to which the network gives no wanted language with at
least CONFIDENCE (null texts and texts without letters get none at all; where no row
has a language to learn from, all texts with letters stay); toxicity rejects
predicted toxic ones; line dedup takes out lines that an earlier line is near to, and
documents that lose all their lines; the n-gram join keeps the document of smallest id
of each group of near copies; packing returns pieces of token sequences.

Cases: null texts go at the first stage; texts of any length are read whole; repeated
rows of one doc_id share the fate of that id, but for line dedup, which tells them apart
by text; ties follow the operators; further columns pass through all stages but the
last; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import fold_of, materialize, table
from graphloom.llm.language_id import classify, fit
from graphloom.llm.line_dedup import dedup_lines
from graphloom.llm.ngram_join import ngram_jaccard_join
from graphloom.llm.packing import pack_documents
from graphloom.llm.queries import vocabulary_path
from graphloom.llm.toxicity import predict_toxicity

#: Languages to keep; None: all that the corpus names.
WANTED: tuple[str, ...] | None = None
#: Mean probability of its language that a document needs; every learned one alike would give 1 / their number.
CONFIDENCE = 0.3
#: Toxicity from which a document goes.
TOXIC = 0.3


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs whose doc_id is not in rejected (doc_id)."""
    return docs.join(rejected.select(F.col("doc_id").alias("__id")).distinct(), F.col("doc_id") == F.col("__id"), "left_anti")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    languages, network = fit(docs, lambda doc_id: fold_of(doc_id, 5) != 0)
    if network is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    said = classify(docs, (languages, network))
    wanted = F.col("lang_pred").isin(list(WANTED or languages)) & (F.col("score") >= CONFIDENCE)
    return _without(docs, said.where(~wanted))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = predict_toxicity(docs, table(spark, sf_dir, "labels"), TOXIC)
    return _without(docs, scored.where("predicted = 1"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    grouped = ngram_jaccard_join(docs)
    return _without(docs, grouped.where("component_id <> doc_id"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pack_documents(docs, vocabulary_path())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_copy_stage),
    ("packing", packing_stage),
]

#: Trained models and learned tokens have no SQL form; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
