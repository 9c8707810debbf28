"""From documents to tokens: quality, near copies, personal data, mixture of sources, encoding.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. ``run`` writes each stage's
rows to the shared folder and reads them again for the next.

Columns other than those of documents are left out, whatever their names. A null text is taken for an empty one and
stays null where it stays. Rows without an id are kept by ``near_copies``, learned from by nothing, and otherwise treated
like others; repeated rows are copies of each other, of which ``near_copies`` keeps one if they have an id. Every stage
gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamgrid.llm import bpe, mixing, neardup, pii, quality_model
from streamgrid.llm.common import DOCUMENTS, cut, prepare, table
from streamgrid.llm.queries import VOCABULARY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones; it learns from their labels and from the other documents.

    Without any label of a good document nothing is learned, and all documents stay.
    """
    prepare(spark)
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    return quality_model.score(docs, model).filter("predicted = 1").select(*DOCUMENTS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id."""
    prepare(spark)
    return neardup.keep_one(docs).select(*DOCUMENTS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    prepare(spark)
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*DOCUMENTS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture of sources takes, as often as it takes them, in shuffled shards.

    Documents without words are never taken; a null source is a source of its own.
    """
    prepare(spark)
    return mixing.mix(docs).select(*DOCUMENTS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its number of tokens and the digests of its token ids and of the text decoded from them."""
    prepare(spark)
    return bpe.digest(docs, VOCABULARY).select(*DOCUMENTS, "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: Trained models and signatures are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, f"pipeline-{name}")
    return docs
