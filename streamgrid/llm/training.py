"""Bounded training samples and plain optimisers for the text classifiers."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamgrid.llm.common import free_name

#: Rows that a classifier is fitted on at most: labelled ones, and as many without labels.
SAMPLE_ROWS = 12_000


def held_out(doc_id: Column) -> Column:
    """Whether the labels of a document are never learned from: crc32 of the id as text is divisible by 5.

    A null id is not held out.
    """
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def few_ids(ids: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` of the distinct ``doc_id``, the first by a hash of it.

    Ids whose hash is too high to be among them are left out where they lie, by a bound from their approximate number,
    so that only about ``rows`` ids are sorted, however many partitions there are.
    """
    many = ids.agg(F.approx_count_distinct("doc_id", 0.02).alias("n")).first()["n"]
    if many > 2 * rows:
        share = 1.25 * (rows + 8 * math.sqrt(rows) + 32) / many
        ids = ids.filter(F.xxhash64("doc_id") <= F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64))))
    return ids.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), F.col("doc_id")).limit(rows)


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, label): at most ``rows`` labelled documents that are not held out, and as many without labels.

    Both are the first by a hash of the id, so the same documents give the same sample; label is null for the others.
    Of several labels of a document the largest counts, of several texts of an id the smallest by a hash. Both bounds
    are parameters of the fit alone: scores are of all documents. The ids are few by that bound and go to the documents
    as a broadcast; no task sorts texts.
    """
    usable = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    )
    known = usable.join(F.broadcast(few_ids(usable.select("doc_id"), rows)), "doc_id")
    others = few_ids(docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id"), rows)
    wanted = known.unionByName(others.withColumn("label", F.lit(None).cast("int")))
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(wanted), "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")
    return found.groupBy("doc_id", "label").agg(one).select("doc_id", "text", "label")


def in_order(table: pa.Table) -> pa.Table:
    """The rows of a sample as collected, in an order that does not depend on the tasks."""
    return table.sort_by([("doc_id", "ascending"), ("label", "ascending")])


def scored(df: DataFrame, score: Column, threshold: float) -> DataFrame:
    """Add ``score`` and ``predicted``; columns of these names are replaced."""
    held = free_name(df.columns, "_score")
    df = df.withColumn(held, score)
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("score", "predicted", held)]
    return df.select(*kept, F.col(held).alias("score"), (F.col(held) >= threshold).cast("int").alias("predicted"))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def descend(gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Adam from ``start``."""
    w, mean, square = start.astype(float).copy(), np.zeros(len(start)), np.zeros(len(start))
    for i in range(1, steps + 1):
        g = gradient(w)
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        w -= rate * (mean / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.999**i)) + 1e-8)
    return w
