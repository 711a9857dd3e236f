"""Labelled rows for the trained operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.session import checkpointed

#: Labelled documents that a model is fitted on at most: those of the smallest hash of their doc_id.
MAX_LABELLED = 20_000


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of all fitting; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_docs(docs: DataFrame, labels: DataFrame, label: str, most: int = MAX_LABELLED) -> DataFrame:
    """(text, label double) of at most `most` labelled documents outside the held-out fold, one row for each doc_id.

    Of several texts of a doc_id the one of the least hash counts, of several labels the least; labels without a document
    count for nothing. Only ids and hashes are joined and ordered. The ids chosen are of fixed number and so small enough
    to broadcast; the texts stay where they are.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("double").alias("label"))
    own = own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.min("label").alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keys = texts.select("doc_id", F.xxhash64("text").alias("hash"))
    found = keys.join(own, keys.doc_id == own.id).groupBy("id").agg(F.min("hash").alias("hash"), F.first("label").alias("label"))
    found = checkpointed(found.orderBy(F.xxhash64("id"), "id").limit(most))
    rows = texts.join(F.broadcast(found), (texts.doc_id == found.id) & (F.xxhash64(texts.text) == found.hash))
    return rows.groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label")).select("text", "label")
