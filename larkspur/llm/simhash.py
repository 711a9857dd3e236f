"""Near-duplicate groups by 64-bit SimHash and deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import counted, same_row, text_column, unused, without
from larkspur.llm.components import connected_components
from larkspur.session import checkpointed

SHINGLE, BITS, SEGMENT = 3, 64, 32
#: Shingles whose bits are summed at once.
BLOCK = 1 << 16
#: Fingerprints whose variants one task makes.
SPREAD = 100_000


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """SimHash of the text: bit b is set if more than half of the shingles' XXH64 values have it.

    A-Z is lower-cased, words are split at ASCII white space, shingles are `width` words joined by a space and
    count as often as they occur; fewer words are one shingle; no words give 0.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    n = max(1, len(words) - width + 1)
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), shingles), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        bits = np.unpackbits(h[at : at + BLOCK].astype(">u8").view(np.uint8)).reshape(-1, BITS)
        ones += bits.sum(axis=0, dtype=np.int64) if len(bits) > 250 else bits.sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in text_column(batch, "text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "text_hash", "fp"])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp): one row per row of `docs`; fp is the SimHash as a signed 64-bit number. Null text is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long")


def _variants(fps: DataFrame) -> DataFrame:
    """(key, fp): for both 32-bit segments, the segment with each of its bits deleted in turn, tagged by segment and bit."""
    keys = []
    for s in range(BITS // SEGMENT):
        part = F.shiftrightunsigned("fp", SEGMENT * s).bitwiseAND(F.lit((1 << SEGMENT) - 1))
        keys += [part.bitwiseAND(F.lit(((1 << SEGMENT) - 1) ^ (1 << b))).bitwiseOR(F.lit((s * SEGMENT + b) << SEGMENT)) for b in range(SEGMENT)]
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _spread(fps: DataFrame) -> DataFrame:
    """Materialised fingerprints dealt to as many tasks as their number asks for: a few bytes each, but soon 64 rows."""
    tasks = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), fps.count() // SPREAD + 1)
    return fps.repartition(tasks, "fp")


def _neighbours(fps: DataFrame) -> DataFrame:
    """(near, fp): the fingerprint itself and all 64 at one bit's distance."""
    flips = [F.lit(0).cast("long"), *(F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long") for b in range(BITS))]
    return fps.select(F.explode(F.array(*(F.col("fp").bitwiseXOR(x) for x in flips))).alias("near"), "fp")


def link_fingerprints(fps: DataFrame) -> DataFrame:
    """Edges (u, v) whose components are those of "at most 2 bits apart" among the distinct fingerprints `fps` (fp).

    Two fingerprints at distance 2 or less differ by at most one bit in one of two segments, and so share a
    one-wildcard variant of it. A variant of exactly two fingerprints is a pair to verify. Fingerprints of a more
    frequent variant are not paired with one another: they meet at the values one bit away from them (two
    fingerprints are at distance 2 or less exactly if they share one), each linked to the least fingerprint there.
    So the edges stay linear in the fingerprints however many near copies there are.
    """
    variants = _variants(_spread(fps))
    keys = variants.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1")
    keys = checkpointed(keys)
    pairs = keys.where("n = 2").select("u", "v").where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2)
    crowded = variants.join(keys.where("n > 2").select("key"), "key", "left_semi").select("fp").distinct()
    near = checkpointed(_neighbours(crowded))
    least = near.groupBy("near").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1")
    stars = near.join(least, "near").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.unionByName(stars).distinct()


def _rooted(found: DataFrame, first: Column) -> DataFrame:
    """(fp, first, root) of each distinct fingerprint: the least `first` of its rows and the least fingerprint it is linked to."""
    fps = checkpointed(found.groupBy("fp").agg(F.min(first).alias("first")))
    parts = connected_components(link_fingerprints(fps.select("fp")))
    return fps.join(parts, fps.fp == parts.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, fp, component_id.

    component_id is the least doc_id among the documents reachable through links of 2 or fewer differing bits;
    equal texts link, as do all texts without words (fp 0). Null doc_ids get a group but never name one (a group
    of null ids only has a null component_id). Repeated rows are returned as often as they occur.
    """
    found = checkpointed(with_fingerprints(docs).drop("text_hash"))
    named = _rooted(found, F.col("doc_id"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = checkpointed(named.join(least, "root").select(F.col("fp").alias("label_fp"), "component_id"))
    return found.join(labels, found.fp == labels.label_fp).select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without all but one of each group of near duplicates: that of the least doc_id (null last).

    Rows of one doc_id and one text are told apart by nothing, and one of them stays. Rows are taken out by the keys of
    those to drop, so that texts stay where they are for as long as the keys are few enough to broadcast.
    """
    found = checkpointed(with_fingerprints(docs))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    best = _rooted(found, first).groupBy("root").agg(F.min("first").alias("best")).select(F.col("best.doc_id").alias("best_id"), F.col("best.text_hash").alias("best_hash"))
    rows = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    rows = checkpointed(rows.join(best, rows.doc_id.eqNullSafe(best.best_id) & (rows.text_hash == best.best_hash), "left"))
    repeated = checkpointed(rows.where("best_hash is not null and n > 1").select("doc_id", "text_hash"))
    once = without(docs, checkpointed(rows.where("best_hash is null or n > 1").select("doc_id", "text_hash")))
    if repeated.isEmpty():
        return once
    key = [unused(docs, "__id"), unused(docs, "__hash")]
    names = repeated.select(F.col("doc_id").alias(key[0]), F.col("text_hash").alias(key[1]), "doc_id", "text_hash")
    twice = docs.join(counted(names), same_row(docs, names)).select(*(docs[c] for c in docs.columns), *key)
    return once.unionByName(twice.dropDuplicates(key).drop(*key))


def op10(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id for every row of `docs`."""
    return near_duplicate_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
