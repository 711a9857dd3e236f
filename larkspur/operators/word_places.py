"""A positional word index: where each word stands in which text, phrases by intersection, and completions of what is typed."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Texts of one posting block, about.
BLOCK = 1000
#: Places after which those of the texts so far are handed on together.
AT_ONCE = 50_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def places(docs: DataFrame, key: str, text: str, pattern: str = "[a-z]+") -> DataFrame:
    """key, word, numbers, starts: for each word of a text with A-Z lower-cased, which words of the text it is and at which characters it begins (both from 0, ascending).

    A row has the places of one word in one text; null texts have none, repeated rows have theirs each.
    """
    kind = docs.schema[key].dataType.simpleString()

    def made(keys: pa.Array, rows: list[int], words: list[str], numbers: list[int], starts: list[int]) -> pa.RecordBatch:
        """The places of some texts' words, sorted by text and word; the sort keeps their order."""
        codes = pa.array(words, pa.string()).dictionary_encode()
        row = np.array(rows, np.int64)
        group = row * (len(codes.dictionary) + 1) + codes.indices.to_numpy()
        order = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.diff(group[order], prepend=-1))
        ends = pa.array(np.append(first, len(order)), pa.int32())
        lists = (pa.ListArray.from_arrays(ends, pa.array(np.array(v, np.int64)[order])) for v in (numbers, starts))
        return pa.RecordBatch.from_arrays([keys.take(pa.array(row[order[first]])), codes.dictionary.take(codes.indices.take(pa.array(order[first]))), *lists], [key, "word", "numbers", "starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(pattern).finditer
        for batch in batches:
            rows, words, numbers, starts = [], [], [], []
            for row in range(batch.num_rows):
                found = [(m[0], m.start()) for m in find(batch.column(1)[row].as_py() or "")]
                rows += [row] * len(found)
                words += [w for w, _ in found]
                numbers += range(len(found))
                starts += [at for _, at in found]
                if len(rows) >= AT_ONCE or rows and row == batch.num_rows - 1:
                    yield made(batch.column(0), rows, words, numbers, starts)
                    rows, words, numbers, starts = [], [], [], []

    low = docs.select(key, F.translate(text, UPPER, UPPER.lower()).alias("low"))
    return low.mapInArrow(run, f"{key} {kind}, word string, numbers array<bigint>, starts array<bigint>")


def _gaps(values: Column) -> Column:
    """Each value less the one before it."""
    return F.transform(values, lambda x, i: x - F.coalesce(F.get(values, i - 1), F.lit(0)))


def postings(found: DataFrame, key: str) -> DataFrame:
    """word, block, n_texts, texts: the texts (key, gaps) of each word in order of key; gaps are the word numbers, each less the one before.

    A word's texts are dealt to a block for each BLOCK of them, by the hash of the key, so no row holds those of a frequent word.
    Only the words of more than one block are looked up, which are broadcast: one at most for each BLOCK words of texts.
    """
    often = found.groupBy("word").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where("blocks > 1")
    block = F.pmod(F.xxhash64(key), F.coalesce("blocks", F.lit(1).cast("long")))
    rows = found.join(F.broadcast(often), "word", "left").select("word", block.alias("block"), F.struct(F.col(key).alias("key"), _gaps(F.col("numbers")).alias("gaps")).alias("t"))
    return rows.groupBy("word", "block").agg(F.count("*").alias("n_texts"), F.array_sort(F.collect_list("t")).alias("texts"))


def phrase_places(index: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """phrase, key, number: where the words of a phrase stand one after another, from postings(); number is that of its first word.

    Texts that lack a word of the phrase are left out before any place is compared. Phrases are few and given.
    """
    wanted = [(" ".join(ws), w, i, len(ws)) for ws in phrases for i, w in enumerate(ws)]
    table = F.broadcast(index.sparkSession.createDataFrame(wanted, "phrase string, word string, i long, size long"))
    rows = index.join(table, "word").select("phrase", "i", "size", F.explode("texts").alias("t")).select("phrase", "i", "size", "t.key", "t.gaps")
    sums = rows.groupBy("phrase", "key").agg(F.count_distinct("i").alias("n"), F.first("size").alias("need")).where("n = need").select("phrase", "key")
    both = rows.join(sums, ["phrase", "key"], "left_semi")
    running = F.aggregate("gaps", F.array().cast("array<bigint>"), lambda acc, g: F.array_append(acc, g + F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0))))
    spots = both.select("phrase", "key", "i", "size", F.explode(running).alias("at")).select("phrase", "key", "size", "i", (F.col("at") - F.col("i")).alias("number"))
    return spots.groupBy("phrase", "key", "number").agg(F.count_distinct("i").alias("n"), F.first("size").alias("need")).where("n = need").select("phrase", "key", "number")


def completions(words: DataFrame, k: int) -> DataFrame:
    """typed, rank, word, n: for everything that may be typed, the `k` most frequent words (word, n) that begin with it, but aren't it and are no number; ties in order of the words.

    Each task keeps its best `k` of a beginning before they are shuffled.
    """
    rows = words.where(~F.col("word").rlike("^[0-9.]+$"))
    sizes = rows.where(F.length("word") > 1).select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("size"))
    typed = sizes.select(F.substring("word", F.lit(1), F.col("size")).alias("typed"), "word", "n")
    place = F.row_number().over(Window.partitionBy("typed").orderBy(F.desc("n"), "word"))
    return typed.withColumn("rank", place).where(F.col("rank") <= k)
