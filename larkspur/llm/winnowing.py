"""Benchmark decontamination by winnowed word k-gram fingerprints, joined and extended to whole shared windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.llm.common import LOWER, chunks, mix, raw_bytes, released, text_column, without, word_hashes, word_spans
from larkspur.session import checkpointed

#: Words of a window. A k-gram of GRAM words is kept if it has the least hash of WINNOW in a row, and
#: GRAM + WINNOW - 1 = SPAN: so each shared run of SPAN words shares a fingerprint.
SPAN, GRAM = 13, 5
WINNOW = SPAN - GRAM + 1
REACH = SPAN - GRAM
#: The presence filter of benchmark fingerprints has SPARSE bits or more for each, between 2**LEAST_BITS (256 KB) and 2**MOST_BITS (64 MB);
#: from 33 million fingerprints on it lets more texts through to the join.
SPARSE, LEAST_BITS, MOST_BITS = 16, 21, 29
_MAX = np.uint64((1 << 64) - 1)
_SCHEMA = "hits array<struct<kind int, hash long, pos long, words array<string>>>"


def _gram_hashes(h: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; the largest value where the row has fewer left."""
    g = np.full(len(h), _MAX)
    n = len(h) - k + 1
    if n > 0:
        sums = h[:n].copy()
        for t in range(1, k):
            sums = sums * np.uint64(0xD6E8FEB86659FD93) + h[t : n + t]
        g[:n] = np.where(np.arange(n) + k <= ends[:n], mix(sums + np.uint64(k)), _MAX)
    return g


def _slide(x: np.ndarray, width: int, least) -> np.ndarray:
    """Minimum or maximum of each `width` values in a row."""
    have = 1
    out = x
    while have < width:
        step = min(have, width - have)
        out = least(out[:-step], out[step:])
        have += step
    return out


def winnow(g: np.ndarray, width: int = WINNOW) -> np.ndarray:
    """Positions of hashes that are the least of some window of `width` in a row (all of them on ties)."""
    if not len(g):
        return np.zeros(0, np.int64)
    pad = np.full(width - 1, _MAX)
    least = _slide(np.concatenate([pad, g, pad]), width, np.minimum)
    return np.flatnonzero((_slide(least, width, np.maximum) == g) & (g != _MAX))


def _prints(data: np.ndarray, offsets: np.ndarray, short: list[int], present: np.ndarray | None, items: bool):
    """For each row: its word count and fingerprints (kind, hash, word position, words around).

    kind SPAN: winnowed k-grams with REACH words on either side (null beyond the row); other kinds: all runs of
    that many words. present: presence filter; items: rows of the benchmark, whose length decides their kind.
    """
    data = LOWER[data]
    starts, stops, first = word_spans(data, offsets)
    h, counts = word_hashes(data, starts, stops), np.diff(first)
    ends = np.repeat(first[1:], counts)
    row = np.repeat(np.arange(len(counts)), counts)
    text = data.tobytes()
    word = lambda i: text[starts[i] : stops[i]].decode("utf-8", "replace")
    out: list[list[tuple]] = [[] for _ in counts]
    for kind in [SPAN, *short]:
        g = _gram_hashes(h, ends, GRAM if kind == SPAN else kind)
        at = winnow(g) if kind == SPAN else np.flatnonzero(g != _MAX)
        if items:
            own = counts[row[at]]
            at = at[own >= SPAN] if kind == SPAN else at[own == kind]
        if present is not None:
            bit = g[at] >> np.uint64(64 - (8 * len(present) - 1).bit_length())
            at = at[(present[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        for i in at.tolist():
            r = row[i]
            lo, hi = (i - REACH, i + GRAM + REACH) if kind == SPAN else (i, i + kind)
            words = [word(j) if first[r] <= j < first[r + 1] else None for j in range(lo, hi)]
            out[r].append((kind, int(g[i].astype(np.int64)), int(i - first[r]), words))
    return counts, out


def _scan(batches: Iterator[pa.RecordBatch], short: list[int], bits) -> Iterator[pa.RecordBatch]:
    return released(_scanned(batches, short, bits))


def _scanned(batches: Iterator[pa.RecordBatch], short: list[int], bits) -> Iterator[pa.RecordBatch]:
    """Columns before `text` as they are, then n_words and hits. bits: broadcast presence filter, or none."""
    present = None if bits is None else np.frombuffer(bits.value, np.uint8)
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("hash", pa.int64()), ("pos", pa.int64()), ("words", pa.list_(pa.string()))]))
    for batch in batches:
        column = text_column(batch, "text")
        keep = [i for i, n in enumerate(batch.schema.names) if n != "text"]
        for a, b in chunks(column):
            counts, hits = _prints(*raw_bytes(column.slice(a, b - a)), short, present, present is None)
            arrays = [batch.column(i).slice(a, b - a) for i in keep]
            fields = [pa.array(counts.astype(np.int64)), pa.array([[dict(zip(("kind", "hash", "pos", "words"), x, strict=True)) for x in r] for r in hits], kind)]
            yield pa.RecordBatch.from_arrays([*arrays, *fields], [*(batch.schema.names[i] for i in keep), "n_words", "hits"])


def _presence(prints: DataFrame) -> bytes:
    """The presence filter of the benchmark's fingerprints, at most 2**MOST_BITS bits; its size follows their number."""
    size = min(MOST_BITS, max(LEAST_BITS, (SPARSE * prints.count()).bit_length()))
    bit = F.shiftrightunsigned("hash", 64 - size) + 1
    rows = prints.select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("at")).groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")).collect()
    bits = bytearray((1 << size) // 8)
    for r in rows:
        bits[(r.bucket - 1) * 4096 : r.bucket * 4096] = r.bits
    return bytes(bits)


def _run(ok: Column, size: int) -> Column:
    """Length of the run of true values at the start of an array of `size`."""
    at = F.array_position(ok, False)
    return F.when(at == 0, size).otherwise(at - 1)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, text_hash, n_words, n_hit, items (sorted distinct ids as strings), contaminated.

    A-Z is lower-cased and words are runs of digits, letters and non-ASCII characters. Windows are the runs of 13
    words of a benchmark text, or the whole of a shorter one; a document word within an occurrence of a window
    is hit; a document is contaminated if a twentieth of its words or more are. Null or wordless texts of either
    table have no windows and no hits; repeated benchmark rows count once per item_id, and rows with null item_id
    hit without being listed; repeated documents are each returned.
    """
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    scan = lambda df, short, bits, schema: df.mapInArrow(lambda it: _scan(it, short, bits), schema)
    prints = scan(bench, list(range(1, SPAN)), None, f"item_id string, n_words long, {_SCHEMA}")
    prints = checkpointed(prints.select("item_id", F.inline("hits")).select("kind", "hash", "item_id", F.col("words").alias("item_words")))
    short = sorted(r.kind for r in prints.where(F.col("kind") < SPAN).select("kind").distinct().collect())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"), F.col("text").cast("string").alias("text"))
    bits = docs.sparkSession.sparkContext.broadcast(_presence(prints))
    found = scan(rows, short, bits, f"doc_id long, text_hash long, n_words long, {_SCHEMA}")
    found = checkpointed(found.withColumn("row", F.monotonically_increasing_id()))

    both = found.select("row", F.inline("hits")).join(prints, ["kind", "hash"])
    same = F.zip_with("words", "item_words", lambda a, b: F.coalesce(a == b, F.lit(False)))
    both = both.select("row", "kind", "pos", "item_id", same.alias("same"))
    left, right = _run(F.reverse(F.slice("same", 1, REACH)), REACH), _run(F.slice("same", SPAN + 1, REACH), REACH)
    whole = F.forall(F.slice("same", REACH + 1, GRAM), lambda x: x) & (left + GRAM + right >= SPAN)
    start = F.when((F.col("kind") == SPAN) & whole, F.col("pos") - left).when((F.col("kind") < SPAN) & F.forall("same", lambda x: x), F.col("pos"))
    stop = F.when(F.col("kind") == SPAN, F.col("pos") + GRAM + right).otherwise(F.col("pos") + F.col("kind"))
    spans = checkpointed(both.select("row", "item_id", start.alias("a"), stop.cast("long").alias("b")).where("a is not null").distinct())
    reached = F.max("b").over(Window.partitionBy("row").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    gain = F.greatest(F.lit(0), F.col("b") - F.greatest("a", F.coalesce(reached, F.lit(0))))
    words = spans.select("row", "a", "b").distinct().select("row", gain.alias("gain")).groupBy("row").agg(F.sum("gain").alias("n_hit"))
    names = spans.select("row", "item_id").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    out = found.drop("hits").join(words, "row", "left").join(names, "row", "left")
    out = out.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that are not contaminated."""
    hit = contamination(docs, benchmark).where("contaminated").select("doc_id", "text_hash")
    return without(docs, checkpointed(hit.distinct()))


def op8(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of `docs`."""
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
items AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
sized AS (SELECT *, least({SPAN}, len(ws)) AS n FROM items WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM sized)),
places AS (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM docs),
held AS (SELECT rid, i, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM places, (SELECT DISTINCT n FROM sized) WHERE i + n - 1 <= len(ws)),
met AS (SELECT rid, i, held.n, item_id FROM held JOIN windows ON held.n = windows.n AND held.w = windows.w),
words AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM met) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT rid, item_id FROM met WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM docs LEFT JOIN words USING (rid) LEFT JOIN named USING (rid)"""
