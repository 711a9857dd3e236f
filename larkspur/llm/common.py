"""Shared pieces: Arrow batch plumbing and byte-level word spans."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text bytes that one numpy step handles; temporaries are about 60 times that.
CHUNK_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`; every byte of a non-ASCII character is one.
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True


def unused(rows: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `rows` has it in either case."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` computed once a row, however often the body names it, inner lambdas included."""
    return F.transform(F.array(value), body)[0]


#: Values that one inner step of running() goes through.
_BLOCK = 256


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """The running totals of an array of longs under an associative `join` with 0 for neutral.

    Totals are made within blocks and then over them: n values take about n * sqrt(n) steps, not n * n.
    """
    none = F.array(F.lit(0).cast("long"))
    grow = lambda acc, x: F.array_append(acc, join(F.get(acc, F.size(acc) - 1), x))
    within = lambda xs: F.slice(F.aggregate(xs, none, grow), F.lit(2), F.size(xs))

    def in_blocks(values: Column) -> Column:
        count = F.ceil(F.size(values) / F.lit(float(_BLOCK))).cast("int")
        return F.transform(F.sequence(F.lit(1), count), lambda k: bound(F.slice(values, (k - 1) * _BLOCK + 1, F.lit(_BLOCK)), within))

    def joined(blocks: Column) -> Column:
        before = F.aggregate(blocks, none, lambda acc, b: grow(acc, F.get(b, F.size(b) - 1)))
        return bound(before, lambda off: F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda x: join(F.get(off, i), x)))))

    return bound(values, lambda v: F.when(F.size(v) > 0, bound(in_blocks(v), joined)).otherwise(F.array().cast("array<bigint>")))


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column with null read as the empty text."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)), "")


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` text bytes each, or of one row that is longer."""
    lengths = pc.binary_length(column).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`batches`; after the last of them what the task held and freed goes back to the system, as the worker process lives on."""
    try:
        yield from batches
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a null-free text column, end to end, and the n + 1 offsets of its rows."""
    binary = column.cast(pa.large_binary())
    offsets = np.frombuffer(binary.buffers()[1], dtype=np.int64)[binary.offset : binary.offset + len(binary) + 1]
    data = binary.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Bytes other than ASCII white space.
SOLID_BYTE = np.ones(256, dtype=bool)
SOLID_BYTE[0x20] = SOLID_BYTE[0x09:0x0E] = False


def word_spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = WORD_BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of the runs of `member` bytes and the first run of each row (n + 1 positions)."""
    inside = member[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = offsets[1:][(offsets[1:] > 0)] - 1
    after[ends] = False
    stops = np.flatnonzero(inside & ~after) + 1
    return starts, stops, np.searchsorted(starts, offsets)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, at least n of them."""
    global _powers
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        tables = []
        for base in (_BASE, inverse):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers = tuple(tables)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one running polynomial sum over the bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return mix((total[stops] - total[starts]) * inverse[starts])


#: Keys of rows that are broadcast at most, counted first (24 bytes each); more of them are joined by a shuffle.
MOST_KEYS = 500_000


def same_row(docs: DataFrame, keys: DataFrame) -> Column:
    """Condition that a row of `docs` is the one that `keys` (doc_id, text_hash) names: null-safe doc_id and hash of the text."""
    return docs["doc_id"].cast("long").eqNullSafe(keys["doc_id"]) & F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).eqNullSafe(keys["text_hash"])


def counted(keys: DataFrame) -> DataFrame:
    """`keys` (materialised), marked for broadcast if they are few, so that what they meet need not be shuffled."""
    return F.broadcast(keys) if keys.count() <= MOST_KEYS else keys


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of `docs` that the materialised `keys` (doc_id, text_hash) don't name."""
    return docs.join(counted(keys), same_row(docs, keys), "left_anti")
