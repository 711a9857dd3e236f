"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, subtracted and peeled between versions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from larkspur.llm.common import SOLID_BYTE, mix, raw_bytes, word_hashes, word_spans

#: A paragraph is a line; a line is cut further after each word whose hash CUT divides, so a change within a long line leaves its other parts alone.
CUT = 2
#: Tables of a sketch; a digest has one cell in each.
TABLES = 3
#: Cells of one table: 2 to this power in a fingerprint, and by so much more with each retry.
SMALLEST, GROWTH = 3, 2
#: Text bytes whose sketches one numpy step compares.
STEP_BYTES = 1 << 20

_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_LOW = np.uint64(0xFFFFFFFF)


def paragraph_digests(texts: pa.Array, cut: int = CUT) -> tuple[np.ndarray, np.ndarray]:
    """Digests of each text's paragraphs, and the n + 1 offsets of the texts. A paragraph's second occurrence has another digest than its first."""
    data, rows = raw_bytes(texts)
    starts, stops, first = word_spans(data, rows, SOLID_BYTE)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(rows), np.int64)
    lines = np.concatenate(([0], np.cumsum(data == 0x0A)))
    ends = np.zeros(len(starts), bool)
    ends[:-1] = lines[starts[1:]] > lines[stops[:-1]]
    ends[first[1:][first[1:] > first[:-1]] - 1] = True
    if cut:
        ends |= word_hashes(data, starts, stops) % np.uint64(cut) == 0
    last = np.flatnonzero(ends)
    begin = np.concatenate(([0], last[:-1] + 1))
    digests = word_hashes(data, starts[begin], stops[last])
    offsets = np.searchsorted(last, first)
    doc = np.repeat(np.arange(len(rows) - 1), np.diff(offsets))
    order = np.lexsort((digests, doc))
    d, h = doc[order], digests[order]
    fresh = np.concatenate(([True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])))
    runs = np.flatnonzero(fresh)
    nth = np.arange(len(order)) - np.repeat(runs, np.diff(np.append(runs, len(order))))
    out = np.empty_like(digests)
    out[order] = np.where(nth > 0, mix(h + nth.astype(np.uint64) * _SALTS[3]), h)
    return out, offsets


def _checks(digests: np.ndarray) -> np.ndarray:
    return mix(digests ^ _SALTS[3]) & _LOW


class Sketches:
    """One sketch per row: counts, xor of digests and xor of check values in TABLES tables of 2**power cells."""

    def __init__(self, n: int, power: int) -> None:
        self.n, self.power, self.width = n, power, TABLES << power
        self.counts = np.zeros(n * self.width, np.int64)
        self.keys, self.checks = (np.zeros(n * self.width, np.uint64) for _ in range(2))

    def add(self, rows: np.ndarray, digests: np.ndarray, sign: int | np.ndarray) -> np.ndarray:
        """Add (sign 1) or take away (-1) digests; returns the cells that changed."""
        checks, touched = _checks(digests), []
        for t in range(TABLES):
            cells = rows * self.width + (t << self.power) + (mix(digests + _SALTS[t]) & np.uint64((1 << self.power) - 1)).astype(np.int64)
            np.add.at(self.counts, cells, sign)
            np.bitwise_xor.at(self.keys, cells, digests)
            np.bitwise_xor.at(self.checks, cells, checks)
            touched.append(cells)
        return np.concatenate(touched)

    def minus(self, mine: np.ndarray, other: Sketches, its: np.ndarray) -> Sketches:
        """The difference of rows `mine` of this and rows `its` of the other."""
        out = Sketches(len(mine), self.power)
        cut = lambda x, rows: x.reshape(-1, self.width)[rows].ravel()
        out.counts = cut(self.counts, mine) - cut(other.counts, its)
        out.keys, out.checks = cut(self.keys, mine) ^ cut(other.keys, its), cut(self.checks, mine) ^ cut(other.checks, its)
        return out

    def texts(self) -> list[str]:
        """Each sketch in hexadecimal: count (8 digits), digest (16) and check (8) of each cell."""
        cells = np.empty(self.n * self.width, np.dtype([("c", ">i4"), ("k", ">u8"), ("x", ">u4")]))
        cells["c"], cells["k"], cells["x"] = self.counts, self.keys, self.checks
        raw, size = cells.tobytes().hex(), 2 * cells.itemsize * self.width
        return [raw[i : i + size] for i in range(0, len(raw), size)]

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Empty the sketches: rows, digests and signs of what came out, and which rows are wholly known."""
        found, cells = [], np.arange(len(self.counts))
        while len(cells):
            alone = cells[(np.abs(self.counts[cells]) == 1) & (_checks(self.keys[cells]) == self.checks[cells])]
            if not len(alone):
                break
            rows, digests, signs = alone // self.width, self.keys[alone], self.counts[alone]
            order = np.lexsort((digests, rows))
            rows, digests, signs = rows[order], digests[order], signs[order]
            fresh = np.concatenate(([True], (rows[1:] != rows[:-1]) | (digests[1:] != digests[:-1])))
            rows, digests, signs = rows[fresh], digests[fresh], signs[fresh]
            found.append((rows, digests, signs))
            cells = np.unique(self.add(rows, digests, -signs))
        empty = (self.counts == 0) & (self.keys == 0) & (self.checks == 0)
        rows, digests, signs = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return rows, digests, signs, empty.reshape(self.n, self.width).all(axis=1)


class Sets:
    """Digest sets of some texts; sketches of any power are made of them."""

    def __init__(self, texts: pa.Array, cut: int = CUT) -> None:
        self.digests, self.offsets = paragraph_digests(texts, cut)
        self.sizes = np.diff(self.offsets)
        self.base = self.sketch(np.arange(len(self.sizes)), SMALLEST)

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in `rows`, digest) of all digests of `rows`."""
        sizes = self.sizes[rows]
        place = np.repeat(np.arange(len(rows)), sizes)
        within = np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return place, self.digests[np.repeat(self.offsets[rows], sizes) + within]

    def sketch(self, rows: np.ndarray, power: int) -> Sketches:
        out = Sketches(len(rows), power)
        out.add(*self.of(rows), 1)
        return out


def differences(sets: Sets, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pairs of rows (a, b): place of the pair, digest and sign (1: only in a, -1: only in b) of each differing paragraph.

    The fingerprints' sketches are subtracted and peeled first; pairs that don't peel are tried again with larger
    sketches, until the last one has. A sketch with fewer cells than the sizes differ by is not tried.
    """
    left, power, out = np.arange(len(a)), SMALLEST, []
    while len(left):
        least = np.abs(sets.sizes[a[left]] - sets.sizes[b[left]])
        now = left[least <= TABLES << power]
        if len(now):
            mine, its = a[now], b[now]
            diff = sets.base.minus(mine, sets.base, its) if power == SMALLEST else sets.sketch(mine, power).minus(np.arange(len(now)), sets.sketch(its, power), np.arange(len(now)))
            rows, digests, signs, whole = diff.peel()
            kept = whole[rows]
            out.append((now[rows[kept]], digests[kept], signs[kept]))
            left = np.setdiff1d(left, now[whole], assume_unique=True)
        power += GROWTH
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


def likeness(sets: Sets, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared paragraphs by all paragraphs of both, each counted as often as it occurs; 1 if neither has any."""
    pair, _, sign = differences(sets, a, b)
    only_a = np.bincount(pair[sign > 0], minlength=len(a))
    only_b = np.bincount(pair[sign < 0], minlength=len(a))
    total = sets.sizes[a] + only_b
    return np.where(total > 0, (sets.sizes[a] - only_a) / np.maximum(total, 1), 1.0)


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as much of the following one's beginning."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_TYPES = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ids: list[int | None], texts: list[str]) -> pa.RecordBatch:
    """All but the last text, each with its edited text and the one that follows it."""
    n = len(ids)
    new = [edited(a, b) for a, b in zip(texts, texts[1:])]
    sets = Sets(pa.array(texts + new))
    prints, at = sets.base.texts(), np.arange(n)
    near = [likeness(sets, at, at + k) for k in (n + 1, 1)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([ids, [len(t) for t in texts[:n]], [hashlib.sha256(t.encode()).hexdigest() for t in new], prints[:n], prints[n + 1 :], *near], _OUT)], schema=_OUT)


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, guest, doc_id, text) in order; of each part's guests, which stand last, the first follows its last row."""
    ids, texts, held, part, done = [], [], 0, None, False
    for batch in batches:
        for p, guest, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if p != part:
                part, done, ids, texts, held = p, False, [], [], 0
            if done:
                continue
            texts.append(text)
            held += len(text)
            if guest:
                done = True
                if ids:
                    yield _compared(ids, texts)
                ids, texts = [], []
                continue
            if held > STEP_BYTES and ids:
                yield _compared(ids, texts)
                texts, held = [text], len(text)
                ids = []
            ids.append(doc_id)


def parts_of(docs: DataFrame) -> list[int]:
    """Borders of doc_id that cut `docs` into parts of about the same number of rows, the first of them the least doc_id."""
    many = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [i / many for i in range(many)], 10 * many).alias("cuts"), F.min(F.col("doc_id").cast("long")).alias("least")).first()
    return sorted({cuts["least"], *cuts["cuts"]}) if cuts["cuts"] else []


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Texts (null: empty) are compared with their edited() form and with the next text in order of doc_id, null first, then
    of the text's hash; after the last comes the first. A single row follows itself. Repeated rows follow one another.
    Each text is shuffled once, to the part of its doc_id; the first row of a part also goes, as a guest, to the part
    before. Tasks read their rows in order and hold STEP_BYTES of them, or one text that is longer.
    """
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    cuts = np.array(parts_of(docs), np.int64)
    last = len(cuts)  # parts 1 to last have doc_ids, part 0 those without
    unnamed = rows.where("doc_id IS NULL").agg(F.min("hash").alias("hash")).first()["hash"]

    @pandas_udf("int")
    def route(ids: pd.Series) -> pd.Series:
        """Twice the part, and one more on its border."""
        known, at = ids.notna().to_numpy(), ids.fillna(0).to_numpy().astype(np.int64)
        part = np.searchsorted(cuts, at, "right")
        return pd.Series(np.where(known, 2 * part + (cuts[np.maximum(part - 1, 0)] == at) if last else 0, 0))

    code = rows.withColumn("code", route("doc_id"))
    part = F.shiftright("code", 1)
    opens = F.when(F.col("doc_id").isNull(), F.col("hash") == F.lit(unnamed)).otherwise(F.col("code") % 2 == 1)
    before = F.when(part == (0 if unnamed is not None else 1), F.lit(last)).otherwise(part - 1)
    place = lambda p, guest: F.struct(p.cast("int").alias("part"), F.lit(guest).alias("guest"))
    dealt = code.select(F.explode(F.when(opens, F.array(place(part, False), place(before, True))).otherwise(F.array(place(part, False)))).alias("to"), "doc_id", "text", "hash")
    order = ["part", "guest", F.col("doc_id").asc_nulls_first(), "hash"]
    there = dealt.select("to.part", "to.guest", "doc_id", "text", "hash").repartitionById(last + 1, "part").sortWithinPartitions(*order)
    return there.drop("hash").mapInArrow(_followed, _TYPES)


def op12(docs: DataFrame) -> DataFrame:
    """fingerprints() of all documents."""
    return fingerprints(docs)
