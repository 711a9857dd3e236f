"""Byte-level token spans and their attribution to sections of a document."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import chunks, text_column

#: Ways to give a token that crosses a border to one section.
RULES = ("start", "end", "most")
#: White space (Unicode's White_Space) in a row from this length on is cut into pieces here: the pattern's own engine gives up
#: on a million of them.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


@cache
def _encoding(ranks: bytes, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    sizes = np.zeros(max(table.values()) + 1, np.int64)
    for t, i in table.items():
        sizes[i] = len(t)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}), sizes


class SpanEncoder:
    """Byte-level BPE with the byte span of every token. Its pickled form is the vocabulary, a few hundred KB."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            self.ranks = f.read()
        self.pattern = pattern

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and the n + 1 byte offsets of their borders; the tokens' bytes end to end are the text.

        By the pattern, all of a run of white space but its last character, or the whole of one that ends the text, is one piece.
        """
        encoding, sizes = _encoding(self.ranks, self.pattern)
        plain = lambda t: encoding.encode_to_numpy(t, disallowed_special=()).astype(np.int64)
        parts, at = [], 0
        for m in _LONG_SPACE.finditer(text):
            stop = m.end() if m.end() == len(text) else m.end() - 1
            parts += [plain(text[at : m.start()]), np.array(encoding._encode_single_piece(text[m.start() : stop]), np.int64)]
            at = stop
        ids = np.concatenate([*parts, plain(text[at:])])
        return ids, np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes[ids])])


def line_starts(raw: bytes) -> np.ndarray:
    """Byte offsets at which the lines of a text begin; a line keeps its line feed."""
    feeds = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return np.concatenate([np.zeros(1, np.int64), feeds[feeds < len(raw)]])


def attribute(borders: np.ndarray, starts: np.ndarray, total: int, rule: str = "start") -> np.ndarray:
    """Tokens of each section, given token borders (n + 1 byte offsets) and the sections' first bytes.

    The interval join is a binary search of token borders among section starts. A token that crosses a border
    belongs, by `rule`, to the section of its first byte, of its last byte, or of most of its bytes (the earliest
    on ties), so each token counts exactly once.
    """
    first = np.searchsorted(starts, borders[:-1], "right") - 1
    last = np.searchsorted(starts, borders[1:] - 1, "right") - 1
    owner = {"start": first, "end": last, "most": first}[rule].copy()
    if rule == "most":
        edges = np.append(starts, total)
        for i in np.flatnonzero(first != last).tolist():
            parts = range(first[i], last[i] + 1)
            owner[i] = max(parts, key=lambda s: (min(edges[s + 1], borders[i + 1]) - max(edges[s], borders[i]), -s))
    return np.bincount(owner, minlength=len(starts))


def section_tokens(docs: DataFrame, encoder: SpanEncoder, rule: str = "start") -> DataFrame:
    """(doc_id, section, n_bytes, n_tokens) for each line of each row of `docs`.

    A document is encoded once as a whole, so a token may cross lines; `rule` gives it to one of them. A null or
    empty text is one section without tokens; repeated rows are each returned.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    source = docs.sparkSession.sparkContext.broadcast(encoder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = source.value
        for batch in batches:
            column = text_column(batch, "text")
            for a, b in chunks(column):
                sizes, counts, rows = [], [], []
                for text in column.slice(a, b - a).to_pylist():
                    raw = text.encode()
                    starts = line_starts(raw)
                    sizes.append(np.diff(starts, append=len(raw)))
                    counts.append(attribute(encode(text)[1], starts, len(raw), rule))
                    rows.append(len(starts))
                n = np.array(rows, np.int64)
                section = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                ids = batch.column(0).slice(a, b - a).take(pa.array(np.repeat(np.arange(b - a), n)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(section), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(counts).astype(np.int64))], ["doc_id", "section", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, section long, n_bytes long, n_tokens long")
