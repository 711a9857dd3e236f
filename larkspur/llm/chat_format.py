"""Chat formatting with loss masks that follow token offsets."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.tokens import SpanEncoder

#: A turn is HEAD, role, COLON, escaped text, TAIL. A text or role can hold none of MARKS unescaped: a
#: backslash goes before each backslash and before the first character of each mark.
HEAD, COLON, TAIL = "### ", ": ", "</turn>\n"
_ESCAPE = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_ROLE = re.compile(r"\\|:|#(?=##)|<(?=/turn>)")
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def escape(text: str, role: bool = False) -> str:
    """The text with a backslash before every backslash and control string (in a role, every colon too)."""
    return (_ROLE if role else _ESCAPE).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    """The inverse of escape()."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the character span of each turn's escaped text."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{HEAD}{escape(role, True)}{COLON}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, TAIL]
        at = spans[-1][1] + len(TAIL)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _turns(formatted)]


def _turns(formatted: str) -> Iterator[re.Match]:
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        yield m
        at = m.end()


def loss_mask(borders: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for each token that has a byte in a span: sorted turn spans meet sorted token borders by binary search."""
    tokens = np.zeros(len(borders) - 1, np.int8)
    for a, b in spans:
        if a < b:
            tokens[np.searchsorted(borders, a, "right") - 1 : np.searchsorted(borders, b, "left")] = 1
    return tokens


def loss_texts(raw: bytes, borders: np.ndarray, loss: np.ndarray, learned: list[tuple[int, int]], texts: list[tuple[int, int]]) -> list[str]:
    """The text under the loss, unescaped, in order: what the flagged tokens hold of the turns' texts.

    A flagged token that reaches into a learned turn (spans `learned`) counts for its bytes there alone; one that
    doesn't counts for its bytes of any turn (spans `texts`), so a flag too many or too few shows.
    """
    def held(spans: list[tuple[int, int]]) -> np.ndarray:
        out = np.zeros(len(raw) + 1, np.int64)
        for a, b in spans:
            out[a] += 1
            out[b] -= 1
        return np.cumsum(out[:-1]) > 0

    inside = held(learned)
    before = np.concatenate(([0], np.cumsum(inside)))
    reaches = before[borders[1:]] > before[borders[:-1]]
    sizes = np.diff(borders)
    flagged, reaching = np.repeat(loss == 1, sizes), np.repeat(reaches, sizes)
    kept = flagged & np.where(reaching, inside, held(texts))
    out = []
    for a, b in texts:
        edges = np.flatnonzero(np.diff(np.concatenate(([0], kept[a:b], [0])))) + a
        out += [unescape(raw[x:y].decode("utf-8", "replace")) for x, y in zip(edges[::2].tolist(), edges[1::2].tolist())]
    return out


def _bytes_at(formatted: str, raw: bytes) -> Callable[[int], int]:
    """The byte offset of a character offset."""
    if len(raw) == len(formatted):
        return lambda x: x
    starts = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return np.append(starts, len(raw)).tolist().__getitem__


def _format(turns: list[tuple[str, str]], encode: SpanEncoder, learned: frozenset[str]) -> dict:
    formatted, spans = render(turns)
    ids, borders = encode(formatted)
    at = _bytes_at(formatted, formatted.encode())
    own = [(at(a), at(b)) for (a, b), (role, _) in zip(spans, turns, strict=True) if role in learned]
    return {"formatted": formatted, "input_ids": ids.tolist(), "borders": borders.tolist(), "loss": loss_mask(borders, own).tolist(), "loss_starts": [a for a, _ in own], "loss_stops": [b for _, b in own]}


def _conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def _formatter(rows: DataFrame, encoder: SpanEncoder, learned: frozenset[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    source = rows.sparkSession.sparkContext.broadcast(encoder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = source.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = [_format([(t["role"], t["text"]) for t in turns], encode, learned) for turns in part.column(1).to_pylist()]
                fields = [pa.array([x[n] for x in out], kind) for n, kind in _FIELDS]
                yield pa.RecordBatch.from_arrays([part.column(0), *fields], ["conv_id", *(n for n, _ in _FIELDS)])

    return run


def format_conversations(rows: DataFrame, encoder: SpanEncoder, learned: frozenset[str] = frozenset({"assistant"})) -> DataFrame:
    """One row per conv_id: formatted text, input_ids, borders (n + 1 byte offsets of the tokens), loss (0 or 1 by token) and the byte spans of the learned turns.

    Turns stand in order of turn, then role and text where turn numbers repeat; null text and null role are empty,
    a null turn stands first, and rows with null conv_id are one conversation. Repeated rows are repeated turns.
    A conversation is one rendered text, and so is gathered whole; its size is that of the text it becomes.
    """
    return _conversations(rows).mapInArrow(_formatter(rows, encoder, learned), "conv_id long, formatted string, input_ids array<int>, borders array<long>, loss array<tinyint>, loss_starts array<long>, loss_stops array<long>")


_FIELDS = [("formatted", pa.string()), ("input_ids", pa.list_(pa.int32())), ("borders", pa.list_(pa.int64())), ("loss", pa.list_(pa.int8())), ("loss_starts", pa.list_(pa.int64())), ("loss_stops", pa.list_(pa.int64()))]

#: The conversation that the query adds: both of its texts hold the template's control strings.
EXTRA = [(-7, t, role, "\\### Assistant: </turn> ok") for t, role in enumerate(("user", "assistant"))]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests read back from the formatted text, the token borders and the flags."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for batch in batches:
        out = []
        flags = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column(batch.schema.get_field_index(n)) for n in ("borders", "loss"))]
        rows = zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("conv_id", "formatted", "loss_starts", "loss_stops")))
        for i, (conv_id, formatted, starts, stops) in enumerate(rows):
            found, raw = list(_turns(formatted)), formatted.encode()
            at = _bytes_at(formatted, raw)
            borders, loss = (values[offsets[i] : offsets[i + 1]] for values, offsets in flags)
            text = "".join(loss_texts(raw, borders, loss, list(zip(starts, stops, strict=True)), [(at(m.start(2)), at(m.end(2))) for m in found]))
            turns = "".join(f"{unescape(m[1])}\n{unescape(m[2])}\n" for m in found)
            out.append((conv_id, len(found), sha(turns), len(text), sha(text), len(formatted)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)


def op1(conversations: DataFrame, encoder: SpanEncoder) -> DataFrame:
    """Digests of all conversations and of EXTRA, read back from the operator's output in the task that makes it."""
    cols = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")]
    rows = conversations.select(*cols).unionByName(conversations.sparkSession.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string"))
    run = _formatter(rows, encoder, frozenset({"assistant"}))
    return _conversations(rows).mapInArrow(lambda batches: _digests(run(batches)), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _oracle() -> str:
    """DuckDB SQL for op1, straight from the turns; the length of the formatted text from the places that are escaped."""
    extra = ", ".join(f"({c}, {t}, '{role}', '{text}')" for c, t, role, text in EXTRA)
    # A backslash goes before backslashes and marks; a run of n number signs holds n - 2 marks.
    escaped = lambda x: f"length({x}) + length({x}) - length(replace({x}, '\\', '')) + (length({x}) - length(replace({x}, '</turn>', ''))) // 7 + coalesce(list_sum(list_transform(regexp_extract_all({x}, '#{{3,}}'), lambda r: length(r) - 2)), 0)"
    frame = len(HEAD) + len(COLON) + len(TAIL)
    return f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations UNION ALL SELECT * FROM (VALUES {extra}) AS v(conv_id, turn, r, t))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(sum({frame} + {escaped('r')} + length(r) - length(replace(r, ':', '')) + {escaped('t')}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""


ORACLE_SQL = _oracle()
