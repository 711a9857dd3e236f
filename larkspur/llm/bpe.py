"""Exact byte-pair encoding by per-prefix dynamic programming, and decoding."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache, partial
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkspur.llm.common import chunks, released, text_column

#: Words and pair tests that a worker remembers; both are emptied when full, so memory is bounded.
MEMO_WORDS, MEMO_PAIRS = 800_000, 1_000_000
#: Characters of a piece beyond which it isn't remembered.
MEMO_LENGTH = 64
#: Texts whose characters all lie below this use a faster equivalent of the piece pattern.
_LOW = 0x250
#: Contractions; they stand before the letters in the original order, but no letter begins with an apostrophe.
_TAIL = r"'(?:[stmd]|re|ve|ll)"


def _ranges(major: str) -> str:
    """Regex ranges of the characters below _LOW whose Unicode category starts with `major`."""
    member = [unicodedata.category(chr(c))[0] == major for c in range(_LOW)] + [False]
    firsts = [c for c in range(_LOW) if member[c] and not (c and member[c - 1])]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(member.index(False, a) - 1))}" for a in firsts)


@cache
def _full_pattern() -> regex.Pattern:
    """The piece pattern for all of Unicode, letters and numbers being those of the standard library's version of it."""
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, sys.maxunicode + 1))))
    later = "".join(c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c)[0] not in "LN")
    but = f"--[{''.join(map(regex.escape, later))}]" if later else ""
    return regex.compile(rf"[\p{{L}}{but}]+|{_TAIL}|[\p{{N}}{but}]|[[^\s\p{{L}}\p{{N}}]{'||' + but[2:] if but else ''}]+", regex.V1)


@cache
def _newer_characters() -> re.Pattern:
    """Characters that the standard library's version of Unicode doesn't have."""
    unknown = [unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)] + [False]
    firsts = [c for c in range(sys.maxunicode + 1) if unknown[c] and not unknown[c - 1]]
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(unknown.index(False, a) - 1))}" for a in firsts) + "]")


def _visible_bytes() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else from U+0100 on in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b) if b in plain else chr(next(others)) for b in range(256)}


@cache
def _library_steps(normalizer: str, split: str):
    """The tokenizers library's own normalizer and piece splitter."""
    empty = {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []}
    steps = Tokenizer.from_str(json.dumps(empty | {"normalizer": json.loads(normalizer), "pre_tokenizer": json.loads(split)}))
    return steps.normalizer, steps.pre_tokenizer


def _newest_pieces(normalizer: str, split: str, text: str) -> list[str]:
    """Pieces of a text with characters of a newer Unicode than the standard library's: that library's version decides."""
    normal, pieces = _library_steps(normalizer, split)
    return [p for p, _ in pieces.pre_tokenize_str(normal.normalize_str(text))]


class _Pieces(dict):
    """Ids by piece, computed on first use."""

    def __init__(self, encode):
        self._encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self._encode(piece)
        if len(piece) <= MEMO_LENGTH:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[piece] = ids
        return ids


class PrefixBPE:
    """Encoder and decoder of one vocabulary file (JSON with merges, byte-level pieces, a word-end suffix).

    A piece is a string over symbols (a byte, or a last byte with the word end). For every prefix there is exactly
    one token that ends its encoding: the one that may follow the last token of what stands before it. So a single
    pass over the vocabulary matches that end at each position (found by an automaton over all tokens) fills a
    table of last tokens, and following it back from the end of the piece gives the ids.
    """

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab: dict[str, int] = model["vocab"]
        self.token_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        self._split_specials = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self._symbols = str.maketrans({chr(b): c for b, c in _visible_bytes().items()})
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self._rank, self._left, self._right, self._merge = dict.fromkeys(vocab.values(), -1), {}, {}, {}
        for n, (a, b) in enumerate(pairs):
            whole = vocab[a + b]
            self._merge[vocab[a], vocab[b]] = n
            if self._rank[whole] < 0:
                self._rank[whole], self._left[whole], self._right[whole] = n, vocab[a], vocab[b]
        self._automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            s = self._spell(t)
            if self._rank[i] >= 0 or len(s) == 1:
                self._automaton.add_word(s, (i, len(s)))
        self._automaton.make_automaton()
        self._joins: dict[int, bool] = {}
        self._pieces = _Pieces(self.encode_piece)
        letters, numbers = _ranges("L"), _ranges("N")
        self._newest = partial(_newest_pieces, json.dumps(spec["normalizer"]), json.dumps(spec["pre_tokenizer"]["pretokenizers"][0]))
        self._fast = re.compile(rf"[{letters}]+|{_TAIL}|[{numbers}]|[^\s{letters}{numbers}]+")
        self._beyond = re.compile(f"[^\x00-{chr(_LOW - 1)}]|[\x1c-\x1f]")

    def _spell(self, token: str) -> str:
        """The token as a string of symbols: a last byte with the word end is one symbol, its letter 0x1000 higher."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            stem = token[: -len(self.suffix)]
            return stem[:-1] + chr(ord(stem[-1]) + 0x1000)
        return token

    def _may_follow(self, u: int, t: int) -> bool:
        """Whether `t` can stand right after `u`: undoing merges latest first, no earlier merge joins the two across the border."""
        key = (u << 32) | t
        known = self._joins.get(key)
        if known is not None:
            return known
        rank, merge = self._rank, self._merge
        before = sys.maxsize
        while True:
            across = merge.get((u, t))
            if across is not None and across < before:
                result = False
                break
            ru, rt = rank[u], rank[t]
            if ru < 0 and rt < 0:
                result = True
                break
            if ru > rt:
                before, u = ru, self._right[u]
            else:
                before, t = rt + 1, self._left[t]
        if len(self._joins) >= MEMO_PAIRS:
            self._joins.clear()
        self._joins[key] = result
        return result

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece (a word, number or run of marks)."""
        s = piece.encode("utf-8", "replace").decode("latin-1").translate(self._symbols)
        if self.suffix:
            s = s[:-1] + chr(ord(s[-1]) + 0x1000)
        last, size = [-1] * (len(s) + 1), [0] * (len(s) + 1)
        joins, may_follow = self._joins, self._may_follow
        for at, (t, n) in self._automaton.iter(s):
            at += 1
            if last[at] < 0:
                if at == n:
                    last[at], size[at] = t, n
                elif (u := last[at - n]) >= 0:
                    known = joins.get((u << 32) | t)
                    if known or known is None and may_follow(u, t):
                        last[at], size[at] = t, n
        ids, at = [], len(s)
        while at:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return tuple(ids)

    def pieces(self, text: str) -> list[str]:
        """NFC, lower case letter by letter, then the pieces between white space."""
        low = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if not self._beyond.search(low):
            return self._fast.findall(low)
        return self._newest(text) if _newer_characters().search(low) else _full_pattern().findall(low)

    def _encode_plain(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self._pieces.__getitem__, self.pieces(text))))

    def encode(self, text: str) -> list[int]:
        """Ids of the whole text; the strings of special tokens in it are those tokens."""
        if self._split_specials is None or not any(s in text for s in self.specials):
            return self._encode_plain(text)
        out: list[int] = []
        for k, part in enumerate(self._split_specials.split(text)):
            if k % 2:
                out.append(self.specials[part])
            else:
                out += self._encode_plain(part)
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings, special ones included, joined by one space (the vocabulary has no decoder of its own)."""
        return " ".join(map(self.token_of.__getitem__, ids))


_loaded: dict[int, PrefixBPE] = {}


def _encoder(source) -> PrefixBPE:
    """This worker's encoder for a broadcast vocabulary."""
    key = hash(source.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = PrefixBPE(source.value)
    return _loaded[key]


def encode_decode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Rows of `docs` as (doc_id, ids array<int>, decoded string).

    The vocabulary file (a few MB, as large as the vocabulary and not the data) is read once and broadcast. Null
    and empty texts have no ids and decode to the empty text; repeated rows are each returned.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(source)
        for batch in batches:
            column = text_column(batch, "text")
            for a, b in chunks(column):
                ids = [bpe.encode(t) for t in column.slice(a, b - a).to_pylist()]
                texts = pa.array([bpe.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.list_(pa.int32())), texts], ["doc_id", "ids", "decoded"])
        # The worker may serve other stages next; its tables are made again for a further task.
        _loaded.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return released(encoded(batches))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def op3(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of `docs`."""
    out = encode_decode(docs, vocabulary_path)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
