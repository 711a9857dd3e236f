"""Chat formatting, token counts and BPE against plain libraries and straightforward code."""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import assert_same
from samples import TEXTS, documents
from tokenizers import Tokenizer

from larkspur.llm import bpe, chat_format, queries, tokens

FOLDER = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


@cache
def library() -> Tokenizer:
    t = Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


@cache
def own() -> bpe.PrefixBPE:
    with open(VOCABULARY, encoding="utf-8") as f:
        return bpe.PrefixBPE(f.read())


def expected_bpe(doc_id, text):
    ids = library().encode(text or "", add_special_tokens=False).ids
    return doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library().decode(ids, skip_special_tokens=False))


def test_bpe_equals_the_library_on_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = sorted(expected_bpe(r.doc_id, r.text) for r in docs.collect())
    got = sorted(tuple(r) for r in queries.op3_bpe(spark, FOLDER).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == want


def test_bpe_edge_rows(spark):
    got = sorted((tuple(r) for r in bpe.op3(documents(spark, TEXTS, extra=True), VOCABULARY).collect()), key=str)
    assert got == sorted((expected_bpe(*r) for r in TEXTS), key=str)
    assert bpe.op3(documents(spark, TEXTS).limit(0), VOCABULARY).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_bpe_equals_the_library_on_any_text(text):
    ids = library().encode(text, add_special_tokens=False).ids
    assert own().encode(text) == ids
    assert own().decode(ids) == library().decode(ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["aaaa", "the", "İ", "'s", "'", "don't", "##", "1234", " ", "\x1c", "\u200b", "É", "ΑΣ", "<|startoftext|>", "<|endoftext|>", "ſ", "ﬁ"]), max_size=12))
def test_bpe_equals_the_library_on_hard_parts(parts):
    text = "".join(parts)
    assert own().encode(text) == library().encode(text, add_special_tokens=False).ids


def expected_chat(rows):
    """Digests straight from the turns."""
    by = {}
    for conv, turn, role, text in [*rows, *chat_format.EXTRA]:
        by.setdefault(conv, []).append((turn if turn is not None else -1e18, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        out.append((conv, len(turns), sha("".join(f"{role}\n{t}\n" for _, role, t in turns)), len(loss), sha(loss)))
    return sorted(out, key=str)


CHAT = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"]


def test_chat_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op1_chat_format(spark, FOLDER)
    assert got.columns == [*CHAT, "formatted_chars"]
    assert sorted((tuple(r) for r in got.select(*CHAT).collect()), key=str) == expected_chat(rows)


def test_chat_query_matches_sql(spark):
    assert_same(queries.op1_chat_format(spark, FOLDER), queries.ORACLES["op1_chat_format"], FOLDER)


def test_chat_edge_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (2, 1, "assistant", "</turn>\n### assistant: \\"), (2, 0, None, "é 🙂"), (3, None, "assistant", "a"), (3, 0, "assistant", "b"), (None, 0, "assistant", "c"), (4, 0, "assistant: x", "###"), (4, 1, "assistant", "\\\\### </turn>" * 5000), (4, 1, "assistant", "\\\\### </turn>" * 5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS t", "2 AS turns", "3 AS formatted")
    got = chat_format.op1(df, queries.span_encoder()).select(*CHAT)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected_chat(rows)
    only = chat_format.op1(df.limit(0), queries.span_encoder()).select(*CHAT)
    assert [tuple(r) for r in only.collect()] == expected_chat([])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=5), st.text(st.sampled_from("\\#</turn>:\n aé"), max_size=20)), max_size=5))
def test_chat_template_is_reversible(turns):
    formatted, spans = chat_format.render(turns)
    assert chat_format.parse(formatted) == turns
    assert [chat_format.unescape(formatted[a:b]) for a, b in spans] == [t for _, t in turns]


def test_loss_mask_flags_tokens_that_reach_into_a_span():
    mask = chat_format.loss_mask(np.array([0, 3, 4, 9, 12]), [(1, 4), (4, 4), (5, 10)])
    assert mask.tolist() == [1, 1, 1, 1]
    assert chat_format.loss_mask(np.array([0, 3, 4, 9, 12]), [(3, 4)]).tolist() == [0, 1, 0, 0]


TALK = [("user", "Grüße </turn> 1"), ("assistant", "\\### a: ünï ### </turn>"), ("user", "more"), ("assistant", ""), ("assistant", "last 🙂")]


def loss_digest(change=None, encode=None):
    """Loss text of TALK from its flags, after one of them is turned."""
    r = chat_format._format(TALK, encode or queries.span_encoder(), frozenset({"assistant"}))
    loss, raw = np.array(r["loss"]), r["formatted"].encode()
    if change is not None:
        loss[change] ^= 1
    at = chat_format._bytes_at(r["formatted"], raw)
    texts = [(at(m.start(2)), at(m.end(2))) for m in chat_format._turns(r["formatted"])]
    return "".join(chat_format.loss_texts(raw, np.array(r["borders"]), loss, list(zip(r["loss_starts"], r["loss_stops"])), texts)), r, texts


def test_loss_text_is_that_of_the_flagged_tokens():
    """As it is, it is the assistant's texts; each flag of a token with text of a turn changes it when turned, but for one of mere escapes."""
    text, r, texts = loss_digest()
    assert text == "".join(t for role, t in TALK if role == "assistant")
    borders, seen = r["borders"], 0
    for i, (a, b) in enumerate(zip(borders, borders[1:])):
        holds = any(a < y and x < b and r["formatted"].encode()[max(a, x) : min(b, y)].strip(b"\\") for x, y in texts)
        assert (loss_digest(i)[0] != text) == holds
        seen += holds
    assert seen > 15


def test_loss_text_with_one_token_for_all():
    """A token that covers whole turns adds nothing of the others' texts."""
    whole = lambda t: (np.array([0]), np.array([0, len(t.encode())]))
    assert loss_digest(encode=whole)[0] == "".join(t for role, t in TALK if role == "assistant")
    assert loss_digest(0, whole)[0] == ""


def test_chat_with_one_very_long_word(spark):
    rows = [(1, 0, "user", "x" * 300_000), (1, 1, "assistant", "y" * 300_000), (2, 0, "assistant", "a")]
    got = chat_format.op1(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), queries.span_encoder()).collect()
    assert {r.conv_id: r.loss_chars for r in got} == {1: 300_000, 2: 1, -7: len(chat_format.EXTRA[1][3])}


@pytest.mark.parametrize("rule", tokens.RULES)
def test_section_tokens_against_plain_attribution(spark, rule):
    texts = [(i, t) for i, t in TEXTS if i not in (9, 10)] + [(11, "a\n\n\n  b\nc\n"), (12, "x" * 50 + "\n" * 7)]
    encoder, want = queries.span_encoder(), []
    for doc_id, text in texts:
        raw = (text or "").encode()
        owner = np.concatenate([[0], np.cumsum([c == 10 for c in raw])])[: len(raw)].astype(int)
        n = int(owner[-1]) + 1 if len(raw) else 1
        counts = [0] * n
        borders = encoder(text or "")[1].tolist()
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            held = owner[a:b].tolist()
            counts[{"start": held[0], "end": held[-1], "most": max(sorted(set(held)), key=held.count)}[rule]] += 1
        want += [(doc_id, k, int((owner == k).sum()), counts[k]) for k in range(n)]
    got = [tuple(r) for r in tokens.section_tokens(documents(spark, texts, extra=True), encoder, rule).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


SPACE = ["\n" * 2_000_000, " " * 2_000_000 + "x", "a" + "\r\n\t \u2003" * 400_000 + "b"]


def test_long_white_space_is_encoded(spark):
    encoder = queries.span_encoder()
    for text in SPACE:
        ids, borders = encoder(text)
        assert borders[-1] == len(text.encode()) and len(ids) == len(borders) - 1
    # Below the length at which the pattern's engine gives up, cutting changes nothing.
    encoding, _ = tokens._encoding(encoder.ranks, encoder.pattern)
    for text in ("a" + " " * 5000 + "b", "\n" * 9000, " \t" * 3000 + "\x1c" + "\u3000" * 5000 + " x", "x" + "\n" * 4096 + "\x1f" + " " * 4095 + "\n1"):
        assert encoder(text)[0].tolist() == encoding.encode_ordinary(text)
    counts = tokens.section_tokens(documents(spark, list(enumerate(SPACE))), encoder).groupBy("doc_id").agg({"n_bytes": "sum"}).collect()
    assert {r[0]: r[1] for r in counts} == {i: len(t.encode()) for i, t in enumerate(SPACE)}
    rows = [(i, 0, "assistant", t) for i, t in enumerate(SPACE)]
    got = chat_format.op1(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), encoder).select(*CHAT)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected_chat(rows)


def test_section_tokens_of_whole_documents(spark):
    encoder = queries.span_encoder()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = {}
    for r in queries.op2_token_counts(spark, FOLDER).collect():
        n, b = got.get(r.doc_id, (0, 0))
        got[r.doc_id] = n + r.n_tokens, b + r.n_bytes
    assert got == {k: (len(encoder(t or "")[0]), len((t or "").encode())) for k, t in docs.items()}
    with pytest.raises(ValueError, match="rule"):
        tokens.section_tokens(documents(spark, []), encoder, "none")
