"""The prefix trie, paragraph sketches and the Merkle manifest against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from oracle import assert_same
from samples import TEXTS, documents

from larkspur.llm import merkle, paragraph_sketch, prefix_trie, queries

FOLDER = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda t: tuple((x is not None, x if x is not None else 0) for x in t))


# Prefix trie


def plain_trie(rows: list[tuple]) -> list[tuple]:
    """Every node by looking at all conversations."""
    own: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, sha(f"{len((role or '').encode())}:{role or ''}{text or ''}"), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        base, h = c - (c % 20 if c >= 0 else -(-c % 20)), zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members: dict[tuple, list[int]] = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for path, cs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(1 for p in below if not any(q[: len(p)] == p and len(q) > len(p) for q in below))
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in cs if built[c] == path)))
        out.append((min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), len(kids), leaves, saved, sha(ends)))
    return out


def random_turns(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for c in [None, -45, -21, -20, -7, -1, *range(0, 70), 205, 1003]:
        if rng.random() < 0.2:
            continue
        for t in range(rng.choice([1, 2, 3, 5, 8])):
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(["a", "a b", " a\tb ", "", None, "ä c"])))
    return rows + rows[:5]


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_brute_force(spark, seed, monkeypatch):
    """Null and negative ids, null and repeated turns, repeated rows, lone bases; families written in parts."""
    monkeypatch.setattr(prefix_trie, "HELD", [200_000, 3, 1][seed])
    rows = random_turns(seed)
    got = prefix_trie.op11(spark.createDataFrame(rows, TURNS).selectExpr("*", "'x' AS key", "1 AS base", "2 AS depth")).collect()
    assert ordered(got) == ordered(plain_trie(rows))


def test_trie_of_long_conversations_and_of_many_copies(spark):
    """One conversation of 3,000 turns under another; 3,000 copies of one conversation, which all end at one node."""
    long = [(40, t, "user", f"t{t}") for t in range(3000)] + [(41, t, "user", f"t{t}") for t in range(2000)]
    copies = [(100 + 20 * i, t, "user", "same") for i in range(3000) for t in range(2)]
    got = {(r.conv_id, r.depth): r for r in prefix_trie.trie(spark.createDataFrame(long + copies, TURNS)).collect()}
    assert got[40, 3000].n_leaves == got[40, 1].n_leaves == 1 and got[40, 2000].n_convs == 2 and got[40, 2000].n_children == 1
    assert got[40, 1].saved_tokens == 2000 and got[100, 2].n_convs == 3000 and got[100, 2].saved_tokens == 2999
    assert got[100, 2].ends_sha256 == sha(",".join(str(100 + 20 * i) for i in range(3000)))
    assert got[40, 0].saved_tokens == 2000 + 2 * 2999 and got[40, 2000].ends_sha256 == sha("41")


def test_trie_of_nothing(spark):
    assert prefix_trie.op11(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie.op11(spark.createDataFrame([(None, 1, "user", "x")], TURNS)).count() == 0


# Paragraph sketches


def plain_pieces(text: str) -> Counter:
    """Paragraphs and how often they occur; where a line is cut is a matter of the digests, so whole lines are compared."""
    return Counter(x for x in (tuple(line.split()) for line in re.sub(r"[\x09\x0B-\x0D]", " ", text).split("\n")) if x)


def test_sketches_find_the_differing_lines():
    """With lines left whole, what is peeled is the difference of the multisets of lines, at any size."""
    rng = random.Random(5)
    texts = ["", "a", "a\na", "\n\n a b \n"]
    for n in (3, 20, 300, 5000):
        lines = [f"line {rng.randrange(n)} of {n}" for _ in range(n)]
        texts += ["\n".join(lines), "\n".join(lines[: n // 2] + ["new"] * 3 + lines[n // 2 + 2 :]), "\n".join(rng.sample(lines, n))]
    sets = paragraph_sketch.Sets(pa.array(texts), 0)
    pairs = [(i, j) for i in range(len(texts)) for j in range(len(texts))]
    a, b = (np.array(x) for x in zip(*pairs))
    near = paragraph_sketch.likeness(sets, a, b)
    for (i, j), got in zip(pairs, near):
        x, y = plain_pieces(texts[i]), plain_pieces(texts[j])
        both, union = (x & y).total(), (x | y).total()
        assert got == pytest.approx(both / union if union else 1.0)
    pair, digest, sign = paragraph_sketch.differences(sets, np.array([0]), np.array([1]))
    assert pair.tolist() == [0] and sign.tolist() == [-1] and digest[0] == sets.digests[sets.offsets[1]]


def test_sketch_query_compares_with_the_next_document(spark):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())
    want = {}
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        n = len(text) // 2
        want[i] = (text, text[: len(text) - n] + following[:n], following)
    got = queries.op12_paragraph_sketch(spark, FOLDER).collect()
    assert len(got) == len(rows)
    alone = paragraph_sketch.Sets(pa.array([t for i in sorted(want) for t in want[i]]))
    prints, at = alone.base.texts(), 3 * np.arange(len(rows))
    near = {k: paragraph_sketch.likeness(alone, at, at + k) for k in (1, 2)}
    for n, r in enumerate(sorted(got, key=lambda r: r.doc_id)):
        text, new, _ = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), sha(new), prints[3 * n], prints[3 * n + 1])
        assert (r.near_edited, r.near_next) == (near[1][n], near[2][n])
    assert sum(r.near_edited > r.near_next for r in got) >= 0.9 * len(got)


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_sketches_of_edge_cases(spark, parts):
    """Nulls, empty and very long texts, repeated rows and clashing columns: each row once, whatever the parts."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = paragraph_sketch.op12(documents(spark, [*TEXTS, (None, "x"), (None, None), (11, "\n".join("p" * (i % 7) for i in range(3000)))], extra=True)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars) for r in got) == sorted((i is not None, i or 0, len(t or "")) for i, t in [*TEXTS, (None, "x"), (None, ""), (11, "\n".join("p" * (i % 7) for i in range(3000)))])
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.n_chars), set()).add((r.fingerprint, r.edited_fingerprint))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    same = [r for r in got if r.doc_id == 7]
    assert len(same) == 2 and same[0].fingerprint == same[1].fingerprint and {r.near_next for r in same} >= {1.0}
    assert next(r for r in got if r.doc_id == 9).near_next > 0.99
    # After the last comes the first: a row without doc_id.
    last, first = "\n".join("p" * (i % 7) for i in range(3000)), min((None, "x"), (None, ""), (None, "a row without an id"), key=lambda x: xx(spark, x[1]))[1]
    assert next(r for r in got if r.doc_id == 11).edited_sha256 == sha(paragraph_sketch.edited(last, first))


def xx(spark, text: str) -> int:
    from pyspark.sql import functions as F

    return spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]


def test_sketches_of_few_rows(spark):
    assert paragraph_sketch.op12(documents(spark, [])).count() == 0
    one = paragraph_sketch.op12(documents(spark, [(5, "a b\nc d")])).collect()
    assert one[0].near_next == 1 and one[0].edited_sha256 == sha("a b\n" + "a b")
    assert paragraph_sketch.op12(documents(spark, [(None, None)])).first().near_edited == 1


# Merkle manifest


def plain_tree(leaves: list[str]) -> tuple[str, list[list[tuple[int, str]]]]:
    steps, owner, now = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(now) > 1:
        above, whose = [], []
        for a in range(0, len(now), 16):
            run = now[a : a + 16]
            for j in range(len(run)):
                for o in owner[a + j]:
                    steps[o].append((j, "".join(run[:j] + run[j + 1 :])))
            above.append(sha("".join(run)))
            whose.append(sum(owner[a : a + 16], []))
        now, owner = above, whose
    return now[0], steps


def plain_manifest(rows: list[tuple]) -> list[tuple]:
    """Rows (doc_id, source, lang, n_chars, text)."""
    sized = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(sized, (*r[:4], text))))
    by: dict = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    trees = {s: plain_tree([leaf(r, r[4]) for r in by[s]]) for s in sources}
    root, over = plain_tree([trees[s][0] for s in sources])
    out = []
    for s, up in zip(sources, over):
        for r, own in zip(by[s], trees[s][1]):
            steps, node = own + up, leaf(r, r[4])
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            folded = leaf(r, re.sub("[A-Z]+", lambda m: m[0].lower(), r[4])) if changed else node
            for place, others in steps:
                folded = sha(others[: 64 * place] + folded + others[64 * place :])
            out.append((r[0], node, trees[s][0], root, sha("".join(o for _, o in steps)), folded, folded == root))
    return out


FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize(("seed", "parts"), [(0, 1), (1, 5), (2, 60)])
def test_manifest_equals_brute_force(spark, seed, parts):
    """Null fields and ids, repeated rows and ids, groups of 1, 16, 17, 256, 257 and 600 rows over few and many partitions."""
    rng = random.Random(seed)
    rows, n = [], 0
    for source, many in [("a", 1), ("b", 16), ("ä", 17), (None, 256), ("c", 257), ("hot", 600), *((f"s{i}", 1) for i in range(20))]:
        for _ in range(many):
            n += 1
            rows.append((rng.choice([n, n, n, None, 7]), source, rng.choice(["en", None]), rng.choice([n, None]), rng.choice(["Text A", "text a", "Ünï", "", None])))
    rows += rows[-30:] * 2
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, FIELDS).selectExpr("*", "1 AS part", "2 AS at", "'z' AS leaf", "3 AS row", "4 AS steps")
        assert ordered(merkle.op13(df).collect()) == ordered(plain_manifest(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_manifest_proofs_can_be_checked_alone(spark):
    """A proof folds to the root from its own leaf, and from no other."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = merkle.manifest(docs).collect()
    assert len(got) == docs.count() and len({r.root for r in got}) == 1
    for r in got:
        steps = [(s.place, s.others) for s in r.steps]
        assert merkle.fold_up(r.leaf, steps) == r.root != merkle.fold_up(sha("other"), steps)


def test_manifest_changes_with_a_letter_and_not_with_the_order(spark):
    docs = documents(spark, TEXTS)
    root = merkle.Manifest(docs).root
    assert root == merkle.Manifest(docs.repartition(7)).root
    assert root != merkle.Manifest(documents(spark, [*TEXTS[:-1], (10, (TEXTS[-1][1] or "") + "x")])).root


def test_manifest_of_few_rows(spark):
    assert merkle.op13(documents(spark, [])).count() == 0
    r = merkle.op13(documents(spark, [(None, None)])).first()
    assert r.leaf == r.subroot == r.root == r.folded_root == sha("-3:web---") and r.proof_sha256 == sha("") and r.verified


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_merkle_manifest"])
def test_queries_match_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, FOLDER), queries.ORACLES[name], FOLDER)
