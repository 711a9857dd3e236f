"""The trained operators on held-out rows, neighbour search against brute force, and the pipeline."""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import TEXTS, documents

import corpus_pipeline
from larkspur.llm import ann, quality, queries, simhash, toxicity, training, winnowing

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def held_out_accuracy(spark, scored, label, threshold):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet").select("doc_id", label)
    rows = scored.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in rows)
    own = [r for r in rows if r.held_out]
    return sum(r.predicted == r[label] for r in own) / len(own)


def test_quality_of_held_out_rows(spark):
    scored = queries.op5_quality(spark, MIDDLE)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    assert held_out_accuracy(spark, scored, "quality", 0.7) >= 0.85


def test_toxicity_of_held_out_rows(spark):
    scored = queries.op9_toxicity(spark, MIDDLE)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    assert held_out_accuracy(spark, scored, "toxic", 0.3) >= 0.9


@pytest.mark.parametrize(("op", "label"), [(quality.op5, "quality"), (toxicity.op9, "toxic")])
def test_trained_operators_on_edge_rows(spark, op, label):
    docs = documents(spark, TEXTS, extra=True)
    for rows in ([], [(4, 1)], [(i, i % 2) for i in range(1, 11)], [(None, 1), (5, None), (4, 0), (4, 1), (77, 1)]):
        labels = spark.createDataFrame(rows, f"doc_id long, {label} int").withColumn("text", F.lit("other"))
        got = op(docs, labels).collect()
        assert sorted((r.doc_id for r in got), key=str) == sorted((d for d, _ in TEXTS), key=str)
        assert all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
        assert op(docs.limit(0), labels).count() == 0


def test_rules_are_tree_paths_and_compile_to_the_same_score(spark):
    text = "Tree 0 (weight 1.0):\n  If (feature 0 <= 1.5)\n   If (feature 2 <= 0.25)\n    Predict: 1.0\n   Else (feature 2 > 0.25)\n    Predict: 0.0\n  Else (feature 0 > 1.5)\n   Predict: 0.0\n"
    rules = quality.tree_rules(text)
    assert set(rules) == {frozenset({(0, "<=", 1.5)}), frozenset({(0, "<=", 1.5), (2, "<=", 0.25)}), frozenset({(0, "<=", 1.5), (2, ">", 0.25)}), frozenset({(0, ">", 1.5)})}
    model = quality.RuleEnsemble(0.25, [(r, w) for w, r in enumerate(sorted(rules, key=str), 1)])
    rows = [(1.0, 0.25), (1.0, 0.5), (2.0, 0.1)]
    df = spark.createDataFrame(rows, ["__statistic_words", "__statistic_upper"]).select("*", *(F.lit(0.0).alias(f"__statistic_{s}") for s in quality.STATISTICS if s not in ("words", "upper")))
    at = {0: 0, 2: 1}
    for r, row in zip(df.select(model.score().alias("s")).collect(), rows, strict=True):
        total = 0.25 + sum(w for rule, w in model.weights if all((row[at[f]] > t) == (sign == ">") for f, sign, t in rule))
        assert r.s == pytest.approx(1 / (1 + np.exp(-total)))


def plain_statistics(text):
    """The statistics of one text, straight from their description."""
    raw = text.encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
    low = [w.lower() for w in words]
    again = [a == b for a, b in zip(low[1:], low)]
    longest = run = 0
    for same in again:
        run = run + 1 if same else 0
        longest = max(longest, run)
    share = lambda members: sum(b in members for b in raw) / max(1, len(raw))
    out = {name: share(bytes(members)) for name, members in quality._BYTES.items()}
    n = max(1, len(words))
    out |= {"words": np.log10(1 + len(words)), "word_bytes": sum(map(len, words)) / n, "line_words": min(200, len(words) / (1 + raw.count(b"\n")))}
    out |= {"repeat": sum(again) / n, "distinct": len(set(low)) / n if words else 1.0, "longest_run": min(100, longest)}
    return [float(out[k]) for k in quality.STATISTICS]


def test_statistics_equal_plain_ones(spark):
    docs = documents(spark, [*TEXTS, (20, "A a a A b b\n\nc" + " x" * 300), (21, "ü" * 5000)])
    names = [quality._column(s) for s in quality.STATISTICS]
    for r in quality.with_statistics(docs.unionByName(spark.read.parquet(f"{SMALL}/documents.parquet"))).collect():
        assert [r[n] for n in names] == pytest.approx(plain_statistics(r.text or ""), abs=1e-9)


def test_quality_scores_equal_plain_ones(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    assert model.weights
    for r in quality.with_statistics(docs).select("text", model.score().alias("score")).collect():
        x = plain_statistics(r.text)
        total = model.base + sum(w for rule, w in model.weights if all((x[f] > t) == (sign == ">") for f, sign, t in rule))
        assert r.score == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)


def test_toxicity_scores_equal_plain_ones(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.fit(docs, labels)
    assert lexicon.stems
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.with_scores(docs, lexicon).collect():
        words, total = toxicity.fold(texts[r.doc_id]).split(), 0.0
        for i, w in enumerate(words):
            own = [s for s in lexicon.stems if w.startswith(s)]
            near = {f"{a} {b}" for a, b in zip(words[max(0, i - 1) : i + 1], words[max(0, i - 1) + 1 : i + 2])}
            if own and not near & lexicon.exceptions:
                total += lexicon.stems[max(own, key=len)]
        z = lexicon.base + lexicon.by_sum * np.log1p(total) + lexicon.by_rate * np.log1p(total * 100 / (100 + len(texts[r.doc_id])))
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_accents_fold_in_either_form():
    assert {toxicity.fold(unicodedata.normalize(f, "Ïdíọt İdiot ﬁx Ångström")) for f in ("NFC", "NFD", "NFKC", "NFKD")} == {toxicity.fold("idiot idiot fix angstrom")}
    assert toxicity.fold("кмтвн") == toxicity.fold("kmtbh")


def test_phrases_reach_over_long_gaps():
    text = toxicity.fold("a" * 200 + " " * 500 + "you" + " " * 300 + "b" * 100)
    at = text.index("you")
    assert toxicity.phrases(text, at) == [f"{'a' * 200} you", f"you {toxicity.fold('b' * 100).strip()}"]
    assert toxicity.phrases(" you ", 1) == []


def test_labelled_sample_is_bounded(spark):
    docs = spark.range(3000).selectExpr("id % 50 AS doc_id", "concat('text ', CAST(id % 100 AS STRING)) AS text")
    labels = spark.range(400).selectExpr("id % 200 AS doc_id", "CAST(id % 3 = 0 AS INT) AS quality")
    got = training.labelled_docs(docs, labels, "quality", 20).collect()
    assert len(got) == 20 and len({r.text for r in got}) == 20
    every = training.labelled_docs(docs, labels, "quality").collect()
    assert len(every) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(50))


def test_toxic_words_are_found_behind_look_alikes():
    lexicon = toxicity.Lexicon({toxicity.fold("idiot").strip(): 3.0}, frozenset({"dear iiddot"}))
    plain = lexicon.score("you idiot")
    assert lexicon.score("you 1d1оt") == pytest.approx(plain)
    assert plain > lexicon.score("you there")
    assert lexicon.total(toxicity.fold("idiots and an antiidiot")) == 3.0
    shielded = toxicity.Lexicon(lexicon.stems, frozenset({toxicity.fold("dear idiot").strip()}))
    assert shielded.total(toxicity.fold("my dear idiot")) == 0


# Neighbours


def brute(vectors, asked, k=10):
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], float)
    out = {}
    for q in asked:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def test_neighbours_recall_on_all_rows(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{MIDDLE}/embeddings.parquet").collect()]
    want = brute(rows, [i for i, _ in rows if i % 100 == 0])
    got: dict[int, list] = {}
    for r in queries.op6_neighbours(spark, MIDDLE).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    assert all(s == pytest.approx(dict(want[q])[i]) for q in want for i, s in got[q] if i in dict(want[q]))


def test_neighbours_edge_rows(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(0, 301)]
    odd = [(None, [1.0, 2.0]), (1000, None), (1100, [0.0, 0.0]), (1200, [None, 1.0]), (1300, [float("nan"), 1.0]), (1400, [float("inf"), 1.0]), (1500, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS code", "3 AS x")
    got: dict[int, list] = {}
    for r in ann.op6(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute(rows, [0, 100, 200, 300])
    few = spark.createDataFrame([(100, [1.0, 0.0]), (7, [0.0, 2.0]), (8, [0.0, 2.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.vec_id) for r in ann.op6(few).orderBy("rank").collect()] == [(1, 7), (2, 8)]
    assert ann.op6(few.limit(0)).count() == 0
    assert ann.op6(few.where("vec_id = 100")).count() == 0


def recall(spark, x, step):
    """Share of the true 10 nearest found, and whether every query has 10 rows."""
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    asked = list(range(0, len(x), step))
    got: dict[int, list[int]] = {i: [] for i in asked}
    for r in ann.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % step == 0).collect():
        got[r.query_id].append(r.vec_id)
    want = brute(rows, asked)
    return sum(len(set(got[q]) & {i for i, _ in want[q]}) for q in asked) / (10 * len(asked)), all(len(v) == 10 for v in got.values())


def test_neighbours_of_outliers_beside_tight_clusters(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20, 64))[rng.integers(0, 20, 4000)] + 0.01 * rng.normal(size=(4000, 64))
    x[::40] = rng.normal(size=(100, 64))
    share, whole = recall(spark, x, 40)
    assert whole and share >= 0.9


def test_neighbours_within_a_group_of_near_copies(spark):
    rng = np.random.default_rng(6)
    noise = rng.normal(size=(1500, 6)) @ rng.normal(size=(6, 64))
    x = rng.normal(size=64) + 1e-3 * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    share, whole = recall(spark, x, 30)
    assert whole and share >= 0.95


def test_neighbours_of_many_vectors_with_a_hub_and_a_crowd(spark):
    """12,000 vectors: a third of them near copies, and one vector in the middle that is near to very many."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 48))[rng.integers(0, 60, 12_000)] + 0.4 * rng.normal(size=(12_000, 48))
    x[::3] = 2 + 1e-2 * rng.normal(size=(4000, 48))
    x[100] = 0
    x[100, 0] = 1e-3
    share, whole = recall(spark, x, 100)
    assert whole and share >= 0.9


# Pipeline


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    table = lambda n: spark.read.parquet(f"{SMALL}/{n}.parquet")
    (_, keep), (_, dedup), (_, drop), (_, redact), (_, encode) = corpus_pipeline.STAGES
    good = keep(spark, docs, SMALL)
    accepted = quality.op5(docs, table("labels")).where("predicted = 1")
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in accepted.collect())
    single = dedup(spark, good, SMALL)
    groups = simhash.op10(good).select("component_id").distinct()
    assert sorted(r.doc_id for r in single.collect()) == sorted(r.component_id for r in groups.collect())
    clean = drop(spark, single, SMALL)
    bad = {r.doc_id for r in winnowing.op8(single, table("benchmark")).where("contaminated").collect()}
    assert sorted(r.doc_id for r in clean.collect()) == sorted({r.doc_id for r in single.collect()} - bad)
    assert all(x.columns == docs.columns for x in (good, single, clean))
    plain = redact(spark, clean, SMALL)
    assert plain.columns == docs.columns
    assert plain.count() == clean.count()
    assert all(r.n_chars == len(r.text) for r in plain.where("text like '%[REDACTED]%'").collect())
    done = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(str, done.select("doc_id", "n_tokens", "decoded_sha256").collect())) == sorted(map(str, encode(spark, plain, SMALL).select("doc_id", "n_tokens", "decoded_sha256").collect()))


def test_pipeline_stages_on_edge_rows(spark):
    docs = documents(spark, TEXTS, extra=True)
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, rows, SMALL).count() <= rows.count()
