"""The positional word index and the quadtree against plain code."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from larkspur.operators import quadtree, siblings, windows, word_places

TEXTS = [(1, "The cat, the CAT and the cat"), (2, None), (3, ""), (4, "cat the cat"), (5, "İthe 12 the the cat ünd"), (5, "the cat"), (6, "x" * 10_000 + " the cat " * 300)]


def test_places_of_words(spark, monkeypatch):
    docs = spark.createDataFrame(TEXTS, "k int, t string")
    got = sorted((r.k, r.word, tuple(r.numbers), tuple(r.starts)) for r in word_places.places(docs, "k", "t").collect())
    want = []
    for k, t in TEXTS:
        at: dict[str, tuple[list, list]] = {}
        for n, m in enumerate(re.finditer("[a-zA-Z]+", t or "")):
            low = at.setdefault(m[0].lower(), ([], []))
            low[0].append(n)
            low[1].append(m.start())
        want += [(k, w, tuple(a), tuple(b)) for w, (a, b) in at.items()]
    assert got == sorted(want)


def test_phrases_by_intersection(spark, monkeypatch):
    """In blocks of two texts, so that a frequent word has many."""
    monkeypatch.setattr(word_places, "BLOCK", 2)
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice("a a a b b c d".split()) for _ in range(rng.randrange(40)))) for i in range(60)]
    index = word_places.postings(word_places.places(spark.createDataFrame(texts, "k int, t string"), "k", "t"), "k")
    assert index.where("word = 'a'").count() > 5
    phrases = [["a", "b"], ["a", "a", "a"], ["c", "d", "a", "b"], ["d"], ["zz", "a"]]
    got = sorted(map(tuple, word_places.phrase_places(index, phrases).collect()))
    want = sorted((" ".join(p), k, i) for p in phrases for k, t in texts for ws in [t.split()] for i in range(len(ws)) if ws[i : i + len(p)] == p)
    assert got == want


def test_completions(spark):
    words = {"the": 9, "they": 4, "then": 4, "to": 20, "t": 99, "12": 7, "123": 5, "tha": 1}
    got = word_places.completions(spark.createDataFrame(list(words.items()), "word string, n long"), 2).collect()
    assert sorted((r.typed, r["rank"], r.word) for r in got) == [("t", 1, "to"), ("t", 2, "the"), ("th", 1, "the"), ("th", 2, "then"), ("the", 1, "then"), ("the", 2, "they")]


def test_sites_that_crowd_in_one_spot(spark):
    """100,000 sites, half of them within a ten-thousandth of the extent: no leaf has more than its bound, and each point its nearest."""
    rng = np.random.default_rng(7)
    n = 100_000
    xy = np.concatenate([rng.random((n // 2, 2)) * 100, 3 + rng.random((n // 2 - 5, 2)) * 1e-2, np.full((5, 2), 50.0)])
    sites = spark.createDataFrame(zip(range(n), xy[:, 0].tolist(), xy[:, 1].tolist()), "site long, x double, y double")
    tree = quadtree.Quadtree(sites)
    most = tree.leaves.groupBy("level", "i", "j").count().agg({"count": "max"}).first()[0]
    assert most <= quadtree.BOUND
    asked = np.concatenate([rng.random((60, 2)) * 100, 3 + rng.random((60, 2)) * 1e-2, [[50.0, 50.0], [-500.0, 2.0], [1e6, 1e6]]])
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(asked)] + [(-1, None, 1.0), (-2, float("nan"), 1.0)], "id long, x double, y double")
    got = {r.id: (r.site, r.distance) for r in tree.nearest(points).collect()}
    assert len(got) == len(asked)
    for i, p in enumerate(asked):
        d = np.sqrt(((xy - p) ** 2).sum(axis=1))
        assert got[i] == (int(np.lexsort((np.arange(n), d))[0]), d.min())


def test_others_and_few_sites(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id long, x double, y double")
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (0, 0), (0, 0), (1, 0), (5, 5), (5, 5)])]
    own = lambda df: quadtree.Quadtree(df.withColumnRenamed("id", "site"), others=True, bound=1).nearest(df)
    assert {r.id: (r.site, r.distance) for r in own(frame(rows)).collect()} == {0: (1, 0.0), 1: (0, 0.0), 2: (0, 0.0), 3: (0, 1.0), 4: (5, 0.0), 5: (4, 0.0)}
    assert own(frame(rows[:1])).count() == 0 and own(frame([])).count() == 0
    assert Counter(r.site for r in quadtree.Quadtree(frame(rows[3:4]).withColumnRenamed("id", "site")).nearest(frame(rows)).collect()) == {3: 6}


def test_inserts_among_siblings_equal_a_plain_list(spark):
    """1,000 edits in four batches, most of them in one narrow gap, so that places are used up."""
    rng = random.Random(9)
    plain = {"p": [f"p{i}" for i in range(10)], "q": ["q0"]}
    nodes = siblings.placed(spark.createDataFrame([(x, p, i) for p, xs in plain.items() for i, x in enumerate(xs)] + [("p", None, 0), ("q", None, 1)], "id string, parent string, i int"), ["i"]).select("id", "parent", "place")
    nodes = nodes.withColumn("place", F.col("place") / (1 << 14)).withColumn("place", F.col("place").cast("long"))
    for batch in range(4):
        there, edits = [x for xs in plain.values() for x in xs], []
        for n in range(250):
            side = rng.choice(["before", "after", "under"])
            anchor = rng.choice("pq") if side == "under" else rng.choice(["p3", "q0", rng.choice(there)])
            edits.append((f"n{batch}.{n}", side, anchor, n))
        edits.append(("lost", "after", "unknown", 1))
        nodes = siblings.insert(nodes, spark.createDataFrame(edits, "id string, side string, anchor string, n long")).checkpoint()
        for id, side, anchor, _ in edits[:-1]:
            if side == "under":
                continue
            xs = next(xs for xs in plain.values() if anchor in xs)
            xs.insert(xs.index(anchor) + (side == "after"), id)
        for id, side, anchor, _ in edits[:-1]:
            if side == "under":
                plain[anchor].append(id)
    got = {}
    for r in nodes.where("parent IS NOT NULL").orderBy("place").collect():
        got.setdefault(r.parent, []).append(r.id)
    assert got == plain


def test_pies_between_angles(spark):
    rows = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", -5.0)], "k string, v double")
    got = {r.k: (round(r.start_angle, 9), round(r.end_angle, 9)) for r in windows.pie(rows, "k", "v", 1.0, 3.0, 0.1).collect()}
    assert got == {"a": (1.0, 2.375), "b": (2.375, 2.9), "c": (2.9, 3.0)}
