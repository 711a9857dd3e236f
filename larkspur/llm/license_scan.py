"""Licence scan: phrase places, and an exact set-similarity join of text lines with notice templates."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import running
from larkspur.session import checkpointed

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words are runs of these characters in text with A-Z lower-cased.
_W, _N = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: (phrase, label).
PHRASES: tuple[tuple[str, str], ...] = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: (label, notice). A line matches if it holds at least CONTAINMENT of the notice's distinct words, and so does any stretch
#: of as many words as the notice has, over line breaks.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("agpl", "GNU Affero General Public License, version 3."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "GNU Lesser General Public License, version 2.1."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
    ("reserved", "All rights reserved."),
)
CONTAINMENT = 0.8
#: Tasks that the rows of one text may be dealt to.
PARTS = 16


def template_words(notice: str) -> list[str]:
    """Distinct words of an ASCII notice."""
    return sorted(set("".join(c if c.isalnum() else " " for c in notice.lower()).split()))


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, low, key): text with A-Z lower-cased, null as empty, and the 128-bit key by which equal texts are known."""
    low = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _UPPER.lower())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), low.alias("low"))
    return rows.withColumn("key", F.struct(F.xxhash64("low").alias("a"), F.xxhash64(F.lit("key"), "low").alias("b")))


def notice_length(notice: str) -> int:
    """Words of an ASCII notice, repeated ones too."""
    return len("".join(c if c.isalnum() else " " for c in notice.lower()).split())


def _words(low: Column) -> Column:
    return F.split(low, f"{_N}+")


def word_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary by the number of texts that hold each word, rarest first, ties in code point order.

    As many rows as the templates have words reach the driver; the counts are of all texts.
    """
    mine = F.array(*map(F.lit, vocabulary))
    counts = _texts(docs).select(F.explode(F.array_intersect(_words(F.col("low")), mine)).alias("word")).groupBy("word").count().collect()
    count = {r.word: r["count"] for r in counts}
    return sorted(vocabulary, key=lambda w: (count.get(w, 0), w))


def matching_lines(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = CONTAINMENT) -> DataFrame:
    """(key, label, containment) of each line, or stretch over lines, that holds `threshold` of a template's words: an exact join.

    A line with c = ceil(threshold * n) of a template's n words has one of its n - c + 1 rarest. So lines meet templates on
    those prefix words only; from the first of them, what is left of either word list (rarest first) must reach c;
    the pairs that remain are verified.
    """
    sets = [(n, label, template_words(text)) for n, (label, text) in enumerate(templates)]
    order = word_order(docs, sorted({w for _, _, ws in sets for w in ws}))
    rank = {w: i for i, w in enumerate(order)}
    rows, prefix = [], set()
    for n, label, ws in sets:
        ranks = sorted(rank[w] for w in ws)
        need = ceil(threshold * len(ws) - 1e-9)
        for at, r in enumerate(ranks[: len(ws) - need + 1]):
            rows.append((r, n, label, at, need, ranks))
            prefix.add(order[r])
    # A few rows for each template, whatever the data.
    table = F.broadcast(docs.sparkSession.createDataFrame(rows, "word int, template int, label string, at int, need int, words array<int>"))
    held = F.array(*map(F.lit, sorted(prefix)))
    ranks = F.create_map(*(x for w in order for x in (F.lit(w), F.lit(rank[w]))))
    lines = F.filter(F.split("low", "\n"), lambda x: F.arrays_overlap(_words(x), held))
    lines = _texts(docs).select("key", F.explode(F.transform(lines, lambda x: F.array_intersect(_words(x), F.array(*map(F.lit, order))))).alias("line"))
    lines = lines.select("key", F.array_sort(F.transform("line", lambda w: F.element_at(ranks, w))).alias("line")).distinct()
    pairs = lines.select("key", "line", F.posexplode("line").alias("pos", "word")).join(table, "word")
    pairs = pairs.where(1 + F.least(F.size("words") - F.col("at") - 1, F.size("line") - F.col("pos") - 1) >= F.col("need"))
    common = F.size(F.array_intersect("line", "words"))
    found = pairs.where(common >= F.col("need")).select("key", "label", (common / F.size("words")).alias("containment"))
    return found.unionByName(_wrapped(docs, templates, rows, order)).distinct()


def _wrapped(docs: DataFrame, templates: tuple[tuple[str, str], ...], rows: list[tuple], order: list[str]) -> DataFrame:
    """(key, label, containment) of templates found in stretches of words over line breaks, each as long as the notice.

    A stretch that matches holds a prefix word of the template (`rows`), so only what surrounds those words is compared.
    """
    clauses = [(order[r], label, notice_length(templates[n][1]), need, [order[w] for w in ranks]) for r, n, label, _, need, ranks in rows]
    table = F.broadcast(docs.sparkSession.createDataFrame(clauses, "word string, label string, span int, need int, names array<string>"))
    held, most = F.array(*map(F.lit, sorted({c[0] for c in clauses}))), max(c[2] for c in clauses)
    texts = _texts(docs).where(F.contains("low", F.lit("\n"))).select("key", _words(F.col("low")).alias("ws")).where(F.arrays_overlap("ws", held))
    first = lambda i: F.greatest(i - most + 1, F.lit(0))
    block = lambda i: F.struct((i - first(i)).alias("at"), F.slice("ws", first(i) + 1, F.lit(2 * most - 1)).alias("near"))
    spots = F.filter(F.transform("ws", lambda w, i: F.when(F.array_contains(held, w), i)), lambda i: i.isNotNull())
    blocks = texts.select("key", F.explode(F.transform(spots, block)).alias("b")).select("key", "b.at", "b.near").distinct()
    pairs = blocks.withColumn("word", F.get("near", F.col("at"))).join(table, "word")
    starts = F.sequence(F.greatest(F.col("at") - F.col("span") + 1, F.lit(0)), F.col("at"))
    common = F.array_max(F.transform(starts, lambda k: F.size(F.array_intersect(F.slice("near", k + 1, F.col("span")), "names"))))
    hits = pairs.where(F.size(F.array_intersect("near", "names")) >= F.col("need")).withColumn("common", common)
    return hits.where("common >= need").select("key", "label", (F.col("common") / F.size("names")).alias("containment"))


def _phrase_pattern(phrase: str) -> str:
    first, *rest = phrase.split()
    return f"{first}(?<!{_W}{first})" + "".join(f"{_N}+{w}" for w in rest) + f"(?!{_W})"


def phrase_starts(low: Column, phrase: str) -> Column:
    """The word positions at which the phrase's words stand consecutively: running sums of the words between them."""
    pattern, size = _phrase_pattern(phrase), len(phrase.split())
    words = F.transform(F.split(low, pattern, -1), lambda x: F.regexp_count(x, F.lit(f"{_W}+")).cast("long") + size)
    stops = running(F.slice(words, F.lit(1), F.size(words) - 1), lambda a, b: a + b)
    return F.transform(stops, lambda x: x - size)


def find_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, starts (array of positions), base_labels, labels, score.

    labels: those of phrases and of templates that some line or stretch of words matches; score: 1 with a phrase, else the largest
    containment of a match, else 0. Null and empty texts have no words and no labels; repeated rows are
    each returned.
    """
    low = F.col("low")
    none = F.array().cast("array<bigint>")
    places = [F.when(low.rlike(_phrase_pattern(p)), phrase_starts(low, p)).otherwise(none) for p, _ in PHRASES]
    base = _texts(docs).select("doc_id", "key", F.regexp_count(low, F.lit(f"{_W}+")).cast("long").alias("n_words"), F.array(*places).alias("places"))
    labels = F.array(*(F.when(F.size(F.get("places", F.lit(i))) > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)))
    # The rows of one frequent text are dealt to PARTS tasks.
    base = base.select("doc_id", "key", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).alias("part"), "n_words", F.flatten("places").alias("starts"), F.array_compact(labels).alias("base_labels"))
    found = matching_lines(docs).groupBy("key").agg(F.collect_set("label").alias("found"), F.max("containment").alias("containment"))
    found = checkpointed(found).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    out = base.join(found, ["key", "part"], "left")
    score = F.when(F.size("starts") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0)))
    every = F.array_union("base_labels", F.coalesce("found", F.array().cast("array<string>")))
    return out.select("doc_id", "n_words", "starts", F.array_sort(F.array_distinct("base_labels")).alias("base_labels"), F.array_sort(every).alias("labels"), score.alias("score"))


def op7(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of `docs`."""
    join = lambda c: F.array_join(c, ",").alias(c)
    return find_licenses(docs).select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").alias("first_word"), F.array_max("starts").alias("last_word"), join("base_labels"), join("labels"), "score"
    )


def _oracle() -> str:
    """DuckDB SQL for op7: phrase places in word lists; all lines, and all stretches that begin with a word of it, against each template."""
    quote = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    w = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    phrases = " UNION ALL ".join(f"SELECT {quote(p.split())} AS p, '{label}' AS label" for p, label in PHRASES)
    templates = " UNION ALL ".join(f"SELECT {quote(template_words(t))} AS ws, '{label}' AS label, {ceil(CONTAINMENT * len(template_words(t)) - 1e-9)} AS need, {notice_length(t)} AS span" for label, t in TEMPLATES)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS t FROM documents),
words AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{w}') AS ws FROM docs),
phrases AS ({phrases}),
spots AS (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM words),
starts AS (SELECT rid, i - 1 AS pos, label FROM spots, phrases WHERE ws[i] = p[1] AND ws[i:i + len(p) - 1] = p),
base AS (SELECT rid, count(*) AS n, min(pos) AS lo, max(pos) AS hi, list(DISTINCT label) AS labels FROM starts GROUP BY rid),
templates AS ({templates}),
lines AS (SELECT DISTINCT rid, list_distinct(regexp_extract_all(unnest(string_split(t, chr(10))), '{w}')) AS ls FROM words),
hits AS (SELECT rid, label, len(list_intersect(ls, templates.ws)) AS c, len(templates.ws) AS n, need FROM lines, templates
UNION ALL SELECT rid, label, len(list_intersect(list_distinct(spots.ws[i:i + span - 1]), templates.ws)), len(templates.ws), need FROM spots JOIN (SELECT *, unnest(ws) AS w FROM templates) AS templates ON spots.ws[i] = w),
found AS (SELECT rid, list(DISTINCT label) AS labels, max(c / n) AS containment FROM hits WHERE c >= need GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ',') AS labels,
  CASE WHEN coalesce(base.n, 0) > 0 THEN 1.0 ELSE coalesce(containment, 0.0) END::DOUBLE AS score
FROM words LEFT JOIN base USING (rid) LEFT JOIN found USING (rid)"""


ORACLE_SQL = _oracle()
