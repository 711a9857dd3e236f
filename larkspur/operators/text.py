"""Text operators: lines, words, links, headings, and objects flattened to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lines(text: Column) -> Column:
    """Lines of a text at any of the three line ends; a null text has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\r\n|\n|\r", -1)


def line_stats(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_lines, n_blank and longest (characters of the longest line)."""
    own = lines(F.col(text))
    blank = F.size(F.filter(own, lambda x: F.trim(x) == "")).cast("long")
    return docs.select(key, F.size(own).cast("long").alias("n_lines"), blank.alias("n_blank"), F.array_max(F.transform(own, F.length)).cast("long").alias("longest"))


def word_index(docs: DataFrame, key: str, text: str, pattern: str = "[a-z]+") -> DataFrame:
    """word, n, n_rows: how often each word of the lower-cased texts occurs and in how many rows.

    Words of a row and its distinct words are told apart within the row, so there is one shuffle, of sums a word and task.
    """
    words = docs.select(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)).alias("w"))
    every = F.transform("w", lambda x: F.struct(x.alias("word"), F.lit(1).alias("n"), F.lit(0).alias("n_rows")))
    once = F.transform(F.array_distinct("w"), lambda x: F.struct(x.alias("word"), F.lit(0).alias("n"), F.lit(1).alias("n_rows")))
    return words.select(F.inline(F.concat(every, once))).groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_rows").alias("n_rows"))


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, position (from 0), href of every quoted link in a page."""
    return pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))).alias("position", "href")).withColumn("position", F.col("position").cast("long"))


def headings(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, position (from 0), level, title of the headings of a page that hold no further tags."""
    pattern = F.lit("<h([1-6])[^>]*>([^<]*)</h[1-6]>")
    both = F.arrays_zip(F.regexp_extract_all(html, pattern, F.lit(1)).alias("level"), F.regexp_extract_all(html, pattern, F.lit(2)).alias("title"))
    out = pages.select(key, F.posexplode(both).alias("position", "h"))
    return out.select(key, F.col("position").cast("long").alias("position"), F.col("h.level").cast("int").alias("level"), F.col("h.title").alias("title"))


def members(rows: DataFrame, key: str, json: str) -> DataFrame:
    """key, name, value (as text) of each member of a JSON object; none of what is not an object."""
    return rows.select(key, F.explode(F.from_json(json, "map<string,string>")).alias("name", "value"))


def top_words(docs: DataFrame, by: str, text: str, k: int, pattern: str = "[a-z]{2,}") -> DataFrame:
    """by, word, n, rank: the `k` most frequent words of the lower-cased texts of each group, ties in order of the words."""
    words = docs.select(by, F.explode(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))).alias("word")).groupBy(by, "word").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "word"))
    return words.withColumn("rank", place).where(F.col("rank") <= k)


def identical(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, first, copies: the least key among the rows of the same lines, whatever their line ends, and how many there are."""
    digest = F.sha2(F.array_join(lines(F.col(text)), "\n"), 256)
    rows = docs.select(key, digest.alias("digest"))
    groups = rows.groupBy("digest").agg(F.min(key).alias("first"), F.count("*").alias("copies"))
    return rows.join(groups, "digest").select(key, "first", "copies")


def character_profile(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_basic, n_other, n_invisible: characters of ASCII, others, and those of no width (soft hyphen, zero-width and direction marks)."""
    t = F.coalesce(F.col(text), F.lit(""))
    count = lambda p: F.regexp_count(t, F.lit(p)).cast("long")
    other = count(r"[^\x00-\x7F]")
    return docs.select(key, (F.length(t) - other).cast("long").alias("n_basic"), other.alias("n_other"), count("[\u00AD\u200B-\u200F\u2028-\u202E\u2060-\u2064\uFEFF]").alias("n_invisible"))


def line_differences(a: DataFrame, b: DataFrame, key: str, text: str) -> DataFrame:
    """key, removed, added, kept: numbers of lines, repeated ones too, that only the text of `a`, only that of `b`, and both have.

    Rows of a key that one side lacks count as an empty text. Lines meet by their hash and by themselves, not in pairs of texts.
    """
    side = lambda rows, was: rows.select(key, F.explode(lines(F.col(text))).alias("line"), F.lit(was).alias("was"))
    counts = side(a, 1).unionByName(side(b, 0)).groupBy(key, "line").agg(F.sum("was").alias("x"), F.sum(1 - F.col("was")).alias("y"))
    gone = lambda p, q: F.sum(F.greatest(F.lit(0), F.col(p) - F.col(q)))
    return counts.groupBy(key).agg(gone("x", "y").alias("removed"), gone("y", "x").alias("added"), F.sum(F.least("x", "y")).alias("kept"))


def section_marks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 1), title of the lines that begin a section: a comment with MARK:, or a region."""
    rows = docs.select(key, F.posexplode(lines(F.col(text))).alias("at", "line"))
    title = F.regexp_extract("line", r"^\s*(?://|#|--|/\*|<!--)\s*(?:MARK:\s*-?|#?region\b)\s*(.*?)\s*(?:\*/|-->)?\s*$", 1)
    found = F.col("line").rlike(r"^\s*(?://|#|--|/\*|<!--)\s*(?:MARK:|#?region\b)")
    return rows.where(found).select(key, (F.col("at") + 1).cast("long").alias("line"), title.alias("title"))


def suggestions(index: DataFrame, typed: str, k: int) -> DataFrame:
    """word: the `k` most frequent words of a word index (word, n) that begin with what is typed, but aren't it and are no number."""
    rows = index.where(F.col("word").startswith(typed) & (F.col("word") != typed) & ~F.col("word").rlike("^[0-9.]+$"))
    return rows.orderBy(F.desc("n"), "word").limit(k).select("word")
