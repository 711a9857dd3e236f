"""Queries over texts, pages and time windows of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import line_diff, text, word_places
from larkspur.plans.registry import query
from larkspur.session import checkpointed, table
from larkspur.streaming import telemetry

_SUMS = "count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS greatest"


def _windowed(spark: SparkSession, sf_dir: str, window, key: str) -> DataFrame:
    out = telemetry.windowed(table(spark, sf_dir, "events"), "ts", window, [key], "value")
    return out.withColumn("total", F.round("total", 4))


@query(f"SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, {_SUMS} FROM events GROUP BY 1, 2, 3")
def window_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windowed(spark, sf_dir, telemetry.tumbling("ts", "1 hour"), "event_type")


@query(f"WITH w AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) - i * INTERVAL 1 HOUR AS a FROM events, range(2) t(i)) SELECT event_type, a AS window_start, a + INTERVAL 2 HOUR AS window_end, {_SUMS} FROM w GROUP BY 1, 2, 3")
def window_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windowed(spark, sf_dir, telemetry.sliding("ts", "2 hours", "1 hour"), "event_type")


@query(
    f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER u <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, {_SUMS} FROM s GROUP BY user_id, k"""
)
def window_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windowed(spark, sf_dir, telemetry.session("ts", "30 minutes"), "user_id")


@query("WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_rows FROM w GROUP BY 1")
def word_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.word_index(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    r"""WITH l AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '\r\n|\n|\r') AS l FROM documents)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(list_filter(l, lambda x: trim(x) = '')) AS BIGINT) AS n_blank, CAST(list_max(list_transform(l, lambda x: length(x))) AS BIGINT) AS longest FROM l"""
)
def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.line_stats(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages) SELECT page_id, CAST(i AS BIGINT) AS position, l[i + 1] AS href FROM (SELECT page_id, l, unnest(range(len(l))) AS i FROM l)""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.links(table(spark, sf_dir, "pages"), "page_id", "html")


@query(
    """WITH l AS (SELECT page_id, regexp_extract_all(html, '<h([1-6])[^>]*>([^<]*)</h[1-6]>', 1) AS a, regexp_extract_all(html, '<h([1-6])[^>]*>([^<]*)</h[1-6]>', 2) AS b FROM pages)
SELECT page_id, CAST(i AS BIGINT) AS position, CAST(a[i + 1] AS INT) AS level, b[i + 1] AS title FROM (SELECT *, unnest(range(len(a))) AS i FROM l)"""
)
def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.headings(table(spark, sf_dir, "pages"), "page_id", "html")


@query("SELECT event_id, name, json_extract_string(props, '$.' || name) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS name FROM events)")
def json_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.members(table(spark, sf_dir, "events"), "event_id", "props")


_EDIT = """a AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '\r\n|\n|\r') AS l FROM documents),
b AS (SELECT doc_id, l, list_concat(l[len(l) // 3 + 1:], ['new line', ''], list_filter(l[:len(l) // 3], lambda x, i: i % 4 <> 0)) AS m FROM a)"""


@query(
    f"""WITH {_EDIT}, c AS (SELECT doc_id, line, sum(s) AS x, sum(1 - s) AS y FROM (SELECT doc_id, unnest(l) AS line, 1 AS s FROM b UNION ALL SELECT doc_id, unnest(m), 0 FROM b) GROUP BY 1, 2)
SELECT b.doc_id, CAST(sum(least(x, y)) AS BIGINT) AS n_same, CAST(any_value(len(l)) - sum(least(x, y)) AS BIGINT) AS n_removed, CAST(any_value(len(m)) - sum(least(x, y)) AS BIGINT) AS n_added,
sha256(any_value(array_to_string(m, chr(10)))) AS replayed FROM b JOIN c USING (doc_id) GROUP BY b.doc_id"""
)
def line_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against an edit of it, whose first third comes last and lost every fourth line: lines kept or moved, removed and added, and the replayed text."""
    old = table(spark, sf_dir, "documents").select("doc_id", "text")
    own = text.lines(F.col("text"))
    third = F.floor(F.size(own) / 3).cast("int")
    first = F.filter(F.slice(own, F.lit(1), third), lambda x, i: (i + 1) % 4 != 0)
    new = old.select("doc_id", F.array_join(F.concat(F.slice(own, third + 1, F.size(own)), F.array(F.lit("new line"), F.lit("")), first), "\n").alias("text"))
    script = checkpointed(line_diff.line_script(old, new, "doc_id", "text"))
    count = lambda *ops: F.count_if(F.col("op").isin(*ops))
    sums = script.groupBy("doc_id").agg(count("kept", "moved").alias("n_same"), count("removed").alias("n_removed"), count("added").alias("n_added"))
    done = line_diff.replayed(old, script, "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("replayed"))
    return sums.join(done, "doc_id")


_WORDS = """low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
lists AS (SELECT doc_id, regexp_extract_all(t, '[a-z]+') AS ws, string_split_regex(t, '[a-z]+') AS gs FROM low),
parts AS (SELECT doc_id, unnest(ws) AS word, unnest(gs[:len(ws)]) AS gap, unnest(range(len(ws))) AS i FROM lists),
places AS (SELECT doc_id, word, i, CAST(sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY i) - length(word) AS BIGINT) AS start FROM parts)"""
_PHRASES = ("the of", "of the and", "in", "to the", "is that in")


@query(f"WITH {_WORDS} SELECT doc_id, word, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS numbers, string_agg(CAST(start AS VARCHAR), ',' ORDER BY i) AS starts FROM places GROUP BY doc_id, word")
def word_places_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every document with its places."""
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return word_places.places(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "word", joined("numbers"), joined("starts"))


@query(f"""WITH {_WORDS}, p AS (SELECT unnest({list(_PHRASES)}) AS phrase), q AS (SELECT phrase, string_split(phrase, ' ') AS ps FROM p), s AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM lists)
SELECT phrase, doc_id, CAST(i - 1 AS BIGINT) AS number FROM s JOIN q ON ws[i] = ps[1] AND ws[i:i + len(ps) - 1] = ps""")
def phrase_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of five phrases, found in the posting blocks of their words."""
    index = word_places.postings(word_places.places(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")
    return word_places.phrase_places(index, [p.split() for p in _PHRASES]).withColumnRenamed("key", "doc_id")


@query(f"""WITH {_WORDS}, n AS (SELECT word, count(*) AS n FROM places GROUP BY word), t AS (SELECT word, n, unnest(range(1, length(word))) AS k FROM n),
r AS (SELECT left(word, k) AS typed, word, n, row_number() OVER (PARTITION BY left(word, k) ORDER BY n DESC, word) AS rank FROM t) SELECT typed, CAST(rank AS INT) AS rank, word, n FROM r WHERE rank <= 5""")
def word_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent words for every beginning of a word."""
    found = word_places.places(table(spark, sf_dir, "documents"), "doc_id", "text")
    return word_places.completions(found.groupBy("word").agg(F.sum(F.size("numbers")).cast("long").alias("n")), 5)


@query(r"""WITH t AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '\r\n|\n|\r') AS l, source FROM documents), n AS (SELECT doc_id, len(l) AS n, coalesce(source, '') AS source FROM t)
SELECT doc_id, CAST(n + 1 AS BIGINT) AS line, 'part ' || source AS title FROM n UNION ALL SELECT doc_id, CAST(n + 3 AS BIGINT), 'tail' FROM n""")
def section_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with two marks and a line between them after its text."""
    docs = table(spark, sf_dir, "documents")
    marked = F.concat(F.coalesce("text", F.lit("")), F.lit("\n// MARK: - part "), F.coalesce("source", F.lit("")), F.lit("\nno mark\n  #region tail"))
    return text.section_marks(docs.select("doc_id", marked.alias("text")), "doc_id", "text")
