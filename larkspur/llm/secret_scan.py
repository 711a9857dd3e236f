"""Secret scan: a trigram index proposes texts for each rule, and the rule's regex verifies them."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import bound, running, unused
from larkspur.session import checkpointed

#: (kind, regex of both Java and Python, group that is the span, group whose length is measured, least length). A span's group ends
#: with the match. Matches of too short a group are dropped after matching (for a run of one class of characters, asking
#: for the length within the regex comes to the same).
Rule = tuple[str, str, int, int, int]
BASE: tuple[Rule, ...] = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 0, 2, 8),
    ("access", r"(AKIA[A-Z0-9]{12,})", 0, 1, 16),
    ("hex", r"([0-9a-f]{32,})", 0, 1, 32),
)
#: Rules beyond the base ones: code-host tokens, chat tokens, signed web tokens, private key headers, credentials in URLs.
MORE: tuple[Rule, ...] = (
    ("hosting", r"(gh[pousr]_[A-Za-z0-9]+)", 0, 1, 36),
    ("chat", r"(xox[abprs]-[A-Za-z0-9-]+)", 0, 1, 15),
    # Only at the start of a run of its characters, so that a run of many "eyJ" is read once.
    ("jwt", r"(?:^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", 1, 1, 30),
    ("private_key", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 0, 1, 27),
    ("url_login", r"([a-z][a-z0-9+.-]{0,20}://[^\x00-\x20/:@]+:[^\x00-\x20/:@]+@)", 0, 1, 10),
)
RULES = BASE + MORE

#: Strings that a part of a regex may stand for are listed up to this number; beyond it the part counts as any text.
_LISTED = 32
#: Alternatives, each a set of trigrams that must all occur; one without trigrams makes every text a candidate.
_Alternatives = frozenset[frozenset[str]]
_ANY: _Alternatives = frozenset([frozenset()])


def trigrams(word: str) -> frozenset[str]:
    """The distinct trigrams of a literal in lower case."""
    word = word.lower()
    return frozenset(word[i : i + 3] for i in range(len(word) - 2))


def _both(a: _Alternatives, b: _Alternatives) -> _Alternatives:
    """Texts that satisfy a and b; where that would be too many alternatives, the one that asks for more."""
    if len(a) * len(b) > _LISTED:
        return a if min(map(len, a)) >= min(map(len, b)) else b
    return frozenset(x | y for x, y in product(a, b))


def _required(parts) -> tuple[set[str] | None, _Alternatives]:
    """Of a sequence of parsed regex parts: all strings it can stand for (None: too many), and the trigrams it needs.

    Strings of neighbouring parts are joined for as long as there are few; where a part can be anything, what has been
    gathered becomes a condition of its own.
    """
    held, need, exact = {""}, _ANY, True
    for op, arg in parts:
        strings, own = _part(str(op), arg)
        if strings is not None and len(held) * len(strings) <= _LISTED:
            held = {a + b for a in held for b in strings}
        else:
            need, exact = _both(_both(need, frozenset(map(trigrams, held))), own), False
            held = {""} if strings is None else strings
    return (held if exact else None), _both(need, frozenset(map(trigrams, held)))


def _part(op: str, arg) -> tuple[set[str] | None, _Alternatives]:
    """The same of one part. Letters count in either case."""
    if op == "LITERAL":
        return {chr(arg).lower()}, _ANY
    if op == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
        return {chr(c).lower() for _, c in arg}, _ANY
    if op == "SUBPATTERN":
        return _required(arg[-1])
    if op == "AT":
        return {""}, _ANY
    if op == "BRANCH":
        branches = [_required(b) for b in arg[1]]
        strings = set().union(*(s for s, _ in branches if s is not None))
        return (strings if all(s is not None for s, _ in branches) and len(strings) <= _LISTED else None), frozenset().union(*(q for _, q in branches))
    if op in ("MAX_REPEAT", "POSSESSIVE_REPEAT", "MIN_REPEAT"):
        least, most, inner = arg
        strings, own = _required(inner)
        if most == 1 and strings is not None:
            return (strings if least else strings | {""}), _ANY
        return None, own if least else _ANY
    return None, _ANY


@dataclass(frozen=True)
class TrigramQuery:
    """The Boolean trigram query of a rule: an OR over alternatives of the AND of their trigrams; no alternatives: every text."""

    kind: str
    alternatives: tuple[tuple[str, ...], ...]

    def accepts(self, text: str) -> bool:
        """Whether a text is a candidate."""
        return not self.alternatives or any(all(t in text.lower() for t in a) for a in self.alternatives)


def trigram_query(rule: Rule) -> TrigramQuery:
    """Derived from the regex of the rule (as Python's own regex module reads it)."""
    found = _required(re._parser.parse(rule[1]))[1]
    found = {a for a in found if not any(b < a for b in found)}
    return TrigramQuery(rule[0], () if frozenset() in found else tuple(sorted(tuple(sorted(a)) for a in found)))


def postings(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """The inverted index (trigram, row) of the `wanted` trigrams in `rows` (row, text), letters in either case."""
    held = bound(F.lower("text"), lambda low: F.filter(F.array(*map(F.lit, wanted)), lambda t: F.contains(low, t)))
    return rows.select("row", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: list[TrigramQuery]) -> DataFrame:
    """(row, kinds): rows that satisfy a query, by intersecting the postings of each of its alternatives."""
    clauses = [(q.kind, i, t, len(a)) for q in queries for i, a in enumerate(q.alternatives) for t in a]
    # A few dozen clause rows, fixed by the rules.
    table = F.broadcast(index.sparkSession.createDataFrame(clauses, "kind string, clause int, trigram string, needed int"))
    met = index.join(table, "trigram").groupBy("row", "kind", "clause").agg(F.count("*").alias("n"), F.first("needed").alias("needed")).where("n = needed")
    return met.groupBy("row").agg(F.collect_set("kind").alias("kinds"))


_SPAN = "array<struct<start:bigint,rank:int,kind:string,stop:bigint>>"


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """Matches of one rule in a text as (start, rank, kind, stop), code points, end exclusive, in order.

    The text is cut at the matches: the running sums of the lengths of what lies between and of the matches give the places.
    """
    kind, pattern, span, group, least = rule
    lengths = lambda g: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)), lambda m: F.length(m).cast("long"))
    between = F.transform(F.split(text, pattern, -1), lambda b: F.length(b).cast("long"))

    def placed(p: Column) -> Column:
        stops = running(F.zip_with(p["b"], p["m"], lambda b, m: b + m), lambda a, b: a + b)
        rows = F.arrays_zip(stops.alias("stop"), p["s"].alias("s"), p["g"].alias("g"))
        return F.transform(F.filter(rows, lambda r: r["g"] >= least), lambda r: F.struct((r["stop"] - r["s"]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), r["stop"].alias("stop")))

    def zipped(m: Column) -> Column:
        return bound(F.struct(m.alias("m"), F.slice(between, F.lit(1), F.size(m)).alias("b"), (lengths(span) if span else m).alias("s"), lengths(group).alias("g")), placed)

    return bound(lengths(0), zipped).cast(_SPAN)


#: Parts into which the rows of one text are dealt for the join with its candidates.
_DEALT = 16


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, into: str = "__spans") -> DataFrame:
    """The rows of `docs` with a column `into`: the matches by start, then in the order of the rules.

    Rules with mandatory trigrams are looked up in the trigram index, and only texts proposed for them are matched; the
    others scan all texts. A text without the rarest trigram of any alternative can't be a candidate: it stays where it
    is, and only the others are shuffled to meet the candidates. Texts are known by their hash: two that shared one
    would only both be candidates, and the regex decides. Null and empty texts have no spans; repeated rows are each
    returned; columns of `docs` may have any names but `into`.
    """
    if into.lower() in map(str.lower, docs.columns):
        raise ValueError(f"a column {into} is there already")
    queries = [trigram_query(r) for r in rules]
    asked = [q for q in queries if q.alternatives]
    wanted = sorted({t for q in asked for a in q.alternatives for t in a})
    text, none = F.coalesce(F.col("text").cast("string"), F.lit("")), F.array().cast(_SPAN)
    row, part, kinds = (unused(docs, n) for n in ("__row", "__part", "__kinds"))

    def matched(proposed: Column | None) -> Column:
        found = []
        for n, (r, q) in enumerate(zip(rules, queries, strict=True)):
            if proposed is not None or not q.alternatives:
                here = F.array_contains(proposed, r[0]) if q.alternatives else F.lit(True)
                found.append(F.when(here & text.rlike(r[1]), spans(text, r, n)).otherwise(none))
        return F.array_sort(F.concat(*found)).alias(into) if found else none.alias(into)

    if not asked:
        return docs.select("*", matched(None))
    index = checkpointed(postings(docs.select(F.xxhash64(text).alias("row"), text.alias("text")), wanted).distinct())
    # One row for each wanted trigram.
    count = {r.trigram: r["count"] for r in index.groupBy("trigram").count().collect()}
    rarest = sorted({min(a, key=lambda t: (count.get(t, 0), t)) for q in asked for a in q.alternatives})
    maybe = bound(F.lower(text), lambda low: F.exists(F.array(*map(F.lit, rarest)), lambda t: F.contains(low, t)))
    proposed = candidates(index, asked).select(F.col("row").alias(row), F.col("kinds").alias(kinds), F.explode(F.sequence(F.lit(0), F.lit(_DEALT - 1))).alias(part))
    # A text that a third of the rows share is dealt to several tasks.
    rows = docs.where(maybe).withColumns({row: F.xxhash64(text), part: F.pmod(F.spark_partition_id(), F.lit(_DEALT))})
    met = rows.join(proposed, [row, part], "left").select(*(rows[c] for c in docs.columns), kinds)
    met = met.select(*docs.columns, matched(F.coalesce(F.col(kinds), F.array().cast("array<string>"))))
    return docs.where(~maybe).select("*", matched(None)).unionByName(met)


#: Code points of the chunks in which a text is looked up when it is cut: finding a place in a string means counting from its start.
_CHUNK = 4096


def _stretch(chunks: Column, a: Column, b: Column) -> Column:
    """Code points a to b of the text that `chunks` make up."""
    piece = lambda k: F.substring(F.get(chunks, k), (F.greatest(a - k * _CHUNK, F.lit(0)) + 1).cast("int"), (F.least(b - k * _CHUNK, F.lit(_CHUNK)) - F.greatest(a - k * _CHUNK, F.lit(0))).cast("int"))
    chunk = lambda at: F.floor(at / F.lit(float(_CHUNK))).cast("int")
    return F.when(b > a, F.array_join(F.transform(F.sequence(chunk(a), chunk(b - 1)), piece), "")).otherwise(F.lit(""))


def redact(text: Column, found: Column, mark: str = "[REDACTED]") -> Column:
    """The text with every stretch of overlapping spans (in order of start) replaced by `mark`."""

    def kept(x: Column) -> Column:
        """What lies between the stretches: x has the spans, how far those up to each reach, where stretches begin, and the text."""
        begin = lambda j: F.when(j < F.size(x["first"]), F.get(x["found"], F.get(x["first"], j))["start"]).otherwise(x["length"])
        ended = lambda j: F.when(j == 0, F.lit(0).cast("long")).when(j < F.size(x["first"]), F.get(x["reach"], F.get(x["first"], j) - 1)).otherwise(F.get(x["reach"], F.size(x["reach"]) - 1))
        edges = lambda j: F.struct(ended(j).alias("a"), begin(j).alias("b"))
        parts = F.transform(F.sequence(F.lit(0), F.size(x["first"])), lambda j: bound(edges(j), lambda e: _stretch(x["chunks"], e["a"], e["b"])))
        return F.array_join(parts, mark)

    def marked(x: Column) -> Column:
        new = lambda i: (i == 0) | (F.get(x["found"], i)["start"] >= F.get(x["reach"], i - 1))
        first = F.filter(F.sequence(F.lit(0), F.size(x["found"]) - 1), new)
        chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))
        return bound(F.struct(x["found"].alias("found"), x["reach"].alias("reach"), first.alias("first"), chunks.alias("chunks"), F.length(text).cast("long").alias("length")), kept)

    reach = lambda s: running(F.transform(s, lambda p: p["stop"]), F.greatest)
    whole = bound(found, lambda s: bound(F.struct(s.alias("found"), reach(s).alias("reach")), marked))
    return F.when(F.size(found) > 0, whole).otherwise(text)


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows and columns of `docs` with the secrets of their texts replaced, and n_chars (where there is one) the new length.

    Rows without secrets, null texts too, are as they were.
    """
    into = unused(docs, "__spans")
    found, hit = find_secrets(docs, rules, into), F.size(into) > 0
    fresh = unused(found, "__text")
    text = redact(F.coalesce(F.col("text").cast("string"), F.lit("")), F.col(into))
    out = found.withColumn(fresh, F.when(hit, text).otherwise(F.col("text")))
    new = {"text": F.col(fresh)} | ({"n_chars": F.when(hit, F.length(fresh).cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return out.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))


def _listed(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op4(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of `docs`."""
    out = find_secrets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", F.col("__spans").alias("s"))
    base = F.filter("s", lambda s: s["rank"] < len(BASE))
    count = lambda kind: F.size(F.filter("s", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *(count(r[0]) for r in BASE), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("s")).alias("spans"))


def _oracle() -> str:
    """DuckDB SQL for op4: every rule matched on every text."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    parts = [
        f"SELECT rid, {n} AS rank, {quote(kind)} AS kind, {least} AS least, regexp_extract_all(t, {quote(p)}) AS m, regexp_extract_all(t, {quote(p)}, {span}) AS s, "
        f"regexp_extract_all(t, {quote(p)}, {group}) AS g, string_split_regex(t, {quote(p)}) AS b FROM docs"
        for n, (kind, p, span, group, least) in enumerate(RULES)
    ]
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
hits AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM ({' UNION ALL '.join(parts)}) WHERE len(m) > 0),
spans AS (SELECT rid, rank, kind, length(g[i]) AS size, least, length(s[i]) AS n,
  CAST(list_sum(list_transform(b[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS BIGINT) AS z FROM hits),
kept AS (SELECT rid, rank, z - n AS a, kind, kind || ':' || (z - n) || ':' || z AS s FROM spans WHERE size >= least),
agg AS (SELECT rid, count(*) FILTER (rank = 0) AS n0, count(*) FILTER (rank = 1) AS n1, count(*) FILTER (rank = 2) AS n2,
  string_agg(s, ',' ORDER BY a, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(s, ',' ORDER BY a, rank) AS listed FROM kept GROUP BY rid)
SELECT doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(listed, '') AS spans
FROM docs LEFT JOIN agg USING (rid)"""


ORACLE_SQL = _oracle()
