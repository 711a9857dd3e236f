"""The trie of all conversations' turns: families first, then the nodes that families share."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.session import checkpointed

#: Conversations c with one c - c % FAMILY belong together; the first of them lends the others up to SHARED - 1 turns.
FAMILY, SHARED = 20, 4
ROOT = bytes(16)
#: Nodes of a family held by its task; a larger family is written in parts, which add up all the same.
HELD = 200_000
#: Families whose ends of one node are packed in one row.
PACK = 1024
WORDS = r"[^\x20\x09-\x0D]+"


def _base(c: Column) -> Column:
    return c - c % FAMILY


def turns_of(rows: DataFrame) -> DataFrame:
    """(base, own, conv_id, turn, digest, words): each turn as a digest of role and text, and the number of its words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    c = F.col("conv_id").cast("long")
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    out = rows.select(c.alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"))
    return out.where("conv_id IS NOT NULL").select(_base(F.col("conv_id")).alias("base"), (F.col("conv_id") != _base(F.col("conv_id"))).alias("own"), "conv_id", "turn", "digest", "words")


class _Family:
    """The small trie of one family: a node's key is the digest of its parent's key and its turn."""

    def __init__(self, base: int) -> None:
        self.base, self.lent, self.nodes = base, [], {}

    def begin(self, c: int) -> None:
        self.c, self.at, self.depth, self.taken = c, ROOT, 0, zlib.crc32(str(c).encode()) % SHARED
        self.seen = 0
        self._visit(ROOT, ROOT, 0, 0)
        if c != self.base:
            for digest, words in self.lent[: self.taken]:
                self._step(digest, words)

    def turn(self, digest: bytes, words: int) -> None:
        if self.c == self.base and self.seen < SHARED - 1:
            self.lent.append((digest, words))
        if self.c == self.base or self.seen >= self.taken:
            self._step(digest, words)
        self.seen += 1

    def end(self) -> None:
        """The conversation ends at this node: a bit of the family's mask."""
        node = self.nodes.get(self.at)
        if node is None:  # written already
            node = self.nodes[self.at] = [self.parent, self.depth, self.last, 0, self.c, 0]
        node[5] |= 1 << (self.c - self.base + FAMILY - 1)

    def _step(self, digest: bytes, words: int) -> None:
        key = hashlib.sha256(self.at + digest).digest()[:16]
        self.depth += 1
        self._visit(key, self.at, self.depth, words)
        self.at = key

    def _visit(self, key: bytes, parent: bytes, depth: int, words: int) -> None:
        self.parent, self.last = parent, words
        node = self.nodes.get(key)
        if node is None:
            self.nodes[key] = [parent, depth, words, 1, self.c, 0]
        else:
            node[3] += 1
            node[4] = min(node[4], self.c)


_NODES = pa.schema([("base", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("words", pa.int64()), ("n", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.int64())])
_NODE_TYPES = "base long, key binary, parent binary, depth long, words long, n long, conv_id long, ends long"


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _family_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of each family; rows come in order of family, its base first, conversation and turn."""
    family, c, out = None, None, []

    def written(f: _Family) -> None:
        out.extend((f.base, key, *node) for key, node in f.nodes.items())
        f.nodes = {}

    for batch in batches:
        for base, conv, digest, words in zip(*(batch.column(i).to_pylist() for i in (0, 2, 4, 5))):
            if conv != c:
                if family is not None:
                    family.end()
                    if base != family.base:
                        written(family)
                if family is None or base != family.base:
                    family = _Family(base)
                c = conv
                family.begin(c)
            family.turn(digest, words)
            if len(family.nodes) >= HELD:
                written(family)
        if len(out) >= 10_000:
            yield _batch(_NODES, out)
            out = []
    if family is not None:
        family.end()
        written(family)
    if out:
        yield _batch(_NODES, out)


def family_tries(rows: DataFrame) -> DataFrame:
    """Nodes of every family (base, key, parent, depth, words, n, conv_id, ends); ends has bit c - base + 19 for each c that ends there.

    Turns meet by base id. They are digests by then, sorted by Spark and read in order, so a conversation of any length
    takes a task no more memory than HELD nodes; it is one chain of digests, and so passes through one task.
    """
    order = [F.col("base"), F.col("own"), F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    return turns_of(rows).repartition("base").sortWithinPartitions(*order).mapInArrow(_family_nodes, _NODE_TYPES)


_SUMS = pa.schema([("key", pa.binary()), ("leaves", pa.int64()), ("saved", pa.int64())])


def _subtree_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over each family's subtrees; rows (base, depth, key, parent, leaves, saved) come deepest first, so only two levels are held."""
    base, level = None, None
    here, above, waiting = {}, {}, {}  # this level's nodes, what they give their parents, and what their children gave
    out: list[tuple] = []

    def close() -> None:
        """Hand the level's sums to its parents."""
        nonlocal here
        for key, (parent, leaves, saved) in here.items():
            if leaves or saved:
                out.append((key, leaves, saved))
                if key != ROOT:
                    above.setdefault(parent, [0, 0])
                    above[parent][0] += leaves
                    above[parent][1] += saved
        here = {}

    for batch in batches:
        for b, depth, key, parent, leaves, saved in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if b != base or depth != level:
                close()
                if b != base:
                    above = {}
                base, level, waiting, above = b, depth, above, {}
            node = here.setdefault(key, [parent, 0, 0])
            got = waiting.pop(key, None)
            if got:
                node[1] += got[0]
                node[2] += got[1]
            node[1] += leaves
            node[2] += saved
        if len(out) >= 10_000:
            yield _batch(_SUMS, out)
            out = []
    close()
    if out:
        yield _batch(_SUMS, out)


_OFFSETS = np.arange(2 * FAMILY, dtype=np.int64)


def _end_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's member ids, fed to the hash in order from packed rows (key, pack, ends: base and mask)."""
    key, state, first, out = None, None, True, []
    for batch in batches:
        keys, ends = batch.column(0).to_pylist(), batch.column(2)
        for i, k in enumerate(keys):
            if k != key:
                if key is not None:
                    out.append((key, state.hexdigest()))
                key, state, first = k, hashlib.sha256(), True
            packed = ends[i].values
            bases, masks = packed.field(0).to_numpy(), packed.field(1).to_numpy()
            at, bit = np.nonzero(masks[:, None] >> _OFFSETS & 1)
            text = ",".join(map(str, (bases[at] + bit - FAMILY + 1).tolist()))
            state.update(text.encode() if first else b"," + text.encode())
            first = False
    if key is not None:
        out.append((key, state.hexdigest()))
    yield _batch(pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())]), out)


def ends_of(family: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes where conversations end.

    A hash of a sequence is made in sequence: the ids of a node that very many conversations end at pass through one
    task, PACK families to a row, in order of their ids and in bounded memory.
    """
    packs = family.where("ends <> 0").groupBy("key", F.floor(F.col("base") / (FAMILY * PACK)).alias("pack")).agg(F.array_sort(F.collect_list(F.struct("base", "ends"))).alias("ends"))
    return packs.repartition("key").sortWithinPartitions("key", "pack").mapInArrow(_end_hashes, "key binary, ends_sha256 string")


def trie(rows: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, key.

    `rows` (conv_id, turn, role, text) are conversations in order of turn, null first, then of the digest of role and
    text where turn numbers repeat; null role and text are empty; rows without conv_id are no conversation. Every
    conversation c takes its first h turns (h: crc32 of its decimal id, modulo 4) from the conversation c - c % 20
    (the remainder has the sign of c). Repeated rows are repeated turns. No rows give no nodes.

    Families are rebuilt and made into tries first; only their nodes are merged over all families. A node's smallest
    member c is that of all nodes further down along c, so each node is at home in the family of its smallest member,
    and a subtree is the sum, over the families that have its top, of the nodes at home there. Two passes over the
    families give subtree sums at any depth without a join for each level.
    """
    family = checkpointed(family_tries(rows))
    nodes = family.groupBy("key").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    children = nodes.where("depth > 0").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "key")
    nodes = checkpointed(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    own = nodes.select(_base(F.col("conv_id")).alias("base"), "depth", "key", "parent", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    none = F.lit(0).cast("long")
    parts = own.unionByName(family.select("base", "depth", "key", "parent", none.alias("leaves"), none.alias("saved")))
    sums = parts.repartition("base").sortWithinPartitions("base", F.col("depth").desc(), "key").mapInArrow(_subtree_sums, "key binary, leaves long, saved long")
    sums = sums.groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    above = nodes.select(F.col("key").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    full = nodes.join(sums, "key", "left").join(ends_of(family), "key", "left")
    out = full.join(above, (full.parent == above.above) & (full.depth > 0), "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", none).alias("n_leaves"), F.coalesce("saved_tokens", none).alias("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256"), "key")


def op11(conversations: DataFrame) -> DataFrame:
    """trie() of all conversations, without the keys."""
    return trie(conversations).drop("key")


ORACLE_SQL = f"""
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
heads AS (
  SELECT DISTINCT c, c - c % {FAMILY} AS base FROM own),
bits AS (
  SELECT c, base, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda acc, x: list_reduce(list_prepend(xor(acc, x), range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)) AS v FROM heads),
taken AS (
  SELECT c, base, xor(v, 4294967295) % {SHARED} AS h FROM bits),
rebuilt AS (
  SELECT k.c, o.r, o.t, o.i AS o, 0 AS part FROM taken k JOIN own o ON o.c = k.base AND o.i <= k.h
  UNION ALL SELECT k.c, o.r, o.t, o.i, 1 FROM taken k JOIN own o ON o.c = k.c AND o.i > k.h),
placed AS (
  SELECT c, r, t, row_number() OVER (PARTITION BY c ORDER BY part, o) AS d FROM rebuilt),
paths AS (
  SELECT c, d, t, string_agg(sha256(CAST(strlen(r) AS VARCHAR) || ':' || r || t), '') OVER (PARTITION BY c ORDER BY d) AS path FROM placed
  UNION ALL SELECT c, 0, '', '' FROM heads),
lengths AS (
  SELECT c, max(d) AS n FROM paths GROUP BY c),
nodes AS (
  SELECT path, min(d) AS d, min(p.c) AS c, count(*) AS n, any_value(t) AS t,
    sha256(coalesce(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (l.n = p.d), '')) AS ends
  FROM paths p JOIN lengths l USING (c) GROUP BY path),
up AS (
  SELECT m.*, CASE WHEN m.d > 0 THEN left(m.path, length(m.path) - 64) END AS parent FROM nodes m),
kids AS (
  SELECT parent, count(*) AS k FROM up WHERE parent IS NOT NULL GROUP BY parent),
below AS (
  SELECT DISTINCT a.path AS top, b.path FROM paths a JOIN paths b ON a.c = b.c AND b.d >= a.d),
sums AS (
  SELECT top, count(*) FILTER (k IS NULL) AS leaves, sum((n - 1) * len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))) AS saved
  FROM below JOIN up USING (path) LEFT JOIN kids ON kids.parent = below.path GROUP BY top)
SELECT m.c AS conv_id, CAST(m.d AS BIGINT) AS depth, p.c AS parent_conv_id, m.n AS n_convs, CAST(coalesce(k, 0) AS BIGINT) AS n_children, leaves AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, m.ends AS ends_sha256
FROM up m JOIN sums s ON s.top = m.path LEFT JOIN kids ON kids.parent = m.path LEFT JOIN nodes p ON p.path = m.parent"""
