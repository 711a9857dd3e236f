"""Approximate nearest neighbours: a neighbour graph by NN-descent joins, searched greedily."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import frexp, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.llm.common import counted
from larkspur.session import checkpointed

#: Neighbours kept for each vector, and the nearest of them by which convergence is judged.
DEGREE, WATCHED = 50, 10
#: Rounds at most, and the relative fall of the watched distances below which they end.
ROUNDS, SETTLED = 8, 0.004
#: Vectors that are compared with one another at a time; larger groups are dealt into several, anew each round.
POOL, BUCKET, TABLES = 128, 512, 2
#: Mean members of the random groups in which every vector also starts.
STRANGERS = 128
#: A group of more members than this is spread over tasks.
SPREAD = 512
#: Greedy search: rounds, nodes opened in each, nodes kept, and the nearest of the nodes that have a node as neighbour to go back to.
STEPS, OPENED, KEPT, BACK = 3, 24, 64, 50
#: Candidate pairs that a task gathers before it keeps the nearest of each vector.
GATHERED = 1_500_000
#: Squared distances below this share of the squared lengths are computed anew from differences: there the dot product has lost its digits.
CLOSE = 1e-6
_CODE = "id long, code binary"


@dataclass
class Index:
    """codes (id, code): the bytes of the vectors' components, all times one power of two; graph (id, near: squared distance and id, nearest first).

    kind: numpy type of the components in the bytes, 4 bytes each where the vectors come as single floats, so that none is rounded.
    """

    codes: DataFrame
    graph: DataFrame
    kind: str = "f8"


def usable(vectors: DataFrame, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """(vec_id, x): vectors that take part, single floats as they are and other numbers as doubles. Null, empty, zero, null or non-finite components, a null id, and another length than the longest do not."""
    x = F.col(value) if dict(vectors.dtypes)[value] == "array<float>" else F.col(value).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), x.alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c).cast("double") < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where((F.size("x") > 0) & finite & F.exists("x", lambda c: c != 0))
    size = rows.agg(F.max(F.size("x"))).first()[0]
    return rows.where(F.size("x") == (size or 0))


def _unsigned(x: str) -> Column:
    """The vector with -0 as 0."""
    return F.transform(x, lambda c: F.when(c == 0, F.abs(c)).otherwise(c))


def classes(rows: DataFrame, most: int) -> DataFrame:
    """(x, id, members): distinct vectors with the least id that has them and their `most` least ids.

    The window is limited before its shuffle, so a vector that a third of the rows share sends `most` rows a task.
    """
    rank = F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))
    first = rows.select(_unsigned("x").alias("x"), "vec_id").withColumn("r", rank).where(F.col("r") <= most)
    return first.groupBy("x").agg(F.array_distinct(F.array_sort(F.collect_list("vec_id"))).alias("members")).select("x", F.col("members")[0].alias("id"), "members")


def _encode(batches: Iterator[pa.RecordBatch], shift: int, kind: str) -> Iterator[pa.RecordBatch]:
    """The components as bytes, times a power of two that keeps squares in range; no digit is lost."""
    for batch in batches:
        if batch.num_rows:
            x = np.ldexp(np.array(batch.column(1).to_pylist(), np.float64), shift).astype(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "code"])


def _codes(column: pa.Array, kind: str) -> np.ndarray:
    """The vectors as a matrix of doubles."""
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), kind).reshape(len(data), -1).astype(np.float64)


def _squared(x: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to one another, those of near copies from their differences."""
    x = x - x.mean(axis=0)
    norm = (x * x).sum(axis=1)
    both = norm[:, None] + norm[None, :]
    d = np.maximum(both - 2 * (x @ x.T), 0)
    i, j = np.nonzero(d <= CLOSE * both)
    for k in range(0, len(i), 4096):
        part = slice(k, k + 4096)
        d[i[part], j[part]] = ((x[i[part]] - x[j[part]]) ** 2).sum(axis=1)
    return d


def _nearest(v: np.ndarray, w: np.ndarray, d: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (v, w), the nearest `most` of each v."""
    order = np.lexsort((w, d, v))
    v, w, d = v[order], w[order], d[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
    v, w, d = v[new], w[new], d[new]
    place = np.arange(len(v)) - np.searchsorted(v, v)
    keep = place < most
    return v[keep], w[keep], d[keep]


def _compare(batches: Iterator[pa.RecordBatch], pool: int, most: int, kind: str) -> Iterator[pa.RecordBatch]:
    """From rows (center, spread, id, worst, code) in groups of center and spread: pairs nearer than id's worst neighbour."""
    held: list[tuple[np.ndarray, ...]] = []
    count = 0

    def flush() -> pa.RecordBatch:
        nonlocal held, count
        v, w, d = _nearest(*(np.concatenate(x) for x in zip(*held, strict=True)), most)
        held, count = [], 0
        return pa.RecordBatch.from_arrays([pa.array(v), pa.array(w), pa.array(d)], ["id", "other", "d"])

    def pairs(ids, worst, code) -> None:
        nonlocal count
        d = _squared(code)
        i, j = np.nonzero((d < worst[:, None]) & (ids[:, None] != ids[None, :]))
        held.append((ids[i], ids[j], d[i, j]))
        count += len(i)

    def even(rows: tuple, a: int, b: int) -> None:
        """Compare rows a to b in pools of equal sizes, so that nobody of a group is left alone."""
        parts = -(-(b - a) // pool)
        for k in range(parts):
            pairs(*(x[a + (b - a) * k // parts : a + (b - a) * (k + 1) // parts] for x in rows[1:]))

    rest: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        group = np.column_stack([batch.column(k).to_numpy() for k in (0, 1)])
        now = (group, batch.column(2).to_numpy(), batch.column(3).to_numpy(), _codes(batch.column(4), kind))
        if rest is not None:
            now = tuple(np.concatenate([a, b]) for a, b in zip(rest, now, strict=True))
        group = now[0]
        cuts = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
        borders = [0, *cuts.tolist()]
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            even(now, a, b)
        s = borders[-1]
        while len(group) - s >= 2 * pool:
            pairs(*(x[s : s + pool] for x in now[1:]))
            s += pool
        rest = tuple(x[s:] for x in now)
        if count >= GATHERED:
            yield flush()
    if rest is not None:
        even(rest, 0, len(rest[0]))
    if count:
        yield flush()


def _local_join(members: DataFrame, codes: DataFrame, pool: int, most: int, seed: int, kind: str) -> DataFrame:
    """(id, other, d): compare the members (center, spread, id, worst) of each center and spread with one another.

    Groups are dealt into pools by a hash that changes with `seed`.
    """
    rows = members.join(codes, "id").select("center", "spread", "id", "worst", "code")
    rows = rows.repartition("center", "spread").sortWithinPartitions("center", "spread", F.xxhash64("id", F.lit(seed + 1)))
    return rows.mapInArrow(lambda it: _compare(it, pool, most, kind), "id long, other long, d double")


def _dealt(members: DataFrame, seed: int) -> DataFrame:
    """Members with the column spread: groups above SPREAD are dealt over several tasks."""
    large = checkpointed(members.groupBy("center").agg(F.ceil(F.count("*") / SPREAD).cast("long").alias("parts")).where("parts > 1"))
    return members.join(counted(large), "center", "left").withColumn("spread", F.coalesce(F.pmod(F.xxhash64("id", F.lit(seed)), F.col("parts")), F.lit(0)).cast("long"))


def _merge(pairs: DataFrame, most: int) -> DataFrame:
    """Graph rows (id, near) of the nearest `most` distinct others; each task has sent at most a few times `most` of an id."""
    near = F.slice(F.array_sort(F.collect_set(F.struct("d", "other"))), 1, most)
    return pairs.groupBy("id").agg(near.alias("near"))


def _center(codes: DataFrame, kind: str) -> np.ndarray:
    """The mean of all vectors; each task sends one row."""

    def run(batches):
        total, n = 0.0, 0
        for batch in batches:
            if batch.num_rows:
                total, n = total + _codes(batch.column(0), kind).sum(axis=0), n + batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["total", "n"])

    parts = codes.select("code").mapInArrow(run, "total binary, n long").collect()
    return sum(np.frombuffer(p.total, np.float64) for p in parts) / sum(p.n for p in parts)


def _buckets(codes: DataFrame, bits: int, center: np.ndarray, seed: int, kind: str) -> DataFrame:
    """(center, id, worst): each vector in the bucket of its signs, seen from the mean, against `bits` random directions, in TABLES tables."""
    planes = np.random.default_rng(seed).normal(size=(len(center), TABLES * bits))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            signs = ((_codes(batch.column(1), kind) - center) @ planes > 0).reshape(batch.num_rows, TABLES, bits)
            keys = signs @ (1 << np.arange(bits)) + (np.arange(TABLES) << bits)
            ids = np.repeat(batch.column(0).to_numpy(), TABLES)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().astype(np.int64)), pa.array(ids), pa.array(np.full(len(ids), np.inf))], ["center", "id", "worst"])

    return codes.select("id", "code").mapInArrow(run, "center long, id long, worst double")


def _strangers(codes: DataFrame, n: int, bits: int, seed: int) -> DataFrame:
    """(center, id, worst): each vector in a random group, whatever its bucket; the numbers follow those of the buckets."""
    group = F.pmod(F.xxhash64("id", F.lit(seed + 5)), F.lit(max(1, n // STRANGERS)))
    return codes.select((group + F.lit(TABLES << bits)).cast("long").alias("center"), "id", F.lit(float("inf")).alias("worst"))


def build(distinct: DataFrame, degree: int = DEGREE, seed: int = 7) -> Index:
    """Index of distinct vectors (id, x): every vector is in it.

    Starting from neighbours within random buckets and, for vectors alone in theirs, random groups, each round gathers at every
    vector its neighbours and the nearest `degree` of those whose neighbour it is, compares them with one another (so neighbours
    of neighbours meet), and keeps the nearest. So no group of a round has more than 1 + 2 * `degree` members; who is left out at
    a vector near to very many still meets it among its own neighbours.
    """
    single = dict(distinct.dtypes)["x"] == "array<float>"
    kind = "f4" if single else "f8"
    most = distinct.agg(F.max(F.array_max(F.transform("x", F.abs)))).first()[0]
    shift = -frexp(most or 1.0)[1]
    codes = checkpointed(distinct.select("id", "x").mapInArrow(lambda it: _encode(it, shift, kind), _CODE))
    n = codes.count()
    if not n:
        return Index(codes, codes.select("id", F.array().cast("array<struct<d:double,other:bigint>>").alias("near")), kind)
    bits = max(0, round(log2(max(1, n / 200))))
    met = _buckets(codes, bits, _center(codes, kind), seed, kind).unionByName(_strangers(codes, n, bits, seed))
    graph = checkpointed(_merge(_local_join(_dealt(checkpointed(met), seed), codes, BUCKET, degree, seed, kind), degree))
    watched = F.aggregate(F.slice("near", 1, WATCHED), F.lit(0.0), lambda a, p: a + p["d"])
    before = graph.agg(F.sum(watched)).first()[0]
    for k in range(ROUNDS):
        # A vector with fewer than `degree` neighbours takes any other.
        worst = graph.select(F.col("id").alias("of"), F.when(F.size("near") >= degree, F.element_at("near", -1)["d"]).otherwise(float("inf")).alias("worst"))
        edges = graph.select("id", F.inline("near")).select(F.col("id").alias("center"), F.col("other").alias("id"), "d")
        both = edges.select("center", "id").unionByName(_backward(edges, degree)).distinct()
        members = both.join(worst, both.id == worst.of).select("center", F.lit(0).cast("long").alias("spread"), "id", "worst")
        found = _local_join(members, codes, POOL, degree, seed + 10 * (k + 1), kind)
        kept = graph.select("id", F.inline("near")).select("id", "other", "d")
        graph = checkpointed(_merge(kept.unionByName(found), degree))
        now = graph.agg(F.sum(watched)).first()[0]
        if not now or (before is not None and before - now <= SETTLED * before):
            break
        before = now
    if n > 1 and graph.count() != n:
        raise RuntimeError("a vector is not in the neighbour graph")
    return Index(codes, graph, kind)


def _backward(edges: DataFrame, most: int) -> DataFrame:
    """(center, id): the nearest `most` centers that have each id, as members of it. The limit comes before the shuffle too."""
    place = F.row_number().over(Window.partitionBy("id").orderBy("d", "center"))
    return edges.withColumn("place", place).where(F.col("place") <= most).select(F.col("id").alias("center"), F.col("center").alias("id"))


def _distances(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """(query, id, d) from rows (query, id, code, own_code)."""
    for batch in batches:
        if batch.num_rows:
            d = ((_codes(batch.column(2), kind) - _codes(batch.column(3), kind)) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d)], ["query", "id", "d"])


def search(index: Index, queries: DataFrame, steps: int = STEPS, opened: int = OPENED, kept: int = KEPT) -> DataFrame:
    """(query, id): the nodes that a greedy walk over the graph keeps for each query (query: an id in the index).

    Each step opens the nearest nodes that are not yet open, along edges in both directions, measures the new nodes and keeps
    the nearest. Every query holds `kept` nodes at most, and every node DEGREE edges and BACK backward ones, so that one which is
    near to many does not fan out.
    """
    own = checkpointed(queries.select("query").distinct().join(index.codes.select(F.col("id").alias("query"), F.col("code").alias("own_code")), "query"))
    ahead = index.graph.select(F.col("id").alias("center"), F.inline("near")).select("center", F.col("other").alias("id"), "d")
    edges = ahead.select("center", "id").unionByName(_backward(ahead, BACK)).distinct()
    edges, kind = checkpointed(edges.withColumnRenamed("center", "node")), index.kind

    def measured(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(index.codes, "id").join(own, "query")
        return rows.select("query", "id", "code", "own_code").mapInArrow(lambda it: _distances(it, kind), "query long, id long, d double")

    def nearest(rows: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("query").orderBy("d", "id"))
        return rows.withColumn("place", place).where(F.col("place") <= kept).drop("place")

    beam = own.select("query", F.col("query").alias("id"), F.lit(0.0).alias("d"), F.lit(False).alias("open"))
    for k in range(steps + 1):
        place = F.row_number().over(Window.partitionBy("query", "open").orderBy("d", "id"))
        beam = beam.withColumn("next", ~F.col("open") & (place <= (1 if k == 0 else opened)))
        front = beam.where("next").select("query", F.col("id").alias("node"))
        new = front.join(edges, "node").select("query", "id").distinct().join(beam.select("query", "id"), ["query", "id"], "left_anti")
        old = beam.select("query", "id", "d", (F.col("open") | F.col("next")).alias("open"))
        beam = checkpointed(nearest(old.unionByName(measured(new).withColumn("open", F.lit(False)))))
    return beam.select("query", "id")


def euclidean(a: str, b: str) -> Column:
    gap = lambda p, q: p.cast("double") - q.cast("double")
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: gap(p, q) * gap(p, q)), F.lit(0.0), lambda s, p: s + p))


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows found for each row with `is_query` (over vec_id).

    Equal vectors are one node of the graph, each with its k + 1 least ids, which suffice for any k nearest. Distances
    of the result are computed from the original vectors in double precision; ties go to the smaller vec_id, and a
    vec_id that repeats with one vector counts once.
    """
    rows = usable(vectors, key, value)
    nodes = checkpointed(classes(rows, k + 1))
    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), _unsigned("x").alias("q")).distinct()
    asked = checkpointed(asked.join(nodes.select(F.col("x").alias("q"), F.col("id").alias("query")), "q"))
    found = search(build(nodes), asked)
    near = found.join(nodes, "id").select("query", "x", F.explode("members").alias("vec_id"))
    own = nodes.select(F.col("id").alias("query"), F.col("x").alias("q"))
    scored = near.join(own, "query").select("query", "vec_id", euclidean("q", "x").alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    # One more than k of each node, so that k remain without the row itself.
    best = scored.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("best"))
    others = F.slice(F.filter("best", lambda p: p["vec_id"] != F.col("query_id")), 1, k)
    out = asked.select("query_id", "query").join(best, "query").select("query_id", F.posexplode(others).alias("pos", "p"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "p.vec_id", "p.score")


def op6(embeddings: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score: the 10 nearest found for each row whose vec_id is divisible by 100."""
    return nearest_neighbours(embeddings, F.col("vec_id") % 100 == 0)
