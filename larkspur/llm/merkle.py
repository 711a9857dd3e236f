"""A Merkle manifest of a dataset: trees of digests over range-sorted rows, their root, and a proof for each row."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.window import Window

from larkspur.session import checkpointed

#: Children of a node.
FAN = 16
#: Rows of one sorted partition.
RUN = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One step up: the node's place among its siblings, and the digests of the others, end to end.
STEP = "struct<place:int,others:string>"

Digests = list[str]
#: A row's way up: its place and the others' digests on each level.
Steps = list[tuple[int, str]]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above n leaves."""
    up = 0
    while n > 1:
        n, up = -(-n // FAN), up + 1
    return up


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(docs: DataFrame, text: Column | None = None) -> Column:
    """The digest of a row's FIELDS, `text` in place of its text."""
    return F.sha2(F.concat(*(field(text if c == "text" and text is not None else docs[c]) for c in FIELDS)), 256)


def range_sorted(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`rows` (materialised) with `part` and `at`, in partitions that follow one another in order of group, then `order`; null first.

    Rows that are equal in all of these are told apart by their number, so a partition holds no more for it.
    """
    many = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // RUN + 1)
    keys = [F.col(c).asc_nulls_first() for c in (group, *order, "row")]
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(many, *keys).sortWithinPartitions(*keys).drop("row")
    at = F.monotonically_increasing_id()
    return checkpointed(dealt.withColumn("at", at).withColumn("part", F.shiftright("at", 33)))


#: By partition: how many rows of its first group lie in earlier ones; how many its first and its last group have in all, where they cross its borders.
Offsets = dict[int, tuple[int, int | None, int | None]]


def offsets(rows: DataFrame, group: str) -> Offsets:
    """At most one number for each border between partitions, whatever the rows and groups."""
    counts = rows.groupBy(group, "part").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    crossing = counts.select("part", "n", before.alias("before"), F.sum("n").over(whole).alias("total")).where("n < total")
    out: Offsets = {}
    for part, n, before_, total in crossing.collect():
        first, head, tail = out.get(part, (0, None, None))
        out[part] = (before_, total, total if before_ + n < total else tail) if before_ else (first, head, total)
    return out


class Run:
    """The rows of one group in one partition: leaves `start` and following of `total`, and the complete aligned subtrees among them."""

    def __init__(self, start: int, leaves: Digests, total: int) -> None:
        self.start, self.total, self.top = start, total, height(total)
        self.levels: list[tuple[int, Digests]] = [(start, leaves)]
        size = 1
        for _ in range(self.top):
            low, below = self.levels[-1]
            size *= FAN
            stop = start + len(leaves)
            first = -(-start // size)
            last = -(-total // size) if stop == total else stop // size  # the group's last run is complete where the group ends
            digests = [sha("".join(below[k * FAN - low : (k + 1) * FAN - low])) for k in range(first, last)]
            if not digests:
                break
            self.levels.append((first, digests))

    def has(self, level: int, k: int) -> bool:
        return level < len(self.levels) and 0 <= k - self.levels[level][0] < len(self.levels[level][1])

    def ragged(self) -> Iterator[tuple[int, int, str]]:
        """(level, index, digest) of the nodes whose parents are not here."""
        for level, (low, digests) in enumerate(self.levels):
            for k, d in enumerate(digests, low):
                if level == self.top or not self.has(level + 1, k // FAN):
                    yield level, k, d

    def steps(self, i: int) -> tuple[Steps, tuple[int, int]]:
        """The steps from leaf i to its highest node here, and that node's coordinate."""
        level, k, out = 0, self.start + i, []
        while level < self.top and self.has(level + 1, k // FAN):
            low, digests = self.levels[level]
            a = k // FAN * FAN - low
            run = digests[a : a + FAN]
            out.append((k % FAN, "".join(run[: k % FAN] + run[k % FAN + 1 :])))
            level, k = level + 1, k // FAN
        return out, (level, k)


def runs_of(part: int, groups: list, leaves: Digests, known: Offsets) -> Iterator[tuple[int, int, Run]]:
    """(first row, row after the last, run) for each group of a partition."""
    cuts = [0, *(i for i in range(1, len(groups)) if groups[i] != groups[i - 1]), len(groups)]
    before, head, tail = known.get(part, (0, None, None))
    for a, b in zip(cuts, cuts[1:]):
        start = before if a == 0 else 0
        total = head if a == 0 and before else tail if b == len(groups) and tail is not None else None
        yield a, b, Run(start, leaves[a:b], start + b - a if total is None else total)


NODE = "part long, {group}, top int, level int, k long, digest string"


def _local(known: Offsets, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Ragged nodes of each partition of (part, group, leaf)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [b for b in batches if b.num_rows]
        if not table:
            return
        whole = pa.Table.from_batches(table)
        part, groups = whole.column(0)[0].as_py(), whole.column(1).to_pylist()
        out = [(part, groups[a], r.top, *node) for a, _, r in runs_of(part, groups, whole.column(2).to_pylist(), known) for node in r.ragged()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


class Forest:
    """Trees of FAN children over the leaves of each group of `rows` (group, order..., leaf, more), in order; a lone leaf is its own root.

    Rows are range-sorted, so a group lies in partitions that follow one another; a task needs only the number of rows
    before it to know which subtrees of its rows are complete, and builds those. What is left at its borders, at most
    30 nodes a level, meets the neighbours' by coordinate, level by level: no task holds a group.
    """

    def __init__(self, rows: DataFrame, group: str, order: list[str]) -> None:
        self.group = group
        self.rows = range_sorted(rows, group, order)
        self.known = offsets(self.rows, group)
        kind = self.rows.schema[group].dataType.simpleString()
        schema = pa.schema([("part", pa.int64()), (group, pa.string() if kind == "string" else pa.int64()), ("top", pa.int32()), ("level", pa.int32()), ("k", pa.int64()), ("digest", pa.string())])
        self.edge = checkpointed(self.rows.select("part", group, "leaf").mapInArrow(_local(self.known, schema), NODE.format(group=f"{group} {kind}")))
        self.tops = max([height(t) for x in self.known.values() for t in x[1:] if t], default=0)
        self._finish()

    def _finish(self) -> None:
        """The upper levels of groups that cross a border: self.runs[level] has the children of each node above them."""
        nodes = self.edge.select(self.group, "top", "level", "k", "digest")
        self.runs: list[DataFrame] = []
        made = None
        for level in range(self.tops):
            here = nodes.where((F.col("level") == level) & (F.col("top") > level))
            here = here if made is None else here.unionByName(made.where(F.col("top") > level))
            child = F.struct((F.col("k") % FAN).cast("int").alias("place"), "digest")
            above = here.groupBy(self.group, "top", F.floor(F.col("k") / FAN).alias("up")).agg(F.array_sort(F.collect_list(child)).alias("children"))
            above = checkpointed(above)
            self.runs.append(above)
            made = above.select(self.group, "top", F.lit(level + 1).alias("level"), F.col("up").alias("k"), _parent().alias("digest"))
        roots = [nodes.where("level = top").select(self.group, F.col("digest").alias("root"))]
        roots += [r.where(F.col("top") == level + 1).select(self.group, _parent().alias("root")) for level, r in enumerate(self.runs)]
        self.roots = reduce(DataFrame.unionByName, roots)

    def proofs(self, above: DataFrame, emit: Callable[[dict, Steps, int], tuple], columns: list[str], schema: pa.Schema) -> DataFrame:
        """emit(row, steps, own) of every row: its `columns`, its steps to the top and how many of them lie in its group's tree.

        `above` (group, steps) has the steps that follow each group's root. Steps go down from the roots by coordinate to
        the ragged nodes, and meet the rows of a partition there; what lies below them is built again from the rows.
        """
        g, known = self.group, self.known
        ends = self._paths(above)

        def prove(rows: pa.Table, tops: pa.Table) -> pa.Table:
            rows = rows.sort_by("at")
            groups, leaves = rows.column(g).to_pylist(), rows.column("leaf").to_pylist()
            further = {(x[g], x["level"], x["k"]): [(s["place"], s["others"]) for s in x["steps"]] for x in tops.select([g, "level", "k", "steps"]).to_pylist()}
            given = zip(*(rows.column(c).to_pylist() for c in columns))
            out = []
            for a, b, r in runs_of(rows.column("part")[0].as_py(), groups, leaves, known):
                for i in range(b - a):
                    steps, top = r.steps(i)
                    out.append(emit(dict(zip(columns, next(given))), steps + further[(groups[a], *top)], r.top))
            return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        return self.rows.select("part", "at", g, *(c for c in dict.fromkeys(["leaf", *columns]) if c != g)).groupBy("part").cogroup(ends.groupBy("part")).applyInArrow(prove, from_arrow_schema(schema))

    def _paths(self, above: DataFrame) -> DataFrame:
        """(part, group, level, k, steps): the steps that follow each ragged node."""
        g = self.group
        steps = above.select(F.col(g).alias("its"), "steps")
        start = self.edge.where("level = top").select("part", g, "level", "k")
        paths = start.join(steps, start[g].eqNullSafe(steps.its)).select("part", g, "level", "k", "steps")
        down = None
        for level in reversed(range(self.tops)):
            run = self.runs[level].select(g, "top", F.col("up").alias("k"), "children")
            born = run.where(F.col("top") == level + 1)
            born = born.join(steps, born[g].eqNullSafe(steps.its)).select(g, "top", "k", "children", "steps")
            if down is not None:
                later = down.select(F.col(g).alias("its"), F.col("k").alias("its_k"), "steps")
                rest = run.where(F.col("top") > level + 1)
                born = born.unionByName(rest.join(later, rest[g].eqNullSafe(later.its) & (rest.k == later.its_k)).select(g, "top", "k", "children", "steps"))
            down = checkpointed(born.select(g, "top", "k", "steps", F.explode(_steps_of(F.col("children"))).alias("step")).select(g, "top", (F.col("k") * FAN + F.col("step.place")).alias("k"), F.concat(F.array("step"), "steps").alias("steps")))
            ends = self.edge.where((F.col("level") == level) & (F.col("top") > level)).select("part", F.col(g).alias("its"), "level", F.col("k").alias("its_k"))
            paths = paths.unionByName(ends.join(down, down[g].eqNullSafe(ends.its) & (down.k == ends.its_k)).select("part", g, "level", "k", "steps"))
        return paths


def _parent() -> Column:
    """The digest of a node from its children in order."""
    return F.sha2(F.array_join("children.digest", ""), 256)


def _steps_of(children: Column) -> Column:
    """The step of each of a node's children (place, digest)."""
    others = lambda c: F.transform(F.filter(children, lambda x: x["place"] != c["place"]), lambda x: x["digest"])
    return F.transform(children, lambda c: F.struct(c["place"].alias("place"), F.array_join(others(c), "").alias("others")))


def fold_up(node: str, steps: Steps) -> str:
    """The root that follows from a node and its steps."""
    for place, others in steps:
        node = sha(others[: 64 * place] + node + others[64 * place :])
    return node


_STEPS = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.string())]))
_PATHS = pa.schema([("source", pa.string()), ("steps", _STEPS)])
_PROOFS = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("altered", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("steps", _STEPS)])
_CHECKS = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])


def _listed(steps: Steps) -> list[dict]:
    return [{"place": p, "others": o} for p, o in steps]


def _leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, altered): altered is the leaf of the tampered row, null where nothing is tampered with."""
    typed = docs.select(*(F.col(c).cast("long" if c in ("doc_id", "n_chars") else "string").alias(c) for c in FIELDS))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return typed.select("doc_id", "source", leaf(typed).alias("leaf"), F.when(chosen, leaf(typed, F.translate("text", upper, lower))).alias("altered"))


class Manifest:
    """The trees of all sources of `docs`, and the tree over their roots.

    Leaves of one source ascend by doc_id, null first, then by digest where doc_ids repeat; sources stand in the order of
    their UTF-8 bytes, null first. Null fields are a `-`. Repeated rows are leaves of their own. No rows have the root "".
    """

    def __init__(self, docs: DataFrame) -> None:
        self.trees = Forest(checkpointed(_leaves(docs)), "source", ["doc_id", "leaf"])
        roots = checkpointed(self.trees.roots)
        self.over = Forest(roots.select(F.lit(0).cast("long").alias("all"), "source", F.col("root").alias("leaf")), "all", ["source"])
        top = self.over.roots.first()
        self.root = top["root"] if top else ""

    def proofs(self, emit: Callable[[dict, Steps, int], tuple], schema: pa.Schema) -> DataFrame:
        """emit(row, steps to the root, steps to the source's root) of every row (doc_id, leaf, altered)."""
        nothing = self.over.roots.select("all", F.array().cast(f"array<{STEP}>").alias("steps"))
        above = self.over.proofs(nothing, lambda row, steps, _: (row["source"], _listed(steps)), ["source"], _PATHS)
        return self.trees.proofs(checkpointed(above), emit, ["doc_id", "leaf", "altered"], schema)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, altered, subroot, root and steps (place, others) of every row of `docs`: verify() needs no more than these."""
    whole = Manifest(docs)
    root = whole.root
    return whole.proofs(lambda row, steps, own: (row["doc_id"], row["leaf"], row["altered"], fold_up(row["leaf"], steps[:own]), root, _listed(steps)), _PROOFS)


def op13(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of `docs`; see Manifest.

    A row is tampered with if 5 divides the crc32 of its decimal doc_id (never where that is null), by lower-casing A-Z
    in its text.
    """
    whole = Manifest(docs)
    root = whole.root

    def checked(row: dict, steps: Steps, own: int) -> tuple:
        folded = fold_up(row["altered"] or row["leaf"], steps)
        return row["doc_id"], row["leaf"], fold_up(row["leaf"], steps[:own]), root, sha("".join(o for _, o in steps)), folded, folded == root

    return whole.proofs(checked, _CHECKS)


def _oracle() -> str:
    """DuckDB SQL for op13: levels by recursion, steps by coordinate."""
    sized = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    digest = lambda text: f"sha256({' || '.join(sized(text if c == 'text' else c) for c in FIELDS)})"
    level = lambda t, by: f"SELECT {by}, level + 1, k // {FAN}, sha256(string_agg(digest, '' ORDER BY k)), (n + {FAN - 1}) // {FAN} FROM {t} WHERE n > 1 GROUP BY {by}, level, k // {FAN}, n"
    others = "coalesce(string_agg(t.digest, '' ORDER BY t.k) FILTER (t.k {} x.k // CAST(power(16, t.level) AS BIGINT)), '')"
    run = f"t.n > 1 AND t.k // {FAN} = x.k // CAST(power(16, t.level + 1) AS BIGINT)"
    return f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS r, doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, {digest("text")} AS leaf, {digest("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lowered,
    list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda acc, x: list_reduce(list_prepend(xor(acc, x), range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)) AS crc FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, count(*) OVER (PARTITION BY s) AS n FROM leaves),
low(s, level, k, digest, n) AS (
  SELECT s, 0, k, leaf, n FROM placed UNION ALL {level("low", "s")}),
subroots AS (
  SELECT s, digest FROM low WHERE n = 1),
high(level, k, digest, n) AS (
  SELECT 0, s, digest, count(*) OVER () FROM subroots UNION ALL {level("high", "").replace("SELECT ,", "SELECT").replace("GROUP BY ,", "GROUP BY")}),
top AS (
  SELECT digest AS root FROM high WHERE n = 1),
steps AS (
  SELECT x.r, t.level, {others.format("<")} AS a, {others.format(">")} AS b FROM placed x JOIN low t ON t.s = x.s AND {run} GROUP BY x.r, t.level
  UNION ALL SELECT x.r, 1000 + t.level, {others.format("<")}, {others.format(">")} FROM (SELECT r, s AS k FROM placed) x JOIN high t ON {run} GROUP BY x.r, t.level),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY level) AS i, count(*) OVER (PARTITION BY r) AS m FROM steps),
proofs AS (
  SELECT r, sha256(string_agg(a || b, '' ORDER BY i)) AS proof FROM numbered GROUP BY r),
fold(r, i, node) AS (
  SELECT r, CAST(1 AS BIGINT), CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN lowered ELSE leaf END FROM placed
  UNION ALL SELECT f.r, f.i + 1, sha256(a || node || b) FROM fold f JOIN numbered n ON n.r = f.r AND n.i = f.i),
folded AS (
  SELECT r, arg_max(node, i) AS node FROM fold GROUP BY r)
SELECT doc_id, leaf, u.digest AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, node AS folded_root, node = root AS verified
FROM placed x JOIN subroots u USING (s) CROSS JOIN top LEFT JOIN proofs USING (r) JOIN folded USING (r)"""


ORACLE_SQL = _oracle()
