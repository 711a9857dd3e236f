"""One JSON document at a time: taken apart into its values, built from them, and merged with another.

The texts are those that Spark writes of a variant (to_json), so what counts as JSON and how a number reads is Spark's.
Each function takes and gives Arrow arrays, a document an entry; rows are grouped, joined and dealt by Spark.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import pyarrow as pa

_PLAIN = re.compile("[A-Za-z_$][A-Za-z0-9_$]*")
_STEP = re.compile(r'(?:\.(?P<plain>[A-Za-z_$][A-Za-z0-9_$]*)|\[(?P<index>[0-9]+)\]|\["(?P<quoted>(?:[^"\\]|\\.)*)"\])\Z', re.S)
_SPECIAL = re.compile('[\x00-\x1f"\\\\]')
_ESCAPES = {i: f"\\u{i:04X}" for i in range(32)} | {ord(c): "\\" + e for c, e in zip('"\\\b\f\n\r\t', '"\\bfnrt')}


class _Raw(str):
    """A number as it stands in the text."""


#: Value and end of the JSON that begins at a place of a text. Spark's parser takes 1,000 levels.
_decoded = json.JSONDecoder(parse_int=_Raw, parse_float=_Raw, parse_constant=_Raw).scan_once
sys.setrecursionlimit(max(sys.getrecursionlimit(), 5000))


def _quote(text: str) -> str:
    return f'"{text.translate(_ESCAPES) if _SPECIAL.search(text) else text}"'


_name = lru_cache(1 << 16)(_quote)


@lru_cache(1 << 16)
def _member(name: str) -> str:
    """The step of a path to the member `name`."""
    return "." + name if _PLAIN.fullmatch(name) else '["' + name.replace("\\", "\\\\").replace('"', '\\"') + '"]'


@lru_cache(1 << 16)
def _step(path: str) -> tuple[str | None, str | None, int | None]:
    """The parent's path, and the name or the index within it, of a path; nothing where it ends in no step."""
    found = _STEP.search(path)
    if found is None:
        return None, None, None
    name = found["plain"] if found["quoted"] is None else re.sub(r"(?s)\\(.)", r"\1", found["quoted"])
    return path[: found.start()], name, None if found["index"] is None else int(found["index"])


def _listed(column: pa.Array) -> list:
    return column.to_numpy(zero_copy_only=False).tolist()


_VALUES = pa.struct([("path", pa.string()), ("depth", pa.int64()), ("kind", pa.string()), ("value", pa.string())])


#: Values that are handed on together, about.
_TOGETHER = 100_000


def _values(columns: tuple[list, ...], ends: list[int]) -> pa.Array:
    arrays = [pa.array(c, f.type) for c, f in zip(columns, _VALUES)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(arrays, fields=list(_VALUES)))


def opened(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """All values of each document, a level after the other: path, depth, kind, value. None of a null text."""
    for texts in batches:
        paths, depths, kinds, values, ends = [], [], [], [], [0]
        for text in _listed(texts):
            work = [] if text is None else [("$", 0, _decoded(text, 0)[0])]
            for path, depth, v in work:
                value = None
                if type(v) is dict:
                    kind = "object"
                    work += [(path + _member(name), depth + 1, x) for name, x in v.items()]
                elif type(v) is list:
                    kind = "array"
                    work += [(f"{path}[{i}]", depth + 1, x) for i, x in enumerate(v)]
                elif v is None:
                    kind = "null"
                elif type(v) is bool:
                    kind, value = "boolean", "true" if v else "false"
                else:
                    kind, value = "number" if type(v) is _Raw else "string", v
                paths.append(path)
                depths.append(depth)
                kinds.append(kind)
                values.append(value)
            ends.append(len(paths))
            if len(paths) >= _TOGETHER:
                yield _values((paths, depths, kinds, values), ends)
                paths, depths, kinds, values, ends = [], [], [], [], [0]
        yield _values((paths, depths, kinds, values), ends)


def _document(rows: list[tuple]) -> list[str | None]:
    """Texts of the values of depth 0, from (depth, path, kind, value), deepest first; members in order of their names."""
    below: dict[tuple, list] = {}
    out = []
    for depth, path, kind, value in rows:
        if kind == "object":
            value = "{" + ",".join([_name(name) + ":" + x for numbered, _, name, x in sorted(below.get((depth, path), ())) if not numbered]) + "}"
        elif kind == "array":
            value = "[" + ",".join([x for *_, x in sorted(below.get((depth, path), ()))]) + "]"
        elif kind == "null":
            value = "null"
        elif kind == "string" and value is not None:
            value = _quote(value)
        if depth == 0:
            out.append(value)
        elif value is not None:
            parent, name, index = _step(path)
            if parent is not None:
                below.setdefault((depth - 1, parent), []).append((index is not None, index or 0, name or "", value))
    return out


def built(documents: pa.Array) -> pa.Array:
    """The texts of documents that are arrays of (path, depth, kind, value): one for each value of depth 0."""
    values = documents.flatten()
    columns = [_listed(values.field(k)) for k in ("depth", "path", "kind", "value")]
    rows, out, at = list(zip(*columns)), [], 0
    for n in documents.value_lengths().to_pylist():
        out.append(_document(sorted(rows[at : at + n], key=itemgetter(0), reverse=True)))
        at += n
    return pa.array(out, pa.list_(pa.string()))


def _written(v) -> str:
    """JSON of an opened document, members in order of their names."""
    kind = type(v)
    if kind is _Raw:
        return v
    if kind is str:
        return _quote(v)
    if kind is dict:
        return "{" + ",".join([f"{_name(k)}:{_written(v[k])}" for k in sorted(v)]) + "}"
    if kind is list:
        return "[" + ",".join([_written(x) for x in v]) + "]"
    return "null" if v is None else "true" if v else "false"


def merged(targets: pa.Array, sources: pa.Array) -> pa.Array:
    """Each source object merged into its target: members of both that are objects are merged in turn, of others the source's counts. Null where either is null."""
    out = []
    for a, b in zip(_listed(targets), _listed(sources)):
        if a is None or b is None:
            out.append(None)
            continue
        whole, other = _decoded(a, 0)[0], _decoded(b, 0)[0]
        work = [(whole, other)]
        while work:
            mine, its = work.pop()
            for name, x in its.items():
                if type(x) is dict and type(mine.get(name)) is dict:
                    work.append((mine[name], x))
                else:
                    mine[name] = x
        out.append(_written(whole))
    return pa.array(out, pa.string())
