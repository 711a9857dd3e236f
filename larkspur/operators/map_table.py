"""Mind maps as a table function: callable from SQL, one row for each node, in one pass over each text."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, LongType, MapType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: Elements of a map, and the attributes of a node that have columns of their own.
COLUMNS = {"FOLDED": "folded", "POSITION": "side", "COLOR": "color", "BACKGROUND_COLOR": "background", "LINK": "link", "ID": "id"}


class _Parser:
    """Nodes of one map as expat comes by them; those above the current one are on a stack."""

    def __init__(self) -> None:
        self.nodes: list[dict] = []
        self.stack: list[dict] = []
        self.rich: tuple[str, int] | None = None
        self.depth = 0
        self.text: list[str] = []
        self.expat = expat.ParserCreate()
        self.expat.StartElementHandler, self.expat.EndElementHandler, self.expat.CharacterDataHandler = self._start, self._end, self._characters

    def run(self, text: str) -> str | None:
        """What is wrong with the text, if anything; nodes before that place are kept."""
        try:
            self.expat.Parse(text, True)
        except expat.ExpatError as e:
            return f"{expat.ErrorString(e.code)} at line {e.lineno}, column {e.offset}"
        return None if self.nodes else "no node"

    def _start(self, name: str, found: dict[str, str]) -> None:
        self.depth += 1
        if self.rich:
            return
        if name == "node":
            up = self.stack[-1] if self.stack else None
            node = {"position": len(self.nodes), "depth": len(self.stack), "parent": up and up["position"], "topic": found.get("TEXT"), "note": None, "attributes": {}, "icons": []}
            node |= {column: found.get(a) for a, column in COLUMNS.items()} | {"given": found}
            self.nodes.append(node)
            self.stack.append(node)
        elif self.stack:
            if name == "richcontent":
                self.rich, self.text = (found.get("TYPE", "NODE"), self.depth), []
            elif name == "attribute":
                self.stack[-1]["attributes"][found.get("NAME", "")] = found.get("VALUE", "")
            elif name == "icon":
                self.stack[-1]["icons"].append(found.get("BUILTIN", ""))

    def _end(self, name: str) -> None:
        if self.rich and self.depth == self.rich[1]:
            words = " ".join("".join(self.text).split())
            if self.rich[0] == "NOTE":
                self.stack[-1]["note"] = words
            elif self.stack[-1]["topic"] is None:
                self.stack[-1]["topic"] = words
            self.rich = None
        elif not self.rich and name == "node":
            self.stack.pop()
        self.depth -= 1

    def _characters(self, text: str) -> None:
        if self.rich:
            self.text.append(text)


@udtf
class FreemindNodes:
    """freemind_nodes(TABLE(SELECT key, text ...) [PARTITION BY key], keep => 'NAME,NAME')

    One row for each <node>: key, position (from 0, in order of the text), depth, parent (its position), topic (attribute
    TEXT, else the words of the rich content), folded, side, color, background, link, id, note (words of rich content of
    type NOTE), attributes (a map of the <attribute> elements, the last of a name), icons, problem; and for each name in
    `keep` a text column of that attribute of the node, in lower case. A text that is no well-formed map gives the nodes
    up to the place where it breaks and one row without position whose problem says what and where; a null or empty one
    just that row. Repeated keys give their rows each.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, keep: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not rows.isTable or len(rows.dataType.fields) < 2:
            raise ValueError("freemind_nodes takes a table of two columns, a key and a text")
        key = rows.dataType.fields[0]
        out = StructType().add(key.name, key.dataType).add("position", LongType()).add("depth", LongType()).add("parent", LongType()).add("topic", StringType()).add("folded", BooleanType())
        for name in ("side", "color", "background", "link", "id", "note"):
            out = out.add(name, StringType())
        out = out.add("attributes", MapType(StringType(), StringType())).add("icons", StringType()).add("problem", StringType())
        for name in _names(keep.value if keep else None):
            out = out.add(name.lower(), StringType())
        return AnalyzeResult(out)

    def eval(self, rows: Row, keep: str | None = None) -> Iterator[tuple]:
        key, text = rows[0], rows[1]
        parser = _Parser()
        problem = parser.run(text or "")
        names = _names(keep)
        for n in parser.nodes:
            yield (
                key, n["position"], n["depth"], n["parent"], n["topic"] or "", n["folded"] == "true", n["side"], n["color"], n["background"], n["link"], n["id"], n["note"],
                n["attributes"], ",".join(n["icons"]), None, *(n["given"].get(k) for k in names),
            )
        if problem:
            yield (key, *[None] * 13, problem, *[None] * len(names))


def _names(keep: str | None) -> list[str]:
    return [k.strip() for k in (keep or "").split(",") if k.strip()]


def register(spark: SparkSession) -> None:
    """Make freemind_nodes known to the session's SQL."""
    spark.udtf.register("freemind_nodes", FreemindNodes)
