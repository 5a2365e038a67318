"""Graphs as Turtle and N-Triples text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomflow.functions.terms import NAMESPACES
from loomflow.operators.graph import TRIPLE, Graph
from loomflow.stage import Staged

_TOKEN = re.compile(
    r'\s+|#[^\n]*|"""(?P<long>(?:[^"\\]|\\.|"(?!""))*)"""|"(?P<text>(?:[^"\\\n]|\\.)*)"|<(?P<uri>[^>]*)>|\^\^|@(?P<at>[A-Za-z][\w-]*)'
    r"|(?P<node>_:[\w.-]*\w)|(?P<number>[+-]?(?:\d+\.\d*(?:[eE][+-]?\d+)?|\.?\d+(?:[eE][+-]?\d+)?))|(?P<name>[\w-]*:(?:[\w.%-]*[\w%-])?|a\b|true\b|false\b)|(?P<mark>[][().;,])",
    re.S,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}
XSD = NAMESPACES["xsd"]


def _plain(text: str) -> str:
    return re.sub(r"\\(u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), text, flags=re.S)


class _Reader:
    def __init__(self, text: str, name: str, prefixes: dict[str, str] | None = None, anonymous: str | None = None) -> None:
        self.text, self.at, self.name, self.blank = text, 0, name, 0
        self.anonymous = name + "b" if anonymous is None else anonymous
        self.prefixes: dict[str, str] = dict(prefixes or {})
        self.out: list[tuple] = []
        self.held: re.Match | None = None

    def peek(self) -> re.Match | None:
        while self.held is None and self.at < len(self.text):
            m = _TOKEN.match(self.text, self.at)
            if m is None:
                raise ValueError(f"{self.name}: cannot read {self.text[self.at:self.at + 30]!r}")
            self.at = m.end()
            if m.lastgroup or m[0] == "^^":
                self.held = m
        return self.held

    def take(self, mark: str | None = None) -> re.Match:
        m, self.held = self.peek(), None
        if m is None or (mark and m[0] != mark):
            raise ValueError(f"{self.name}: expected {mark or 'a term'} at {self.at}")
        return m

    def is_next(self, mark: str) -> bool:
        m = self.peek()
        return m is not None and m[0] == mark

    def node(self) -> str:
        self.blank += 1
        return f"_:{self.anonymous}{self.blank}"

    def term(self) -> tuple[str, str, str | None]:
        m = self.take()
        kind = m.lastgroup
        if kind == "uri":
            return _plain(m["uri"]), "uri", None
        if kind == "node":
            return f"_:{self.name}{m[0][2:]}", "bnode", None
        if kind == "number":
            return m[0], "literal", XSD + ("integer" if re.fullmatch(r"[+-]?\d+", m[0]) else "double" if "e" in m[0].lower() else "decimal")
        if kind in ("text", "long"):
            value, datatype = _plain(m[kind]), None
            if self.is_next("^^"):
                self.take()
                datatype = self.term()[0]
            elif (after := self.peek()) is not None and after.lastgroup == "at":
                self.take()
            return value, "literal", datatype
        if kind == "name":
            if m[0] in ("true", "false"):
                return m[0], "literal", XSD + "boolean"
            if m[0] == "a":
                return NAMESPACES["rdf"] + "type", "uri", None
            prefix, _, rest = m[0].partition(":")
            return self.prefixes.get(prefix, NAMESPACES.get(prefix, "")) + rest, "uri", None
        if m[0] == "[":
            node = self.node()
            if not self.is_next("]"):
                self.verbs(node)
            self.take("]")
            return node, "bnode", None
        if m[0] == "(":
            items = []
            while not self.is_next(")"):
                items.append(self.term())
            self.take(")")
            rdf, head = NAMESPACES["rdf"], (NAMESPACES["rdf"] + "nil", "uri", None)
            for item in reversed(items):
                node = self.node()
                self.out += [(node, rdf + "first", *item), (node, rdf + "rest", *head)]
                head = (node, "bnode", None)
            return head
        raise ValueError(f"{self.name}: unexpected {m[0]!r}")

    def verbs(self, subject: str) -> None:
        while True:
            predicate = self.term()[0]
            while True:
                self.out.append((subject, predicate, *self.term()))
                if not self.is_next(","):
                    break
                self.take()
            while self.is_next(";"):
                self.take()
            if self.is_next(".") or self.is_next("]") or self.peek() is None:
                return

    def statement(self) -> None:
        m = self.peek()
        if m.lastgroup == "at" and m["at"] == "prefix":
            self.take()
            prefix = self.take()[0].partition(":")[0]
            self.prefixes[prefix] = self.take()["uri"]
        else:
            subject, kind, _ = self.term()
            if kind != "bnode" or not self.is_next("."):
                self.verbs(subject)
        self.take(".")

    def read(self) -> list[tuple]:
        while self.peek() is not None:
            self.statement()
        return self.out


def _ends(text: str) -> tuple[int, int]:
    """Where the first and the last statement that ends in the text ends; -1 where none does. The text begins outside of long strings."""
    first = last = -1
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            # a long string that goes on, or nothing that is Turtle: what reads the statement tells
            break
        at = m.end()
        if m.lastgroup == "mark" and m[0] == ".":
            first, last = (at if first < 0 else first), at
    return first, last


def parse(text: str, name: str = "") -> list[tuple]:
    """Rows (s, p, o, o_kind, o_dt) of a Turtle or N-Triples text; blank nodes are named after the text."""
    return list(dict.fromkeys(_Reader(text, name).read()))


#: What tells whether a line ends inside a long string that it begins.
_LEXED = re.compile(r'#[^\n]*|<[^>]*>|"""|"(?:[^"\\\n]|\\.)*"|[^#<"]+|.', re.S)
_LONG_END = re.compile(r'(?:[^"\\]|\\.|"(?!""))*"""', re.S)


def _long_after(line: str, long: bool) -> bool:
    """Whether a line ends inside a long string."""
    at = 0
    while at < len(line):
        if long:
            m = _LONG_END.match(line, at)
            if m is None:
                return True
            at, long = m.end(), False
            continue
        m = _LEXED.match(line, at)
        at, long = m.end(), m[0] == '"""'
    return long


def _prefix(line: str) -> tuple[str, str] | None:
    m = re.match(r"\s*@prefix\s+([\w-]*):\s*<([^>]*)>", line)
    return (m[1], m[2]) if m else None


def _states(lines: DataFrame) -> dict[tuple[str, int], tuple[bool, dict[str, str]]]:
    """(whether it begins in a long string, the prefixes so far) of each range, by path and place.

    A range is read as if it began outside of a long string and as if inside; only
    lines with three quotes or a prefix matter. A row for each range with such lines
    goes to the driver, which puts them in order.
    """
    some = lines.where(F.contains("value", F.lit('"""')) | F.rlike("value", F.lit(r"^\s*@prefix")))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, long, found = None, [False, True], [[], []]

        def told() -> pa.RecordBatch:
            pairs = pa.array([[f"{p} {u}" for p, u in x] for x in found], pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int64()), pa.array([long[0]]), pa.array([long[1]]), pairs[:1], pairs[1:]], names=["path", "at", "outside", "inside", "named", "named_inside"])

        for batch in batches:
            for path, at, value in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "value")), strict=True):
                if (path, at) != now:
                    if now is not None:
                        yield told()
                    now, long, found = (path, at), [False, True], [[], []]
                for k in (0, 1):
                    if not long[k] and (pair := _prefix(value)):
                        found[k].append(pair)
                    long[k] = _long_after(value, long[k])
        if now is not None:
            yield told()

    rows = some.mapInArrow(each, "path string, at bigint, outside boolean, inside boolean, named array<string>, named_inside array<string>").collect()
    out, last, long, prefixes = {}, None, False, {}
    for r in sorted(rows, key=lambda r: (r["path"], r["at"])):
        if r["path"] != last:
            last, long, prefixes = r["path"], False, {}
        # the state holds from here to the next range that is told
        out[r["path"], r["at"]] = (long, prefixes)
        prefixes = prefixes | dict(x.split(" ", 1) for x in r["named_inside" if long else "named"])
        long = r["inside"] if long else r["outside"]
        out[r["path"], r["at"] + 1] = (long, prefixes)
    return out


class _Range:
    """Reads one range of a file: whole statements give triples, and what belongs to statements of other ranges too is left as a piece."""

    def __init__(self, path: str, at: int, long: bool, prefixes: dict[str, str]) -> None:
        import hashlib

        self.path, self.at, self.long, self.prefixes = path, at, long, prefixes
        self.name = hashlib.sha256(path.encode()).hexdigest()[:8]
        # the first range begins with a statement
        self.head: list[str] | None = [] if at else None
        self.inside = long
        self.lines: list[str] = []
        self.blank = 0

    def add(self, lines: list[str]) -> list[tuple]:
        """The triples of the statements that end with these lines."""
        for line in lines:
            self.lines.append(line)
            self.long = _long_after(line, self.long)
        return [] if self.long else self._read()

    def _read(self) -> list[tuple]:
        text = "\n".join(self.lines) + "\n" if self.lines else ""
        if self.inside:
            # the long string's end is not a statement's
            skip = _LONG_END.match(text).end()
            self.head.append(text[:skip])
            text, self.inside = text[skip:], False
        first, last = _ends(text)
        if self.head is not None:
            if first < 0:
                self.head.append(text)
                self.lines = []
                return []
            self.head.append(text[:first])
            self.closed, self.head, text, last = "".join(self.head), None, text[first:], last - first
        if last <= 0:
            self.lines = [text.removesuffix("\n")] if text else []
            return []
        reader = _Reader(text[:last], self.name, self.prefixes, f"{self.name}r{self.at}b")
        reader.blank = self.blank
        out = reader.read()
        self.prefixes, self.blank = reader.prefixes, reader.blank
        rest = text[last:].removesuffix("\n")
        self.lines = [rest] if rest else []
        return out

    #: The end of a statement that began in an earlier range.
    closed: str | None = None

    def pieces(self) -> list[tuple[str, int, int, str]]:
        """(path, at, order, text): order 0 ends a statement of before, 1 is all within one, 2 begins one."""
        rest = "\n".join(self.lines) + "\n" if self.lines else ""
        if self.head is not None:
            return [(self.path, self.at, 1, "".join(self.head) + rest)]
        out = [] if self.closed is None else [(self.path, self.at, 0, self.closed)]
        # what begins here begins with the prefixes that hold here
        named = "".join(f"@prefix {p}: <{u}> .\n" for p, u in self.prefixes.items())
        return out + ([(self.path, self.at, 2, named + rest)] if rest.strip() else [])


def read(spark: SparkSession, path: str) -> Graph:
    """The graph of the Turtle files at a path, each file in as many tasks as Spark cuts it into.

    A range's lines are read from the first statement that begins in it to the last
    that ends in it. The pieces at the ranges' ends, two of each, are put together
    file by file. Blank nodes are named after their file, and those without a name
    after their range too. Prefixes hold from where they are named on.
    """
    place = (F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))
    lines = spark.read.option("lineSep", "\n").text(path).select(*place, "value")
    states = _states(lines)
    known = sorted(states)

    def state(of: str, at: int) -> tuple[bool, dict[str, str]]:
        from bisect import bisect_right

        n = bisect_right(known, (of, at)) - 1
        return states[known[n]] if n >= 0 and known[n][0] == of else (False, {})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Range | None = None

        def told(triples: list[tuple], pieces: list[tuple] = ()) -> pa.RecordBatch:
            rows = [(*t, None, None, None, None) for t in triples] + [(None, None, None, None, None, *p) for p in pieces]
            columns = zip(*rows, strict=True) if rows else [[]] * 9
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SHAPE.types, strict=True)], schema=_SHAPE)

        for batch in batches:
            paths, ats, values = (batch.column(c).to_pylist() for c in ("path", "at", "value"))
            lo = 0
            while lo < len(paths):
                hi = lo + 1
                while hi < len(paths) and hi - lo < 2000 and (paths[hi], ats[hi]) == (paths[lo], ats[lo]):
                    hi += 1
                if now is None or (now.path, now.at) != (paths[lo], ats[lo]):
                    if now is not None:
                        yield told([], now.pieces())
                    now = _Range(paths[lo], ats[lo], *state(paths[lo], ats[lo]))
                yield told(now.add(values[lo:hi]))
                lo = hi
        if now is not None:
            yield told([], now.pieces())

    shape = "s string, p string, o string, o_kind string, o_dt string, path string, at bigint, part int, text string"
    rows = Staged(spark, "turtle").save(lines.mapInArrow(each, shape))

    def joined(group: pa.Table) -> pa.Table:
        import hashlib

        out, held, of, named = [], [], group.column("path")[0].as_py(), {}
        name = hashlib.sha256(of.encode()).hexdigest()[:8]
        for at, part, text in zip(*(group.sort_by([("at", "ascending"), ("part", "ascending")]).column(c).to_pylist() for c in ("at", "part", "text")), strict=True):
            named = named if held else {} if part == 2 else state(of, at)[1]
            held.append(text)
            if part == 0:
                out += _Reader("".join(held), name, named, f"{name}s{at}b").read()
                held = []
        # at the file's end only comments go without a statement's end
        out += _Reader("".join(held), name, named, f"{name}eb").read()
        return pa.table([pa.array(c, pa.string()) for c in (zip(*out, strict=True) if out else [[]] * 5)], names=TRIPLE.names)

    ends = rows.where("path is not null").select("path", "at", "part", "text").groupBy("path").applyInArrow(joined, TRIPLE)
    return Graph(rows.where("path is null").select(*TRIPLE.names).unionByName(ends).dropDuplicates())


_SHAPE = pa.schema([(c, pa.string()) for c in (*TRIPLE.names, "path")] + [("at", pa.int64()), ("part", pa.int32()), ("text", pa.string())])


def _escaped(x: Column) -> Column:
    for plain, escape in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        x = F.replace(x, F.lit(plain), F.lit(escape))
    return x


def lines(graph: Graph) -> DataFrame:
    """(value) each triple as a line of N-Triples."""

    def resource(x: Column) -> Column:
        return F.when(F.startswith(x, F.lit("_:")), x).otherwise(F.concat(F.lit("<"), x, F.lit(">")))

    datatype = F.when(F.col("o_dt").isNotNull(), F.concat(F.lit("^^<"), F.col("o_dt"), F.lit(">"))).otherwise("")
    o = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'), datatype)).otherwise(resource(F.col("o")))
    return graph.triples.select(F.concat(resource(F.col("s")), F.lit(" <"), F.col("p"), F.lit("> "), o, F.lit(" .")).alias("value"))


def write(graph: Graph, path: str) -> None:
    """Sorted N-Triples."""
    lines(Graph(graph.distinct())).orderBy("value").write.text(path)
