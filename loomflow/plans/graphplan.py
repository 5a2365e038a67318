"""Compositions of a graph compiled to columns: a graph read or described anywhere runs over a table.

The control edges are walked once from the start. A call's value is a column of
the values that its data edges bring; a branch gives its calls a condition; the
calls that a loop repeats become the body of an aggregate, whose state is the
outputs that edges with a priority carry to the next round. Where no round runs,
a carried output has the value its target starts from. Calls of functions with a
composition are inlined.

A program's graph is small and is read to the driver; MOST_TRIPLES bounds it.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomflow.functions import pysem
from loomflow.functions.pysem import Unsupported, Value
from loomflow.functions.terms import NAMESPACES, expand
from loomflow.operators.access import CONTROL
from loomflow.operators.graph import Graph
from loomflow.plans.compile import MAX_DEPTH
from loomflow.sources.describe import OPERATORS

MOST_TRIPLES = 1_000_000
_NODES = {v: k for k, v in reversed(OPERATORS.items())} | {"op_and": "BitAnd", "op_or": "BitOr"}
_COMPARE = {"op_eq", "op_ne", "op_lt", "op_le", "op_gt", "op_ge"}
_UNARY = {"op_pos", "op_neg", "op_invert", "op_not"}
_READ = {"integer": int, "int": int, "double": float, "float": float, "decimal": float, "boolean": lambda x: x == "true"}


@dataclass
class Edge:
    literal: object = None
    call: str | None = None
    terminal: str | None = None
    item: object = None
    key: int | str | None = None
    priority: str | None = None


@dataclass
class Composition:
    f: str
    start: str | None
    inputs: dict[tuple[str, str], list[Edge]] = field(default_factory=lambda: defaultdict(list))


class Program:
    """The functions, calls, control edges and compositions of a graph."""

    def __init__(self, graph: Graph) -> None:
        rows = graph.triples.select("s", "p", "o", "o_kind", "o_dt").distinct().limit(MOST_TRIPLES + 1).collect()
        if len(rows) > MOST_TRIPLES:
            raise ValueError(f"a program has at most {MOST_TRIPLES} triples")
        by: dict[tuple[str, str], list] = defaultdict(list)
        members: dict[str, list[tuple[int, str]]] = defaultdict(list)
        for r in rows:
            by[r["s"], r["p"]].append(r)
            if r["p"].startswith(NAMESPACES["rdf"] + "_"):
                members[r["s"]].append((int(r["p"].rpartition("_")[2]), r["o"]))
        one = lambda s, p: next((r["o"] for r in by[s, expand(p)]), None)
        self.params: dict[str, list[str]] = {}
        self.names: dict[str, str] = {}
        self.outs: dict[str, list[str]] = {}
        for r in rows:
            if r["p"] == expand("a") and r["o"] == expand("fno:Function"):
                for at, to in (("fno:expects", self.params), ("fno:returns", self.outs)):
                    to[r["s"]] = [o for _, o in sorted(members.get(one(r["s"], at), []))]
                self.names[r["s"]] = r["s"].rpartition("#")[2]
        self.applies = {r["s"]: r["o"] for r in rows if r["p"] == expand("fnoc:applies")}
        self.control: dict[str, dict[str, str]] = defaultdict(dict)
        for r in rows:
            for kind in CONTROL:
                if r["p"] == expand(f"fnoc:{kind}"):
                    self.control[r["s"]][kind] = r["o"]
        self.compositions: dict[str, Composition] = {}
        for r in rows:
            if r["p"] == expand("fnoc:represents"):
                comp = Composition(r["o"], one(r["s"], "fnoc:start"))
                for edge in by[r["s"], expand("fnoc:composedOf")]:
                    self._edge(comp, edge["o"], by, one)
                self.compositions[r["o"]] = comp

    def _edge(self, comp: Composition, node: str, by: dict, one) -> None:
        end = one(node, "fnoc:mapTo")
        edge = Edge(priority=one(node, "fnoc:priority"))
        key = next(iter(by[end, expand("fnoc:key")]), None)
        if key is not None:
            edge.key = _literal(key)
        source = one(node, "fnoc:mapFrom")
        if source is None:
            r = by[node, expand("fnoc:mapFromTerm")][0]
            edge.literal = _literal(r)
        else:
            edge.call = one(source, "fnoc:constituentFunction")
            edge.terminal = one(source, "fnoc:functionOutput") or one(source, "fnoc:functionParameter")
            item = next((x for p in ("fnoc:key", "fnoc:index", "fnoc:property") for x in by[source, expand(p)]), None)
            edge.item = None if item is None else _literal(item)
        target = one(end, "fnoc:constituentFunction"), one(end, "fnoc:functionParameter") or one(end, "fnoc:functionOutput")
        comp.inputs[target].append(edge)

    def find(self, name: str) -> str:
        found = [f for f, n in self.names.items() if name in (f, n)]
        if len(found) != 1:
            raise KeyError(f"{len(found)} functions are called {name}")
        return found[0]


def _literal(row) -> object:
    if row["o_dt"] and "NoneType" in row["o_dt"]:
        return None
    return _READ.get((row["o_dt"] or "").rpartition("#")[2], str)(row["o"])


class _Walk:
    def __init__(self, program: Program, comp: Composition, given: dict[str, Value], depth: int) -> None:
        self.program, self.comp, self.given, self.depth = program, comp, given, depth
        self.values: dict[str, tuple[Column | None, Value, Value | None]] = {}
        self.state: dict[str, Value] = {}

    # values

    def edge(self, e: Edge) -> Value:
        if e.call is None:
            return pysem.constant(e.literal)
        if e.call == self.comp.f:
            out = self.given[e.terminal]
        elif e.call in self.values:
            _, value, own = self.values[e.call]
            out = own if own is not None and e.terminal.endswith("SelfOutput") else value
        elif e.call in self.state:
            out = self.state[e.call]
        else:
            raise Unsupported(f"the value of {e.call} is not known here")
        return out if e.item is None else pysem.field(out, e.item)

    def param(self, call: str, term: str) -> Value:
        edges = self.comp.inputs.get((call, term), [])
        if edges and all(e.key is not None for e in edges):
            return edges  # a list to be assembled
        for e in edges:
            if e.priority in self.state:
                return self.state[e.priority]
        plain = [e for e in edges if e.priority is None]
        if not plain:
            return pysem.constant(None)
        if len(plain) > 1 and sum(e.call is None for e in plain) > 1:
            raise Unsupported(f"{term} has several constants")
        out = None
        for e in sorted(plain, key=lambda e: e.call is not None):
            value = self.edge(e)
            holds = self.values[e.call][0] if e.call in self.values else None
            out = value if out is None or holds is None else pysem.choose(holds, value, out)
        return out

    # control

    def walk(self, node: str | None, holds: Column | None, stop: str | None) -> None:
        while node is not None and node != stop:
            f = self.program.applies[node]
            name = self.program.names.get(f, f.rpartition("#")[2])
            after = self.program.control.get(node, {})
            if name == "if":
                test = pysem.truthy(self.param(node, self.program.params[f][0]))
                join = self.join(after.get("true"), after.get("false"), stop)
                for kind, side in (("true", test), ("false", ~test)):
                    if after.get(kind) not in (None, join):
                        self.walk(after[kind], side if holds is None else holds & side, join)
                node = join
                continue
            if name == "next" and "iterate" in after:
                self.loop(node, after["iterate"], self.param(node, self.program.params[f][0]))
            else:
                value, own = self.call(node, f, name)
                before = self.values.get(node) or ((None, self.state[node], None) if node in self.state else None)
                if holds is not None and before is not None:
                    value = pysem.choose(holds, value, before[1])
                    own = None if own is None else pysem.choose(holds, own, before[2] or before[1])
                self.values[node] = (holds, value, own)
            node = after.get("next")

    def join(self, a: str | None, b: str | None, stop: str | None) -> str | None:
        """The first call that both branches come to."""
        reach = []
        for at in (a, b):
            seen: list[str] = []
            todo = [at] if at else []
            while todo:
                n = todo.pop(0)
                if n in seen:
                    continue
                seen.append(n)
                if n != stop:
                    after = self.program.control.get(n, {})
                    todo += [after[k] for k in ("iterate", "true", "false", "next") if k in after]
            reach.append(seen)
        return next((n for n in reach[0] if n in reach[1]), None)

    def body(self, head: str, first: str) -> set[str]:
        seen, todo = set(), [first]
        while todo:
            n = todo.pop()
            if n not in seen and n != head:
                seen.add(n)
                todo += self.program.control.get(n, {}).values()
        return seen

    def loop(self, head: str, first: str, over: Value) -> None:
        over = pysem.items_of(over)
        inside = self.body(head, first)
        carried = sorted({e.priority for (call, _), edges in self.comp.inputs.items() for e in edges if e.priority in inside and call in inside})
        start: dict[str, Value] = {}
        for (call, term), edges in self.comp.inputs.items():
            for e in edges:
                if call in inside and e.priority in carried and e.priority not in start:
                    start[e.priority] = self.param(call, term)
        kinds = {p: start[p].kind for p in carried}
        outer_values, outer_state = dict(self.values), dict(self.state)

        def round_(state, x: Column) -> dict[str, Value]:
            self.values = dict(outer_values) | {head: (None, Value(x, over.kind[1]), None)}
            self.state = outer_state | {p: Value(state(p), kinds[p]) for p in carried}
            self.walk(first, None, head)
            out = {p: self.own(p) for p in carried}
            self.values, self.state = dict(outer_values), dict(outer_state)
            return out

        for _ in range(4):
            found: dict[str, Value] = {}

            def probe(x: Column) -> Column:
                found.update(round_(lambda p: F.lit(None).cast(pysem.ddl(kinds[p])), x))
                return F.lit(0)

            F.transform(over.col, probe)
            wider = {p: pysem.widest(kinds[p], found[p].kind) for p in carried}
            if wider == kinds:
                break
            kinds = wider
        if not carried:
            return
        names = {p: f"_{n}" for n, p in enumerate(carried)}
        shape = "struct<" + ",".join(f"{names[p]}:{pysem.ddl(kinds[p])}" for p in carried) + ">"

        def pack(values: dict[str, Value]) -> Column:
            return F.struct(*[pysem.to_kind(values[p], kinds[p]).col.alias(names[p]) for p in carried]).cast(shape)

        end = F.aggregate(over.col, pack(start), lambda s, x: pack(round_(lambda p: s.getField(names[p]), x)))
        for p in carried:
            value = Value(end.getField(names[p]), kinds[p])
            self.values[p] = (None, value, value)

    def own(self, call: str) -> Value:
        """What a carried call leaves: its receiver where it changes one."""
        if call not in self.values:
            return self.state[call]
        _, value, own = self.values[call]
        return value if own is None else own

    # calls

    def call(self, node: str, f: str, name: str) -> tuple[Value, Value | None]:
        args = [self.param(node, term) for term in self.program.params.get(f, [])]
        if args and isinstance(args[0], list):
            args = [self.edge(e) for e in sorted(args[0], key=lambda e: e.key)]
            return self.assembled(name, args), None
        if f in self.program.compositions:
            if self.depth <= 0:
                raise Unsupported(f"{name} is inlined too deep")
            return value_of(self.program, f, args, self.depth - 1), None
        if name in ("list", "tuple", "dict"):
            given = [a for a, term in zip(args, self.program.params[f], strict=True) if (node, term) in self.comp.inputs]
            return self.assembled(name, given), None
        if name in _COMPARE:
            return pysem.compare(_NODES[name], *args), None
        if name in ("Is", "IsNot"):
            return pysem.compare(name, *args), None
        if name == "op_contains":
            return pysem.compare("In", args[1], args[0]), None
        if name in _UNARY:
            return pysem.unary(_NODES[name], *args), None
        if name in ("op_and", "op_or") and {a.kind for a in args} == {"bool"}:
            x, y = (a.col for a in args)
            return Value(x & y if name == "op_and" else x | y, "bool"), None
        if name == "op_getitem":
            if isinstance(args[0].kind, tuple) and args[0].kind[0] == "tuple":
                raise Unsupported("item of a tuple")
            return pysem.item(*args), None
        if name == "getattr":
            name_edge = self.comp.inputs[node, self.program.params[f][1]][0]
            return pysem.attribute(args[0], name_edge.literal), None
        if name == "op_setitem":
            return pysem.put(*args), None
        if name == "ifexpr":
            return pysem.choose(pysem.truthy(args[0]), args[1], args[2]), None
        if name == "iter":
            return pysem.items_of(args[0]), None
        if name == "format" and len(args) == 1:
            return pysem.to_str(args[0]), None
        if name in _NODES:
            return pysem.binary(_NODES[name], *args), None
        if name in pysem.BUILTINS:
            return pysem.BUILTINS[name](*args), None
        kind = args[0].kind[0] if args and isinstance(args[0].kind, tuple) else args[0].kind if args else None
        if (kind, name) in pysem.MUTATIONS:
            changed = pysem.MUTATIONS[kind, name](*args)
            return changed, changed
        if (kind, name) in pysem.METHODS:
            return pysem.METHODS[kind, name](*args), args[0]
        raise Unsupported(f"call of {name}")

    def assembled(self, name: str, args: list[Value]) -> Value:
        if name == "list":
            return pysem.list_of(args)
        if name == "tuple":
            return pysem.tuple_of(args)
        if name == "dict":
            return pysem.dict_of([(pysem.field(a, 0), pysem.field(a, 1)) for a in args])
        if name == "joinstr":
            return pysem.joined(args)
        raise Unsupported(f"a list for {name}")


def value_of(program: Program, f: str, args: list[Value], depth: int = MAX_DEPTH) -> Value:
    """The value of a function with a composition."""
    comp = program.compositions[f]
    params = program.params[f]
    if len(args) != len(params):
        raise TypeError(f"{program.names[f]} takes {len(params)} arguments")
    walk = _Walk(program, comp, dict(zip(params, args, strict=True)), depth)
    walk.walk(comp.start, None, None)
    edges = comp.inputs.get((f, program.outs[f][0]), [])
    constants = [e for e in edges if e.call is None]
    if len(constants) > 1:
        raise Unsupported("several constants are returned")
    out = walk.edge(constants[0]) if constants else None
    for e in [e for e in edges if e.call is not None][::-1]:
        value = walk.edge(e)
        holds = walk.values[e.call][0] if e.call in walk.values else None
        out = value if out is None or holds is None else pysem.choose(holds, value, out)
    return out if out is not None else pysem.constant(None)


def column(df: DataFrame, graph: Graph | Program, name: str, *args: str | Column) -> Column:
    """The value of a graph's function for the columns of df. Raises Unsupported where no column has its meaning."""
    program = graph if isinstance(graph, Program) else Program(graph)

    def value(x: str | Column) -> Value:
        col = df[x] if isinstance(x, str) else x
        return pysem.of_column(col, df.select(col).schema[0].dataType)

    return value_of(program, program.find(name), [value(a) for a in args]).col
