"""Python programs described as graphs of functions, calls, data flow and control flow.

Source text is parsed, never imported or run. The rows become tables of the
graph on the driver, as they are metadata; many files are described in parallel
by describe_tree().
"""

from __future__ import annotations

import ast
import hashlib
import inspect
import textwrap
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomflow.functions.terms import NAMESPACES, expand, mint
from loomflow.operators.graph import Graph, Lit, literal_of

# Names of the functions that operators stand for.
OPERATORS = {
    "Add": "op_add", "Sub": "op_sub", "Mult": "op_mul", "Div": "op_truediv", "FloorDiv": "op_floordiv", "Mod": "op_mod", "Pow": "op_pow",
    "LShift": "op_lshift", "RShift": "op_rshift", "BitOr": "op_or", "BitXor": "op_xor", "BitAnd": "op_and", "MatMult": "op_matmul",
    "UAdd": "op_pos", "USub": "op_neg", "Invert": "op_invert", "Not": "op_not", "And": "op_and", "Or": "op_or",
    "Eq": "op_eq", "NotEq": "op_ne", "Lt": "op_lt", "LtE": "op_le", "Gt": "op_gt", "GtE": "op_ge", "In": "op_contains", "NotIn": "op_contains",
}
CONTROL_FUNCTIONS = ("if", "ifexpr", "Is", "IsNot", "list", "tuple", "dict", "slice", "joinstr", "format", "getattr", "setattr")
MAX_DEPTH = 3


@dataclass(frozen=True)
class Source:
    """Where a value comes from: a literal, or a terminal of a call or of the function itself."""

    literal: object = None
    call: str | None = None
    terminal: str | None = None
    output: bool = True
    item: object = None
    others: tuple["Source", ...] = ()  # what it is where another branch was taken


@dataclass
class Described:
    """Rows of a described program; see triples()."""

    functions: dict[str, tuple[str, list[str], list[str]]] = field(default_factory=dict)
    implementations: dict[str, dict] = field(default_factory=dict)
    mappings: dict[str, dict] = field(default_factory=dict)
    calls: list[tuple[str, str]] = field(default_factory=list)
    control: list[tuple[str, str, str]] = field(default_factory=list)
    compositions: dict[str, dict] = field(default_factory=dict)

    def triples(self) -> Iterator[tuple]:
        ex = NAMESPACES["ex"]
        for f, (label, params, outs) in self.functions.items():
            u = ex + f
            yield from ((u, "a", "fno:Function"), (u, "a", "prov:Entity"), (u, "rdfs:label", Lit(label)))
            for kind, predicate, terms in (("Parameter", "fno:expects", params), ("Output", "fno:returns", outs)):
                if not terms:
                    continue
                node = f"_:{f}{predicate[4:]}"
                yield from ((u, predicate, node), (node, "a", "rdf:Seq"))
                for n, (term, name, hint) in enumerate(terms, 1):
                    yield from ((node, f"rdf:_{n}", ex + term), (ex + term, "a", f"fno:{kind}"), (ex + term, "fno:predicate", ex + name))
                    if hint:
                        yield (ex + term, "fno:type", mint(hint, "builtins"))
        for imp, row in self.implementations.items():
            yield from ((imp, "a", "fnoi:Implementation"), (imp, "a", "fnoi:" + row["kind"]), (imp, "doap:name", Lit(row["name"])))
            for key in ("module", "package"):
                if row.get(key):
                    yield (imp, f"fnoi:{key}", Lit(row[key]))
            if row.get("file"):
                yield (imp, "fnoi:file", "file://" + row["file"])
            if row.get("doc"):
                yield (imp, "dcterms:description", Lit(row["doc"]))
            if row.get("method_of"):
                yield (imp, "fnoi:methodOf", row["method_of"])
        for m, row in self.mappings.items():
            u = ex + m
            yield from ((u, "a", "fno:Mapping"), (u, "fno:function", ex + row["f"]), (u, "fno:implementation", row["imp"]), (u, "fnom:mappingMethod", Lit(row.get("method", "default"))))
            node = f"_:{m}method"
            yield (u, "fno:methodMapping", node)
            if row.get("command"):
                yield from ((node, "a", "fnom:CommandMethodMapping"), (node, "fnom:command", Lit(row["command"])))
            else:
                yield from ((node, "a", "fnom:StringMethodMapping"), (node, "fnom:method-name", Lit(row["name"])))
            for term, required in row.get("required", {}).items():
                yield (ex + term, "fno:required", Lit(required))
            for n, out in enumerate(row["outputs"]):
                node = f"_:{m}return{n}"
                yield from ((u, "fno:returnMapping", node), (node, "a", "fnom:DefaultReturnMapping" if n == 0 else "fnom:ValueReturnMapping"), (node, "fnom:functionOutput", ex + out))
            for n, (kind, term, value) in enumerate(row["parameters"]):
                node = f"_:{m}parameter{n}"
                yield from ((u, "fno:parameterMapping", node), (node, "a", f"fnom:{kind}Mapping" if kind == "Argument" else f"fnom:{kind}ParameterMapping"), (node, "fnom:functionParameter", ex + term))
                predicate = {"Position": "implementationParameterPosition", "Property": "implementationProperty", "Default": "defaultValue"}.get(kind)
                if kind == "Argument":
                    at, nargs = value
                    yield (node, "fnom:implementationProperty" if isinstance(at, str) else "fnom:implementationParameterPosition", Lit(at))
                    if nargs is not None:
                        yield (node, "fnom:nargs", Lit(nargs))
                elif predicate:
                    yield (node, f"fnom:{predicate}", Lit(value))
        for call, f in self.calls:
            yield (ex + call, "fnoc:applies", ex + f)
        for a, kind, b in self.control:
            yield (ex + a, f"fnoc:{kind}", ex + b)
        for c, row in self.compositions.items():
            u = ex + c
            yield from ((u, "a", "fno:Composition"), (u, "fnoc:represents", ex + row["f"]))
            if row["start"]:
                yield (u, "fnoc:start", ex + row["start"])
            for source, target, priority in row["flow"]:
                key = hashlib.sha256(repr((c, source, target, priority)).encode()).hexdigest()[:16]
                edge, a, b = f"_:m{key}", f"_:f{key}", f"_:t{key}"
                yield (u, "fnoc:composedOf", edge)
                if priority:
                    yield (edge, "fnoc:priority", ex + priority)
                if source.call is None:
                    yield (edge, "fnoc:mapFromTerm", Lit(source.literal))
                else:
                    yield from ((edge, "fnoc:mapFrom", a), (a, "fnoc:constituentFunction", ex + source.call), (a, "fnoc:functionOutput" if source.output else "fnoc:functionParameter", ex + source.terminal))
                    if source.item is not None:
                        yield from ((a, "fnoc:mappingStrategy", "fnoc:getItem"), (a, "fnoc:key", Lit(source.item)))
                call, term, is_out, strategy, key = target
                yield from ((edge, "fnoc:mapTo", b), (b, "fnoc:constituentFunction", ex + call), (b, "fnoc:functionOutput" if is_out else "fnoc:functionParameter", ex + term))
                if strategy:
                    yield from ((b, "fnoc:mappingStrategy", f"fnoc:{strategy}"), (b, "fnoc:key", Lit(key)))

    def rows(self) -> list[tuple]:
        """Rows of a table of triples."""
        out = set()
        for s, p, o in self.triples():
            kind = literal_of(o.value) if isinstance(o, Lit) else (expand(o), "bnode" if o.startswith("_:") else "uri", None)
            out.add((expand(s), expand(p), *kind))
        return sorted(out, key=str)

    def graph(self, spark: SparkSession) -> Graph:
        return Graph.of(spark, self.rows())


class _Body:
    """The composition of one function."""

    def __init__(self, all_: "_Program", f: str, depth: int) -> None:
        self.all, self.f, self.depth = all_, f, depth
        self.names: dict[str, Source] = {}
        self.flow: list[tuple] = []
        self.uses: list[tuple[str, tuple, int]] = []  # variable, target, number of the loop it is in
        self.exits: list[tuple[str, str]] = []
        self.start: str | None = None
        self.loops: list[set[str]] = []

    # control and data edges

    def call(self, f: str, label: str, args: list[tuple[Source, str | None]], imp: dict | None = None, strategy: str | None = None, has_self: bool = False) -> Source:
        """A call in sequence; args are (source, variable it was read from)."""
        name = self.all.number(f)
        fixed = strategy is not None
        self.all.function(f, label, 1 if fixed else len(args), imp, has_self)
        self.all.out.calls.append((name, f))
        for a, kind in self.exits:
            self.all.out.control.append((a, kind, name))
        self.exits = [(name, "next")]
        self.start = self.start or name
        for n, (source, variable) in enumerate(args):
            term = f"{f}Parameter{0 if fixed else n}"
            self.link(source, (name, term, False, strategy, n if fixed else None), variable)
        return Source(call=name, terminal=f"{f}Output")

    def link(self, source: Source, target: tuple, variable: str | None = None, priority: str | None = None) -> None:
        for one in (replace(source, others=()), *source.others):
            self.flow.append((one, target, priority))
        if variable:
            self.uses.append((variable, target, len(self.loops)))

    # statements

    def block(self, body: list[ast.stmt]) -> None:
        for stmt in body:
            make = getattr(self, f"_do_{type(stmt).__name__.lower()}", None)
            if make is None:
                raise NotImplementedError(f"{type(stmt).__name__} at line {stmt.lineno}")
            make(stmt)

    def _do_pass(self, stmt: ast.stmt) -> None:
        pass

    def _do_expr(self, stmt: ast.Expr) -> None:
        if isinstance(stmt.value, ast.Constant):
            return
        self.expr(stmt.value)

    def _do_assign(self, stmt: ast.Assign) -> None:
        value, _ = self.expr(stmt.value)
        for target in stmt.targets:
            self.assign(target, value)

    def _do_annassign(self, stmt: ast.AnnAssign) -> None:
        if stmt.value is not None:
            self.assign(stmt.target, self.expr(stmt.value)[0])

    def _do_augassign(self, stmt: ast.AugAssign) -> None:
        now = ast.parse(ast.unparse(stmt.target), mode="eval").body
        self.assign(stmt.target, self.expr(ast.BinOp(now, stmt.op, stmt.value))[0])

    def _do_return(self, stmt: ast.Return) -> None:
        value, variable = (Source(), None) if stmt.value is None else self.expr(stmt.value)
        self.link(value, (self.f, f"{self.f}Output", True, None, None), None)
        self.exits = []

    def _do_if(self, stmt: ast.If) -> None:
        test = self.expr(stmt.test)
        self.call("if", "if", [test])
        branch = self.exits[0][0]
        ends, before = [], dict(self.names)
        merged: dict[str, Source] = {}
        for kind, body in (("true", stmt.body), ("false", stmt.orelse)):
            self.exits, self.names = [(branch, kind)], dict(before)
            self.block(body)
            ends += self.exits
            for k, v in self.names.items():
                if before.get(k) != v:
                    first = merged.get(k)
                    merged[k] = v if first is None else replace(first, others=(*first.others, replace(v, others=()), *v.others))
        self.exits, self.names = ends, before | merged

    def _do_for(self, stmt: ast.For) -> None:
        over = self.expr(stmt.iter)
        items = self.call("iter", "iter", [over])
        element = self.call("next", "next", [(items, None)])
        head = element.call
        before = dict(self.names)
        self.loops.append(set())
        first_use = len(self.uses)
        self.assign(stmt.target, element, loop=True)
        self.exits = [(head, "iterate")]
        self.block(stmt.body)
        for a, kind in self.exits:
            self.all.out.control.append((a, kind, head))
        changed = self.loops.pop()
        for variable, target, _ in self.uses[first_use:]:
            if variable in changed and variable in before and self.names[variable] != before[variable] and self.names[variable].call:
                self.flow.append((self.names[variable], target, self.names[variable].call))
        self.exits = [(head, "next")]

    def assign(self, target: ast.expr, value: Source, loop: bool = False) -> None:
        if isinstance(target, ast.Name):
            self.names[target.id] = value
            if not loop:
                for changed in self.loops:
                    changed.add(target.id)
        elif isinstance(target, (ast.Tuple, ast.List)):
            for n, part in enumerate(target.elts):
                self.assign(part, Source(call=value.call, terminal=value.terminal, output=value.output, item=n), loop)
        elif isinstance(target, ast.Subscript):
            box = self.expr(target.value)
            out = self.call("op_setitem", "setitem", [box, self.expr(target.slice), (value, None)])
            if isinstance(target.value, ast.Name):
                self.assign(target.value, out)
        elif isinstance(target, ast.Attribute):
            self.call("setattr", "setattr", [self.expr(target.value), (Source(literal=target.attr), None), (value, None)])
        else:
            raise NotImplementedError(ast.unparse(target))

    # expressions: (source, variable read)

    def expr(self, e: ast.expr) -> tuple[Source, str | None]:
        kind = type(e).__name__
        if kind == "Constant":
            return Source(literal=e.value), None
        if kind == "Name":
            if e.id in self.names:
                return self.names[e.id], e.id
            return Source(literal=e.id), None
        return self.compound(e, kind), None

    def compound(self, e: ast.expr, kind: str) -> Source:
        if kind in ("BinOp", "UnaryOp"):
            f = OPERATORS[type(e.op).__name__]
            return self.call(f, f[3:], [self.expr(e.left), self.expr(e.right)] if kind == "BinOp" else [self.expr(e.operand)])
        if kind == "BoolOp":
            f = OPERATORS[type(e.op).__name__]
            left = self.expr(e.values[0])
            rest = e.values[1] if len(e.values) == 2 else ast.BoolOp(e.op, e.values[1:])
            return self.call(f, f[3:], [left, self.expr(rest)])
        if kind == "Compare":
            return self.compare(e)
        if kind == "IfExp":
            return self.call("ifexpr", "ifexpr", [self.expr(e.test), self.expr(e.body), self.expr(e.orelse)])
        if kind in ("List", "Tuple"):
            return self.call(kind.lower(), kind.lower(), [self.expr(x) for x in e.elts], strategy="toList")
        if kind == "Dict":
            pairs = [(self.call("tuple", "tuple", [self.expr(k), self.expr(v)], strategy="toList"), None) for k, v in zip(e.keys, e.values, strict=True)]
            return self.call("dict", "dict", pairs, strategy="toList")
        if kind == "Subscript":
            return self.call("op_getitem", "getitem", [self.expr(e.value), self.expr(e.slice)])
        if kind == "Slice":
            return self.call("slice", "slice", [(Source(), None) if x is None else self.expr(x) for x in (e.lower, e.upper, e.step)])
        if kind == "Attribute":
            return self.call("getattr", "getattr", [self.expr(e.value), (Source(literal=e.attr), None)])
        if kind == "JoinedStr":
            return self.call("joinstr", "joinstr", [self.expr(v) for v in e.values], strategy="toList")
        if kind == "FormattedValue":
            spec = [self.expr(e.format_spec)] if e.format_spec else []
            return self.call("format", "format", [self.expr(e.value), *spec])
        if kind in ("ListComp", "GeneratorExp", "SetComp", "DictComp"):
            return self.comprehend(e, kind)
        if kind == "Call":
            return self.invoke(e)
        raise NotImplementedError(f"{kind} at line {e.lineno}")

    def compare(self, e: ast.Compare) -> Source:
        out, left = None, self.expr(e.left)
        for op, right in zip(e.ops, e.comparators, strict=True):
            right, name = self.expr(right), type(op).__name__
            f = name if name in ("Is", "IsNot") else OPERATORS[name]
            args = [right, left] if name in ("In", "NotIn") else [left, right]
            one = self.call(f, f.removeprefix("op_"), args)
            if name == "NotIn":
                one = self.call("op_not", "not", [(one, None)])
            out = one if out is None else self.call("op_and", "and", [(out, None), (one, None)])
            left = right
        return out

    def comprehend(self, e: ast.expr, kind: str) -> Source:
        """As the loop it stands for: an empty list, and an append for each element that passes."""
        name = f"_{kind.lower()}{self.all.number('_')[2:]}"
        kept = self.call("dict" if kind == "DictComp" else "list", "dict" if kind == "DictComp" else "list", [], strategy="toList")
        self.names[name] = kept
        element = ast.unparse(e.key if kind == "DictComp" else e.elt)
        text = f"{name}[{element}] = {ast.unparse(e.value)}" if kind == "DictComp" else f"{name}.append({element})"
        for g in reversed(e.generators):
            for test in reversed(g.ifs):
                text = f"if {ast.unparse(test)}:\n" + textwrap.indent(text, " ")
            text = f"for {ast.unparse(g.target)} in {ast.unparse(g.iter)}:\n" + textwrap.indent(text, " ")
        inner = dict(self.names)
        self.block(ast.parse(text).body)
        out = self.names[name]
        self.names = inner
        return out

    def invoke(self, e: ast.Call) -> Source:
        args = [self.expr(a.value if isinstance(a, ast.Starred) else a) for a in e.args]
        named = [(k.arg, self.expr(k.value)) for k in e.keywords]
        if isinstance(e.func, ast.Attribute):
            box = self.expr(e.func.value)
            name = e.func.attr
            out = self.call(name, name, [box, *args, *(v for _, v in named)], {"kind": "PythonMethod"}, has_self=True)
            if isinstance(e.func.value, ast.Name) and e.func.value.id in self.names:
                self.assign(e.func.value, Source(call=out.call, terminal=f"{name}SelfOutput"))
            return out
        name = ast.unparse(e.func)
        if name in self.all.nodes:
            self.all.describe(name, self.depth - 1)
            order = [a.arg for a in self.all.nodes[name].args.args]
            args += [v for k, v in sorted(named, key=lambda x: order.index(x[0]) if x[0] in order else len(order))]
            return self.call(name, name, args)
        return self.call(name.replace(".", "_"), name.rpartition(".")[2], [*args, *(v for _, v in named)])


class _Program:
    def __init__(self, nodes: dict[str, ast.FunctionDef], module: str | None, file: str | None) -> None:
        self.nodes, self.module, self.file = nodes, module, file
        self.out, self.counts, self.done = Described(), Counter(), set()

    def number(self, f: str) -> str:
        self.counts[f] += 1
        return f"{f}_{self.counts[f]}"

    def function(self, f: str, label: str, arity: int, imp: dict | None, has_self: bool) -> None:
        """A function that is called but not described here: its arity tells its parameters."""
        if f in self.nodes:
            return
        known = self.out.functions.get(f)
        if known and len(known[1]) >= arity:
            return
        params = [(f"{f}Parameter{n}", "self" if has_self and n == 0 else f"p{n}", None) for n in range(arity)]
        outs = [(f"{f}Output", f"{f}Result", None)] + ([(f"{f}SelfOutput", "self_output", None)] if has_self else [])
        self.out.functions[f] = (label, params, outs)
        module = "_operator" if f.startswith("op_") else "builtins"
        uri = mint(f, module)
        self.out.implementations[uri] = {"kind": "PythonFunction", "name": f, "module": module} | (imp or {})
        self.out.mappings[f"{f}Mapping"] = {"f": f, "imp": uri, "name": label, "outputs": [o[0] for o in outs], "parameters": [("Position", p[0], n) for n, p in enumerate(params)]}

    def describe(self, name: str, depth: int) -> None:
        if name in self.done:
            return
        self.done.add(name)
        fn = self.nodes[name]
        spec = fn.args
        given = [*spec.posonlyargs, *spec.args]
        every = [*given, *([spec.vararg] if spec.vararg else []), *spec.kwonlyargs, *([spec.kwarg] if spec.kwarg else [])]
        hints = {a.arg: a.annotation.id for a in every if isinstance(a.annotation, ast.Name)}
        params = [(f"{name}Parameter{n}", a.arg, hints.get(a.arg)) for n, a in enumerate(every)]
        self.out.functions[name] = (name, params, [(f"{name}Output", f"{name}Result", None)])
        package = self.module.rpartition(".")[0] if self.module else None
        uri = mint(name, self.module, package, self.file)
        self.out.implementations[uri] = {"kind": "PythonFunction", "name": name, "module": self.module, "package": package, "file": self.file, "doc": ast.get_docstring(fn)}
        rows = [(kind, params[n][0], value) for n, a in enumerate(given) for kind, value in (("Position", n), ("Property", a.arg))]
        term = {a.arg: p[0] for a, p in zip(every, params, strict=True)}
        rows += [("Property", term[a.arg], a.arg) for a in spec.kwonlyargs]
        rows += [("VarPositional", term[spec.vararg.arg], None)] if spec.vararg else []
        rows += [("VarProperty", term[spec.kwarg.arg], None)] if spec.kwarg else []
        defaults = [*zip(given[::-1], spec.defaults[::-1], strict=False), *((a, d) for a, d in zip(spec.kwonlyargs, spec.kw_defaults, strict=True) if d is not None)]
        rows += [("Default", term[a.arg], ast.literal_eval(d) if isinstance(d, (ast.Constant, ast.UnaryOp)) else ast.unparse(d)) for a, d in defaults]
        optional = {term[a.arg] for a, _ in defaults}
        required = {term[a.arg]: term[a.arg] not in optional for a in (*given, *spec.kwonlyargs)}
        mapping = {"f": name, "imp": uri, "name": name, "outputs": [f"{name}Output"], "parameters": rows, "required": required}
        if arguments := getattr(fn, "arguments", None):
            # parameters that come from the command line, by flag or place
            mapping |= {"method": "argparse", "command": "python", "required": {}, "parameters": []}
            for n, (flag, a) in enumerate(arguments):
                own = term[flag.lstrip("-").replace("-", "_")]
                mapping["parameters"].append(("Argument", own, (flag if flag.startswith("-") else n, a.get("nargs"))))
                mapping["required"][own] = "default" not in a
                if "default" in a:
                    mapping["parameters"].append(("Default", own, a["default"]))
        self.out.mappings[f"{name}Mapping"] = mapping
        if depth <= 0:
            return
        body = _Body(self, name, depth)
        body.names = {a.arg: Source(call=name, terminal=p[0], output=False) for a, p in zip(every, params, strict=True)}
        body.block(fn.body)
        self.out.compositions[f"{name}Composition"] = {"f": name, "start": body.start, "flow": list(dict.fromkeys(body.flow))}


def _main(tree: ast.Module) -> ast.FunctionDef | None:
    """The body of the main guard as a function, its argparse arguments as parameters."""
    for stmt in tree.body:
        if isinstance(stmt, ast.If) and ast.unparse(stmt.test) in ("__name__ == '__main__'", "'__main__' == __name__"):
            body, args, given, parsers = [], [], [], set()
            for s in stmt.body:
                text = ast.unparse(s)
                if isinstance(s, ast.Assign) and "ArgumentParser(" in text:
                    parsers.add(s.targets[0].id)
                elif isinstance(s, ast.Expr) and isinstance(s.value, ast.Call) and text.partition(".add_argument")[0] in parsers:
                    flag = ast.literal_eval(s.value.args[-1])
                    known = {k.arg: ast.literal_eval(k.value) for k in s.value.keywords if isinstance(k.value, ast.Constant)}
                    args.append(flag.lstrip("-").replace("-", "_"))
                    given.append((flag, known))
                elif isinstance(s, ast.Assign) and text.endswith(".parse_args()"):
                    space = s.targets[0].id
                else:
                    body.append(s)

            class Direct(ast.NodeTransformer):
                def visit_Attribute(self, node: ast.Attribute) -> ast.expr:  # noqa: N802
                    self.generic_visit(node)
                    return ast.Name(node.attr, ast.Load()) if args and isinstance(node.value, ast.Name) and node.value.id == space else node

            made = ast.parse(f"def _({', '.join(args)}):\n pass").body[0]
            made.body = [Direct().visit(s) for s in body] or made.body
            made.arguments = given
            return ast.fix_missing_locations(made)
    return None


def describe(source: str, module: str | None = None, file: str | None = None, names: list[str] | None = None, max_depth: int = MAX_DEPTH) -> Described:
    """A source text's functions, or the named ones with what they call; with file, its main body as the function ``_``."""
    tree = ast.parse(source)
    nodes = {n.name: n for n in tree.body if isinstance(n, ast.FunctionDef)}
    if main := _main(tree):
        nodes["_"] = main
    program = _Program(nodes, module, file)
    for name in names or nodes:
        program.describe(name, max_depth)
    if file and not names:
        uri = mint(file.rpartition("/")[2], file)
        program.out.implementations[uri] = {"kind": "PythonFile", "name": file.rpartition("/")[2], "file": file}
    return program.out


def describe_function(f: Callable) -> Described:
    """A live function, from its source text."""
    return describe(textwrap.dedent(inspect.getsource(f)), f.__module__, inspect.getsourcefile(f), [f.__name__])


def implementation_of(obj: object) -> tuple[str, dict]:
    """(uri, row) of a live object: its kind, name, module and, of a method, the class that has it."""
    owner = getattr(obj, "__objclass__", None) or getattr(obj, "__self__", None)
    owner = owner if owner is None or isinstance(owner, type) else None if inspect.ismodule(owner) else type(owner)
    if inspect.ismodule(obj):
        kind, name, module = "PythonFile", obj.__name__, obj.__name__
    else:
        name, module = getattr(obj, "__name__", type(obj).__name__), getattr(obj, "__module__", None) or getattr(owner, "__module__", None) or "builtins"
        kind = "PythonClass" if isinstance(obj, type) else "PythonMethod" if owner else "PythonFunction"
    row = {"kind": kind, "name": name, "module": module, "package": module.partition(".")[0], "doc": inspect.getdoc(obj)}
    try:
        row["file"] = inspect.getsourcefile(obj)
    except TypeError:  # of builtins and compiled modules
        pass
    if kind == "PythonMethod":
        row["method_of"] = mint(owner.__name__, owner.__module__)
    return mint(f"{owner.__name__}.{name}" if kind == "PythonMethod" else name, module), row


def describe_callable(f: Callable, count: int | None = None) -> Described:
    """A callable that has no source text, such as a builtin: parameters by position, as many as its signature has or, where it has none, as told."""
    if count is None:
        try:
            kinds = [p.kind for p in inspect.signature(f).parameters.values()]
        except ValueError:
            raise ValueError(f"{f!r} has no signature: tell the number of parameters") from None
        count = sum(k in (inspect.Parameter.POSITIONAL_ONLY, inspect.Parameter.POSITIONAL_OR_KEYWORD) for k in kinds)
    imp, row = implementation_of(f)
    name, out = row["name"], Described()
    params = [(f"{name}Parameter{k}", f"p{k}", None) for k in range(count)]
    out.functions[name] = (name, params, [(f"{name}Output", "result", None)])
    out.implementations[imp] = row
    mapped = [("Position", term, k) for k, (term, *_) in enumerate(params)]
    out.mappings[f"{name}Mapping"] = {"f": name, "imp": imp, "name": name, "outputs": [f"{name}Output"], "parameters": mapped, "required": {term: True for term, *_ in params}}
    return out


def describe_tree(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(file, s, p, o, o_kind, o_dt) of all Python files and container build files below a folder, described in parallel.

    A file that cannot be described has one row whose o is the error.
    """
    import pandas as pd

    from loomflow.sources.containers import describe_dockerfile

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                path = path.removeprefix("file:")
                name = path.rpartition("/")[2]
                try:
                    text = content.decode()
                    if name.endswith(".py"):
                        rows = describe(text, name[:-3], path).rows()
                    elif name.startswith("Dockerfile"):
                        rows = describe_dockerfile(text, path).rows()
                    else:
                        continue
                except (SyntaxError, NotImplementedError, UnicodeDecodeError) as e:
                    rows = [(path, "error", str(e), "literal", None)]
                out += [(path, *r) for r in rows]
            yield pd.DataFrame(out, columns=["file", "s", "p", "o", "o_kind", "o_dt"])

    return files.select("path", "content").mapInPandas(each, "file string, s string, p string, o string, o_kind string, o_dt string")


def graph_of(rows: DataFrame) -> Graph:
    """The union of the described files."""
    return Graph(rows.where(F.col("p") != "error").select("s", "p", "o", "o_kind", "o_dt").dropDuplicates())
