"""Functions compiled to columns, so that one described function runs over a whole table.

Statements run in order on an environment of values. A branch runs both ways
and merges what differs under its condition; returns are kept with the
condition under which they are reached, and the first that holds is the value.
A loop is an aggregate over what it goes through, whose state is the variables
that the body changes. Calls of other functions in the same source are inlined
to a bounded depth. What no column can say raises Unsupported; run() then sends
the function to Python over Arrow batches, or first, if asked to, makes a table of
states of it.
"""

from __future__ import annotations

import ast
import inspect
import textwrap
from collections.abc import Callable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomflow.functions import pysem
from loomflow.functions.pysem import NONE, Unsupported, Value

#: Calls of described functions are inlined this deep.
MAX_DEPTH = 3


def parse(source: str | Callable) -> dict[str, ast.FunctionDef]:
    """The functions of a source text, or of a live function's module text around it."""
    text = source if isinstance(source, str) else textwrap.dedent(inspect.getsource(source))
    return {n.name: n for n in ast.parse(text).body if isinstance(n, ast.FunctionDef)}


class _Run:
    """One function body: variables, and returns with their conditions."""

    def __init__(self, functions: dict[str, ast.FunctionDef], names: dict[str, Value], depth: int) -> None:
        self.functions, self.names, self.depth = functions, dict(names), depth
        self.returns: list[tuple[Column, Value]] = []

    # statements

    def block(self, body: list[ast.stmt], path: Column | None) -> Column | None:
        """Run statements under a path condition; the condition under which what follows is reached, None where nothing does."""
        for n, stmt in enumerate(body):
            if isinstance(stmt, ast.Return):
                value = pysem.constant(None) if stmt.value is None else self.expr(stmt.value)
                self.returns.append((F.lit(True) if path is None else path, value))
                return F.lit(False)
            if isinstance(stmt, ast.If):
                if self._returns(stmt):
                    return self._branch_out(stmt, body[n + 1 :], path)
                self._branch(stmt)
            elif isinstance(stmt, ast.For):
                self._loop(stmt)
            elif isinstance(stmt, ast.Assign):
                value = self.expr(stmt.value)
                for target in stmt.targets:
                    self._assign(target, value)
            elif isinstance(stmt, ast.AnnAssign) and stmt.value is not None:
                self._assign(stmt.target, self.expr(stmt.value))
            elif isinstance(stmt, ast.AugAssign):
                now = self.expr(ast.copy_location(_loaded(stmt.target), stmt))
                self._assign(stmt.target, pysem.binary(type(stmt.op).__name__, now, self.expr(stmt.value)))
            elif isinstance(stmt, ast.Expr):
                self._effect(stmt.value)
            elif not isinstance(stmt, ast.Pass):
                raise Unsupported(type(stmt).__name__)
        return path

    @staticmethod
    def _returns(stmt: ast.stmt) -> bool:
        return any(isinstance(x, ast.Return) for x in ast.walk(stmt))

    def _branch(self, stmt: ast.If) -> None:
        test = pysem.truthy(self.expr(stmt.test))
        before = self.names
        sides = []
        for body in (stmt.body, stmt.orelse):
            self.names = dict(before)
            self.block(body, None)
            sides.append(self.names)
        self.names = dict(before)
        for name in sides[0].keys() | sides[1].keys():
            a, b = sides[0].get(name), sides[1].get(name)
            if a is b:
                self.names[name] = a
            else:
                none = pysem.constant(None)
                self.names[name] = pysem.choose(test, a or none, b or none)

    def _branch_out(self, stmt: ast.If, rest: list[ast.stmt], path: Column | None) -> Column:
        """A branch that may return: each side goes on with the statements that follow."""
        test = pysem.truthy(self.expr(stmt.test))
        before = self.names
        for body, holds in ((stmt.body, test), (stmt.orelse, ~test)):
            self.names = dict(before)
            here = holds if path is None else path & holds
            left = self.block([*body, *rest], here)
            if not body or not self._ends(body + rest):
                self.returns.append((here if left is None else left, pysem.constant(None)))
        return F.lit(False)

    def _ends(self, body: list[ast.stmt]) -> bool:
        return any(isinstance(s, ast.Return) or (isinstance(s, ast.If) and self._returns(s)) for s in body)

    def _loop(self, stmt: ast.For) -> None:
        if self._returns(stmt) or any(isinstance(x, (ast.Break, ast.Continue)) for x in ast.walk(stmt)) or stmt.orelse:
            raise Unsupported("leaving a loop early")
        over = pysem.items_of(self.expr(stmt.iter))
        changed = sorted({n for s in stmt.body for n in _changed(s)} & self.names.keys())
        kinds = {n: self.names[n].kind for n in changed}
        outer = self.names

        def body(state: Callable[[str], Column], x: Column) -> dict[str, Value]:
            run = _Run(self.functions, outer | {n: Value(state(n), kinds[n]) for n in changed}, self.depth)
            run._assign(stmt.target, Value(x, over.kind[1]))
            run.block(stmt.body, None)
            return {n: run.names[n] for n in changed}

        for _ in range(4):  # kinds widen, as from int to float, until they stay
            found = {}

            def probe(x: Column) -> Column:
                found.update(body(lambda n: F.lit(None).cast(pysem.ddl(kinds[n])), x))
                return F.lit(0)

            F.transform(over.col, probe)
            wider = {n: pysem.widest(kinds[n], found[n].kind) for n in changed}
            if wider == kinds:
                break
            kinds = wider
        if not changed:
            return
        shape = "struct<" + ",".join(f"`{n}`:{pysem.ddl(kinds[n])}" for n in changed) + ">"

        def pack(values: Mapping[str, Value]) -> Column:
            return F.struct(*[pysem.to_kind(values[n], kinds[n]).col.alias(n) for n in changed]).cast(shape)

        end = F.aggregate(over.col, pack(self.names), lambda s, x: pack(body(lambda n: s.getField(n), x)))
        for n in changed:
            self.names[n] = Value(end.getField(n), kinds[n])

    def _assign(self, target: ast.expr, value: Value) -> None:
        if isinstance(target, ast.Name):
            self.names[target.id] = value
        elif isinstance(target, (ast.Tuple, ast.List)):
            for n, part in enumerate(target.elts):
                self._assign(part, pysem.field(value, n))
        elif isinstance(target, ast.Subscript) and isinstance(target.value, ast.Name):
            self.names[target.value.id] = pysem.put(self.expr(target.value), self.expr(target.slice), value)
        else:
            raise Unsupported("assignment to " + type(target).__name__)

    def _effect(self, call: ast.expr) -> None:
        if isinstance(call, ast.Constant):
            return
        if isinstance(call, ast.Call) and isinstance(call.func, ast.Attribute) and isinstance(call.func.value, ast.Name):
            value = self.expr(call.func.value)
            change = pysem.MUTATIONS.get((value.kind[0] if isinstance(value.kind, tuple) else value.kind, call.func.attr))
            if change and not call.keywords:
                self.names[call.func.value.id] = change(value, *map(self.expr, call.args))
                return
        if isinstance(call, ast.Call) and isinstance(call.func, ast.Name) and call.func.id == "print":
            return
        raise Unsupported(ast.unparse(call))

    # expressions

    def expr(self, e: ast.expr) -> Value:
        kind = type(e).__name__
        make = getattr(self, f"_{kind.lower()}", None)
        if make is None:
            raise Unsupported(kind)
        return make(e)

    def _constant(self, e: ast.Constant) -> Value:
        return pysem.constant(e.value)

    def _name(self, e: ast.Name) -> Value:
        if e.id not in self.names:
            raise Unsupported(f"name {e.id}")
        return self.names[e.id]

    def _binop(self, e: ast.BinOp) -> Value:
        return pysem.binary(type(e.op).__name__, self.expr(e.left), self.expr(e.right))

    def _unaryop(self, e: ast.UnaryOp) -> Value:
        return pysem.unary(type(e.op).__name__, self.expr(e.operand))

    def _boolop(self, e: ast.BoolOp) -> Value:
        out = self.expr(e.values[-1])
        for v in reversed(e.values[:-1]):
            left = self.expr(v)
            test = pysem.truthy(left)
            out = pysem.choose(test, out, left) if isinstance(e.op, ast.And) else pysem.choose(test, left, out)
        return out

    def _compare(self, e: ast.Compare) -> Value:
        out, left = None, self.expr(e.left)
        for op, right in zip(e.ops, e.comparators, strict=True):
            right = self.expr(right)
            one = pysem.compare(type(op).__name__, left, right)
            out, left = one if out is None else Value(out.col & one.col, "bool"), right
        return out

    def _ifexp(self, e: ast.IfExp) -> Value:
        return pysem.choose(pysem.truthy(self.expr(e.test)), self.expr(e.body), self.expr(e.orelse))

    def _list(self, e: ast.List) -> Value:
        return pysem.list_of([self.expr(x) for x in e.elts])

    def _tuple(self, e: ast.Tuple) -> Value:
        return pysem.tuple_of([self.expr(x) for x in e.elts])

    def _dict(self, e: ast.Dict) -> Value:
        return pysem.dict_of([(self.expr(k), self.expr(v)) for k, v in zip(e.keys, e.values, strict=True)])

    def _subscript(self, e: ast.Subscript) -> Value:
        box = self.expr(e.value)
        if isinstance(e.slice, ast.Slice):
            low, high = (None if x is None else self.expr(x) for x in (e.slice.lower, e.slice.upper))
            step = None if e.slice.step is None else ast.literal_eval(e.slice.step)
            return pysem.cut(box, low, high, step)
        if isinstance(box.kind, tuple) and box.kind[0] == "tuple":
            return pysem.field(box, range(len(box.kind[1]))[ast.literal_eval(e.slice)])
        return pysem.item(box, self.expr(e.slice))

    def _joinedstr(self, e: ast.JoinedStr) -> Value:
        return pysem.joined([self.expr(v) for v in e.values])

    def _formattedvalue(self, e: ast.FormattedValue) -> Value:
        spec = "".join(ast.literal_eval(v) for v in e.format_spec.values) if e.format_spec else ""
        return pysem.formatted(self.expr(e.value), spec)

    def _listcomp(self, e: ast.ListComp) -> Value:
        return self._comprehend(e.generators, lambda run: run.expr(e.elt))

    _generatorexp = _listcomp

    def _dictcomp(self, e: ast.DictComp) -> Value:
        pairs = self._comprehend(e.generators, lambda run: pysem.tuple_of([run.expr(e.key), run.expr(e.value)]))
        key, value = pairs.kind[1][1]
        # the last of equal keys wins, at the place of the first
        last = F.aggregate(pairs.col, F.create_map().cast(pysem.ddl(("dict", key, value))), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["_0"]), F.create_map(p["_0"], p["_1"])))
        return Value(last, ("dict", key, value))

    def _comprehend(self, generators: list[ast.comprehension], result: Callable[["_Run"], Value]) -> Value:
        first, *rest = generators
        over = pysem.items_of(self.expr(first.iter))
        kinds = []

        def inner(x: Column) -> "_Run":
            run = _Run(self.functions, self.names, self.depth)
            run._assign(first.target, Value(x, over.kind[1]))
            return run

        def keep(x: Column) -> Column:
            out = F.lit(True)
            for test in first.ifs:
                out = out & pysem.truthy(inner(x).expr(test))
            return out

        def one(x: Column) -> Column:
            v = inner(x)._comprehend(rest, result) if rest else result(inner(x))
            kinds.append(v.kind)
            return v.col

        col = F.transform(F.filter(over.col, keep) if first.ifs else over.col, one)
        return Value(F.flatten(col), kinds[-1]) if rest else Value(col, ("list", kinds[-1]))

    def _attribute(self, e: ast.Attribute) -> Value:
        return pysem.attribute(self.expr(e.value), e.attr)

    def _call(self, e: ast.Call) -> Value:
        if isinstance(e.func, ast.Attribute):
            value = self.expr(e.func.value)
            method = pysem.METHODS.get((value.kind[0] if isinstance(value.kind, tuple) else value.kind, e.func.attr))
            if method is None or e.keywords:
                raise Unsupported(ast.unparse(e.func))
            return method(value, *map(self.expr, e.args))
        name = e.func.id if isinstance(e.func, ast.Name) else None
        args = []
        for a in e.args:
            if isinstance(a, ast.Starred):
                raise Unsupported("starred argument")
            args.append(self.expr(a))
        keywords = {k.arg: self.expr(k.value) for k in e.keywords}
        if name in self.functions:
            if self.depth <= 0:
                raise Unsupported(f"{name} is inlined too deep")
            return call(self.functions, name, args, keywords, self.depth - 1)
        if name in pysem.BUILTINS and not keywords:
            return pysem.BUILTINS[name](*args)
        raise Unsupported(f"call of {name}")


def _loaded(target: ast.expr) -> ast.expr:
    return ast.parse(ast.unparse(target), mode="eval").body


def _changed(stmt: ast.stmt) -> set[str]:
    """Names that a statement may give a new value."""
    out = set()
    for x in ast.walk(stmt):
        if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store):
            out.add(x.id)
        elif isinstance(x, ast.Subscript) and isinstance(x.ctx, ast.Store) and isinstance(x.value, ast.Name):
            out.add(x.value.id)
        elif isinstance(x, ast.Expr) and isinstance(x.value, ast.Call) and isinstance(x.value.func, ast.Attribute) and isinstance(x.value.func.value, ast.Name):
            out.add(x.value.func.value.id)
    return out


def bind(fn: ast.FunctionDef, args: list, keywords: dict, default: Callable[[ast.expr], object]) -> dict[str, object]:
    """Arguments by parameter name: positional, by keyword, *args, **kwargs and defaults."""
    spec = fn.args
    names = [a.arg for a in (*spec.posonlyargs, *spec.args)]
    out = dict(zip(names, args, strict=False))
    if len(args) > len(names):
        if not spec.vararg:
            raise TypeError(f"{fn.name} takes {len(names)} arguments")
    if spec.vararg:
        out[spec.vararg.arg] = args[len(names) :]
    known = {*names[len(spec.posonlyargs) :], *(a.arg for a in spec.kwonlyargs)}
    extra = {}
    for k, v in keywords.items():
        if k in out and k in known:
            raise TypeError(f"{fn.name} got {k} twice")
        (out if k in known else extra)[k] = v
    if extra and not spec.kwarg:
        raise TypeError(f"{fn.name} has no {', '.join(extra)}")
    if spec.kwarg:
        out[spec.kwarg.arg] = extra
    for a, d in [*zip(names[::-1], spec.defaults[::-1], strict=False), *((a.arg, d) for a, d in zip(spec.kwonlyargs, spec.kw_defaults, strict=True) if d is not None)]:
        if a not in out:
            out[a] = default(d)
    missing = [n for n in (*names, *(a.arg for a in spec.kwonlyargs)) if n not in out]
    if missing:
        raise TypeError(f"{fn.name} needs {', '.join(missing)}")
    return out


def call(functions: dict[str, ast.FunctionDef], name: str, args: list[Value], keywords: dict[str, Value], depth: int = MAX_DEPTH) -> Value:
    """The value of a function for arguments."""
    fn = functions[name]
    names = bind(fn, args, keywords, lambda d: _Run(functions, {}, depth).expr(d))
    for k, v in names.items():
        if isinstance(v, list):
            names[k] = pysem.list_of(v)
        elif isinstance(v, dict):
            names[k] = pysem.dict_of([(pysem.constant(n), x) for n, x in v.items()])
    run = _Run(functions, names, depth)
    run.block(fn.body, None)
    if not run.returns:
        return pysem.constant(None)
    kind = NONE
    for _, v in run.returns:
        kind = pysem.widest(kind, v.kind) if kind != NONE else v.kind
    out = None
    for path, v in run.returns:
        col = pysem.to_kind(v, kind).col
        out = F.when(path, col) if out is None else out.when(path, col)
    return Value(run.returns[0][1].col if len(run.returns) == 1 and kind == run.returns[0][1].kind and not isinstance(fn.body[-1], ast.If) else out, kind)


def column(df: DataFrame, source: str | Callable, *args: str | Column, name: str | None = None, **keywords: str | Column) -> Column:
    """A function's value for the columns of df. Raises Unsupported where no column has its meaning."""
    functions = parse(source)
    name = name or next(reversed(functions))

    def value(x: str | Column) -> Value:
        col = df[x] if isinstance(x, str) else x
        return pysem.of_column(col, df.select(col).schema[0].dataType)

    return call(functions, name, [value(a) for a in args], {k: value(v) for k, v in keywords.items()}).col


def run(df: DataFrame, source: str | Callable, *args: str, into: str, name: str | None = None, returns: str = "string", states: bool = False) -> DataFrame:
    """df with a function's value in the column into: as a column where possible, else by Python on Arrow batches.

    With states, what no column can say first becomes a table of states, which
    gives the rows back in any order.
    """
    try:
        return df.withColumn(into, column(df, source, *args, name=name))
    except Unsupported:
        pass
    if states:
        from loomflow.plans import machine

        try:
            return machine.run(df, source, *args, into=into, name=name, returns=returns)
        except Unsupported:
            pass
    return df.withColumn(into, python_udf(source, name, returns)(*args))


def python_udf(source: str | Callable, name: str | None = None, returns: str = "string"):
    """The function as an Arrow-batched UDF. Runs its source on the executors: for trusted code only."""
    text = source if isinstance(source, str) else textwrap.dedent(inspect.getsource(source))
    name = name or next(reversed(parse(text)))

    @F.arrow_udf(returns)
    def each(rows: pa.Array) -> pa.Array:
        space: dict = {}
        exec(compile(text, name, "exec"), space)  # noqa: S102
        return pa.array([space[name](*row) for row in zip(*(c.to_pylist() for c in rows.flatten()), strict=True)])

    return lambda *columns: each(F.struct(*columns))
