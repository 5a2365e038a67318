"""Functions that no single column can say, run as tables of states.

While loops, loops that are left early and recursion become blocks: straight
statements that end in a jump, a choice, a call or a return. Each row has a stack
of frames, a frame being the next block and the variables; a step is a column that
runs the block on top and those after it, up to where a loop begins anew, a call or
a return. Steps are taken many at a time; then the rows that have
returned leave the table, and those still at work go on, until there are none.
Everything is columns: no row goes to Python. A value depends on nothing but the
arguments, so rows with equal ones share one state.

A loop over numbers that does nothing until a test of its number holds, and whose
test goes on to hold once it does (i * i >= p), begins at the number where it first
holds, which is found by halving; other loops are stepped number by number.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomflow.functions import pysem
from loomflow.functions.pysem import NONE, Unsupported, Value
from loomflow.plans.compile import _Run, bind, parse
from loomflow.stage import Staged

#: Steps before the rows that have returned leave the table: at first, and at most.
FIRST_STEPS, MOST_STEPS = 64, 4096
#: Rounds after which a program counts as endless.
MOST_ROUNDS = 10_000
#: Results of different arguments up to which Spark chooses how rows meet them; of more it would go by the size of their files and broadcast them.
MOST_TOLD = 1 << 17
#: Blocks that a step runs one after another at most.
MOST_BLOCKS = 6


@dataclass
class _Block:
    function: str
    #: The variable that takes the value of the call before.
    takes: str | None = None
    body: list[ast.stmt] = field(default_factory=list)
    end: tuple = ()


class _Flat:
    """The blocks of functions; the first blocks of each are in `entry`."""

    def __init__(self, functions: dict[str, ast.FunctionDef], name: str) -> None:
        self.functions, self.blocks, self.entry, self.names = functions, [], {}, 0
        todo = [name]
        while todo:
            f = todo.pop()
            if f not in self.entry:
                self.f = f
                self.entry[f] = self._new()
                last = self._run(functions[f].body, self.entry[f], None)
                if last is not None:
                    self.blocks[last].end = ("return", None)
                todo += [b.end[1] for b in self.blocks if b.end and b.end[0] == "call"]

    def _new(self, takes: str | None = None) -> int:
        self.blocks.append(_Block(self.f, takes))
        return len(self.blocks) - 1

    def _name(self) -> str:
        self.names += 1
        return f"_{self.names}"

    def _calls(self, e: ast.AST) -> bool:
        return any(isinstance(x, ast.Call) and isinstance(x.func, ast.Name) and x.func.id in self.functions for x in ast.walk(e))

    def _plain(self, s: ast.stmt) -> bool:
        """Whether a column can say it as it stands."""
        return not self._calls(s) and not any(isinstance(x, (ast.While, ast.Break, ast.Continue, ast.Return)) or (isinstance(x, ast.For) and x.orelse) for x in ast.walk(s))

    def _lift(self, e: ast.expr, at: int) -> tuple[ast.expr, int]:
        """An expression whose calls of functions have become variables, and the block it is in."""
        if not self._calls(e):
            return e, at
        if isinstance(e, (ast.BoolOp, ast.IfExp, ast.ListComp, ast.DictComp, ast.GeneratorExp, ast.Lambda)):
            raise Unsupported("a call of a function inside " + type(e).__name__)
        if isinstance(e, ast.Call) and isinstance(e.func, ast.Name) and e.func.id in self.functions:
            args, keywords = [], {}
            for a in e.args:
                if isinstance(a, ast.Starred):
                    raise Unsupported("starred argument")
                a, at = self._lift(a, at)
                # what a later argument's call changes, this one has taken before
                name = self._name()
                self.blocks[at].body.append(ast.Assign([ast.Name(name, ast.Store())], a))
                args.append(ast.Name(name, ast.Load()))
            for k in e.keywords:
                keywords[k.arg], at = self._lift(k.value, at)
            name = self._name()
            then = self._new(name)
            self.blocks[at].end = ("call", e.func.id, args, keywords, then)
            return ast.Name(name, ast.Load()), then
        made = type(e)(**{n: getattr(e, n) for n in e._fields})
        for n in e._fields:
            v = getattr(e, n)
            if isinstance(v, ast.expr):
                v, at = self._lift(v, at)
            elif isinstance(v, list) and any(isinstance(x, ast.expr) for x in v):
                out = []
                for x in v:
                    x, at = self._lift(x, at)
                    out.append(x)
                v = out
            setattr(made, n, v)
        return made, at

    def _run(self, body: list[ast.stmt], at: int, loop: tuple[int, int] | None) -> int | None:
        """Put statements into block `at` and those after it; the block where they end, None where nothing goes on."""
        for s in body:
            if self._plain(s):
                self.blocks[at].body.append(s)
            elif isinstance(s, ast.Return):
                if isinstance(s.value, ast.IfExp) and self._calls(s.value):
                    v = s.value
                    return self._run([ast.If(v.test, [ast.Return(v.body)], [ast.Return(v.orelse)])], at, loop)
                value, at = (None, at) if s.value is None else self._lift(s.value, at)
                self.blocks[at].end = ("return", value)
                return None
            elif isinstance(s, (ast.Break, ast.Continue)):
                self.blocks[at].end = ("go", loop[isinstance(s, ast.Continue)])
                return None
            elif isinstance(s, ast.If):
                test, at = self._lift(s.test, at)
                sides = self._new(), self._new()
                self.blocks[at].end = ("if", test, *sides)
                ends = [x for x in (self._run(part, side, loop) for part, side in zip((s.body, s.orelse), sides, strict=True)) if x is not None]
                if not ends:
                    return None
                at = self._new()
                for x in ends:
                    self.blocks[x].end = ("go", at)
            elif isinstance(s, (ast.While, ast.For)):
                at = self._loop(s, at)
            elif isinstance(s, (ast.Assign, ast.AugAssign, ast.AnnAssign, ast.Expr)) and getattr(s, "value", None) is not None:
                value, at = self._lift(s.value, at)
                made = type(s)(**{n: getattr(s, n) for n in s._fields})
                made.value = value
                self.blocks[at].body.append(made)
            else:
                raise Unsupported(type(s).__name__)
        return at

    def _idle(self, s: ast.For) -> ast.expr | None:
        """The test that a loop waits for: of its ifs, where it is made of nothing else."""
        if not isinstance(s.target, ast.Name) or not all(isinstance(x, ast.If) and not x.orelse and not self._calls(x.test) for x in s.body):
            return None
        return s.body[0].test if len(s.body) == 1 else ast.BoolOp(ast.Or(), [x.test for x in s.body])

    def _loop(self, s: ast.While | ast.For, at: int) -> int:
        head, test, first = None, getattr(s, "test", None), []
        if isinstance(s, ast.For):
            call = s.iter
            if isinstance(call, ast.Call) and isinstance(call.func, ast.Name) and call.func.id == "range" and "range" not in self.functions and len(call.args) in (1, 2) and not call.keywords:
                # a count; a list of all numbers would go from step to step
                n, upto = self._name(), self._name()
                for name, bound in ((n, call.args[0] if len(call.args) == 2 else ast.Constant(0)), (upto, call.args[-1])):
                    bound, at = self._lift(bound, at)
                    self.blocks[at].body.append(ast.Assign([ast.Name(name, ast.Store())], bound))
                idle = self._idle(s)
                if idle is not None:
                    skip = ast.parse(f"{n} = __skip__({n}, {upto})\n").body[0]
                    skip.value.args += [ast.Constant(s.target.id), idle]
                    self.blocks[at].body.append(skip)
                test = ast.parse(f"{n} < {upto}", mode="eval").body
                item = ast.Name(n, ast.Load())
            else:
                # through the items by their numbers
                over, at = self._lift(s.iter, at)
                items, n = self._name(), self._name()
                self.blocks[at].body += ast.parse(f"{items} = __items__(0)\n{n} = 0\n").body
                self.blocks[at].body[-2].value.args = [over]
                test = ast.parse(f"{n} < __size__({items})", mode="eval").body
                item = ast.parse(f"__at__({items}, {n})", mode="eval").body
            first = [ast.Assign([s.target], item), *ast.parse(f"{n} = {n} + 1\n").body]
        head = self._new()
        self.blocks[at].end = ("go", head)
        test, last = self._lift(test, head)
        body, otherwise, after = self._new(), self._new(), self._new()
        self.blocks[last].end = ("if", test, body, otherwise)
        end = self._run([*first, *s.body], body, (after, head))
        if end is not None:
            self.blocks[end].end = ("go", head)
        end = self._run(s.orelse, otherwise, None)
        if end is not None:
            self.blocks[end].end = ("go", after)
        return after


class _Step(_Run):
    def _call(self, e: ast.Call) -> Value:
        name = e.func.id if isinstance(e.func, ast.Name) else None
        if name == "__items__":
            return pysem.items_of(self.expr(e.args[0]))
        if name == "__size__":
            return Value(F.size(self.expr(e.args[0]).col).cast("long"), "int")
        if name == "__at__":
            items, n = map(self.expr, e.args)
            return Value(F.get(items.col, n.col.cast("int")), items.kind[1])
        if name == "__skip__":
            return self._skipped(*e.args)
        return super()._call(e)

    def _skipped(self, low: ast.expr, upto: ast.expr, item: ast.Constant, test: ast.expr) -> Value:
        """The number at which a loop's test first holds, or the last one; the first one where the test cannot be told to go on holding."""
        n, end = self.expr(low), self.expr(upto)
        guards: list[Column] = []
        try:
            if (n.kind, end.kind) != ("int", "int"):
                raise Unsupported("numbers that are none")
            holds = self._lasting(test, item.value, n.col, guards)
        except Unsupported:
            return n

        def half(s: Column, _: Column) -> Column:
            lo, hi = s.getField("lo"), s.getField("hi")
            middle = lo + F.shiftright(hi - lo, 1)
            # what does not fit is left to the loop, which fails there
            found = F.coalesce(holds(middle), F.lit(True))
            return F.when(lo >= hi, s).otherwise(F.struct(F.when(found, lo).otherwise(middle + 1).alias("lo"), F.when(found, middle).otherwise(hi).alias("hi")))

        halvings = F.sequence(F.lit(1), F.length(F.bin(F.try_subtract(end.col, n.col))))
        found = F.aggregate(halvings, F.struct(n.col.alias("lo"), F.try_subtract(end.col, F.lit(1)).cast("long").alias("hi")), half, lambda s: s.getField("lo"))
        able = reduce(lambda x, y: x & y, guards, n.col < end.col)
        return Value(F.when(able, F.coalesce(found, n.col)).otherwise(n.col), "int")

    def _lasting(self, test: ast.expr, item: str, first: Column, guards: list[Column]) -> Callable[[Column], Column]:
        """A test as a function of the loop's number, if it holds for all numbers after one for which it holds; null where a number does not fit."""
        if isinstance(test, ast.BoolOp):
            fold = (lambda x, y: x & y) if isinstance(test.op, ast.And) else (lambda x, y: x | y)
            parts = [self._lasting(x, item, first, guards) for x in test.values]
            return lambda at: reduce(fold, [f(at) for f in parts])
        if not isinstance(test, ast.Compare) or len(test.ops) != 1:
            raise Unsupported("a test that may end")
        (a, da), (b, db) = (self._rising(x, item, first, guards) for x in (test.left, test.comparators[0]))
        op, up = test.ops[0], 1
        if isinstance(op, (ast.Lt, ast.LtE)):
            a, b, up = b, a, -1
        if not isinstance(op, (ast.Gt, ast.GtE, ast.Lt, ast.LtE)) or da * up < 0 or db * up > 0:
            raise Unsupported("a test that may end")
        return (lambda at: a(at) >= b(at)) if isinstance(op, (ast.GtE, ast.LtE)) else (lambda at: a(at) > b(at))

    def _rising(self, e: ast.expr, item: str, first: Column, guards: list[Column]) -> tuple[Callable[[Column], Column], int]:
        """Whole numbers as a function of the loop's number, and how they go as it grows: 1 for up, -1 for down, 0 where it is not in them; guards are what must be so."""
        if isinstance(e, ast.Name) and e.id == item:
            return (lambda at: at), 1
        if isinstance(e, (ast.Name, ast.Constant)):
            v = self.expr(e)
            if v.kind != "int":
                raise Unsupported("not a whole number")
            return (lambda at: v.col), 0
        if isinstance(e, ast.UnaryOp) and isinstance(e.op, ast.USub):
            a, up = self._rising(e.operand, item, first, guards)
            return (lambda at: F.try_subtract(F.lit(0).cast("long"), a(at))), -up
        if not isinstance(e, ast.BinOp) or not isinstance(e.op, (ast.Add, ast.Sub, ast.Mult)):
            raise Unsupported("numbers that may go up and down")
        (a, da), (b, db) = (self._rising(x, item, first, guards) for x in (e.left, e.right))
        if isinstance(e.op, ast.Mult):
            if min(da, db) < 0:
                raise Unsupported("numbers that may go up and down")
            if max(da, db):
                # factors that begin at zero or above stay there
                guards += [a(first) >= 0, b(first) >= 0]
            return (lambda at: F.try_multiply(a(at), b(at))), max(da, db)
        if isinstance(e.op, ast.Sub):
            db = -db
        if da * db < 0:
            raise Unsupported("numbers that may go up and down")
        put = F.try_add if isinstance(e.op, ast.Add) else F.try_subtract
        return (lambda at: put(a(at), b(at))), da or db


class _Machine:
    def __init__(self, functions: dict[str, ast.FunctionDef], name: str, args: list[Value]) -> None:
        self.functions, self.name, self.flat = functions, name, _Flat(functions, name)
        self.kinds: dict[tuple[str, str], object] = {}
        self.returns: dict[str, object] = {}
        self._give(name, bind(functions[name], args, {}, self._default))
        while True:
            before, failed = (dict(self.kinds), dict(self.returns)), None
            for b in self.flat.blocks:
                try:
                    self._after(b, lambda n, b=b: F.lit(None).cast(pysem.ddl(self.kinds[b.function, n])), Value(F.lit(None).cast(pysem.ddl(self.returns.get(b.function, NONE))), NONE))
                except Unsupported as e:
                    failed = e  # a variable's kind may be known in the next pass
            if (self.kinds, self.returns) == before:
                if failed:
                    raise failed
                break
        self.columns = {k: f"v{n}" for n, k in enumerate(sorted(self.kinds))}
        frame = "pc:int" + "".join(f",{c}:{pysem.ddl(self.kinds[k])}" for k, c in self.columns.items())
        self.shape = f"struct<stack:array<struct<{frame}>>,value:{pysem.ddl(self.result)}>"

    @property
    def result(self) -> object:
        kinds = NONE
        for k in self.returns.values():
            kinds = pysem.widest(kinds, k)
        return kinds

    def _default(self, e: ast.expr) -> Value:
        return _Step({}, {}, 0).expr(e)

    def _wider(self, table: dict, key: object, kind: object) -> None:
        table[key] = pysem.widest(table.get(key, NONE), kind)

    def _give(self, f: str, names: dict[str, object]) -> dict[str, Value]:
        """A call's variables."""
        for n, v in names.items():
            if isinstance(v, list):
                names[n] = pysem.list_of(v)
            elif isinstance(v, dict):
                names[n] = pysem.dict_of([(pysem.constant(k), x) for k, x in v.items()])
            self._wider(self.kinds, (f, n), names[n].kind)
        return names

    def _after(self, b: _Block, get: Callable[[str], Column], value: Value) -> tuple[dict[str, Value], tuple]:
        """Variables after a block, and its end with values in place of expressions."""
        known = {n: Value(get(n), k) for (f, n), k in self.kinds.items() if f == b.function and k != NONE}
        if b.takes:
            called = next(c.end[1] for c in self.flat.blocks if c.end[0] == "call" and self.flat.blocks[c.end[4]] is b)
            kind = self.returns.get(called, NONE)
            if kind == NONE:
                raise Unsupported("a function that never returns")
            known[b.takes] = Value(value.col.cast(pysem.ddl(kind)), kind)
        run = _Step({}, known, 0)
        run.block(b.body, None)
        for n, v in run.names.items():
            self._wider(self.kinds, (b.function, n), v.kind)
        end = b.end
        if end[0] == "if":
            end = ("if", pysem.truthy(run.expr(end[1])), *end[2:])
        elif end[0] == "return":
            v = pysem.constant(None) if end[1] is None else run.expr(end[1])
            self._wider(self.returns, b.function, v.kind)
            end = ("return", v)
        elif end[0] == "call":
            _, f, args, keywords, then = end
            given = bind(self.functions[f], [run.expr(a) for a in args], {k: run.expr(v) for k, v in keywords.items()}, self._default)
            end = ("call", f, self._give(f, given), then)
        return run.names, end

    def _frame(self, f: str, pc: Column, names: dict[str, Value], old: Column | None = None) -> Column:
        fields = [pc.cast("int").alias("pc")]
        for key, c in self.columns.items():
            kind = self.kinds[key]
            if key[0] == f and key[1] in names:
                col = pysem.to_kind(names[key[1]], kind).col
            else:
                col = F.lit(None) if old is None else old.getField(c)
            fields.append(col.cast(pysem.ddl(kind)).alias(c))
        return F.struct(*fields)

    def start(self, args: list[Value]) -> Column:
        names = self._give(self.name, bind(self.functions[self.name], args, {}, self._default))
        return F.struct(F.array(self._frame(self.name, F.lit(self.flat.entry[self.name]), names)).alias("stack"), F.lit(None).alias("value")).cast(self.shape)

    def step(self, s: Column) -> Column:
        stack, size = s.getField("stack"), F.size(s.getField("stack"))
        top, value = F.element_at(stack, -1), s.getField("value")
        # without calls there is one frame
        alone = not any(b.end[0] == "call" for b in self.flat.blocks)
        below = F.slice(stack, F.lit(1), size - 1)
        put = (lambda frame: F.array(frame)) if alone else (lambda frame: F.array_append(below, frame))
        heads = self._heads()
        todo, seen, out = [self.flat.entry[self.name]], set(), None

        def state(then: Column, value: Column) -> Column:
            return F.struct(then.alias("stack"), value.alias("value")).cast(self.shape)

        def run(n: int, get: Callable[[str], Column], room: int) -> Column:
            b = self.flat.blocks[n]
            names, end = self._after(b, get, Value(value, self.result))
            if end[0] == "return":
                return state(F.slice(stack, F.lit(1), F.lit(0)) if alone else below, pysem.to_kind(end[1], self.result).col if end[1].kind != NONE else F.lit(None))
            if end[0] == "call":
                todo.extend((self.flat.entry[end[1]], end[3]))
                frame = self._frame(end[1], F.lit(self.flat.entry[end[1]]), end[2])
                return state(F.array_append(put(self._frame(b.function, F.lit(end[3]), names, top)), frame), value)

            def follow(m: int) -> Column:
                if m in heads or room <= 1:
                    todo.append(m)
                    return state(put(self._frame(b.function, F.lit(m), names, top)), value)
                kinds = {v: self.kinds[b.function, v] for v in names}
                held = lambda v: pysem.to_kind(names[v], kinds[v]).col.cast(pysem.ddl(kinds[v])) if v in names else top.getField(self.columns[b.function, v])
                return run(m, held, room - 1)

            return follow(end[1]) if end[0] == "go" else F.when(end[1], follow(end[2])).otherwise(follow(end[3]))

        while todo:
            n = todo.pop()
            if n in seen:
                continue
            seen.add(n)
            f = self.flat.blocks[n].function
            made = run(n, lambda v, f=f: top.getField(self.columns[f, v]), MOST_BLOCKS)
            out = F.when(top.getField("pc") == n, made) if out is None else out.when(top.getField("pc") == n, made)
        return out

    def _heads(self) -> set[int]:
        """Blocks that something later leads back to."""
        after = [[x for x in b.end[1:] if isinstance(x, int)] if b.end[0] == "go" else list(b.end[2:]) if b.end[0] == "if" else [b.end[4]] if b.end[0] == "call" else [] for b in self.flat.blocks]
        heads, done, path = set(), set(), set()
        for first in self.flat.entry.values():
            todo = [(first, False)]
            while todo:
                n, left = todo.pop()
                if left:
                    path.discard(n)
                    done.add(n)
                elif n in path:
                    heads.add(n)
                elif n not in done:
                    path.add(n)
                    todo.append((n, True))
                    todo += [(m, False) for m in after[n]]
        return heads

    def steps(self, state: Column, n: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(n)), state, lambda s, _: F.when(F.size(s.getField("stack")) > 0, self.step(s)).otherwise(s))


def run(df: DataFrame, source: str | Callable, *args: str, into: str, name: str | None = None, returns: str | None = None) -> DataFrame:
    """df with a function's value in the column into. Raises Unsupported where blocks cannot say the function.

    An error that Python would raise is one that Spark raises. A program that does
    not end raises RuntimeError after MOST_ROUNDS.
    """
    kinds = [df.select(df[a]).schema[0].dataType for a in args]
    # doubles that count as equal can be told apart, so only other arguments are shared
    if args and all(isinstance(k, (T.IntegralType, T.StringType, T.BooleanType, T.DateType)) for k in kinds):
        given = [f"_a{n}" for n in range(len(args))]
        while set(given) & set(df.columns):
            given = [f"_{g}" for g in given]
        called = df.select(*[df[a].alias(g) for a, g in zip(args, given, strict=True)]).distinct()
        told = _run(called, source, *given, into="_out", name=name, returns=returns)
        told = told if told.count() <= MOST_TOLD else told.hint("merge")
        same = reduce(lambda x, y: x & y, [df[a].eqNullSafe(told[g]) for a, g in zip(args, given, strict=True)])
        return df.join(told, same).select(*[df[f"`{c}`"] for c in df.columns], told["_out"].alias(into))
    return _run(df, source, *args, into=into, name=name, returns=returns)


def _run(df: DataFrame, source: str | Callable, *args: str, into: str, name: str | None, returns: str | None) -> DataFrame:
    """run(), with a state for each row."""
    functions = parse(source)
    name = name or next(reversed(functions))
    values = [pysem.of_column(df[a], df.select(df[a]).schema[0].dataType) for a in args]
    machine = _Machine(functions, name, values)
    stage, names, state = Staged(df.sparkSession, "machine"), df.columns, "_state"
    while state in names:
        state += "_"
    live, done, n = df.withColumn(state, machine.start(values)), None, FIRST_STEPS
    for _ in range(MOST_ROUNDS):
        stepped = stage.save(live.withColumn(state, machine.steps(F.col(state), n)))
        left = F.size(F.col(state).getField("stack")) > 0
        value = F.col(state).getField("value")
        ended = stepped.where(~left).select(*[F.col(f"`{c}`") for c in names], (value.cast(returns) if returns else value).alias(into))
        done = ended if done is None else done.unionByName(ended)
        live, n = stepped.where(left), min(2 * n, MOST_STEPS)
        if live.isEmpty():
            return done
    raise RuntimeError(f"{name} does not end")
