"""Python's meaning of operators and builtins, as columns.

A Value is a column with the kind it would have in Python: int, float, bool,
str, none, ("list", kind), ("tuple", kinds) or ("dict", key kind, value kind).
Whole numbers are bigint; what does not fit fails, as ANSI arithmetic does.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Unsupported(TypeError):
    """No column has this meaning; the caller may fall back to running Python."""


@dataclass
class Value:
    col: Column
    kind: object


NONE = "none"
_DDL = {"int": "bigint", "float": "double", "bool": "boolean", "str": "string", NONE: "void", None: "bigint"}


def ddl(kind: object) -> str:
    """The Spark type of a kind."""
    if isinstance(kind, tuple):
        if kind[0] == "list":
            return f"array<{ddl(kind[1])}>"
        if kind[0] == "dict":
            return f"map<{ddl(kind[1])},{ddl(kind[2])}>"
        if kind[0] == "record":
            return "struct<" + ",".join(f"`{n}`:{ddl(k)}" for n, k in kind[1]) + ">"
        return "struct<" + ",".join(f"_{n}:{ddl(k)}" for n, k in enumerate(kind[1])) + ">"
    return _DDL[kind]


def kind_of(kind: T.DataType) -> object:
    """The kind of a Spark type; structs are records with attributes."""
    if isinstance(kind, T.IntegralType):
        return "int"
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return "float"
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.StringType):
        return "str"
    if isinstance(kind, T.ArrayType):
        return ("list", kind_of(kind.elementType))
    if isinstance(kind, T.MapType):
        return ("dict", kind_of(kind.keyType), kind_of(kind.valueType))
    if isinstance(kind, T.StructType):
        return ("record", tuple((f.name, kind_of(f.dataType)) for f in kind.fields))
    raise Unsupported(kind.simpleString())


def of_column(col: Column, spark_type: T.DataType) -> Value:
    kind = kind_of(spark_type)
    return Value(col.cast(ddl(kind)), kind)


def attribute(v: Value, name: str) -> Value:
    """v.name of a record."""
    if isinstance(v.kind, tuple) and v.kind[0] == "record":
        for n, kind in v.kind[1]:
            if n == name:
                return Value(v.col.getField(n), kind)
    raise Unsupported(f"attribute {name} of {v.kind}")


def constant(x: object) -> Value:
    if x is None:
        return Value(F.lit(None), NONE)
    kind = type(x).__name__
    if kind not in ("int", "float", "bool", "str"):
        raise Unsupported(kind)
    return Value(F.lit(x).cast(ddl(kind)), kind)


def widest(a: object, b: object) -> object:
    """The kind that holds both."""
    if a == b or b in (None, NONE):
        return a
    if a in (None, NONE):
        return b
    if {a, b} <= {"int", "float", "bool"}:
        return "float" if "float" in (a, b) else "int"
    if isinstance(a, tuple) and isinstance(b, tuple) and a[0] == b[0] == "list":
        return ("list", widest(a[1], b[1]))
    if isinstance(a, tuple) and isinstance(b, tuple) and a[0] == b[0] == "dict":
        return ("dict", widest(a[1], b[1]), widest(a[2], b[2]))
    if isinstance(a, str) and isinstance(b, str):
        return "str"
    raise Unsupported(f"{a} and {b}")


def to_kind(v: Value, kind: object) -> Value:
    if v.kind == kind:
        return v
    if kind == "str" and v.kind not in (NONE, None):
        return to_str(v)
    return Value(v.col.cast(ddl(kind)), kind)


def number(v: Value) -> Value:
    return Value(v.col.cast("bigint"), "int") if v.kind == "bool" else v


def truthy(v: Value) -> Column:
    if v.kind == "bool":
        out = v.col
    elif v.kind in ("int", "float"):
        out = v.col != 0
    elif v.kind == "str":
        out = F.length(v.col) > 0
    elif v.kind == NONE:
        return F.lit(False)
    elif v.kind[0] == "tuple":
        return F.lit(bool(v.kind[1]))
    else:
        out = F.size(v.col) > 0
    return F.coalesce(out, F.lit(False))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor."""
    return ((a % b) + b) % b


def binary(op: str, a: Value, b: Value) -> Value:
    """a op b, op being the name of the syntax node, such as Add."""
    a, b = number(a), number(b)
    kinds = {a.kind, b.kind} if not isinstance(a.kind, tuple) and not isinstance(b.kind, tuple) else None
    if kinds and kinds <= {"int", "float"}:
        return _arithmetic(op, a, b)
    if op == "Add" and a.kind == b.kind == "str":
        return Value(F.concat(a.col, b.col), "str")
    if op == "Mult" and "int" in (a.kind, b.kind):
        what, n = (a, b) if b.kind == "int" else (b, a)
        times = F.greatest(n.col, F.lit(0)).cast("int")
        if what.kind == "str":
            return Value(F.call_function("repeat", what.col, times), "str")
        if what.kind[0] == "list":
            return Value(F.flatten(F.array_repeat(what.col, times)), what.kind)
    if isinstance(a.kind, tuple) and isinstance(b.kind, tuple) and a.kind[0] == b.kind[0] == "list":
        kind = widest(a.kind, b.kind)
        if op == "Add":
            return Value(F.concat(to_kind(a, kind).col, to_kind(b, kind).col), kind)
        if op == "MatMult":
            inner = widest(a.kind[1], b.kind[1])
            zero = F.lit(0).cast(ddl(inner))
            return Value(F.aggregate(F.zip_with(a.col, b.col, lambda x, y: (x * y).cast(ddl(inner))), zero, lambda s, x: s + x), inner)
    if op == "Mod" and a.kind == "str":
        args = [b] if not isinstance(b.kind, tuple) else [Value(b.col.getField(f"_{n}"), k) for n, k in enumerate(b.kind[1])]
        return Value(F.call_function("format_string", a.col, *[x.col for x in args]), "str")
    if op == "BitOr" and isinstance(a.kind, tuple) and a.kind[0] == "dict":
        kind = widest(a.kind, b.kind)
        return Value(F.map_concat(F.map_filter(a.col, lambda k, _: ~F.map_contains_key(b.col, k)), b.col), kind)
    raise Unsupported(f"{op} of {a.kind} and {b.kind}")


def _arithmetic(op: str, a: Value, b: Value) -> Value:
    kind = "float" if "float" in (a.kind, b.kind) else "int"
    x, y = to_kind(a, kind).col, to_kind(b, kind).col
    if op in ("Add", "Sub", "Mult"):
        return Value({"Add": x + y, "Sub": x - y, "Mult": x * y}[op], kind)
    if op == "Div":
        return Value(a.col.cast("double") / b.col.cast("double"), "float")
    if op == "Mod":
        return Value(modulo(x, y), kind)
    if op == "FloorDiv":
        # what is left over taken off, whole numbers divide exactly
        whole = F.call_function("div", x - modulo(x, y), y) if kind == "int" else F.floor(x / y).cast("double")
        return Value(whole, kind)
    if op == "Pow":
        p = F.pow(x.cast("double"), y.cast("double"))
        return Value(F.round(p).cast("bigint"), "int") if kind == "int" else Value(p, "float")
    if kind == "int":
        bits = {"BitOr": lambda: x.bitwiseOR(y), "BitXor": lambda: x.bitwiseXOR(y), "BitAnd": lambda: x.bitwiseAND(y)}
        if op in bits:
            return Value(bits[op](), "int")
        if op in ("LShift", "RShift"):
            return Value(F.call_function("shiftleft" if op == "LShift" else "shiftright", x, y.cast("int")), "int")
    raise Unsupported(f"{op} of {a.kind} and {b.kind}")


def unary(op: str, v: Value) -> Value:
    if op == "Not":
        return Value(~truthy(v), "bool")
    v = number(v)
    if op == "UAdd" and v.kind in ("int", "float"):
        return v
    if op == "USub" and v.kind in ("int", "float"):
        return Value(-v.col, v.kind)
    if op == "Invert" and v.kind == "int":
        return Value(F.bitwise_not(v.col), "int")
    raise Unsupported(f"{op} of {v.kind}")


def compare(op: str, a: Value, b: Value) -> Value:
    if op in ("Is", "IsNot") or NONE in (a.kind, b.kind):
        if op not in ("Is", "IsNot", "Eq", "NotEq"):
            raise Unsupported("order of None")
        same = (b if a.kind == NONE else a).col.isNull() if NONE in (a.kind, b.kind) else a.col.eqNullSafe(b.col)
        return Value(~same if op in ("IsNot", "NotEq") else same, "bool")
    if op in ("In", "NotIn"):
        if b.kind == "str":
            out = F.contains(b.col, a.col)
        elif b.kind[0] == "dict":
            out = F.map_contains_key(b.col, to_kind(a, b.kind[1]).col)
        elif b.kind[0] == "list":
            out = F.coalesce(F.array_contains(b.col, to_kind(a, b.kind[1]).col), F.lit(False))
        else:
            raise Unsupported("in a tuple")
        return Value(~out if op == "NotIn" else out, "bool")
    if op in ("Eq", "NotEq"):
        same = to_kind(a, widest(a.kind, b.kind)).col.eqNullSafe(to_kind(b, widest(a.kind, b.kind)).col) if (a.kind == "str") == (b.kind == "str") else F.lit(False)
        return Value(~same if op == "NotEq" else same, "bool")
    kind = widest(number(a).kind, number(b).kind)
    x, y = to_kind(a, kind).col, to_kind(b, kind).col
    return Value({"Lt": x < y, "LtE": x <= y, "Gt": x > y, "GtE": x >= y}[op], "bool")


def choose(test: Column, a: Value, b: Value) -> Value:
    """a if test else b."""
    kind = widest(a.kind, b.kind)
    return Value(F.when(test, to_kind(a, kind).col).otherwise(to_kind(b, kind).col), kind)


def to_str(v: Value) -> Value:
    if v.kind == "str":
        return v
    if v.kind == "bool":
        return Value(F.initcap(v.col.cast("string")), "str")
    if v.kind == NONE:
        return Value(F.lit("None"), "str")
    if v.kind in ("int", "float"):
        return Value(v.col.cast("string"), "str")
    raise Unsupported(f"str of {v.kind}")


def formatted(v: Value, spec: str) -> Value:
    """format(v, spec) for the specs that Spark's formats share with Python's: width, precision, d, f, e, s, x."""
    if not spec:
        return to_str(v)
    if spec[-1] not in "dfesx" or "," in spec or "^" in spec or "<" in spec or ">" in spec:
        raise Unsupported(f"format {spec}")
    return Value(F.format_string("%" + spec, v.col), "str")


def joined(parts: list[Value]) -> Value:
    """The parts of an f-string; null reads None."""
    return Value(F.concat(*[F.coalesce(to_str(p).col, F.lit("None")) for p in parts], F.lit("")), "str")


def list_of(items: list[Value]) -> Value:
    kind = reduce(widest, [i.kind for i in items], None)
    return Value(F.array(*[to_kind(i, kind).col for i in items]).cast(ddl(("list", kind))), ("list", kind))


def tuple_of(items: list[Value]) -> Value:
    kinds = tuple(i.kind for i in items)
    return Value(F.struct(*[i.col.cast(ddl(i.kind)).alias(f"_{n}") for n, i in enumerate(items)]), ("tuple", kinds))


def dict_of(pairs: list[tuple[Value, Value]]) -> Value:
    """The last of equal keys wins."""
    key = reduce(widest, [k.kind for k, _ in pairs], None)
    value = reduce(widest, [v.kind for _, v in pairs], None)
    out = Value(F.create_map().cast(ddl(("dict", key, value))), ("dict", key, value))
    for k, v in pairs:
        out = put(out, k, v)
    return out


def put(box: Value, at: Value, item: Value) -> Value:
    """box after box[at] = item."""
    if isinstance(box.kind, tuple) and box.kind[0] == "dict":
        kind = ("dict", widest(box.kind[1], at.kind), widest(box.kind[2], item.kind))
        key = to_kind(at, kind[1]).col
        rest = F.map_filter(box.col.cast(ddl(kind)), lambda k, _: k != key)
        return Value(F.map_concat(rest, F.create_map(key, to_kind(item, kind[2]).col)), kind)
    if isinstance(box.kind, tuple) and box.kind[0] == "list":
        kind = ("list", widest(box.kind[1], item.kind))
        place = F.when(at.col < 0, at.col + F.size(box.col)).otherwise(at.col)
        return Value(F.transform(box.col.cast(ddl(kind)), lambda x, i: F.when(i == place, to_kind(item, kind[1]).col).otherwise(x)), kind)
    raise Unsupported(f"assignment into {box.kind}")


def item(box: Value, at: Value) -> Value:
    """box[at]; a place or key that is not there gives null."""
    if box.kind == "str":
        place = F.when(at.col < 0, at.col).otherwise(at.col + 1).cast("int")
        return Value(F.substring(box.col, place, F.lit(1)), "str")
    if box.kind[0] == "list":
        place = F.when(at.col < 0, at.col + F.size(box.col)).otherwise(at.col).cast("int")
        return Value(F.get(box.col, place), box.kind[1])
    if box.kind[0] == "dict":
        return Value(F.try_element_at(box.col, to_kind(at, box.kind[1]).col), box.kind[2])
    raise Unsupported(f"item of {box.kind}")


def cut(box: Value, low: Value | None, high: Value | None, step: int | None) -> Value:
    """box[low:high:step] for step 1 or -1 without bounds."""
    size = F.length(box.col) if box.kind == "str" else F.size(box.col)
    if step == -1 and low is None and high is None:
        return Value(F.reverse(box.col), box.kind)
    if step not in (None, 1):
        raise Unsupported("steps")

    def place(v: Value | None, default: Column) -> Column:
        if v is None or v.kind == NONE:
            return default
        return F.least(size, F.greatest(F.lit(0), F.when(v.col < 0, v.col + size).otherwise(v.col)))

    a, b = place(low, F.lit(0)), place(high, size)
    n = F.greatest(F.lit(0), b - a).cast("int")
    if box.kind == "str":
        return Value(F.substring(box.col, (a + 1).cast("int"), n), "str")
    if box.kind[0] == "list":
        return Value(F.slice(box.col, (a + 1).cast("int"), n), box.kind)
    raise Unsupported(f"slice of {box.kind}")


def span(*bounds: Value) -> Value:
    """range(...)."""
    start, stop = (constant(0), bounds[0]) if len(bounds) == 1 else bounds[:2]
    step = bounds[2].col if len(bounds) > 2 else F.lit(1).cast("bigint")
    last = stop.col - F.signum(step).cast("bigint")
    empty = F.when(step > 0, start.col >= stop.col).otherwise(start.col <= stop.col)
    none = F.array().cast("array<bigint>")
    return Value(F.when(empty, none).otherwise(F.sequence(start.col, last, step)), ("list", "int"))


def items_of(v: Value) -> Value:
    """What a loop over v goes through, as a list."""
    if v.kind == "str":
        return Value(F.filter(F.split(v.col, ""), lambda c: c != ""), ("list", "str"))
    if v.kind[0] == "dict":
        return Value(F.map_keys(v.col), ("list", v.kind[1]))
    if v.kind[0] == "list":
        return v
    raise Unsupported(f"loop over {v.kind}")


def field(v: Value, n: int) -> Value:
    """Part n of a tuple or list."""
    if isinstance(v.kind, tuple) and v.kind[0] == "tuple":
        return Value(v.col.getField(f"_{n}"), v.kind[1][n])
    return item(v, constant(n))


def _sum(v: Value) -> Value:
    kind = "int" if v.kind[1] in ("bool", None) else v.kind[1]
    return Value(F.aggregate(v.col.cast(ddl(("list", kind))), F.lit(0).cast(ddl(kind)), lambda s, x: s + x), kind)


def _extreme(fold, of_list):
    def run(*args: Value) -> Value:
        if len(args) == 1:
            return Value(of_list(args[0].col), args[0].kind[1])
        kind = reduce(widest, [a.kind for a in args])
        return Value(fold(*[to_kind(a, kind).col for a in args]), kind)

    return run


def _int(v: Value) -> Value:
    return Value((F.trim(v.col) if v.kind == "str" else v.col).cast("bigint"), "int")


def _enumerate(v: Value) -> Value:
    v = items_of(v)
    return Value(F.transform(v.col, lambda x, i: F.struct(i.cast("bigint").alias("_0"), x.alias("_1"))), ("list", ("tuple", ("int", v.kind[1]))))


def _zip(a: Value, b: Value) -> Value:
    a, b = items_of(a), items_of(b)
    n = F.least(F.size(a.col), F.size(b.col))
    pairs = F.zip_with(F.slice(a.col, F.lit(1), n), F.slice(b.col, F.lit(1), n), lambda x, y: F.struct(x.alias("_0"), y.alias("_1")))
    return Value(pairs, ("list", ("tuple", (a.kind[1], b.kind[1]))))


BUILTINS = {
    "len": lambda v: Value((F.length(v.col) if v.kind == "str" else F.size(v.col)).cast("bigint"), "int"),
    "int": _int,
    "float": lambda v: Value((F.trim(v.col) if v.kind == "str" else v.col).cast("double"), "float"),
    "str": to_str,
    "bool": lambda v: Value(truthy(v), "bool"),
    "abs": lambda v: Value(F.abs(number(v).col), number(v).kind),
    "sum": _sum,
    "min": _extreme(F.least, F.array_min),
    "max": _extreme(F.greatest, F.array_max),
    "sorted": lambda v: Value(F.array_sort(items_of(v).col), items_of(v).kind),
    "reversed": lambda v: Value(F.reverse(items_of(v).col), items_of(v).kind),
    "list": items_of,
    "range": span,
    "enumerate": _enumerate,
    "zip": _zip,
    "pow": lambda a, b: binary("Pow", a, b),
    "round": lambda v, n=None: Value(F.bround(v.col).cast("bigint"), "int") if n is None else Value(F.bround(v.col, n.col.cast("int")), v.kind),
    "any": lambda v: Value(F.exists(v.col, lambda x: truthy(Value(x, v.kind[1]))), "bool"),
    "all": lambda v: Value(F.forall(v.col, lambda x: truthy(Value(x, v.kind[1]))), "bool"),
    "format": lambda v, spec=None: to_str(v) if spec is None else Value(F.call_function("format_string", F.concat(F.lit("%"), spec.col), v.col), "str"),
}


def _text(f):
    return lambda v, *args: Value(f(v.col, *[a.col for a in args]), "str")


#: Methods of values that return something and leave the value as it is.
METHODS = {
    ("str", "upper"): _text(F.upper),
    ("str", "lower"): _text(F.lower),
    ("str", "strip"): _text(lambda c, *a: F.btrim(c, *a) if a else F.btrim(c)),
    ("str", "lstrip"): _text(lambda c, *a: F.ltrim(c, *a)),
    ("str", "rstrip"): _text(lambda c, *a: F.rtrim(c, *a)),
    ("str", "replace"): _text(lambda c, a, b: F.replace(c, a, b)),
    ("str", "removeprefix"): _text(lambda c, a: F.when(F.startswith(c, a), F.substring(c, F.length(a) + 1, F.length(c))).otherwise(c)),
    ("str", "removesuffix"): _text(lambda c, a: F.when(F.endswith(c, a), F.substring(c, F.lit(1), F.length(c) - F.length(a))).otherwise(c)),
    ("str", "startswith"): lambda v, a: Value(F.startswith(v.col, a.col), "bool"),
    ("str", "endswith"): lambda v, a: Value(F.endswith(v.col, a.col), "bool"),
    ("str", "join"): lambda v, a: Value(F.concat_ws("", F.transform(items_of(a).col, lambda x, i: F.when(i == 0, x).otherwise(F.concat(v.col, x)))), "str"),
    ("str", "split"): lambda v, a: Value(F.call_function("split", v.col, F.concat(F.lit("\\Q"), a.col, F.lit("\\E")), F.lit(-1)), ("list", "str")),
    ("list", "count"): lambda v, a: Value(F.size(F.filter(v.col, lambda x: x == a.col)).cast("bigint"), "int"),
    ("list", "index"): lambda v, a: Value(F.array_position(v.col, a.col) - 1, "int"),
    ("dict", "get"): lambda v, a, d=None: Value(F.coalesce(item(v, a).col, to_kind(d, v.kind[2]).col) if d is not None else item(v, a).col, v.kind[2]),
    ("dict", "keys"): lambda v: Value(F.map_keys(v.col), ("list", v.kind[1])),
    ("dict", "values"): lambda v: Value(F.map_values(v.col), ("list", v.kind[2])),
    ("dict", "items"): lambda v: Value(F.transform(F.map_entries(v.col), lambda e: F.struct(e["key"].alias("_0"), e["value"].alias("_1"))), ("list", ("tuple", (v.kind[1], v.kind[2])))),
}


def _append(v: Value, x: Value) -> Value:
    kind = ("list", widest(v.kind[1], x.kind))
    return Value(F.array_append(v.col.cast(ddl(kind)), to_kind(x, kind[1]).col), kind)


#: Methods that change the value: what it is afterwards.
MUTATIONS = {
    ("list", "append"): _append,
    ("list", "extend"): lambda v, x: binary("Add", v, items_of(x)),
    ("list", "reverse"): lambda v: Value(F.reverse(v.col), v.kind),
    ("list", "sort"): lambda v: Value(F.array_sort(v.col), v.kind),
    ("list", "insert"): lambda v, i, x: Value(F.array_insert(v.col, F.when(i.col < 0, i.col).otherwise(i.col + 1).cast("int"), to_kind(x, v.kind[1]).col), v.kind),
    ("list", "clear"): lambda v: Value(F.array().cast(ddl(v.kind)), v.kind),
    ("dict", "update"): lambda v, x: binary("BitOr", v, x),
}
