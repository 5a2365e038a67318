"""Graphs as a table of triples, and patterns of triples compiled to joins.

A graph has the columns s, p, o, o_kind (uri, bnode or literal) and o_dt (the
datatype of a literal), and set semantics. Patterns name variables with a
leading question mark; other terms are prefixed names or URIs, Lit(...) for
literals. A filter on p reaches into the union a graph is made of, so that only
the parts with that predicate are computed.

A graph derived from a table may also have s_of and o_of: the numbers that its
terms are made of, 0 for terms of several rows. Equal terms have equal numbers.
Joins and distinct rows take them as further keys, so that triples which are dealt
by the number stay where they are.

A wide graph is one made of a table's rows, whose terms are many times wider than
what the files tell of their size: Spark would broadcast millions of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomflow.functions.terms import expand
from loomflow.operators import units
from loomflow.stage import Staged

OWNERS = ("s_of", "o_of")
TRIPLE = T.StructType([T.StructField(c, T.StringType()) for c in ("s", "p", "o", "o_kind", "o_dt")])


@dataclass(frozen=True)
class Lit:
    value: object


@dataclass(frozen=True)
class Owned:
    """A term made of a number: the term and the number."""

    term: Column
    of: Column


Term = str | Lit
Pattern = tuple[Term, "str | tuple[str, ...]", Term]

# Vocabularies of implementations; datatypes of Python literals.
_FEW = (expand("fnoi:"), expand("doap:"))
_TYPES = {bool: "boolean", int: "integer", float: "double", str: "string"}


def literal_of(value: object) -> tuple[str, str, str | None]:
    """(o, o_kind, o_dt) of a Python value; kinds without a standard type name their class."""
    kind = type(value)
    if kind in _TYPES:
        text = str(value).lower() if kind is bool else str(value)
        return text, "literal", None if kind is str else expand("xsd:" + _TYPES[kind])
    name = {"datetime": "dateTime", "date": "date", "time": "time", "Decimal": "decimal"}.get(kind.__name__)
    if name:
        return (value.isoformat() if hasattr(value, "isoformat") else str(value)), "literal", expand("xsd:" + name)
    from loomflow.functions.terms import mint

    return str(value), "literal", mint(kind.__name__, kind.__module__)


def owners(df: DataFrame, *names: str) -> list[str]:
    """The columns names, those of their numbers before them where df has such."""
    return [c for n in names for c in (f"_of_{n}", n) if c in df.columns]


def plain(df: DataFrame) -> DataFrame:
    """df without the columns of numbers."""
    return df.select(*[df[c] for c in df.columns if not c.startswith("_of_")])


def is_var(term: object) -> bool:
    return isinstance(term, str) and term.startswith("?")


@dataclass
class Group:
    """A graph pattern: triples that must match, optional groups, conditions and allowed values."""

    patterns: list[Pattern]
    optional: list["Group"] = field(default_factory=list)
    filters: list[Callable[..., Column]] = field(default_factory=list)
    values: dict[str, Iterable[str]] = field(default_factory=dict)


class Graph:
    def __init__(self, triples: DataFrame, wide: bool = False) -> None:
        self.triples, self.wide = triples, wide

    @classmethod
    def of(cls, spark: SparkSession, rows: Iterable[tuple]) -> "Graph":
        """From (s, p, o) with o a term or Lit, or rows of five strings."""
        out = []
        for row in rows:
            if len(row) == 5:
                out.append(tuple(row))
            else:
                s, p, o = row
                kind = literal_of(o.value) if isinstance(o, Lit) else (expand(o), "bnode" if o.startswith("_:") else "uri", None)
                out.append((expand(s), expand(p), *kind))
        return cls(spark.createDataFrame(sorted(set(out), key=str), TRIPLE))

    def __or__(self, other: "Graph") -> "Graph":
        if OWNERS[0] in self.triples.columns or OWNERS[0] in other.triples.columns:
            return Graph(_with_owners(self.triples).unionByName(_with_owners(other.triples)), self.wide or other.wide)
        return Graph(self.triples.unionByName(other.triples), self.wide or other.wide)

    def distinct(self) -> DataFrame:
        return self.triples.select(*TRIPLE.names).dropDuplicates()

    def minus(self, other: "Graph") -> "Graph":
        cols = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in TRIPLE.names]
        return Graph(self.triples.alias("a").join(other.triples.alias("b"), reduce(lambda x, y: x & y, cols), "left_anti"))

    def _scan(self, pattern: Pattern, subjects: set[str]) -> DataFrame:
        s, p, o = pattern
        rows = self.triples
        ps = p if isinstance(p, tuple) else (p,)
        if not is_var(ps[0]):
            rows = rows.where(F.col("p").isin([expand(x) for x in ps]) if len(ps) > 1 else F.col("p") == expand(ps[0]))
        owned = OWNERS[0] in rows.columns
        out: dict[str, Column] = {}
        of: dict[str, Column] = {}
        for term, place in ((s, "s"), (ps[0], "p"), (o, "o")):
            if isinstance(term, Lit):
                value, _, kind = literal_of(term.value)
                rows = rows.where((F.col("o") == value) & (F.col("o_kind") == "literal"))
                if kind is not None:
                    rows = rows.where(F.col("o_dt") == kind)
            elif is_var(term):
                if term[1:] in out:
                    rows = rows.where(F.col(place) == out[term[1:]])
                out.setdefault(term[1:], F.col(place))
                if owned and place != "p":
                    of.setdefault(f"_of_{term[1:]}", F.col(f"{place}_of"))
                if place == "o" and term in subjects:
                    rows = rows.where(F.col("o_kind") != "literal")
            elif place != "p":
                rows = rows.where(F.col(place) == expand(term))
                if place == "o":
                    rows = rows.where(F.col("o_kind") != "literal")
        return rows.select(*[c.alias(v) for v, c in (of | out).items()]) if out else rows.select(F.lit(True).alias("_found")).limit(1)

    def match(self, group: Group | list[Pattern], *variables: str, distinct: bool = True, owned: bool = False) -> DataFrame:
        """The bindings of a group as columns, of all variables or the named ones; owned: with the numbers of their terms, where the graph has them.

        Patterns join in the order of how many terms they bind, each on the
        variables it shares with those before; optional groups join left.
        """
        group = group if isinstance(group, Group) else Group(group)
        out = self._solve(group)
        names = [v.lstrip("?") for v in variables] or [c for c in out.columns if not c.startswith("_of_")]
        kept = owners(out, *names)
        if not owned:
            # one number is enough to leave equal rows where they are
            kept = [c for c in kept if c.startswith("_of_")][:1] + names
        out = out.select(*[out[n] for n in kept])
        out = out.distinct() if distinct else out
        return out if owned else plain(out)

    def _joined(self, found: DataFrame, pattern: Pattern, group: Group) -> DataFrame:
        """What a pattern finds, for a join; in a wide graph it is dealt, not broadcast, unless it tells of implementations, which are few."""
        _, p, o = pattern
        # the classes of a type tell what it is about, other predicates themselves
        about = p if isinstance(p, tuple) else group.values.get(o, (o,)) if p == "a" else (p,)
        few = all(isinstance(x, str) and expand(x).startswith(_FEW) for x in about)
        return found.hint("merge") if self.wide and not few else found

    def _solve(self, group: Group) -> DataFrame:
        subjects = {s for g in (group, *group.optional) for s, _, _ in g.patterns if is_var(s)}
        todo = sorted(group.patterns, key=lambda t: sum(is_var(x[0] if isinstance(x, tuple) else x) for x in t))
        out: DataFrame | None = None
        while todo:
            names = set(out.columns) if out is not None else set()
            linked = [t for t in todo if names & {x[1:] for x in (t[0], t[1] if isinstance(t[1], str) else "", t[2]) if is_var(x)}]
            pattern = (linked or todo)[0]
            todo.remove(pattern)
            found = self._scan(pattern, subjects)
            for v, allowed in group.values.items():
                if v.lstrip("?") in found.columns:
                    found = found.where(F.col(v.lstrip("?")).isin([expand(x) for x in allowed]))
            if out is None:
                out = found
            else:
                shared = [c for c in found.columns if c in names]
                if shared:
                    out = out.join(self._joined(found, pattern, group), shared)
                elif set(found.columns) == {"_found"}:
                    out = out.join(found.limit(1), how="cross").drop("_found")
                else:
                    raise ValueError("the patterns are not connected")
        for inner in group.optional:
            found = self._solve(inner)
            out = out.join(self._joined(found, inner.patterns[0], inner), [c for c in found.columns if c in out.columns], "left")
        for condition in group.filters:
            out = out.where(condition(out))
        return out

    def ask(self, group: Group | list[Pattern]) -> bool:
        """Whether the group matches at all."""
        return not self._solve(group if isinstance(group, Group) else Group(group)).isEmpty()

    def found(self, *uris: str) -> DataFrame:
        """(term, found) for each of the terms: whether it occurs anywhere."""
        wanted = [expand(u) for u in uris]
        named = self.triples.select(F.explode(F.array("s", "p", F.when(F.col("o_kind") != "literal", F.col("o")))).alias("term")).where(F.col("term").isin(wanted)).distinct()
        terms = self.triples.sparkSession.createDataFrame([(u,) for u in wanted], "term string")
        return terms.join(named.withColumn("found", F.lit(True)), "term", "left").select("term", F.coalesce("found", F.lit(False)).alias("found"))

    def exists(self, uri: str) -> bool:
        """Whether a term occurs anywhere."""
        u = expand(uri)
        return not self.triples.where((F.col("s") == u) | (F.col("p") == u) | (F.col("o") == u)).isEmpty()


def closure(edges: DataFrame, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, a, b, steps): the pairs that edges (by, a, b) link, by the fewest steps.

    Small groups by `by` are closed in one row each. Of the others each round joins
    what is known with itself, so paths double, and keeps the shortest of each pair;
    cycles end, as nothing is new. Rounds are staged. Numbers of the terms in `by`
    (columns _of_) say where groups are; the result is without them.
    """
    if by:
        # written once: read to tell the groups' sizes, and again to close them
        edges = Staged(edges.sparkSession, "closure").save(edges.select(*owners(edges, *by), a, b))
        small, large = units.sized(edges, owners(edges, *by), (a, b))
        found = units.closed(small, a, b, owners(edges, *by)).select(*by, a, b, "steps")
        return found.unionByName(_doubled(large, a, b, by)) if large.count() else found
    return _doubled(edges, a, b, by)


def _doubled(edges: DataFrame, a: str, b: str, by: tuple[str, ...]) -> DataFrame:
    stage = Staged(edges.sparkSession, "closure")
    known, size = stage.save(edges.select(*by, a, b, F.lit(1).alias("steps")).distinct()), None
    for _ in range(62):
        mark = known.agg(F.count("*"), F.sum("steps")).first()
        if mark == size:
            return known
        size = mark
        left = known.select(*by, a, F.col(b).alias("_via"), F.col("steps").alias("_n"))
        right = known.select(*by, F.col(a).alias("_via"), b, "steps")
        longer = left.join(right, [*by, "_via"]).select(*by, a, b, (F.col("_n") + F.col("steps")).alias("steps"))
        then = stage.save(known.unionByName(longer).groupBy(*by, a, b).agg(F.min("steps").alias("steps")))
        stage.drop(known)
        known = then
    raise RuntimeError("the closure did not settle")


def _with_owners(triples: DataFrame) -> DataFrame:
    return triples if OWNERS[0] in triples.columns else triples.select("*", *[F.lit(0).cast("long").alias(c) for c in OWNERS])


def triples(rows: DataFrame, s: Column | Owned, *edges: tuple[str, Column | Owned, str] | tuple[str, Column | Owned, str, str]) -> DataFrame:
    """Triples of each row: (predicate, object, kind[, datatype]) around one subject; null objects give none.

    Rows with a column `_key` leave it to their triples. Around an owned subject
    triples have the columns OWNERS.
    """
    parts, key = [], ["_key"] if "_key" in rows.columns else []
    numbered = isinstance(s, Owned)
    number = lambda x: (x.of if isinstance(x, Owned) else F.lit(0)).cast("long")
    s_of, s = number(s), s.term if numbered else s
    for predicate, o, kind, *datatype in edges:
        dt = F.lit(expand(datatype[0])) if datatype else F.lit(None)
        own = [s_of.alias("s_of"), number(o).alias("o_of")] if numbered else []
        o = o.term if isinstance(o, Owned) else o
        part = rows.select(s.alias("s"), F.lit(expand(predicate)).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), dt.cast("string").alias("o_dt"), *own, *key)
        parts.append(part.where(F.col("o").isNotNull() & F.col("s").isNotNull()))
    return reduce(DataFrame.unionByName, parts)


def direct(rows: DataFrame, table: str, key: str) -> Graph:
    """A relational table as triples: ex:<table>/<key>, ex:<column>, value as text; nulls give none."""
    base = expand("ex:")
    s = F.concat(F.lit(f"{base}{table}/"), F.col(key).cast("string"))
    return Graph(triples(rows, s, *[(f"ex:{c}", F.col(c), "literal") for c in rows.columns]))
