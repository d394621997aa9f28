"""Tensor expressions over a graph: indicators, features, products, sums and functions, compiled to joins and aggregations.

An expression has free node variables; its value at nodes that no factor mentions
together is a product with an indicator, mostly zero, so a compiled expression is a
table of the variables with a value `val` (a number or a vector) that leaves zeros out.
A sum over a variable joins its factors: first those that bound the variable by an edge
or an equality (guards), then factors whose variables are bound already, which filter,
then guards that bring in one more variable; what doesn't mention the variable is taken
out of the sum, so that sums over unrelated variables never meet. A product without a
guard between its variables is refused, as it would list all pairs. A sum over three
variables that three guards join in a ring is computed by blocks of nodes, so that the
paths over the third variable are not listed in a table.
"""

from __future__ import annotations

import dataclasses
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from sparkloom.functions.lineage import cut
from sparkloom.graph import PropertyGraph
from sparkloom.operators import packed
from sparkloom.operators.closed import closed_sums

#: Elementwise functions, and whether they keep zero at zero.
FUNCTIONS: dict[str, tuple[Callable[[Column], Column], bool]] = {
    "relu": (lambda v: F.greatest(v, F.lit(0.0)), True),
    "abs": (F.abs, True),
    "sqrt": (F.sqrt, True),
    "tanh": (F.tanh, True),
    "square": (lambda v: v * v, True),
    "exp": (F.exp, False),
    "log": (F.log, False),
    "reciprocal": (lambda v: F.lit(1.0) / v, False),
    "rsqrt": (lambda v: F.lit(1.0) / F.sqrt(v), False),
    "sigmoid": (lambda v: F.lit(1.0) / (F.lit(1.0) + F.exp(-v)), False),
}


class Expression:
    def __mul__(self, other) -> Expression:
        return Times((self, _made(other)))

    def __add__(self, other) -> Expression:
        return Plus((self, _made(other)))

    __rmul__, __radd__ = __mul__, __add__


def _made(x) -> Expression:
    return x if isinstance(x, Expression) else Const(float(x))


@dataclass(frozen=True)
class Const(Expression):
    value: float


@dataclass(frozen=True)
class Feature(Expression):
    """A stored property of the node, a number or a vector; nodes where it is null count as zero."""

    name: str
    var: str


@dataclass(frozen=True)
class Edge(Expression):
    """1 where there is an edge from x to y (or its stored property `weight`)."""

    x: str
    y: str
    weight: str | None = None


@dataclass(frozen=True)
class Equal(Expression):
    x: str
    y: str


@dataclass(frozen=True)
class Times(Expression):
    factors: tuple[Expression, ...]


@dataclass(frozen=True)
class Plus(Expression):
    terms: tuple[Expression, ...]


@dataclass(frozen=True)
class Sum(Expression):
    """Over all nodes in place of the variable."""

    var: str
    body: Expression


@dataclass(frozen=True)
class Apply(Expression):
    function: str
    body: Expression


@dataclass(frozen=True)
class Linear(Expression):
    """A matrix, a row for each output, times a vector."""

    matrix: tuple[tuple[float, ...], ...]
    body: Expression


def free(e: Expression) -> frozenset[str]:
    match e:
        case Const():
            return frozenset()
        case Feature():
            return frozenset([e.var])
        case Edge() | Equal():
            return frozenset([e.x, e.y])
        case Times():
            return frozenset().union(*map(free, e.factors))
        case Plus():
            return frozenset().union(*map(free, e.terms))
        case Sum():
            return free(e.body) - {e.var}
    return free(e.body)


def renamed(e: Expression, names: dict[str, str]) -> Expression:
    """With other names for its free variables."""
    at = lambda v: names.get(v, v)
    match e:
        case Const():
            return e
        case Feature():
            return dataclasses.replace(e, var=at(e.var))
        case Edge() | Equal():
            return dataclasses.replace(e, x=at(e.x), y=at(e.y))
        case Times():
            return Times(tuple(renamed(f, names) for f in e.factors))
        case Plus():
            return Plus(tuple(renamed(t, names) for t in e.terms))
        case Sum():
            inner = {k: v for k, v in names.items() if k != e.var}
            if e.var in inner.values():
                fresh = f"{e.var}'"
                while fresh in inner.values() or fresh in free(e.body):
                    fresh += "'"
                return Sum(fresh, renamed(e.body, inner | {e.var: fresh}))
            return Sum(e.var, renamed(e.body, inner))
    return dataclasses.replace(e, body=renamed(e.body, names))


def canonical(e: Expression, depth: int = 0) -> Expression:
    """Alike for expressions that differ by the names of variables only."""
    if not depth:
        e = renamed(e, {v: f"${i}" for i, v in enumerate(sorted(free(e)))})
    match e:
        case Times():
            return Times(tuple(canonical(f, depth + 1) for f in e.factors))
        case Plus():
            return Plus(tuple(canonical(t, depth + 1) for t in e.terms))
        case Sum():
            return Sum(f"#{depth}", canonical(renamed(e.body, {e.var: f"#{depth}"}), depth + 1))
        case Apply() | Linear():
            return dataclasses.replace(e, body=canonical(e.body, depth + 1))
    return e


def _inside(e: Expression) -> list[Expression]:
    match e:
        case Times():
            return list(e.factors)
        case Plus():
            return list(e.terms)
        case Sum() | Apply() | Linear():
            return [e.body]
    return []


@dataclass(frozen=True)
class Relation:
    """rows(variables..., val) without zeros, or with every node if `total`; vectors have `width`. A constant has no rows."""

    rows: DataFrame | None
    variables: tuple[str, ...]
    width: int | None = None
    total: bool = False
    constant: float = 0.0


def _map(rel: Relation, f: Callable[[Column], Column]) -> Column:
    return F.transform("val", f) if rel.width else f(F.col("val"))


def _product(a: Column, wa: int | None, b: Column, wb: int | None) -> Column:
    if wa and wb:
        return F.zip_with(a, b, lambda x, y: x * y)
    if wa or wb:
        vector, number = (a, b) if wa else (b, a)
        return F.transform(vector, lambda x: x * number)
    return a * b


class Compiler:
    """Compiles expressions over one graph; parts that occur more than once, under whatever names, are computed once."""

    def __init__(self, graph: PropertyGraph):
        self.graph, self.known, self.uses, self.pieces = graph, {}, Counter(), {}

    def compile(self, e: Expression) -> Relation:
        self._count(e)
        return self._get(e)

    def _count(self, e: Expression) -> None:
        key = canonical(e)
        self.uses[key] += 1
        if self.uses[key] == 1:
            for part in _inside(e):
                self._count(part)

    def _get(self, e: Expression) -> Relation:
        names = sorted(free(e))
        key = canonical(e)
        if key not in self.known:
            made = self._make(renamed(e, {v: f"${i}" for i, v in enumerate(names)}))
            if made.rows is not None and self.uses[key] > 1 and not isinstance(e, Feature | Edge | Equal):
                made = dataclasses.replace(made, rows=cut(made.rows))
            self.known[key] = made
        found = self.known[key]
        if found.rows is None or not names:
            return found
        rows = found.rows.select(*[F.col(f"`${i}`").alias(v) for i, v in enumerate(names)], "val")
        return dataclasses.replace(found, rows=rows, variables=tuple(names))

    def _make(self, e: Expression) -> Relation:
        nodes = self.graph.nodes
        match e:
            case Const():
                return Relation(None, (), constant=e.value, total=True)
            case Feature():
                kind = nodes.schema[e.name].dataType
                width = None
                if isinstance(kind, ArrayType):
                    first = nodes.where(F.col(e.name).isNotNull()).select(F.size(e.name)).first()
                    width = first[0] if first else 0
                value = F.col(e.name).cast("array<double>" if width is not None else "double")
                return Relation(nodes.where(F.col(e.name).isNotNull()).select(F.col("node_id").alias(e.var), value.alias("val")), (e.var,), width)
            case Edge():
                weight = F.col(e.weight).cast("double") if e.weight else F.lit(1.0)
                rows = self.graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), weight.alias("val"))
                if e.x == e.y:
                    return Relation(rows.where("a = b").select(F.col("a").alias(e.x), "val"), (e.x,))
                return Relation(rows.select(F.col("a").alias(e.x), F.col("b").alias(e.y), "val"), (e.x, e.y))
            case Equal():
                if e.x == e.y:
                    return Relation(nodes.select(F.col("node_id").alias(e.x), F.lit(1.0).alias("val")), (e.x,), total=True)
                return Relation(nodes.select(F.col("node_id").alias(e.x), F.col("node_id").alias(e.y), F.lit(1.0).alias("val")), (e.x, e.y))
            case Times():
                return self._closed(e) or self._joined(e)
            case Plus():
                return self._added([self._get(t) for t in e.terms])
            case Sum():
                return self._closed(e) or self._summed(e)
            case Apply():
                if e.function not in FUNCTIONS:
                    raise ValueError(f"no such function: {e.function}")
                f, keeps = FUNCTIONS[e.function]
                body = self._get(e.body)
                body = body if keeps else self._completed(body)
                if body.rows is None:
                    body = self._row(body)
                return dataclasses.replace(body, rows=body.rows.select(*body.variables, _map(body, f).alias("val")))
            case Linear():
                return self._linear(e)
        raise ValueError(f"no such expression: {e}")

    def _row(self, rel: Relation) -> Relation:
        """A constant as a table of one row."""
        return Relation(self.graph.nodes.sparkSession.range(1).select(F.lit(rel.constant).alias("val")), (), total=True)

    def _completed(self, rel: Relation) -> Relation:
        """With a row for every node."""
        if rel.total:
            return rel
        if len(rel.variables) != 1:
            raise ValueError("a function that isn't zero at zero needs an argument of one variable")
        (v,) = rel.variables
        zero = F.array_repeat(F.lit(0.0), rel.width) if rel.width else F.lit(0.0)
        rows = self.graph.nodes.select(F.col("node_id").alias(v)).join(rel.rows, v, "left").select(v, F.coalesce("val", zero).alias("val"))
        return dataclasses.replace(rel, rows=rows, total=True)

    def _linear(self, e: Linear) -> Relation:
        body = self._get(e.body)
        if not body.width or any(len(row) != body.width for row in e.matrix):
            raise ValueError("the matrix doesn't fit the vector")
        # one pass over an array of rows: the plan is as long as the matrix is, whatever reads it
        matrix = F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in e.matrix])
        dot = lambda row: F.aggregate(F.zip_with("val", row, lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
        return dataclasses.replace(body, rows=body.rows.select(*body.variables, F.transform(matrix, dot).alias("val")), width=len(e.matrix))

    def _added(self, terms: list[Relation]) -> Relation:
        constant = sum(t.constant for t in terms if t.rows is None)
        tables = [t for t in terms if t.rows is not None]
        if not tables:
            return Relation(None, (), constant=constant, total=True)
        variables, width = max((t.variables for t in tables), key=len), max((t.width or 0 for t in tables)) or None
        if any(set(t.variables) != set(variables) or t.width != width for t in tables):
            raise ValueError("terms of a sum have the same variables and width")
        rows = tables[0].rows.select(*variables, "val")
        total = any(t.total for t in tables)
        if len(tables) > 1:
            for t in tables[1:]:
                rows = rows.unionByName(t.rows.select(*variables, "val"))
            rows = self._totals(rows, variables, width)
        out = Relation(rows, variables, width, total)
        if constant:
            out = self._completed(out) if variables else out
            out = dataclasses.replace(out, rows=out.rows.select(*variables, _map(out, lambda v: v + F.lit(constant)).alias("val")))
        return out

    def _totals(self, rows: DataFrame, variables: tuple[str, ...], width: int | None) -> DataFrame:
        if not width:
            return rows.groupBy(*variables).agg(F.sum("val").alias("val"))
        sums = rows.groupBy(*variables).agg(*[F.sum(F.col("val")[i]).alias(f"__{i}") for i in range(width)])
        return sums.select(*variables, F.array(*[f"__{i}" for i in range(width)]).alias("val"))

    def _summed(self, e: Sum) -> Relation:
        if e.body == Const(1.0):
            return Relation(self.graph.nodes.agg(F.count("*").cast("double").alias("val")), (), total=True)
        if isinstance(e.body, Plus):
            return self._added([self._get(Sum(e.var, t)) for t in e.body.terms])
        factors = _flat(e.body)
        inner = [f for f in factors if e.var in free(f)]
        outer = [f for f in factors if e.var not in free(f)]
        if outer:
            return self._get(Times((*outer, Sum(e.var, Times(tuple(inner)) if inner else Const(1.0)))))
        body = self._get(e.body if not inner else _product_of(inner))
        rest = tuple(v for v in body.variables if v != e.var)
        out = self._totals(body.rows, rest, body.width)
        if not rest:
            zero = F.array_repeat(F.lit(0.0), body.width) if body.width else F.lit(0.0)
            width = body.width
            empty = F.col("val")[0].isNull() if width else F.col("val").isNull()
            out = out.select(F.when(empty, zero).otherwise(F.col("val")).alias("val"))
        return Relation(out, rest, body.width, total=not rest)

    def _packed(self, e: Expression, first: str) -> tuple[DataFrame, bool]:
        """Pieces of a relation of two variables, and whether they begin with the other one than `first`."""
        a, b = (e.x, e.y) if isinstance(e, Edge) else sorted(free(e))
        key = Edge("a", "b", e.weight) if isinstance(e, Edge) else canonical(e)
        if key not in self.pieces:
            self.pieces[key] = packed.pack(self._get(e).rows.select(F.col(a).alias("a"), F.col(b).alias("b"), "val"))
        return self.pieces[key], a != first

    def _closed(self, e: Expression) -> Relation | None:
        """Sums of numbers over a ring x -> y -> z -> x of which z, at least, is summed over; None for any other expression."""
        ring = _ring(e)
        if not ring:
            return None
        x, y, summed, constant, mask, onward, back = ring
        if any(self._get(f).width for f in (mask, onward, back)):
            return None
        keep = {n: v for n, v in (("x", x), ("y", y)) if v not in summed}
        sides = self._packed(mask, x), self._packed(onward, y), self._packed(back, next(iter(free(back) - {x})))
        parts = closed_sums(*sides, tuple(keep))
        rest = tuple(keep.values())
        out = self._totals(parts.select(*[F.col(n).alias(v) for n, v in keep.items()], (F.col("val") * F.lit(constant)).alias("val")), rest, None)
        if not rest:
            out = out.select(F.coalesce("val", F.lit(0.0)).alias("val"))
        return Relation(out, rest, total=not rest)

    def _joined(self, e: Times) -> Relation:
        factors = _flat(e)
        constant = 1.0
        for f in factors:
            constant *= f.value if isinstance(f, Const) else 1.0
        left = [f for f in factors if not isinstance(f, Const)]
        if not left:
            return Relation(None, (), constant=constant, total=True)
        now: Relation | None = None
        while left:
            bound = set(now.variables) if now else set()
            # guards first, then what is bound already, then guards that bring one more variable; numbers without variables last
            rank = lambda f: (not free(f), bool(bound) and not free(f) & bound, len(free(f) - bound) if bound else not isinstance(f, Edge | Equal))  # noqa: E731, B023
            nxt = min(left, key=rank)
            left.remove(nxt)
            other = self._get(nxt)
            now = other if now is None else self._times(now, other)
        if constant != 1.0:
            now = self._times(now, Relation(None, (), constant=constant, total=True))
        return now

    def _times(self, a: Relation, b: Relation) -> Relation:
        if b.rows is None or a.rows is None:
            table, c = (a, b.constant) if b.rows is None else (b, a.constant)
            if table.rows is None:
                return Relation(None, (), constant=a.constant * b.constant, total=True)
            return dataclasses.replace(table, rows=table.rows.select(*table.variables, _map(table, lambda v: v * F.lit(c)).alias("val")))
        common = [v for v in a.variables if v in b.variables]
        variables = (*a.variables, *[v for v in b.variables if v not in a.variables])
        right = b.rows.withColumnRenamed("val", "__val")
        if not a.variables or not b.variables:
            # one side is a single row
            table, one = (a.rows, F.broadcast(right)) if not b.variables else (F.broadcast(a.rows), right)
            rows = table.join(one)
        elif common:
            rows = a.rows.join(right, common)
        else:
            raise ValueError(f"no guard between {a.variables} and {b.variables}")
        value = _product(F.col("val"), a.width, F.col("__val"), b.width)
        return Relation(rows.select(*variables, value.alias("val")), variables, a.width or b.width, a.total and b.total)


def _flat(e: Expression) -> list[Expression]:
    return [x for f in e.factors for x in _flat(f)] if isinstance(e, Times) else [e]


def _ring(e: Expression) -> tuple | None:
    """x, y, the variables summed over, the constant and the factors over (x, y), (y, z), (z, x) of a sum over a ring."""
    summed: list[str] = []
    while isinstance(e, Sum):
        summed, e = [*summed, e.var], e.body
    factors = _flat(e)
    for f in [f for f in factors if isinstance(f, Sum)]:
        others = [g for g in factors if g is not f]
        if f.var not in summed and not any(f.var in free(g) for g in others):
            factors, summed = [*others, *_flat(f.body)], [*summed, f.var]
    constant = 1.0
    for f in factors:
        constant *= f.value if isinstance(f, Const) else 1.0
    factors = [f for f in factors if not isinstance(f, Const)]
    if len(set(summed)) < len(summed):
        return None
    for z in summed:
        own = [f for f in factors if free(f) == {z}]
        ends = [f for f in factors if z in free(f) and len(free(f)) > 1]
        rest = [f for f in factors if z not in free(f)]
        if len(ends) != 2 or any(len(free(f)) != 2 for f in ends):
            continue
        (y,), (x,) = (free(f) - {z} for f in ends)
        if x != y and any(free(f) == {x, y} for f in rest) and all(free(f) and free(f) <= {x, y} for f in rest) and set(summed) <= {x, y, z}:
            return x, y, set(summed), constant, _product_of(rest), _product_of([ends[0], *own]), ends[1]
    return None


def _product_of(factors: list[Expression]) -> Expression:
    return factors[0] if len(factors) == 1 else Times(tuple(factors))


def evaluate(graph: PropertyGraph, e: Expression, complete: bool = False) -> DataFrame:
    """(variables..., val) of the expression; `complete` gives every node of a one-variable expression a row."""
    compiler = Compiler(graph)
    out = compiler.compile(e)
    if out.rows is None:
        out = compiler._row(out)
    return (compiler._completed(out) if complete else out).rows


# ---- usual expressions


def degree(v: str) -> Expression:
    """In-degree."""
    return Sum("u" if v != "u" else "t", Edge("u" if v != "u" else "t", v))


def normaliser(v: str) -> Expression:
    return Apply("rsqrt", degree(v) + 1)


def gcn_layer(h: Callable[[str], Expression], matrix: list[list[float]], v: str = "x") -> Expression:
    """relu of the symmetrically normalised sum over a node and its in-neighbours of W h."""
    w = tuple(map(tuple, matrix))
    around = Sum("y", Edge("y", v) * normaliser("y") * Linear(w, h("y")))
    return Apply("relu", normaliser(v) * around + normaliser(v) * normaliser(v) * Linear(w, h(v)))


def triangles() -> Expression:
    """Closed walks x -> y -> z -> x, each counted from each of its nodes."""
    return Sum("x", Sum("y", Sum("z", Edge("x", "y") * Edge("y", "z") * Edge("z", "x"))))


def readout(h: Callable[[str], Expression]) -> Expression:
    return Sum("x", h("x"))
