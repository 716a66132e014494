"""A Cypher subset compiled to DataFrames: MATCH one pattern chain, WHERE, RETURN, ORDER BY, LIMIT.

Fixed-length steps keep one row per matching edge. A step *min..max gives, for each row, the distinct end nodes whose
least distance is in the range. Tests are two-valued: a null is false, also before NOT.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import json_is_text
from ..graph import Graph
from ..operators.traverse import reach, steps

#: Hops of an open pattern: it ends where no new node is reached.
MOST_HOPS = 1 << 62


class CypherError(ValueError):
    """The text is not a query of the subset."""


# --- syntax ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class NodePattern:
    variable: str | None
    labels: tuple[str, ...]
    properties: tuple[tuple[str, Any], ...]


@dataclass(frozen=True)
class RelPattern:
    variable: str | None
    types: tuple[str, ...]
    direction: str
    hops: tuple[int, int] | None


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Variable:
    name: str


@dataclass(frozen=True)
class Property:
    variable: str
    key: str


@dataclass(frozen=True)
class Star:
    pass


@dataclass(frozen=True)
class Call:
    name: str
    arguments: tuple


@dataclass(frozen=True)
class Op:
    """A comparison, text test, connective or null test."""

    kind: str
    arguments: tuple


@dataclass(frozen=True)
class Query:
    start: NodePattern
    chain: tuple[tuple[RelPattern, NodePattern], ...]
    where: Any
    items: tuple[tuple[Any, str], ...]
    order: tuple[tuple[Any, bool], ...]
    limit: int | None


_TOKENS = re.compile(r"\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+\.\d+|\d+(?!\.\d))|(?P<word>[A-Za-z_]\w*|`[^`]+`)|(?P<mark><=|>=|<>|<-|->|\.\.|[()\[\]{}:,.*=<>|-]))")
_KEYWORDS = {"MATCH", "WHERE", "RETURN", "ORDER", "BY", "LIMIT", "AND", "OR", "NOT", "AS", "ASC", "DESC", "CONTAINS", "STARTS", "ENDS", "WITH", "IS", "NULL", "TRUE", "FALSE"}


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens, at = [], 0
        text = text.strip().rstrip(";").rstrip()
        while at < len(text):
            m = _TOKENS.match(text, at)
            if not m:
                raise CypherError(f"unexpected {text[at : at + 10]!r}")
            kind = m.lastgroup
            value = m[kind]
            if kind == "word" and value.upper() in _KEYWORDS:
                kind, value = "key", value.upper()
            self.tokens.append((kind, value.strip("`") if kind == "word" else value))
            at = m.end()
        self.at = 0

    def peek(self, *values: str, ahead: int = 0) -> bool:
        i = self.at + ahead
        return i < len(self.tokens) and self.tokens[i][0] in ("mark", "key") and self.tokens[i][1] in values

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.at += 1
            return True
        return False

    def need(self, *values: str) -> None:
        for v in values:
            if not self.take(v):
                raise CypherError(f"{v} expected, not {self.tokens[self.at][1] if self.at < len(self.tokens) else 'the end'!r}")

    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def word(self) -> str:
        if self.kind() not in ("word", "key"):
            raise CypherError("a name is expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def query(self) -> Query:
        self.need("MATCH")
        start, chain = self.node(), []
        while self.peek("-", "<-"):
            chain.append((self.relation(), self.node()))
        where = self.either() if self.take("WHERE") else None
        self.need("RETURN")
        items = [self.item()]
        while self.take(","):
            items.append(self.item())
        order, limit = [], None
        if self.take("ORDER"):
            self.need("BY")
            while True:
                e = self.either()
                order.append((e, self.take("DESC") or (self.take("ASC") and False)))
                if not self.take(","):
                    break
        if self.take("LIMIT"):
            if self.kind() != "number" or "." in self.tokens[self.at][1]:
                raise CypherError("LIMIT takes a whole number")
            limit = int(self.tokens[self.at][1])
            self.at += 1
        if self.at < len(self.tokens):
            raise CypherError(f"unexpected {self.tokens[self.at][1]!r}")
        return Query(start, tuple(chain), where, tuple(items), tuple(order), limit)

    def node(self) -> NodePattern:
        self.need("(")
        variable = self.word() if self.kind() == "word" else None
        labels, properties = [], []
        while self.take(":"):
            name = self.word()
            while self.peek(":") and self.tokens[self.at + 1][0] == "word" and name.islower():  # ns:name types
                self.at += 1
                name += ":" + self.word()
            labels.append(name)
        if self.take("{"):
            while not self.take("}"):
                key = self.word()
                self.need(":")
                properties.append((key, self.atom()))
                self.take(",")
        self.need(")")
        return NodePattern(variable, tuple(labels), tuple(properties))

    def relation(self) -> RelPattern:
        back = self.take("<-")
        if not back:
            self.need("-")
        variable, types, hops = None, [], None
        if self.take("["):
            variable = self.word() if self.kind() == "word" else None
            if self.take(":"):
                types.append(self.word())
                while self.take("|"):
                    self.take(":")
                    types.append(self.word())
            if self.take("*"):
                low = self.number()
                high = self.number() if self.take("..") else low
                hops = (1 if low is None else low, MOST_HOPS if high is None else high)
            self.need("]")
        forward = self.take("->")
        if not forward:
            self.need("-")
        if back and forward:
            raise CypherError("a relation cannot point both ways")
        return RelPattern(variable, tuple(types), "in" if back else "out" if forward else "both", hops)

    def number(self) -> int | None:
        if self.kind() != "number":
            return None
        self.at += 1
        return int(self.tokens[self.at - 1][1])

    def item(self) -> tuple[Any, str]:
        e = self.either()
        return e, self.word() if self.take("AS") else name_of(e)

    def either(self) -> Any:
        e = self.both()
        while self.take("OR"):
            e = Op("OR", (e, self.both()))
        return e

    def both(self) -> Any:
        e = self.negated()
        while self.take("AND"):
            e = Op("AND", (e, self.negated()))
        return e

    def negated(self) -> Any:
        return Op("NOT", (self.negated(),)) if self.take("NOT") else self.compared()

    def compared(self) -> Any:
        e = self.atom()
        for op in ("=", "<>", "<=", ">=", "<", ">"):
            if self.take(op):
                return Op(op, (e, self.atom()))
        if self.take("CONTAINS"):
            return Op("CONTAINS", (e, self.atom()))
        for word in ("STARTS", "ENDS"):
            if self.take(word):
                self.need("WITH")
                return Op(word, (e, self.atom()))
        if self.take("IS"):
            kind = "IS NOT NULL" if self.take("NOT") else "IS NULL"
            self.need("NULL")
            return Op(kind, (e,))
        return e

    def atom(self) -> Any:
        if self.take("("):
            e = self.either()
            self.need(")")
            return e
        if self.take("*"):
            return Star()
        if self.take("-"):
            e = self.atom()
            return Literal(-e.value)
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "the end")
        self.at += 1
        if kind == "text":
            return Literal(re.sub(r"\\(.)", r"\1", value[1:-1]))
        if kind == "number":
            return Literal(float(value) if "." in value else int(value))
        if kind == "key" and value in ("TRUE", "FALSE", "NULL"):
            return Literal({"TRUE": True, "FALSE": False, "NULL": None}[value])
        if kind != "word":
            raise CypherError(f"unexpected {value!r}")
        if self.take("("):
            arguments = []
            while not self.take(")"):
                arguments.append(self.either())
                self.take(",")
            return Call(value.upper(), tuple(arguments))
        return Property(value, self.word()) if self.take(".") else Variable(value)


def parse(text: str) -> Query:
    return _Parser(text).query()


def name_of(e: Any) -> str:
    """The column of a RETURN item without an alias."""
    match e:
        case Variable(n):
            return n
        case Property(v, k):
            return f"{v}.{k}"
        case Call(n, a):
            return f"{n}({', '.join(name_of(x) for x in a)})"
        case Star():
            return "*"
        case Literal(v):
            return str(v)
    return "expr"


# --- compilation ----------------------------------------------------------------------------------------------------

_NODE_COLUMNS = ["id", "node_type", "name", "file", "exported", "metadata"]
_EDGE_COLUMNS = ["src", "dst", "edge_type", "metadata"]
_PROPERTIES = {"id": "id", "name": "name", "type": "node_type", "file": "file", "exported": "exported", "semanticId": "id", "semantic_id": "id"}
_EDGE_PROPERTIES = {"src": "src", "dst": "dst", "type": "edge_type"}
AGGREGATES = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}


class _Compiler:
    def __init__(self, g: Graph) -> None:
        self.g = g
        self.kinds: dict[str, str] = {}
        self.unnamed = 0

    def bound(self, variable: str | None, kind: str) -> str:
        if variable is None:
            self.unnamed += 1
            variable = f"_{self.unnamed}"
        if self.kinds.get(variable, kind) != kind:
            raise CypherError(f"{variable} is a node and a relation")
        self.kinds[variable] = kind
        return variable

    def nodes(self, variable: str, p: NodePattern) -> DataFrame:
        df = self.g.nodes.select(*(F.col(c).alias(f"{variable}__{c}") for c in _NODE_COLUMNS))
        if p.labels:
            df = df.where(F.col(f"{variable}__node_type").isin(*p.labels))
        for key, value in p.properties:
            df = df.where(self.test(Op("=", (Property(variable, key), value))))
        return df

    def match(self, q: Query) -> DataFrame:
        left = self.bound(q.start.variable, "node")
        df = self.nodes(left, q.start)
        for rel, node in q.chain:
            known = node.variable in self.kinds
            right = self.bound(node.variable, "node")
            side = f"{right}__again" if known else right
            self.kinds[side] = "node"
            df = self.hops(df, left, side, rel) if rel.hops else self.hop(df, left, side, rel)
            df = df.join(self.nodes(side, node), f"{side}__id")
            if known:
                df = df.where(F.col(f"{side}__id") == F.col(f"{right}__id"))
            left = right
        return df if q.where is None else df.where(self.test(q.where))

    def hop(self, df: DataFrame, left: str, right: str, rel: RelPattern) -> DataFrame:
        name = self.bound(rel.variable, "edge")
        e = self.g.edges.where(F.col("edge_type").isin(*rel.types)) if rel.types else self.g.edges
        own = [F.col(c).alias(f"{name}__{c}") for c in _EDGE_COLUMNS]
        sides = []
        if rel.direction in ("out", "both"):
            sides.append(e.select(F.col("src").alias(f"{left}__id"), F.col("dst").alias(f"{right}__id"), *own))
        if rel.direction in ("in", "both"):
            back = e.where("src != dst") if rel.direction == "both" else e  # a loop matches once
            sides.append(back.select(F.col("dst").alias(f"{left}__id"), F.col("src").alias(f"{right}__id"), *own))
        return df.join(sides[0] if len(sides) == 1 else sides[0].unionAll(sides[1]), f"{left}__id")

    def hops(self, df: DataFrame, left: str, right: str, rel: RelPattern) -> DataFrame:
        low, high = rel.hops
        if rel.variable:
            self.bound(rel.variable, "edge")
            raise CypherError("a variable-length relation binds no variable")
        if low > high:
            raise CypherError("*min..max with min above max")
        seeds = df.select(F.col(f"{left}__id").alias("origin"), F.col(f"{left}__id").alias("node"))
        found = reach(seeds, steps(self.g.edges, rel.direction, rel.types), high).where(F.col("depth") >= low)
        return df.join(found.select(F.col("origin").alias(f"{left}__id"), F.col("node").alias(f"{right}__id")), f"{left}__id")

    # values: a column, and its kind - num, text, bool, any (metadata as text) or node

    def value(self, e: Any) -> tuple[Column, str]:
        match e:
            case Literal(None):
                return F.lit(None).cast("string"), "null"
            case Literal(v):
                return F.lit(v), "bool" if isinstance(v, bool) else "text" if isinstance(v, str) else "num"
            case Variable(v):
                if v not in self.kinds:
                    raise CypherError(f"{v} is not bound")
                columns = _NODE_COLUMNS if self.kinds[v] == "node" else _EDGE_COLUMNS
                return F.struct(*(F.col(f"{v}__{c}").alias(c) for c in columns)), "node"
            case Property(v, k):
                if v not in self.kinds:
                    raise CypherError(f"{v} is not bound")
                fixed = (_PROPERTIES if self.kinds[v] == "node" else _EDGE_PROPERTIES).get(k)
                if fixed:
                    return F.col(f"{v}__{fixed}"), "bool" if fixed == "exported" else "text"
                return F.get_json_object(F.col(f"{v}__metadata"), "$['" + k.replace("'", "\\'") + "']"), "any"
            case Op():
                return self.test(e), "bool"
        raise CypherError(f"{name_of(e)} has no value here")

    def test(self, e: Any) -> Column:
        """A boolean column without nulls."""
        match e:
            case Op("AND", (a, b)):
                return self.test(a) & self.test(b)
            case Op("OR", (a, b)):
                return self.test(a) | self.test(b)
            case Op("NOT", (a,)):
                return ~self.test(a)
            case Op("IS NULL", (a,)):
                return self.null(a)
            case Op("IS NOT NULL", (a,)):
                return ~self.null(a)
            case Op("CONTAINS" | "STARTS" | "ENDS" as op, (a, b)):
                x, y = self.text(a), self.text(b)
                return F.coalesce({"CONTAINS": x.contains, "STARTS": x.startswith, "ENDS": x.endswith}[op](y), F.lit(False))
            case Op(op, (a, b)):
                return F.coalesce(self.compare(op, a, b), F.lit(False))
        column, kind = self.value(e)
        empty = {"bool": column, "num": column != 0, "text": column != "", "null": F.lit(False), "node": column.isNotNull(), "any": (column != "") & (column != "0") & (column != "false")}[kind]
        return F.coalesce(empty, F.lit(False))

    def null(self, e: Any) -> Column:
        return F.col(f"{e.name}__{'id' if self.kinds.get(e.name) == 'node' else 'src'}").isNull() if isinstance(e, Variable) else self.value(e)[0].isNull()

    def text(self, e: Any) -> Column:
        column, kind = self.value(e)
        if kind == "any":
            return F.when(json_is_text(F.col(f"{e.variable}__metadata"), e.key), column)
        return column if kind == "text" else F.lit(None).cast("string")

    def compare(self, op: str, a: Any, b: Any) -> Column:
        (x, s), (y, t) = self.value(a), self.value(b)
        if "null" in (s, t):
            return F.lit(False)
        kinds = {s, t}
        if "any" in kinds:
            other = (kinds - {"any"}).pop() if len(kinds) == 2 else "any"
            if other == "num":
                x, y = (self.number(e) if k == "any" else c for e, c, k in ((a, x, s), (b, y, t)))
            elif other == "text":
                x, y = (self.text(e) if k == "any" else c for e, c, k in ((a, x, s), (b, y, t)))
            elif other == "bool":
                x, y = (c.cast("string") for c in (x, y))
            else:
                n, m = self.number(a), self.number(b)
                return self.op(op, n, m) if op in ("<", ">", "<=", ">=") else self.op(op, x, y)
        elif s != t:
            return F.lit(op == "<>")  # values of unlike types are not equal and have no order
        elif s == "node":
            x, y = (c[c_id] for c, c_id in ((x, "id"), (y, "id")))
        return self.op(op, x, y)

    def number(self, e: Property) -> Column:
        text = F.col(f"{e.variable}__metadata")
        return F.when(~json_is_text(text, e.key), self.value(e)[0].try_cast("double"))

    @staticmethod
    def op(op: str, x: Column, y: Column) -> Column:
        return {"=": x == y, "<>": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]

    def aggregate(self, call: Call) -> Column:
        if len(call.arguments) != 1:
            raise CypherError(f"{call.name} takes one argument")
        (e,) = call.arguments
        if call.name == "COUNT":
            return F.count(F.lit(1)) if isinstance(e, Star) else F.count(F.when(~self.null(e), 1))
        column, kind = self.value(e)
        if call.name == "COLLECT":
            return F.sort_array(F.collect_list(column))
        if call.name not in AGGREGATES:
            raise CypherError(f"unknown function {call.name}")
        return AGGREGATES[call.name](self.number(e) if kind == "any" and call.name in ("SUM", "AVG", "MIN", "MAX") else column)

    def run(self, q: Query) -> DataFrame:
        df = self.match(q)
        names = [n for _, n in q.items]
        if len(set(names)) < len(names):
            raise CypherError("two columns have one name")
        grouped = any(isinstance(e, Call) for e, _ in q.items)
        if grouped:
            keys = [self.value(e)[0].alias(n) for e, n in q.items if not isinstance(e, Call)]
            df = df.groupBy(*keys).agg(*(self.aggregate(e).alias(n) for e, n in q.items if isinstance(e, Call))).select(*(F.col(f"`{n}`") for n in names))
        order = []
        for e, down in q.order:
            name = next((n for x, n in q.items if x == e or (isinstance(e, Variable) and e.name == n)), None)
            if name is not None and (grouped or not isinstance(e, Property)):
                column = F.col(f"`{name}`") if grouped else self.value(next(x for x, n in q.items if n == name))[0]
            elif grouped:
                raise CypherError("ORDER BY takes returned columns after an aggregate")
            else:
                column = self.value(e)[0]
            order.append(column.desc_nulls_last() if down else column.asc_nulls_first())  # nulls are smallest
        if order:
            df = df.orderBy(*order)
        if not grouped:
            df = df.select(*(self.value(e)[0].alias(n) for e, n in q.items))
        return df if q.limit is None else df.limit(q.limit)


def cypher(g: Graph, text: str) -> DataFrame:
    """The rows of a query. Order holds until the result is transformed further."""
    return _Compiler(g).run(parse(text))


@dataclass(frozen=True)
class Step:
    operator: str
    detail: str
    rows: int | None = None


def explain(g: Graph, text: str, count: bool = False) -> list[Step]:
    """The operators of a query in the order in which they work; with count the rows after scans and expansions, each
    counted by itself."""
    q, compiler = parse(text), _Compiler(g)
    labels = lambda p: f"({p.variable or ''}{''.join(':' + x for x in p.labels)})"
    after = lambda part: compiler.__class__(g).match(part).count() if count else None
    first = Query(q.start, (), None, q.items, (), None)
    out = [Step("NodeScan", labels(q.start), after(first))]
    for k, (rel, node) in enumerate(q.chain):
        arrow = {"out": "-[{}]->", "in": "<-[{}]-", "both": "-[{}]-"}[rel.direction].format(("|".join(rel.types) and ":" + "|".join(rel.types)) + (f"*{rel.hops[0]}..{rel.hops[1]}" if rel.hops else ""))
        out.append(Step("VarLengthExpand" if rel.hops else "Expand", arrow + labels(node), after(Query(q.start, q.chain[: k + 1], None, q.items, (), None))))
    if q.where is not None:
        out.append(Step("Filter", shown(q.where), after(Query(q.start, q.chain, q.where, q.items, (), None))))
    names = ", ".join(n for _, n in q.items)
    aggregate = any(isinstance(e, Call) for e, _ in q.items)
    if aggregate:
        out.append(Step("Aggregate", names))
    if q.order:
        out.append(Step("Sort", ", ".join(name_of(e) + (" DESC" if down else "") for e, down in q.order)))
    if not aggregate:
        out.append(Step("Project", names))
    return out if q.limit is None else [*out, Step("Limit", str(q.limit))]


def shown(e: Any) -> str:
    """A condition as text."""
    match e:
        case Op("NOT", (a,)):
            return f"NOT ({shown(a)})"
        case Op("IS NULL" | "IS NOT NULL" as op, (a,)):
            return f"{shown(a)} {op}"
        case Op(op, (a, b)):
            return f"({shown(a)} {({'STARTS': 'STARTS WITH', 'ENDS': 'ENDS WITH'}).get(op, op)} {shown(b)})"
        case Literal(v) if isinstance(v, str):
            return repr(v)
    return name_of(e)


def type_names(text: str) -> tuple[set[str], set[str]]:
    """The node and the edge types that a query names."""
    q = parse(text)
    return {x for p in (q.start, *(n for _, n in q.chain)) for x in p.labels}, {x for r, _ in q.chain for x in r.types}
