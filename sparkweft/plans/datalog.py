"""Datalog over a property graph, compiled to DataFrames.

Conjunction is a natural join, negation an anti join, several rules with one head a union; predicates are sets.
node and attr literals on one variable are read in a single scan of the nodes. Recursive predicates are stratified and
run as a semi-naive fixpoint. All values are text. A wildcard is an unnamed variable, also under negation.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import json_attribute, node_attribute, type_matches
from ..graph import Graph
from ..operators.traverse import closure, steps, upward
from ..scratch import settled


class DatalogError(ValueError):
    """The program cannot be read, is unsafe or cannot be ordered or stratified."""


@dataclass(frozen=True)
class Term:
    """kind: var, const or any (a wildcard)."""

    kind: str
    text: str = ""


@dataclass(frozen=True)
class Literal:
    predicate: str
    terms: tuple[Term, ...]
    positive: bool = True

    @property
    def variables(self) -> set[str]:
        return {t.text for t in self.terms if t.kind == "var"}


@dataclass(frozen=True)
class Rule:
    head: Literal
    body: tuple[Literal, ...]


# --- syntax ---------------------------------------------------------------------------------------------------------

_TOKENS = re.compile(r'(?:\s|%[^\n]*)*(?:(?P<text>"[^"]*"|\'[^\']*\')|(?P<word>[A-Za-z_]\w*)|(?P<mark>:-|\?-|\\\+|[(),.;]))')


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens, at = [], 0
        text = re.sub(r"(?:\s|%[^\n]*)+\Z", "", text)
        while at < len(text):
            m = _TOKENS.match(text, at)
            if not m:
                raise DatalogError(f"unexpected {text[at : at + 12].strip()!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, mark: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at] == ("mark", mark)

    def take(self, mark: str) -> bool:
        if self.peek(mark):
            self.at += 1
            return True
        return False

    def need(self, mark: str) -> None:
        if not self.take(mark):
            raise DatalogError(f"{mark!r} expected, not {self.tokens[self.at][1] if self.at < len(self.tokens) else 'the end'!r}")

    def word(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "word":
            raise DatalogError("a name is expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def program(self) -> list[Rule]:
        rules: list[Rule] = []
        while self.at < len(self.tokens):
            head = self.atom(True)
            bodies = self.either() if self.take(":-") else [()]
            self.need(".")
            rules += [Rule(head, b) for b in bodies]
        return rules

    def query(self) -> list[tuple[Literal, ...]]:
        self.take("?-")
        bodies = self.either()
        self.take(".")
        if self.at < len(self.tokens):
            raise DatalogError(f"unexpected {self.tokens[self.at][1]!r}")
        return bodies

    def either(self) -> list[tuple[Literal, ...]]:
        """The disjuncts of a body, each a conjunction."""
        out = self.all()
        while self.take(";"):
            out += self.all()
        return out

    def all(self) -> list[tuple[Literal, ...]]:
        parts = [self.goal()]
        while self.take(","):
            parts.append(self.goal())
        return [sum(p, ()) for p in product(*parts)]

    def goal(self) -> list[tuple[Literal, ...]]:
        if self.take("("):
            inner = self.either()
            self.need(")")
            return inner
        return [(self.atom(not self.take("\\+")),)]

    def atom(self, positive: bool) -> Literal:
        name, terms = self.word(), []
        if self.take("("):
            while not self.take(")"):
                terms.append(self.term())
                if not self.peek(")"):
                    self.need(",")
        return Literal(name, tuple(terms), positive)

    def term(self) -> Term:
        if self.at >= len(self.tokens):
            raise DatalogError("a term is expected")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "text":
            return Term("const", value[1:-1])
        if kind != "word":
            raise DatalogError(f"unexpected {value!r}")
        if value == "_":
            return Term("any")
        return Term("var" if value[0].isupper() or value[0] == "_" else "const", value)


def parse_program(text: str) -> list[Rule]:
    """Rules and facts; each is checked for safety."""
    rules = _Parser(text).program()
    for r in rules:
        bound = set().union(*(x.variables for x in r.body if x.positive))
        if any(t.kind == "any" for t in r.head.terms) or not r.head.variables <= bound:
            raise DatalogError(f"unsafe rule: every variable of {r.head.predicate} must occur in a positive literal of its body")
    return rules


def parse_query(text: str) -> list[tuple[Literal, ...]]:
    return _Parser(text).query()


# --- order ----------------------------------------------------------------------------------------------------------

#: Built-in predicates: number of terms, and the terms that must be bound before.
BUILT_IN: dict[str, tuple[int, tuple[int, ...]]] = {
    "node": (2, ()), "type": (2, ()), "attr": (3, (1,)), "attr_edge": (5, (3,)), "edge": (3, ()), "incoming": (3, ()), "path": (2, (0,)),
    "parent_function": (2, (0,)), "neq": (2, (0, 1)), "eq": (2, (0, 1)), "starts_with": (2, (0, 1)), "not_starts_with": (2, (0, 1)), "string_contains": (2, (0, 1)),
}
_TESTS = {
    "neq": lambda x, y: x != y,
    "eq": lambda x, y: x == y,
    "starts_with": lambda x, y: x.startswith(y),
    "not_starts_with": lambda x, y: ~x.startswith(y),
    "string_contains": lambda x, y: x.contains(y),
}


def ordered(body: Iterable[Literal]) -> list[Literal]:
    """The body in an order in which every literal finds bound what it needs; the first that fits goes first."""
    rest, out, bound = list(body), [], set()
    while rest:
        for x in rest:
            needs = BUILT_IN.get(x.predicate, (0, ()))[1]
            wanted = x.variables if not x.positive else {x.terms[i].text for i in needs if x.terms[i].kind == "var"}
            if wanted <= bound:
                break
        else:
            raise DatalogError(f"no order binds the variables of {', '.join(x.predicate for x in rest)}")
        rest.remove(x)
        out.append(x)
        bound |= x.variables if x.positive else set()
    return out


# --- evaluation -----------------------------------------------------------------------------------------------------


@dataclass
class Plan:
    """What a query did: its literals in order, warnings and, where asked for, the rows after each."""

    steps: list[str] = field(default_factory=list)
    rows: list[int] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


class Datalog:
    """A graph, a set of rules and the relations derived so far."""

    def __init__(self, g: Graph, program: str = "") -> None:
        self.g, self.rules, self.tables = g, [], {}
        self.plan = Plan()
        self.count = False
        self.load(program)

    def load(self, program: str) -> None:
        """Add rules; relations derived before are derived anew."""
        for r in parse_program(program):
            if r.head.predicate in BUILT_IN:
                raise DatalogError(f"{r.head.predicate} is built in")
            self.rules.append(r)
        self.tables = {}
        sizes: dict[str, int] = {}
        for r in self.rules:
            if sizes.setdefault(r.head.predicate, len(r.head.terms)) != len(r.head.terms):
                raise DatalogError(f"{r.head.predicate} has rules of unlike lengths")

    def clear(self) -> None:
        self.rules, self.tables = [], {}

    def query(self, text: str) -> DataFrame:
        """The distinct bindings of a query's variables; without any, one row if it holds (column holds)."""
        bodies = parse_query(text)
        names = list(dict.fromkeys(t.text for x in bodies[0] for t in x.terms if x.positive and t.kind == "var"))
        parts = [self.solve(b) for b in bodies]
        if not names:
            return reduce(DataFrame.union, (p.select(F.lit(True).alias("holds")) for p in parts)).limit(1)
        if any(not set(names) <= set(p.columns) for p in parts):
            raise DatalogError("the sides of ';' bind different variables")
        return reduce(DataFrame.union, (p.select(*names) for p in parts)).distinct()

    def relation(self, predicate: str) -> DataFrame:
        """A derived predicate's tuples, columns a0, a1, ..."""
        if predicate not in self.tables:
            self._derive(predicate)
        return self.tables[predicate]

    def explain(self, text: str) -> tuple[DataFrame, Plan]:
        """A query's rows and its plan with the rows after each literal; counting runs every step by itself."""
        self.plan, self.count = Plan(), True
        try:
            return self.query(text), self.plan
        finally:
            self.count = False

    # derivation

    def _uses(self, p: str) -> set[str]:
        return {x.predicate for r in self.rules if r.head.predicate == p for x in r.body if x.predicate not in BUILT_IN}

    def _reach(self, p: str) -> set[str]:
        out, todo = set(), [p]
        while todo:
            for q in self._uses(todo.pop()) - out:
                out.add(q)
                todo.append(q)
        return out

    def _derive(self, p: str) -> None:
        if not any(r.head.predicate == p for r in self.rules):
            raise DatalogError(f"{p} has no rule")
        group = {q for q in self._reach(p) | {p} if p in self._reach(q) and q in self._reach(p)}
        own = [r for r in self.rules if r.head.predicate in (group or {p})]
        if any(x.predicate in group and not x.positive for r in own for x in r.body):
            raise DatalogError(f"{p} depends on its own negation")
        if not group:
            self.tables[p] = reduce(DataFrame.union, (self._head(r, {}) for r in own)).distinct()
            return
        empty = {q: self._empty(len(next(r.head.terms for r in own if r.head.predicate == q))) for q in group}
        parts: dict[str, list[DataFrame]] = {q: [] for q in group}
        fresh: dict[str, DataFrame] = {}
        base = [r for r in own if not any(x.predicate in group for x in r.body)]
        for q in group:
            rows = [self._head(r, {}) for r in base if r.head.predicate == q]
            fresh[q] = settled(reduce(DataFrame.union, rows).distinct(), "fix") if rows else empty[q]
        for _ in range(1000):
            live = {q for q in group if not fresh[q].isEmpty()}
            for q in live:
                parts[q].append(fresh[q])
                if len(parts[q]) > 8:  # few files to read again in each round
                    parts[q] = [settled(reduce(DataFrame.union, parts[q]), "fix")]
            known = {q: reduce(DataFrame.union, parts[q]) if parts[q] else empty[q] for q in group}
            if not live:
                self.tables |= known
                return
            grown: dict[str, list[DataFrame]] = {q: [] for q in group}
            for r in own:
                for i, x in enumerate(r.body):
                    if x.predicate in live:  # this occurrence reads what is new, the others all that is known
                        tables = {j: known[y.predicate] for j, y in enumerate(r.body) if y.predicate in group} | {i: fresh[x.predicate]}
                        grown[r.head.predicate].append(self._head(r, tables))
            fresh = {q: settled(reduce(DataFrame.union, grown[q]).distinct().join(known[q], known[q].columns, "left_anti"), "fix") if grown[q] else empty[q] for q in group}
        raise DatalogError(f"{p} reaches no fixpoint")

    def _empty(self, n: int) -> DataFrame:
        return self.g.spark.createDataFrame([], ", ".join(f"a{i} string" for i in range(n)))

    def _head(self, r: Rule, tables: dict[int, DataFrame]) -> DataFrame:
        df = self.solve(r.body, tables)
        return df.select(*((F.col(t.text) if t.kind == "var" else F.lit(t.text)).alias(f"a{i}") for i, t in enumerate(r.head.terms)))

    # bodies

    def solve(self, body: tuple[Literal, ...], tables: dict[int, DataFrame] | None = None) -> DataFrame:
        """The bindings of a conjunction: one column for each variable of its positive literals."""
        for x in body:
            if x.predicate in BUILT_IN and len(x.terms) != BUILT_IN[x.predicate][0]:
                raise DatalogError(f"{x.predicate} takes {BUILT_IN[x.predicate][0]} terms")
        given = {id(x): t for i, t in (tables or {}).items() for x in [body[i]]}
        todo, df = ordered(body), None
        while todo:
            x = todo.pop(0)
            bound = set(df.columns) if df is not None else set()
            if not x.positive:
                df = self._without(df, x)
            elif x.predicate in _TESTS:
                test = _TESTS[x.predicate](*(self._of(t) for t in x.terms))
                df = self._unit().where(test) if df is None else df.where(test)
            else:
                if x.predicate in ("node", "type", "attr") and x.terms[0].kind == "var":
                    same = [y for y in todo if y.positive and y.predicate in ("node", "type", "attr") and y.terms[0] == x.terms[0]]
                    todo = [y for y in todo if y not in same]
                    found = self._scan(x.terms[0], [x, *same])
                else:
                    found = self._atom(x, df, given.get(id(x)))
                shared = sorted(bound & set(found.columns))
                df = found if df is None else df.join(found, shared) if shared else df.crossJoin(found)  # no shared variable: the product is what the rule asks for
            self.plan.steps.append(("" if x.positive else "\\+ ") + x.predicate)
            if self.count:
                self.plan.rows.append(df.count())
        return self._unit() if df is None else df

    def _unit(self) -> DataFrame:
        return self.g.spark.range(1).select()

    @staticmethod
    def _of(t: Term) -> Column:
        return F.col(t.text) if t.kind == "var" else F.lit(t.text)

    @staticmethod
    def _bind(df: DataFrame, terms: Iterable[Term], columns: Iterable[Column]) -> DataFrame:
        """df with its columns named by variables: constants and repeated variables become tests."""
        names: dict[str, Column] = {}
        for t, c in zip(terms, columns, strict=True):
            if t.kind == "const":
                df = df.where(c == t.text)
            elif t.kind == "var":
                if t.text in names:
                    df = df.where(c == names[t.text])
                else:
                    names[t.text] = c
        return df.where(reduce(lambda a, b: a & b, (c.isNotNull() for c in names.values()))).select(*(c.alias(v) for v, c in names.items())) if names else df.select()

    def _scan(self, x: Term, literals: list[Literal]) -> DataFrame:
        """node and attr literals on one variable: a single scan of the nodes."""
        df, terms, columns = self.g.nodes, [x], [F.col("id")]
        for y in literals:
            if y.predicate == "attr":
                value, column = y.terms[2], self._named(y.terms[1])
                if value.kind == "any":
                    df = df.where(column.isNotNull())
            else:
                value, column = y.terms[1], F.col("node_type")
                if value.kind == "const" and value.text.endswith("*"):
                    df = df.where(type_matches(column, value.text))
                    continue
            terms.append(value)
            columns.append(column)
        if x.kind == "any" or not any(y.predicate != "attr" and y.terms[1].kind == "const" for y in literals):
            self.plan.warnings.append("Full node scan")
        return self._bind(df, terms, columns)

    @staticmethod
    def _named(t: Term) -> Column:
        if t.kind != "const":
            raise DatalogError("the attribute's name must be a constant")
        return node_attribute(t.text)

    def _atom(self, x: Literal, df: DataFrame | None, given: DataFrame | None) -> DataFrame:
        t = x.terms
        match x.predicate:
            case "node" | "type" | "attr":
                return self._scan(t[0], [x]).distinct()
            case "edge" | "incoming":
                if t[2].kind != "const":
                    self.plan.warnings.append("Full edge scan")
                ends = ("src", "dst") if x.predicate == "edge" else ("dst", "src")
                found = self._bind(self.g.edges, t, [F.col(ends[0]), F.col(ends[1]), F.col("edge_type")])
                return found.distinct() if any(y.kind == "any" for y in t) else found
            case "attr_edge":
                if t[3].kind != "const":
                    raise DatalogError("the attribute's name must be a constant")
                value = json_attribute(F.col("metadata"), t[3].text)
                return self._bind(self.g.edges.where(value.isNotNull()), [*t[:3], t[4]], [F.col("src"), F.col("dst"), F.col("edge_type"), value]).distinct()
            case "path" | "parent_function":
                if t[0].kind == "any":
                    raise DatalogError(f"{x.predicate} needs its first term bound")
                seeds = (df.select(F.col(t[0].text).alias("origin")) if t[0].kind == "var" else self.g.spark.createDataFrame([(t[0].text,)], "origin string")).distinct()
                seeds = seeds.select("origin", F.col("origin").alias("node"))
                found = closure(seeds, self.g.edges) if x.predicate == "path" else parent_functions(self.g, seeds)
                return self._bind(found, t, [F.col("origin"), F.col("node")]).distinct()
        table = given if given is not None else self.relation(x.predicate)
        if len(table.columns) != len(t):
            raise DatalogError(f"{x.predicate} has {len(table.columns)} terms")
        return self._bind(table, t, [F.col(c) for c in table.columns]).distinct()

    def _without(self, df: DataFrame | None, x: Literal) -> DataFrame:
        if x.predicate in _TESTS:
            return df.where(~_TESTS[x.predicate](*(self._of(t) for t in x.terms)))
        found = self._atom(Literal(x.predicate, x.terms), df, None)
        df = self._unit() if df is None else df
        shared = sorted(x.variables)
        return df.join(found, shared, "left_anti") if shared else df.join(found.select(F.lit(1).alias("_one")).limit(1), F.lit(True), "left_anti")


#: The edges that hold a scope's content, and the types that end the climb to a function.
SCOPE_EDGES, SCOPE_ENDS = ("CONTAINS", "HAS_SCOPE", "DECLARES"), ("MODULE", "CLASS")


def parent_functions(g: Graph, seeds: DataFrame) -> DataFrame:
    """(origin, node): the nearest FUNCTION that holds each seed; a PARAMETER's is the one that has it as parameter."""
    parameters = g.nodes.where("node_type = 'PARAMETER'").select(F.col("id").alias("origin"))
    own = seeds.join(parameters, "origin", "left_semi")
    held = own.join(steps(g.edges, "in", ["HAS_PARAMETER"]), F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node"))
    direct = held.join(g.nodes.where("node_type = 'FUNCTION'").select(F.col("id").alias("node")), "node", "left_semi").groupBy("origin").agg(F.min("node").alias("node"))
    rest = seeds.join(parameters, "origin", "left_anti")
    node_type = F.col("node_type")
    return direct.union(upward(rest, g, SCOPE_EDGES, node_type == "FUNCTION", node_type.isin(*SCOPE_ENDS), 20).select("origin", "node"))


def violations(g: Graph, program: str, predicate: str = "violation") -> DataFrame:
    """What a guarantee's rules derive: (id, node_type, name, file) where the first term is a node, else the term alone."""
    found = Datalog(g, program).relation(predicate).select(F.col("a0").alias("id")).distinct()
    return found.join(g.nodes.select("id", "node_type", "name", "file"), "id", "left")
