"""Guarantees: named Datalog rules over a graph, with severities and the files they govern."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import glob_pattern
from ..graph import Graph
from ..plans.datalog import parse_program, violations


# Codes of diagnostics by category.
CATEGORIES = {
    "connectivity": ("ERR_DISCONNECTED_NODES", "ERR_DISCONNECTED_NODE"),
    "calls": ("ERR_UNRESOLVED_CALL",),
    "dataflow": ("ERR_MISSING_ASSIGNMENT", "ERR_BROKEN_REFERENCE", "ERR_NO_LEAF_NODE"),
    "imports": ("ERR_BROKEN_IMPORT", "ERR_UNDEFINED_SYMBOL"),
}


def issues_of(issues: DataFrame, category: str) -> DataFrame:
    """Rows of diagnostics (column code) of a category."""
    return issues.where(F.col("code").isin(*CATEGORIES[category]))


@dataclass(frozen=True)
class Guarantee:
    id: str
    name: str
    rule: str
    severity: str = "error"
    governs: tuple[str, ...] = ()

    @property
    def types(self) -> set[str]:
        """Node and edge types that the rule names."""
        return {t.text for r in parse_program(self.rule) for x in r.body for i, t in enumerate(x.terms) if t.kind == "const" and (x.predicate, i) in {("node", 1), ("type", 1), ("edge", 2), ("incoming", 2)}}


def check(g: Graph, guarantee: Guarantee) -> DataFrame:
    """(guarantee, severity, id, node_type, name, file) of the violations."""
    return violations(g, guarantee.rule).select(F.lit(guarantee.id).alias("guarantee"), F.lit(guarantee.severity).alias("severity"), "id", "node_type", "name", "file")


def check_all(g: Graph, guarantees: Iterable[Guarantee]) -> DataFrame:
    parts = [check(g, x) for x in guarantees]
    return reduce(DataFrame.union, parts) if parts else g.nodes.limit(0).select(F.lit("").alias("guarantee"), F.lit("").alias("severity"), "id", "node_type", "name", "file")


def affected_by(guarantees: Iterable[Guarantee], changed_types: Iterable[str]) -> list[Guarantee]:
    """Those whose rules name a changed type, or a prefix that covers one, or no type at all."""
    changed = set(changed_types)

    def hit(x: Guarantee) -> bool:
        return not x.types or any(t in changed or t.endswith("*") and any(c.startswith(t[:-1]) for c in changed) for t in x.types)

    return [x for x in guarantees if hit(x)]


def check_selective(g: Graph, guarantees: Iterable[Guarantee], changed_types: Iterable[str]) -> DataFrame:
    return check_all(g, affected_by(guarantees, changed_types))


def summary(g: Graph, guarantees: Iterable[Guarantee]) -> DataFrame:
    """(guarantee, severity, violations, passed), guarantees without violations too."""
    rules = list(guarantees)
    names = g.spark.createDataFrame([(x.id, x.severity) for x in rules], "guarantee string, severity string")
    found = check_all(g, rules).groupBy("guarantee").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return names.join(F.broadcast(found), "guarantee", "left").select("guarantee", "severity", n.alias("violations"), (n == 0).alias("passed"))  # one row a rule


def governs_edges(g: Graph, guarantees: Iterable[Guarantee]) -> DataFrame:
    """(src, dst, edge_type, metadata): a GOVERNS edge from a guarantee to each module whose file a glob matches."""
    parts = []
    for x in guarantees:
        hit = reduce(lambda a, b: a | b, (F.col("file").rlike(glob_pattern(p)) for p in x.governs), F.lit(False))
        parts.append(g.nodes.where((F.col("node_type") == "MODULE") & hit).select(F.lit(x.id).alias("src"), F.col("id").alias("dst")))
    return reduce(DataFrame.union, parts).select("src", "dst", F.lit("GOVERNS").alias("edge_type"), F.lit(None).cast("string").alias("metadata"))


def affected_guarantees(g: Graph, node_id: str) -> DataFrame:
    """(guarantee): those that govern the module of a node's file."""
    own = g.nodes.where(F.col("id") == node_id).select("file")
    modules = g.nodes.where("node_type = 'MODULE'").join(own, "file", "left_semi").select(F.col("id").alias("dst"))
    return g.edges.where("edge_type = 'GOVERNS'").join(modules, "dst", "left_semi").select(F.col("src").alias("guarantee")).distinct()


def drift(in_graph: DataFrame, in_file: DataFrame) -> DataFrame:
    """(id, state) of two rule tables (id, rule, severity): only_in_graph, only_in_file, modified or unchanged."""
    a = in_graph.select("id", F.struct("rule", "severity").alias("a"))
    b = in_file.select("id", F.struct("rule", "severity").alias("b"))
    both = a.join(b, "id", "full_outer")
    return both.select("id", F.when(F.col("b").isNull(), "only_in_graph").when(F.col("a").isNull(), "only_in_file").when(F.col("a") != F.col("b"), "modified").otherwise("unchanged").alias("state"))


def export(guarantees: Iterable[Guarantee]) -> str:
    return json.dumps([asdict(x) for x in guarantees], indent=2)


def load(text: str) -> list[Guarantee]:
    return [Guarantee(**(x | {"governs": tuple(x.get("governs", ()))})) for x in json.loads(text)]


# --- YAML -----------------------------------------------------------------------------------------------------------


def _quoted(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)  # a JSON string is a YAML string


def export_yaml(guarantees: Iterable[Guarantee]) -> str:
    """A YAML document: version and guarantees, rules of several lines as blocks."""
    out = ["version: 1", "guarantees:"]
    for x in guarantees:
        out += [f"  - id: {_quoted(x.id)}", f"    name: {_quoted(x.name)}"]
        block = "\n" in x.rule and x.rule == x.rule.strip() and not any(c in x.rule for c in "\t\r")
        out += ["    rule: |-", *(f"      {line}".rstrip() for line in x.rule.split("\n"))] if block else [f"    rule: {_quoted(x.rule)}"]
        out += [f"    severity: {_quoted(x.severity)}", *(["    governs:", *(f"      - {_quoted(p)}" for p in x.governs)] if x.governs else ["    governs: []"])]
    return "\n".join(out) + "\n"


def _scalar(text: str) -> str:
    text = text.strip()
    if text[:1] == '"' and text[-1:] == '"' and len(text) > 1:
        return json.loads(text)
    if text[:1] == "'" and text[-1:] == "'" and len(text) > 1:
        return text[1:-1].replace("''", "'")
    return text.split(" #")[0].rstrip()


def load_yaml(text: str) -> list[Guarantee]:
    """Guarantees from the subset of YAML that such files use: a list of maps with texts, blocks (| or >, with - or +)
    and lists of texts, in either style."""
    lines, found, key, at = text.split("\n"), [], None, 0
    while at < len(lines):
        raw = lines[at]
        at += 1
        line, indent = raw.strip(), len(raw) - len(raw.lstrip())
        if not line or line.startswith("#") or indent == 0 and not line.startswith("-"):
            continue
        if line.startswith("- ") and ":" in line.split('"')[0].split("'")[0]:  # a new guarantee
            found.append({})
            line, indent = line[2:].strip(), indent + 2
        elif line.startswith("-"):
            found[-1].setdefault(key, []).append(_scalar(line[1:]))
            continue
        key, _, value = line.partition(":")
        key, value = _scalar(key), value.strip()
        if value[:1] in ("|", ">"):
            body = []
            while at < len(lines) and (not lines[at].strip() or len(lines[at]) - len(lines[at].lstrip()) > indent):
                body.append(lines[at])
                at += 1
            while body and not body[-1].strip():
                body.pop()
            margin = min((len(x) - len(x.lstrip()) for x in body if x.strip()), default=0)
            found[-1][key] = ("\n" if value[0] == "|" else " ").join(x[margin:] for x in body)
        elif value[:1] == "[":
            found[-1][key] = [_scalar(x) for x in value.strip("[]").split(",") if x.strip()]
        elif value:
            found[-1][key] = _scalar(value)
    names = {"id", "name", "rule", "severity", "governs"}
    return [Guarantee(**({"name": x["id"]} | {k: tuple(v) if k == "governs" else v for k, v in x.items() if k in names})) for x in found]


def as_nodes(g: Graph, guarantees: Iterable[Guarantee]) -> Graph:
    """Guarantees as GUARANTEE nodes, their rules and severities in the metadata, with GOVERNS edges to modules."""
    rules = list(guarantees)
    rows = [(f"GUARANTEE:{x.id}", "GUARANTEE", x.name, None, None, None, json.dumps({"rule": x.rule, "severity": x.severity, "governs": list(x.governs)})) for x in rules]
    nodes = g.spark.createDataFrame(rows, g.nodes.schema)
    edges = governs_edges(g, rules) if rules else g.edges.limit(0)
    return Graph(nodes, edges.withColumn("src", F.concat(F.lit("GUARANTEE:"), "src")).select(*g.edges.columns))


def stored(g: Graph) -> list[Guarantee]:
    """The guarantees that a graph holds as nodes, by id."""
    found = []
    for r in g.nodes.where("node_type = 'GUARANTEE'").select("id", "name", "metadata").orderBy("id").collect():  # rules are few
        meta = json.loads(r["metadata"])
        found.append(Guarantee(r["id"].removeprefix("GUARANTEE:"), r["name"], meta["rule"], meta.get("severity", "error"), tuple(meta.get("governs", ()))))
    return found


def create(g: Graph, guarantee: Guarantee) -> Graph:
    """The graph with a guarantee added or replaced; its rule is checked first."""
    parse_program(guarantee.rule)
    new, old = as_nodes(g, [guarantee]), delete(g, guarantee.id)
    return Graph(old.nodes.unionByName(new.nodes), old.edges.unionByName(new.edges))


def delete(g: Graph, guarantee_id: str) -> Graph:
    """The graph without a guarantee and its GOVERNS edges."""
    key = "GUARANTEE:" + guarantee_id.removeprefix("GUARANTEE:")
    return Graph(g.nodes.where(F.col("id") != key), g.edges.where(~((F.col("src") == key) & (F.col("edge_type") == "GOVERNS"))))
