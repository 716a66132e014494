"""Text views of small results: notation of a subgraph, and narratives of data-flow traces.

What is drawn is bounded before it reaches the driver: a level of detail around one node, or counts by file.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import Graph
from .operators.code_queries import subgraph, trace_dataflow

# What an edge type means - its archetype, and the verb that is written.
VERBS = {
    "contains": "CONTAINS=contains HAS_SCOPE=scopes HAS_MEMBER=has HAS_BODY=body HAS_PROPERTY=property HAS_ELEMENT=element HAS_INIT=init HAS_UPDATE=update HAS_CALLBACK=callback HAS_CATCH=catch HAS_FINALLY=finally DECLARES=declares DEFINES=defines MOUNTS=mounts PROPERTY_KEY=key PROPERTY_VALUE=value",
    "depends": "DEPENDS_ON=depends_on IMPORTS=imports IMPORTS_FROM=imports_from EXPORTS=exports USES=uses USES_CONFIG=uses_config USES_SECRET=uses_secret DEPLOYED_TO=deployed_to SCHEDULED_BY=scheduled_by",
    "flow_out": "CALLS=calls DELEGATES_TO=delegates_to ROUTES_TO=routes_to HANDLED_BY=handled_by MAKES_REQUEST=requests CALLS_API=calls_API INVOKES_FUNCTION=invokes PASSES_ARGUMENT=passes RETURNS=returns CALL_RETURNS=call_returns YIELDS=yields RESPONDS_WITH=responds_with INTERACTS_WITH=interacts_with ITERATES_OVER=iterates ASSIGNS_TO=assigns_to MODIFIES=modifies CAPTURES=captures FLOWS_INTO=flows_into UNKNOWN=unknown",
    "flow_in": "READS_FROM=reads RECEIVES_ARGUMENT=receives ASSIGNED_FROM=assigned_from DERIVES_FROM=derives_from SPREADS_FROM=spreads_from ELEMENT_OF=element_of KEY_OF=key_of DESTRUCTURED_FROM=destructured_from HTTP_RECEIVES=receives_HTTP EXTENDS=extends IMPLEMENTS=implements INSTANCE_OF=instance_of",
    "write": "WRITES_TO=writes LOGS_TO=logs_to PERFORMS_REDIS=redis",
    "exception": "THROWS=throws REJECTS=rejects CATCHES_FROM=catches_from",
    "publishes": "EMITS_EVENT=emits LISTENS_TO=listens_to PUBLISHES_TO=publishes_to SUBSCRIBES_TO=subscribes_to EXPOSED_VIA=exposed_via EXPOSES=exposes JOINS_ROOM=joins_room",
    "gates": "HAS_CONDITION=guards HAS_CONSEQUENT=then HAS_ALTERNATE=else HAS_CASE=case HAS_DEFAULT=default",
    "governs": "GOVERNS=governs VIOLATES=violates AFFECTS=affects MONITORED_BY=monitored_by MEASURED_BY=measured_by PROVISIONED_BY=provisioned_by REGISTERS_VIEW=registers_view",
}
# Operators by archetype, the order of archetypes, verbs that come last, and views by perspective.
OPERATORS = {"contains": "", "depends": "o-", "flow_out": ">", "flow_in": "<", "write": "=>", "exception": ">x", "publishes": "~>>", "gates": "?|", "governs": "|="}
ORDER = ("contains", "flow_in", "depends", "flow_out", "write", "publishes", "exception", "gates", "governs")
LAST = ("returns", "call returns", "yields", "responds with")
PERSPECTIVES = {"security": ("write", "exception"), "data": ("flow_out", "flow_in", "write"), "errors": ("exception",), "api": ("flow_out", "publishes", "depends"), "events": ("publishes",)}
FOLD_AT, TIERS = 3, (5, 30, 100, 300)

ARCHETYPES = {t: (a, v.replace("_", " ")) for a, text in VERBS.items() for t, v in (x.split("=") for x in text.split())}


def archetype(edge_type: str) -> tuple[str, str]:
    """(archetype, verb); unknown types flow out under their own name."""
    return ARCHETYPES.get(edge_type, ("flow_out", edge_type.lower().replace("_", " ")))


def archetype_column(edge_type: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for t, (a, _) in ARCHETYPES.items() for x in (t, a)))[edge_type], F.lit("flow_out"))


@dataclass(frozen=True)
class Line:
    operator: str
    verb: str
    targets: tuple[str, ...]


@dataclass(frozen=True)
class Block:
    id: str
    kind: str
    name: str
    lines: tuple[Line, ...] = ()
    children: tuple[Block, ...] = field(default=())


def _rank(a: str, verb: str) -> int:
    return len(ORDER) if verb in LAST else ORDER.index(a)


def build(nodes: dict[str, tuple[str, str]], edges: list[tuple[str, str, str]], root: str, depth: int, only: tuple[str, ...] | None = None) -> Block:
    """The block of a node: its other edges as lines by archetype, what it contains as children down to depth."""
    held, out = defaultdict(list), defaultdict(lambda: defaultdict(list))
    for src, dst, kind in edges:
        a, verb = archetype(kind)
        if a == "contains":
            held[src].append(dst)
        elif only is None or a in only:
            out[src][_rank(a, verb), OPERATORS[a], verb].append(nodes.get(dst, ("UNKNOWN", dst))[1])

    def block(i: str, left: int, seen: frozenset[str]) -> Block:
        kind, name = nodes.get(i, ("UNKNOWN", i))
        lines = tuple(Line(op, verb, tuple(dict.fromkeys(sorted(targets)))) for (_, op, verb), targets in sorted(out[i].items())) if left >= 0 else ()
        inner = tuple(block(c, left - 1, seen | {c}) for c in sorted(set(held[i])) if c not in seen) if left > 0 or i == root else ()
        return Block(i, kind, name, lines, inner)

    return block(root, depth, frozenset({root}))


def fold(blocks: tuple[Block, ...]) -> tuple[Block, ...]:
    """Siblings made shorter: doubles once; leaves of one kind together from FOLD_AT on; blocks with one line on the
    same targets as a group; the others keep their place and are folded inside."""
    richest: dict[str, Block] = {}
    for b in blocks:
        weight = lambda x: len(x.lines) + len(x.children) + sum(len(t.targets) for t in x.lines)
        if b.id not in richest or weight(b) > weight(richest[b.id]):
            richest[b.id] = b
    shape = lambda b: (b.kind, b.lines) if not b.children else None
    counts = Counter(shape(b) for b in richest.values())
    out, done = [], set()
    for b in richest.values():
        s = shape(b)
        if s is None or counts[s] < FOLD_AT:
            out.append(replace(b, children=fold(b.children)))
        elif s not in done:
            done.add(s)
            names = [x.name for x in richest.values() if shape(x) == s]
            out.append(Block(b.id, b.kind, f"{', '.join(names[:2])}, ... x{len(names)}", b.lines))
    return tuple(out)


def write(block: Block, budget: int = 7, indent: int = 0) -> str:
    pad = "  " * indent
    head = f"{pad}{block.kind} {block.name}"
    if not block.lines and not block.children:
        return head
    lines = [f"{head} {{"]
    for x in block.lines:
        shown = ", ".join(x.targets[:budget]) + (f", +{len(x.targets) - budget} more" if len(x.targets) > budget else "")
        lines.append(f"{pad}  {x.operator} {x.verb} {shown}")
    lines += [write(c, budget, indent + 1) for c in block.children[: budget * 3]]
    if len(block.children) > budget * 3:
        lines.append(f"{pad}  ... +{len(block.children) - budget * 3} more")
    return "\n".join([*lines, f"{pad}}}"])


def describe(g: Graph, root: str, depth: int = 1, perspective: str | None = None, budget: int = 7, most: int = 10_000) -> str:
    """Notation of a node at a level of detail 0 to 2; folded at 2. At most `most` edges are drawn."""
    part = subgraph(g, root, depth)
    edges = [tuple(r) for r in part.edges.select("src", "dst", "edge_type").orderBy("src", "dst", "edge_type").limit(most).collect()]
    drawn = {root, *(x for e in edges for x in e[:2])}  # of these at most 2 * most + 1
    known = part.nodes.select("id", "node_type", "name").join(g.spark.createDataFrame([(x,) for x in sorted(drawn)], "id string"), "id", "left_semi")
    nodes = {r["id"]: (r["node_type"], r["name"] or r["id"]) for r in known.collect()}
    block = build(nodes, edges, root, depth, PERSPECTIVES[perspective] if perspective else None)
    return write(replace(block, children=fold(block.children)) if depth == 2 else block, budget)


def trace_shape(files: dict[str, int], start: str | None) -> str:
    """chain, fan-out, fan-in or diamond, by how many nodes of a trace lie in which file."""
    total, n = sum(files.values()), len(files)
    if n <= 2 and total <= 10:
        return "chain"
    if n - (start in files) >= 3 and files.get(start, 0) <= 0.3 * total:
        return "fan-out"
    if n >= 3 and any(v > total / 2 for v in files.values()):
        return "fan-in"
    return "diamond" if n >= 4 else "chain"


def narrate(g: Graph, node_id: str, direction: str = "backward", max_depth: int = 10) -> str:
    """A trace in words: its shape, and by its size every node, the nodes by file, or counts by file."""
    found = trace_dataflow(g, node_id, direction, max_depth).where("depth > 0").select("id", "depth").distinct()
    placed = found.join(g.nodes.select("id", "name", "node_type", "file"), "id").cache()
    files = {r["file"] or "?": r["n"] for r in placed.groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()}
    start = g.nodes.where(F.col("id") == node_id).select("file").first()
    total = sum(files.values())
    shape = trace_shape(files, start["file"] if start else None)
    where = {"chain": "", "fan-out": f" across {len(files)} modules", "fan-in": f" from {len(files)} modules", "diamond": f" across {len(files)} modules"}[shape]
    lines = [f"{direction}: {shape}{where} ({total} nodes reached)"]
    tier = sum(total > t for t in TIERS)
    if tier <= 1:
        lines += [f"  {r['depth']}. {r['node_type']} {r['name'] or r['id']} ({r['file']})" for r in placed.orderBy("depth", "id").collect()]
    elif tier <= 2:
        names = placed.groupBy("file").agg(F.sort_array(F.collect_set(F.coalesce("name", "id"))).alias("names")).orderBy("file").collect()
        lines += [f"  {r['file']}: {', '.join(r['names'])}" for r in names]
    else:
        shown = sorted(files.items(), key=lambda x: (-x[1], x[0]))
        lines += [f"  {f}: {n}" for f, n in shown[: 20 if tier == 3 else 10]]
    placed.unpersist()
    return "\n".join(lines)


def by_archetype(edges: DataFrame) -> DataFrame:
    """(archetype, n) of edges."""
    return edges.groupBy(archetype_column(F.col("edge_type")).alias("archetype")).agg(F.count(F.lit(1)).alias("n"))
