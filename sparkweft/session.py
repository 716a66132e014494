"""One handle on a graph database: queries in either language with hints, rules, limits, batches and plug-ins."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.attributes import json_attribute
from .graph import Graph
from .operators.code_queries import similar_names
from .operators.primitives import page
from .operators.store import Store, commit_batch, in_order
from .plans.cypher import cypher, type_names
from .plans.cypher import explain as cypher_explain
from .plans.datalog import Datalog, parse_query


#: Queries that a session remembers.
LOGGED = 10_000


@dataclass
class Answer:
    rows: DataFrame
    more: bool = False
    count: int | None = None
    hints: list[str] = field(default_factory=list)
    plan: object = None


class QueryTimeout(RuntimeError):
    """The query took longer than it was allowed."""


class GraphSession:
    """A database of a store, open for reading or for both; rules live as long as the session."""

    def __init__(self, store: Store, name: str, read_only: bool = False) -> None:
        self.store, self.name, self.read_only = store, name, read_only
        self.rules = ""
        self.declared: dict[str, str] = {}
        self.plugins: dict[str, Callable[[Graph], Graph]] = {}
        self._batch: list[tuple[list[str], DataFrame, DataFrame, list[str]]] | None = None
        self._batch_tags: dict[str, str] = {}
        self.log: list[tuple[str, float, float]] = []

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    @property
    def graph(self) -> Graph:
        g = self.store.read(self.name)
        if self.declared:
            g = Graph(g.nodes.withColumns({f"field_{k}": json_attribute(F.col("metadata"), k).cast(t) for k, t in self.declared.items()}), g.edges)
        return g

    def declare_fields(self, **types: str) -> None:
        """Metadata keys that are shown as typed columns field_<key>."""
        self.declared |= types

    def load_rules(self, program: str) -> None:
        Datalog(self.graph, self.rules + "\n" + program)  # checked before they are kept
        self.rules += "\n" + program

    def clear_rules(self) -> None:
        self.rules = ""

    def query(self, text: str, language: str = "datalog", limit: int = 10, offset: int = 0, count: bool = False, explain: bool = False, seconds: float | None = None) -> Answer:
        """A page of the rows of a query, or their number; hints where there are none."""
        began = time.time()
        try:
            return self._answer(text, language, limit, offset, count, explain, seconds)
        finally:
            self.log.append((text, 1000 * (time.time() - began), began))
            del self.log[:-LOGGED]

    def query_log(self) -> DataFrame:
        """(query, ms, at) of the last LOGGED queries: for latency_stats and slow_queries."""
        return self.spark.createDataFrame(self.log, "query string, ms double, at double")

    def _answer(self, text: str, language: str, limit: int, offset: int, count: bool, explain: bool, seconds: float | None) -> Answer:
        with self.limited(seconds):
            g, plan = self.graph, None
            if language == "cypher":
                df, plan = cypher(g, text), cypher_explain(g, text, True) if explain else None
            elif explain:
                df, plan = Datalog(g, self.rules).explain(text)
            else:
                df = Datalog(g, self.rules).query(text)
            if count:
                return Answer(df, count=df.count(), plan=plan)
            ordered = df if language == "cypher" else df.orderBy(*df.columns)
            # One page and the row after it: they are few, and so the limit on time covers them.
            found = ordered.offset(offset).limit(limit + 1).collect()
            out = Answer(self.spark.createDataFrame(found[:limit], df.schema), len(found) > limit, plan=plan)
            if not found:
                out.hints = self.hints(text, language)
            return out

    def hints(self, text: str, language: str = "datalog") -> list[str]:
        """"Did you mean": type names of a query that the graph lacks, and the nearest it has."""
        if language == "cypher":
            nodes, edges = type_names(text)
        else:
            named = lambda i, *predicates: {x.terms[i].text for body in parse_query(text) for x in body if x.predicate in predicates and x.terms[i].kind == "const"}
            nodes, edges = named(1, "node", "type"), named(2, "edge", "incoming")
        g, out = self.graph, []
        for column, df, wanted in (("node_type", g.nodes, nodes), ("edge_type", g.edges, edges)):
            for name in sorted(wanted):
                near = [r[0] for r in similar_names(df, name, column).limit(3).collect()]
                if name not in near:
                    out.append(f"no {column} {name!r}" + (f"; did you mean {', '.join(near)}?" if near else ""))
        return out

    @contextmanager
    def limited(self, seconds: float | None):  # noqa: ANN201
        """Cancel the session's jobs after a time."""
        if seconds is None:
            yield
            return
        sc, hit = self.spark.sparkContext, threading.Event()
        group = f"limit-{id(self)}-{threading.get_ident()}"
        sc.setJobGroup(group, "limited query", interruptOnCancel=True)

        def stop() -> None:
            hit.set()
            sc.cancelJobGroup(group)

        timer = threading.Timer(seconds, stop)
        timer.start()
        try:
            yield
        except Exception as e:
            if hit.is_set():
                raise QueryTimeout(f"cancelled after {seconds} s") from e
            raise
        finally:
            timer.cancel()

    def page(self, df: DataFrame, limit: int = 10, offset: int = 0) -> tuple[DataFrame, bool]:
        return page(df, limit, offset)

    # writing

    def commit(self, changed_files: Iterable[str], nodes: DataFrame, edges: DataFrame, protected: Iterable[str] = (), **tags: str) -> DataFrame | None:
        """Replace what the files own in the newest snapshot; the node delta (id, node_type, change). Inside a batch
        the commit waits for its end: its protected types and tags count there too."""
        if self.read_only:
            raise PermissionError(f"{self.name} is open for reading")
        if self._batch is not None:
            self._batch.append((list(changed_files), nodes, edges, list(protected)))
            self._batch_tags |= tags
            return None
        return self.store.commit(self.name, changed_files, nodes, edges, protected, tags)[1]

    @contextmanager
    def batch(self, **tags: str):  # noqa: ANN201
        """Commits inside become one snapshot, as if made one after the other; an error, or abort(), leaves none."""
        if self._batch is not None:
            raise RuntimeError("a batch is open")
        self._batch, self._batch_tags = [], {}
        try:
            yield self
            waiting, self._batch = self._batch, None
            if waiting:
                files, nodes, edges, protected = in_order(waiting)
                self.store.commit(self.name, files, nodes, edges, protected, self._batch_tags | tags, "seq")
        finally:
            self._batch = None

    @property
    def pending(self) -> Graph:
        """The graph as the open batch's commits leave it: scans that see what is not written yet."""
        if not self._batch:
            return self.graph
        files, nodes, edges, protected = in_order(self._batch)
        old = self.store.read(self.name) if self.store.snapshots(self.name) else Graph(nodes.drop("seq").limit(0), edges.drop("seq").limit(0))
        return commit_batch(old, files, nodes, edges, protected, "seq").graph

    def abort(self) -> None:
        """Forget the commits of the open batch."""
        if self._batch is None:
            raise RuntimeError("no batch is open")
        self._batch, self._batch_tags = [], {}

    @property
    def is_batching(self) -> bool:
        return self._batch is not None

    def register(self, name: str, plugin: Callable[[Graph], Graph]) -> None:
        """A plug-in derives nodes and edges from the graph."""
        self.plugins[name] = plugin

    def enrich(self, name: str) -> DataFrame | None:
        """Run a plug-in and commit what it derives under its virtual file."""
        from .operators.store import enrichment_file

        found = self.plugins[name](self.graph)
        owner = enrichment_file(name, "all")
        edges = found.edges.withColumn("metadata", F.to_json(F.map_concat(F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>")), F.create_map(F.lit("__file_context"), F.lit(owner)))))
        return self.commit([owner], found.nodes.withColumn("file", F.lit(owner)), edges)
