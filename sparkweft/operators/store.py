"""Writing graphs: upserts, tombstones, per-file commits with deltas, compaction, snapshots and databases."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.attributes import json_attribute, parent_dir
from ..graph import EDGE_SCHEMA, NODE_SCHEMA, Graph

NODE_KEY, EDGE_KEY = ["id"], ["src", "dst", "edge_type"]
#: Deltas from which a compaction pays.
COMPACT_AT = 4


# --- upsert and delete ----------------------------------------------------------------------------------------------


def latest(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row of each key with the highest order. An aggregate, not a window: hot keys are combined before they are
    shuffled. Of equal orders the greatest row wins, so the choice does not depend on partitions."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(order.alias("_order"), *rest)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*(c if c in keys else F.col("_best")[c].alias(c) for c in df.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """old with new rows put in by key, the last write winning; seq orders the writes within new."""
    columns = old.columns
    order = F.col(seq) if seq else F.lit(0)
    both = old.withColumns({"_batch": F.lit(0), "_seq": F.lit(None).cast("long")}).unionByName(new.withColumns({"_batch": F.lit(1), "_seq": order.cast("long")}).select(*columns, "_batch", "_seq"))
    return latest(both, keys, F.struct("_batch", F.coalesce("_seq", F.lit(-1)))).select(*columns)


def without(df: DataFrame, tombstones: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(tombstones.select(*keys).distinct(), keys, "left_anti").select(*df.columns)


def merge(batches: DataFrame, tombstones: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Compaction: the newest row of each key, unless a tombstone is as new or newer. Both have the order column."""
    columns = [c for c in batches.columns if c != order]
    dead = tombstones.groupBy(*keys).agg(F.max(order).alias("_dead"))
    newest = latest(batches, keys, F.col(order))
    return newest.join(dead, keys, "left").where(f"_dead IS NULL OR _dead < {order}").select(*columns)


def should_compact(deltas: int, least: int = COMPACT_AT) -> bool:
    return deltas >= least


# --- commits --------------------------------------------------------------------------------------------------------


def enrichment_file(enricher: str, file: str) -> str:
    """The virtual file that owns what an enricher derived from a file."""
    return f"__enrichment__/{enricher}/{file}"


def edge_owner(metadata: Column) -> Column:
    """The file that a derived edge is filed under; null for edges owned by their source node."""
    return json_attribute(metadata, "__file_context")


def stamped(metadata: Column, generation: int, source: str) -> Column:
    """Metadata with _generation and _source set."""
    base = F.coalesce(F.from_json(metadata, "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(base, lambda k, _: ~k.isin("_generation", "_source"))
    return F.to_json(F.map_concat(kept, F.create_map(F.lit("_generation"), F.lit(str(generation)), F.lit("_source"), F.lit(source))))


@dataclass(frozen=True)
class Commit:
    graph: Graph
    delta: DataFrame


def node_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, node_type, change): added, removed or modified (another content_hash)."""
    a, b = old.select("id", F.col("node_type").alias("t0"), F.col("content_hash").alias("h0"), F.lit(1).alias("in_old")), new.select("id", F.col("node_type").alias("t1"), F.col("content_hash").alias("h1"), F.lit(1).alias("in_new"))
    both = a.join(b, "id", "full_outer")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("h0").eqNullSafe(F.col("h1")), "modified")
    return both.select("id", F.coalesce("t1", "t0").alias("node_type"), change.alias("change")).where("change IS NOT NULL")


def delta_counts(delta: DataFrame) -> DataFrame:
    """One row: added, removed, modified, changed_types."""
    n = lambda kind: F.count(F.when(F.col("change") == kind, 1)).alias(kind)
    return delta.agg(n("added"), n("removed"), n("modified"), F.sort_array(F.collect_set("node_type")).alias("changed_types"))


#: Files up to which a list of them goes into the plan; longer lists and DataFrames are joined.
LISTED = 200


def _in_files(df: DataFrame, column: Column, files: Iterable[str] | DataFrame) -> tuple[DataFrame, DataFrame]:
    """df split in two: rows whose column is one of the files, and the others."""
    if not isinstance(files, DataFrame):
        named = list(dict.fromkeys(files))
        if len(named) <= LISTED:
            hit = F.coalesce(column.isin(*named), F.lit(False)) if named else F.lit(False)
            return df.where(hit), df.where(~hit)
        files = df.sparkSession.createDataFrame([(f,) for f in named], "file string")
    known = files.select(F.col("file").alias("_file")).distinct()
    shown = df.withColumn("_of", column)
    met = F.col("_of") == F.col("_file")
    return shown.join(known, met, "left_semi").drop("_of"), shown.join(known, met, "left_anti").drop("_of")


def replaced(g: Graph, changed_files: Iterable[str] | DataFrame, protected: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """What a commit of files takes out: the nodes (id) that they own but those of protected types, and the edges (src,
    dst, edge_type) that leave these or are filed under the files."""
    kept_types = list(protected)
    open_nodes = g.nodes.where(~F.col("node_type").isin(*kept_types)) if kept_types else g.nodes
    nodes = _in_files(open_nodes.select("id", "file"), F.col("file"), changed_files)[0].select("id")
    filed, others = _in_files(g.edges, edge_owner(F.col("metadata")), changed_files)
    leaving = others.join(nodes.select(F.col("id").alias("src")), "src", "left_semi")
    return nodes, filed.select(*EDGE_KEY).union(leaving.select(*EDGE_KEY))


def commit_batch(g: Graph, changed_files: Iterable[str] | DataFrame, nodes: DataFrame, edges: DataFrame, protected: Iterable[str] = (), seq: str | None = None) -> Commit:
    """Replace everything that the changed files own: their nodes (but protected types), the edges that leave them and
    the edges filed under them; then put in the new rows, those of one key in the order of seq. The delta compares
    nodes before and after. changed_files: names, or a DataFrame (file)."""
    gone_nodes, gone_edges = replaced(g, changed_files, protected)
    after = Graph(upsert(without(g.nodes, gone_nodes, NODE_KEY), nodes, NODE_KEY, seq), upsert(without(g.edges, gone_edges, EDGE_KEY), edges, EDGE_KEY, seq))
    return Commit(after, node_delta(g.nodes, after.nodes))


def in_order(commits: list[tuple[Iterable[str], DataFrame, DataFrame, Iterable[str]]]) -> tuple[list[str], DataFrame, DataFrame, list[str]]:
    """One commit (files, nodes, edges, protected) for several in a row, with a column seq in both tables: of the rows
    of a file only those of its last commit count, and of an id's rows the last. A type that any commit protects is
    protected in all."""
    files, protected = [[str(f) for f in c[0]] for c in commits], sorted({t for c in commits for t in c[3]})
    last = {f: i for i, fs in enumerate(files) for f in fs}
    parts: tuple[list[DataFrame], list[DataFrame]] = ([], [])
    for i, (fs, nodes, edges, _) in enumerate([(f, *c[1:]) for f, c in zip(files, commits, strict=True)]):
        late = [f for f in fs if last[f] > i]  # what a later commit replaces
        gone, kept = _in_files(nodes, F.col("file"), late)
        if late and protected:
            kept = kept.unionByName(gone.where(F.col("node_type").isin(*protected)))
            gone = gone.where(~F.col("node_type").isin(*protected))
        filed = _in_files(edges, edge_owner(F.col("metadata")), late)[1]
        left = filed.join(gone.select(F.col("id").alias("src")), "src", "left_anti").select(*edges.columns) if late else filed
        for part, df in zip(parts, (kept, left), strict=True):
            part.append(df.withColumn("seq", F.lit(i).cast("long")))
    nodes, edges = (reduce(DataFrame.unionByName, p) for p in parts)
    return list(last), nodes, edges, protected


def row_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that only one of two snapshots holds, as often as they are more there, with side added or removed."""
    return new.exceptAll(old).withColumn("side", F.lit("added")).union(old.exceptAll(new).withColumn("side", F.lit("removed")))


def dependent_files(g: Graph, changed_files: Iterable[str] | DataFrame) -> DataFrame:
    """(file): other files with an edge into a changed one."""
    own, other = _in_files(g.nodes.select("id", "file"), F.col("file"), changed_files)
    sources = g.edges.join(own.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    return other.join(sources, "id", "left_semi").where("file IS NOT NULL").select("file").distinct()


def changed_files(listing: DataFrame, known: DataFrame) -> DataFrame:
    """(path, state) of listing (path, mtime) against what was stored: new, changed, deleted or same."""
    both = listing.join(known.withColumnRenamed("mtime", "stored"), "path", "full_outer")
    return both.select("path", F.when(F.col("mtime").isNull(), "deleted").when(F.col("stored").isNull(), "new").when(F.col("mtime") > F.col("stored"), "changed").otherwise("same").alias("state"))


def freshness(modules: DataFrame, contents: DataFrame) -> DataFrame:
    """(file, state) of modules (file, content_hash hex) against contents (file, content, null where unreadable):
    fresh, stale, deleted or unreadable."""
    now = contents.select("file", F.lit(True).alias("there"), F.sha2(F.col("content"), 256).alias("now"))
    both = modules.join(now, "file", "left")
    return both.select("file", F.when(F.col("there").isNull(), "deleted").when(F.col("now").isNull(), "unreadable").when(F.col("now") == F.col("content_hash"), "fresh").otherwise("stale").alias("state"))


def classify_versions(main: DataFrame, local: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """(key, change) of two versions of a table: added, deleted, modified (some compared column differs) or unchanged."""
    a = main.select(key, F.struct(*compared).alias("a"), F.lit(1).alias("in_main"))
    b = local.select(key, F.struct(*compared).alias("b"), F.lit(1).alias("in_local"))
    both = a.join(b, key, "full_outer")
    return both.select(key, F.when(F.col("in_main").isNull(), "added").when(F.col("in_local").isNull(), "deleted").when(~F.col("a").eqNullSafe(F.col("b")), "modified").otherwise("unchanged").alias("change"))


# Metadata keys that make a structural change, by node type, and those of every type.
COMPARED = {
    "FUNCTION": ("params", "returnType", "async", "exported", "bodyHash"),
    "CLASS": ("methods", "properties", "extends", "implements", "exported"),
    "VARIABLE_DECLARATION": ("kind", "value", "exported"),
    "MODULE": ("contentHash", "imports", "exports"),
    "CALL_SITE": ("arguments", "callee"),
    "DATABASE_QUERY": ("query", "operation", "collection"),
    "HTTP_REQUEST": ("method", "url", "endpoint"),
    "ENDPOINT": ("path", "method", "handler"),
}
COMPARED_ALWAYS = ("line", "column")


def stable_id(nodes: DataFrame) -> Column:
    """What names a node in every version, by its type: declarations by name and file, variables by line too, places by
    line and column, outside calls by a hash of what they ask, anything else by all of these."""
    meta = lambda k: json_attribute(F.col("metadata"), k)
    kind, line, column = F.col("node_type"), F.coalesce(meta("line"), F.lit("0")), F.coalesce(meta("column"), F.lit("0"))
    asked = F.coalesce(meta("query"), meta("url"), meta("path"), meta("endpoint"), F.lit(""))
    return (
        F.when(kind.isin("FUNCTION", "CLASS", "INTERFACE", "TYPE_ALIAS"), F.concat_ws(":", kind, "name", "file"))
        .when(kind == "VARIABLE_DECLARATION", F.concat_ws(":", kind, "name", "file", line))
        .when(kind == "MODULE", F.concat(F.col("name"), F.lit("->global->MODULE->module")))
        .when(kind == "SERVICE", F.concat(F.lit("SERVICE:"), F.coalesce("name", "file")))
        .when(kind.isin("CALL_SITE", "SCOPE", "EXPRESSION", "STATEMENT"), F.concat_ws(":", kind, "file", line, column))
        .when(kind.isin("DATABASE_QUERY", "HTTP_REQUEST", "FILESYSTEM", "NETWORK"), F.concat(kind, F.lit(":"), F.substring(F.sha2(asked, 256), 1, 16)))
        .otherwise(F.concat_ws(":", kind, "name", "file", meta("line"), meta("column")))
    )


def classify_nodes(main: DataFrame, local: DataFrame) -> DataFrame:
    """(key, change) of two versions of a graph's nodes, matched by stable_id; of one key's nodes the least id counts.
    Modified: the name, the place or a metadata key of the type (COMPARED) differs."""
    value = lambda k: F.coalesce(F.get_json_object("metadata", "$['" + k + "']"), json_attribute(F.col("metadata"), k))
    own = F.lit(None).cast("string")
    for kind, keys in COMPARED.items():
        own = F.when(F.col("node_type") == kind, F.to_json(F.struct(*(value(k).alias(k) for k in keys)))).otherwise(own)
    shown = F.struct("name", *(value(k).alias(k) for k in COMPARED_ALWAYS), F.when(F.col("node_type").isin("FUNCTION", "CLASS", "VARIABLE_DECLARATION"), F.col("exported")).alias("exported"), own.alias("own"))
    keyed = lambda df: df.select(stable_id(df).alias("key"), "id", shown.alias("shown")).groupBy("key").agg(F.min(F.struct("id", "shown"))["shown"].alias("shown"))
    return classify_versions(keyed(main), keyed(local), "key", ["shown"])


def replaces_edges(changes: DataFrame, key: str) -> DataFrame:
    """REPLACES edges from the local to the main version of what was modified."""
    return changes.where("change = 'modified'").select(F.concat(F.lit("local:"), key).alias("src"), F.concat(F.lit("main:"), key).alias("dst"), F.lit("REPLACES").alias("edge_type"), F.lit(None).cast("string").alias("metadata"))


def body_hash(source: Column) -> Column:
    """SHA-256 of a body with its white space folded."""
    return F.sha2(F.trim(F.regexp_replace(source, r"\s+", " ")), 256)


def suspicious_types(new: DataFrame, known: DataFrame, column: str, most: int = 2) -> DataFrame:
    """(column, close_to): type names that are not known but within `most` edits of a known one (the nearest, then the
    least). Both sides are distinct names of types: few rows."""
    fresh = new.select(column).distinct().join(known.select(column).distinct(), column, "left_anti")
    names = known.select(F.col(column).alias("close_to")).distinct()
    pairs = fresh.join(names, F.levenshtein(column, "close_to") <= most)
    return pairs.groupBy(column).agg(F.min(F.struct(F.levenshtein(column, "close_to").alias("d"), "close_to"))["close_to"].alias("close_to"))


# --- snapshots ------------------------------------------------------------------------------------------------------


class Conflict(RuntimeError):
    """Another writer took the version."""


class Store:
    """A directory of databases; each a row of immutable snapshots with one manifest file a version.

    A snapshot is a base and the deltas since: a commit writes only the rows and tombstones of its files, and readers
    put the newest over the base. Once COMPACT_AT deltas are there, the next commit writes a new base. A base is two
    Parquet tables: nodes partitioned by type, edges by type, both clustered by the directory of the file or by source
    and sorted by id, with bloom filters on the ids. A writer claims its version first, so of two only one has it; a
    version counts once its manifest is there, so readers see whole snapshots only.
    """

    #: Seconds after which a claim without a manifest is that of a writer that died; tries of a commit.
    STALE, TRIES = 600, 5

    def __init__(self, spark: SparkSession, root: str, compact_at: int = COMPACT_AT) -> None:
        self.spark, self.root, self.compact_at = spark, root.rstrip("/"), compact_at
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def databases(self) -> list[str]:
        p = self._fs_path(self.root)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p) if s.isDirectory()) if self._fs.exists(p) else []

    def drop(self, name: str) -> bool:
        return self._fs.delete(self._fs_path(self._dir(name)), True)

    def clear(self, name: str) -> dict:
        """A snapshot without rows; the ones before stay readable."""
        empty = Graph(self.spark.createDataFrame([], NODE_SCHEMA), self.spark.createDataFrame([], EDGE_SCHEMA))
        return self.write(name, empty)

    def _dir(self, name: str) -> str:
        if not re.fullmatch(r"[\w-]+", name):
            raise ValueError(f"database name {name!r}")
        return f"{self.root}/{name}"

    def _texts(self, folder: str) -> list[str]:
        p = self._fs_path(folder)
        files = [str(s.getPath()) for s in self._fs.listStatus(p) if s.getPath().getName().endswith(".json")] if self._fs.exists(p) else []
        return [r["value"] for r in self.spark.read.text(files, wholetext=True).collect()] if files else []  # short files, one a version or tag

    def snapshots(self, name: str) -> list[dict]:
        """Manifests by version, with the tags that were added later."""
        found = {m["version"]: m for m in map(json.loads, self._texts(f"{self._dir(name)}/manifests"))}
        for t in sorted(map(json.loads, self._texts(f"{self._dir(name)}/tags")), key=lambda t: t["at"]):
            if t["version"] in found:
                found[t["version"]]["tags"] |= t["tags"]
        return sorted(found.values(), key=lambda m: m["version"])

    # writing

    def write(self, name: str, g: Graph, tags: dict[str, str] | None = None, only: int | None = None) -> dict:
        """Write a whole graph as a base; the next version, or only the given one."""
        at = self._write_base(name, g)
        stats = {r["node_type"]: r["n"] for r in self._base(at, "nodes").groupBy("node_type").agg(F.count(F.lit(1)).alias("n")).collect()}
        counts = {"nodes": sum(stats.values()), "edges": self._base(at, "edges").count(), "types": stats}
        for _ in range(self.TRIES):
            version = only or max((m["version"] for m in self.snapshots(name)), default=0) + 1
            if self._claim(name, version):
                return self._put(name, {"version": version, "at": time.time(), "tags": tags or {}, **counts, "base": at, "deltas": []})
            if only:
                break
        raise Conflict(f"no version of {name} could be had")

    def commit(self, name: str, changed_files: Iterable[str] | DataFrame, nodes: DataFrame, edges: DataFrame, protected: Iterable[str] = (), tags: dict[str, str] | None = None, seq: str | None = None) -> tuple[dict, DataFrame]:
        """Replace what files own in the newest snapshot, as commit_batch does, by a delta: its manifest, and the node
        delta (id, node_type, change). Only rows of the touched keys are compared. A lost race is tried again."""
        files = changed_files if isinstance(changed_files, DataFrame) else list(changed_files)
        for _ in range(self.TRIES):
            found = self.snapshots(name)
            order = F.col(seq) if seq else F.lit(0)
            try:
                if not found:  # the first commit is the first base
                    g = Graph(latest(nodes, NODE_KEY, order).select(*_columns(NODE_SCHEMA)), latest(edges, EDGE_KEY, order).select(*_columns(EDGE_SCHEMA)))
                    manifest = self.write(name, g, tags, 1)
                    return manifest, self._graph(manifest).nodes.select("id", "node_type", F.lit("added").alias("change"))
                return self._commit(name, found[-1], files, nodes, edges, protected, tags or {}, seq)
            except Conflict:
                continue
        raise Conflict(f"no version of {name} could be had")

    def _commit(self, name: str, last: dict, files: list[str] | DataFrame, nodes: DataFrame, edges: DataFrame, protected: Iterable[str], tags: dict[str, str], seq: str | None) -> tuple[dict, DataFrame]:
        old, at, order = self._graph(last), f"{self._dir(name)}/delta-{uuid.uuid4().hex}", F.col(seq) if seq else F.lit(0)
        gone_nodes, gone_edges = replaced(old, files, protected)
        # One small file or so a table: a commit holds some files' rows.
        for table, df in (("nodes", latest(nodes, NODE_KEY, order).select(*_columns(NODE_SCHEMA))), ("edges", latest(edges, EDGE_KEY, order).select(*_columns(EDGE_SCHEMA))), ("gone_nodes", gone_nodes), ("gone_edges", gone_edges.distinct())):
            df.write.parquet(f"{at}/{table}")
        manifest = {"version": last["version"] + 1, "at": time.time(), "tags": tags, "base": last["base"], "deltas": [*last["deltas"], at]}
        new = self._graph(manifest)
        touched = self._touched(at, "nodes")
        before, after = (x.nodes.join(touched, NODE_KEY, "left_semi") for x in (old, new))
        delta = node_delta(before, after)
        types = dict(last["types"])
        for df, sign in ((before, -1), (after, 1)):
            for r in df.groupBy("node_type").agg(F.count(F.lit(1)).alias("n")).collect():  # one row a type
                types[r["node_type"]] = types.get(r["node_type"], 0) + sign * r["n"]
        moved = [x.edges.join(self._touched(at, "edges"), EDGE_KEY, "left_semi").count() for x in (old, new)]
        types = {k: v for k, v in types.items() if v}
        manifest |= {"nodes": sum(types.values()), "edges": last["edges"] - moved[0] + moved[1], "types": types}
        if should_compact(len(manifest["deltas"]), self.compact_at):
            manifest |= {"base": self._write_base(name, new), "deltas": []}
        if not self._claim(name, manifest["version"]):
            raise Conflict(f"version {manifest['version']} of {name}")
        return self._put(name, manifest), delta

    def compact(self, name: str) -> dict:
        """The newest snapshot as a base alone, as the next version."""
        last = self.snapshots(name)[-1]
        return self.write(name, self._graph(last), last["tags"])

    def _write_base(self, name: str, g: Graph) -> str:
        at = f"{self._dir(name)}/base-{uuid.uuid4().hex}"
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        bloom = {"parquet.bloom.filter.enabled#id": "true", "parquet.bloom.filter.enabled#src": "true", "parquet.bloom.filter.enabled#dst": "true"}
        nodes = g.nodes.withColumn("_dir", parent_dir(F.coalesce("file", F.lit("")))).repartition(parts, "node_type", "_dir", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("node_type", "id").drop("_dir")
        nodes.write.partitionBy("node_type").options(**bloom).parquet(f"{at}/nodes")
        g.edges.repartition(parts, "edge_type", F.pmod(F.xxhash64("src"), F.lit(parts))).sortWithinPartitions("edge_type", "src").write.partitionBy("edge_type").options(**bloom).parquet(f"{at}/edges")
        return at

    def _claim(self, name: str, version: int) -> bool:
        """Create the version's claim if there is none; one of a writer that died long ago is taken away."""
        p = self._fs_path(f"{self._dir(name)}/claims/{version:08d}")
        if self._fs.createNewFile(p):
            return True
        manifest = self._fs_path(f"{self._dir(name)}/manifests/{version:08d}.json")
        if not self._fs.exists(manifest) and time.time() - self._fs.getFileStatus(p).getModificationTime() / 1000 > self.STALE:
            self._fs.delete(p, False)
        else:
            time.sleep(0.2)
        return False

    def _put(self, name: str, manifest: dict) -> dict:
        self._write_text(f"{self._dir(name)}/manifests", f"{manifest['version']:08d}.json", manifest)
        return manifest

    def _write_text(self, folder: str, file: str, content: dict) -> None:
        """Written beside its place and renamed into it: no reader sees a part of it, and nothing is ever replaced."""
        part, final = self._fs_path(f"{folder}/.{file}.{uuid.uuid4().hex}"), self._fs_path(f"{folder}/{file}")
        out = self._fs.create(part, True)
        out.write(json.dumps(content).encode())
        out.close()
        if not self._fs.rename(part, final):
            raise OSError(f"{final} could not be written")

    def tag(self, name: str, version: int, **tags: str) -> dict:
        """Add tags to a version: a file of their own, for manifests never change."""
        if version not in {m["version"] for m in self.snapshots(name)}:
            raise KeyError(f"no version {version} of {name}")
        self._write_text(f"{self._dir(name)}/tags", f"{version:08d}-{uuid.uuid4().hex}.json", {"version": version, "at": time.time(), "tags": tags})
        return next(m for m in self.snapshots(name) if m["version"] == version)

    # reading

    def _base(self, at: str, table: str) -> DataFrame:
        schema = NODE_SCHEMA if table == "nodes" else EDGE_SCHEMA
        return self.spark.read.schema(schema).parquet(f"{at}/{table}").select(*_columns(schema))

    def _touched(self, at: str, table: str) -> DataFrame:
        """The keys that a delta puts in or takes out."""
        key, schema = (NODE_KEY, "id string") if table == "nodes" else (EDGE_KEY, "src string, dst string, edge_type string")
        rows = self._delta(at, table).select(*key)
        return rows.union(self.spark.read.schema(schema).parquet(f"{at}/gone_{table}").select(*key)).distinct()

    def _delta(self, at: str, table: str) -> DataFrame:
        return self.spark.read.schema(NODE_SCHEMA if table == "nodes" else EDGE_SCHEMA).parquet(f"{at}/{table}")

    def _graph(self, manifest: dict) -> Graph:
        """The base without the keys that deltas touch, and for these what the last delta that touches them says. The
        base is not shuffled where the deltas are small."""
        tables = []
        for table, key in (("nodes", NODE_KEY), ("edges", EDGE_KEY)):
            base = self._base(manifest["base"], table)
            if manifest["deltas"]:
                rows = reduce(DataFrame.union, (self._delta(at, table).withColumn("_seq", F.lit(i)) for i, at in enumerate(manifest["deltas"])))
                touched = reduce(DataFrame.union, (self._touched(at, table).withColumn("_last", F.lit(i)) for i, at in enumerate(manifest["deltas"]))).groupBy(*key).agg(F.max("_last").alias("_last"))
                live = rows.join(touched, key).where("_seq = _last").select(*base.columns)
                base = base.join(touched.select(*key), key, "left_anti").select(*base.columns).union(live)
            tables.append(base)
        return Graph(*tables)

    def read(self, name: str, version: int | None = None, tag: tuple[str, str] | None = None) -> Graph:
        """The newest snapshot, or one by version or tag."""
        found = [m for m in self.snapshots(name) if (version is None or m["version"] == version) and (tag is None or m["tags"].get(tag[0]) == tag[1])]
        if not found:
            raise KeyError(f"no such snapshot of {name}")
        return self._graph(found[-1])

    def diff(self, name: str, old: int, new: int) -> DataFrame:
        return node_delta(self.read(name, old).nodes, self.read(name, new).nodes)


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]
