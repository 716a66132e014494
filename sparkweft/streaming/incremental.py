"""Incremental maintenance with Structured Streaming: micro-batches of rows are upserted into a snapshot."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.guarantees import Guarantee, check_selective
from ..operators.store import COMPACT_AT, NODE_KEY, Store, latest, should_compact


class UpsertSink:
    """A table kept as a base and the batches since, each with its batch id; a reader takes the newest row of a key.

    A batch is written under its id and overwritten if it is run again, so each counts once. Once COMPACT_AT batches
    are there, the next one folds all before it into a new base: reads do not grow with the number of batches. A base
    counts once it is whole, and readers pass over the batches in it.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], seq: str, schema: str, compact_at: int = COMPACT_AT) -> None:
        self.spark, self.path, self.keys, self.seq, self.schema, self.compact_at = spark, path.rstrip("/"), keys, seq, schema, compact_at
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def put(self, batch: DataFrame, batch_id: int) -> None:
        latest(batch, self.keys, F.col(self.seq)).write.mode("overwrite").parquet(f"{self.path}/batches/batch={batch_id}")
        if self.compact_due():
            self.compact()

    def _whole(self, folder: str, prefix: str) -> list[int]:
        """The numbers of the finished writes in a folder."""
        p = self._path(f"{self.path}/{folder}")
        names = [s.getPath() for s in self._fs.listStatus(p)] if self._fs.exists(p) else []
        return sorted(int(n.getName().removeprefix(prefix)) for n in names if n.getName().startswith(prefix) and self._fs.exists(self._path(f"{n}/_SUCCESS")))

    def _base(self) -> int | None:
        """The last batch that a base holds."""
        return max(self._whole("bases", "upto="), default=None)

    def _open(self) -> list[int]:
        base = self._base()
        return [b for b in self._whole("batches", "batch=") if base is None or b > base]

    def read(self) -> DataFrame:
        """By key the row with the highest seq, then of the latest batch: a late row of lower seq loses."""
        base, parts = self._base(), []
        if base is not None:
            parts.append(self.spark.read.schema(self.schema).parquet(f"{self.path}/bases/upto={base}").withColumn("batch", F.lit(-1).cast("long")))
        if found := self._open():
            files = [f"{self.path}/batches/batch={b}" for b in found]
            parts.append(self.spark.read.schema(f"{self.schema}, batch bigint").option("basePath", f"{self.path}/batches").parquet(*files))
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return latest(reduce(DataFrame.unionByName, parts), self.keys, F.struct(self.seq, "batch")).drop("batch")

    def batches(self) -> int:
        """Batches that no base holds."""
        return len(self._open())

    def compact_due(self) -> bool:
        return should_compact(self.batches(), self.compact_at)

    def compact(self) -> None:
        """Fold all batches into a base. Bases and batches that are older than the one before it are deleted: a reader
        that began before has them."""
        found, was = self._open(), self._base()
        if not found:
            return
        self.read().repartition(*self.keys).sortWithinPartitions(*self.keys).write.mode("overwrite").parquet(f"{self.path}/bases/upto={found[-1]}")
        if was is not None:
            for b in self._whole("bases", "upto="):
                if b < was:
                    self._fs.delete(self._path(f"{self.path}/bases/upto={b}"), True)
            for b in self._whole("batches", "batch="):
                if b <= was:
                    self._fs.delete(self._path(f"{self.path}/batches/batch={b}"), True)


def stream_upserts(stream: DataFrame, sink: UpsertSink, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(sink.put).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_commits(nodes: DataFrame, store: Store, database: str, edges_of: Callable[[DataFrame, int], DataFrame], checkpoint: str, guarantees: Iterable[Guarantee] = (), on_violations: Callable[[DataFrame, int], None] | None = None, seq: str | None = None) -> StreamingQuery:
    """Commit each micro-batch of nodes as a delta: the files it holds are replaced in the newest snapshot, and the
    guarantees whose types changed are checked again. Of an id's rows the one with the highest seq counts, or without
    that column the greatest. A batch that was committed before (its tag) is passed over."""
    rules = list(guarantees)

    def put(batch: DataFrame, batch_id: int) -> None:
        if any(m["tags"].get("batch") == str(batch_id) for m in store.snapshots(database)):
            return
        files = batch.select("file").where("file IS NOT NULL").distinct()  # joined: a micro-batch may hold very many
        edges = edges_of(batch, batch_id)
        rows = latest(batch, NODE_KEY, F.col(seq) if seq else F.lit(0))
        _, delta = store.commit(database, files, rows, edges, tags={"batch": str(batch_id)})
        if rules and on_violations:
            types = [r["node_type"] for r in delta.select("node_type").distinct().collect()]
            on_violations(check_selective(store.read(database), rules, types), batch_id)

    return nodes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()


def windowed_counts(events: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Tumbling-window counts with a watermark (an extension: the graph itself has no event time)."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), by, "n")
