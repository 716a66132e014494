"""What the operators of this subpackage share: tables, scratch space and Arrow limits."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes that one Arrow batch may hold: bounds a Python worker's memory whatever the texts' lengths.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_limits(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session's Python stages."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir; a local one only where it is unset, as in tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sparkweft-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/sparkweft/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df, written to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
    out = df.sparkSession.read.schema(schema).parquet(path)
    out.settled_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more: what was made of them is settled itself."""
    for df in tables:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(df.settled_at)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def by_batch(df: DataFrame, columns: dict[str, pa.DataType], schema: str, work: Callable[..., list]) -> DataFrame:
    """Run work(lists of the columns of df in order) -> lists of the output columns over each Arrow batch.

    columns gives the Arrow type of each output column, schema the same for Spark.
    """
    arrow_limits(df.sparkSession)
    names, kinds = list(columns), list(columns.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = work(*(c.to_pylist() for c in batch.columns))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

    return df.mapInArrow(run, schema)


def md5_bits(*parts: Column | int | str) -> Column:
    """52 bits, as a long, of the MD5 of the parts as text joined by "|": the same in any engine. Null parts are "null"."""
    shown = [F.lit(str(p)) if not isinstance(p, Column) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *shown).cast("binary")), 1, 13), 16, 10).cast("long")


def uniform(*parts: Column | int | str) -> Column:
    """A number between 0 and 1, both left out, from md5_bits of the parts."""
    return (md5_bits(*parts).cast("double") + 0.5) / float(1 << 52)


#: Bits of a bitmap and of one of its rows: 8 MB in all, whatever it is made of.
BITS, ROW_BITS = 1 << 26, 1 << 13


def bitmap(slots: DataFrame) -> DataFrame:
    """(chunk, bits): at most BITS / ROW_BITS rows that tell which numbers of the column slot (0 to BITS - 1) occur. A
    sieve of bounded size: rows that it lets through must still be joined. Built-in expressions only."""
    parted = slots.select(F.expr(f"slot div {ROW_BITS}").alias("chunk"), F.expr(f"slot % {ROW_BITS}").alias("low"))
    gathered = parted.repartition("chunk").groupBy("chunk").agg(F.bitmap_construct_agg("low").alias("bits"))  # rows are moved, not half-empty bitmaps
    return settled(gathered.select("chunk", F.expr(f"substring(bits, 1, {ROW_BITS // 8})").alias("bits")), "bitmap")


def sieved(df: DataFrame, slot: Column, bits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df in two: rows whose slot is in a bitmap, and the others. The bitmap is broadcast: its size is bounded."""
    columns = df.columns
    found = df.withColumn("__slot", slot).withColumn("chunk_", F.expr(f"__slot div {ROW_BITS}"))
    met = found.join(F.broadcast(bits.toDF("chunk_", "bits_")), "chunk_", "left")
    byte = F.conv(F.hex(F.expr(f"substring(bits_, CAST(1 + (__slot % {ROW_BITS}) div 8 AS INT), 1)")), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), F.expr("CAST(__slot % 8 AS INT)"))) != 0, F.lit(False))
    return met.where(hit).select(*columns), met.where(~hit).select(*columns)
