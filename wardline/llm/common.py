"""Shared helpers: scratch tables, connected components, streaming over sorted groups."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset, on one machine (tests), a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isDefined():
            return got.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="wardline-")
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


#: Rows and bytes of an Arrow batch: texts may be long, and every task holds some batches on either side of its Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows and BATCH_BYTES at most (one row at least), unless the session asks for less.

    The session keeps these two settings, as its DataFrames read them when they run.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(spark.conf.get(key).rstrip("bB")) <= most:
            spark.conf.set(key, str(most))


def release() -> None:
    """Gives freed memory of a Python worker back: workers are kept for other tasks, and each holds what it once needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f over a partition's batches, with its memory given back at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return run


def staged(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/wardline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """df for a join that is always sorted and merged.  Compressed ids take few bytes, so Spark would choose to broadcast, and
    collect in the driver, tables that are many times as large in memory and grow with the input."""
    return df.hint("merge")


def likely(rows: DataFrame, need: DataFrame, key: str, size: int, others: bool = False) -> DataFrame:
    """Rows whose key falls on a bit that some needed key (of the same type) sets, or the others: a bitmap of fixed size, so that a
    join that follows, and is exact, need not shuffle all of them.  Where most bits are set it lets all rows through."""
    spot = F.pmod(F.xxhash64(key), F.lit(size))
    maps = need.select((spot + 1).alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits")).collect()
    every = np.zeros(size // 8, np.uint8)
    for r in maps:  # numbers, parts and so bytes count from 1; a part holds 4096 bytes
        every[(r["part"] - 1) * 4096 : r["part"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(every)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.asarray(b.column("spot"))
            yield b.filter(pa.array(((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool) ^ others)).drop_columns(["spot"])

    return rows.withColumn("spot", spot).mapInArrow(lean(run), rows.schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b), component being the smallest node reachable.

    Contraction: every node joins the smallest node next to it, edges are renamed and made distinct, until none
    is left; then the renamings are composed.  Rounds grow with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    left = staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found: DataFrame | None = None
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("up"))
        # a node's parent is never larger, so parents form trees; two jumps shorten them
        jump = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
        parent = parent.join(merged(jump), "up").select("node", F.col("top").alias("up"))
        parent = staged(parent)
        pa_, pb_ = parent.select(F.col("node").alias("a"), F.col("up").alias("ua")), parent.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        if found is None:
            found = parent.select("node", F.col("up").alias("component"))
        else:
            nxt = parent.select(F.col("node").alias("component"), "up")
            found = found.join(merged(nxt), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        left = staged(left.join(merged(pa_), "a").join(merged(pb_), "b").where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct())
    if found is None:
        return spark.createDataFrame([], f"node {edges.schema['a'].dataType.simpleString()}, component {edges.schema['a'].dataType.simpleString()}")
    return staged(found)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows that agree in keys, over batch borders; the input is sorted by keys and groups are bounded."""
    held: list[pa.Table] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        cols = [np.asarray(t.column(k).to_numpy(zero_copy_only=False)) for k in keys]
        change = np.zeros(t.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), t.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            key = tuple(c[lo] for c in cols)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.concat_tables(held)


class Union:
    """Union-find over 0..n-1 within one bounded block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True
