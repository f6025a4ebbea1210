"""What the operators of this subpackage share: batch mapping, the shared folder, dealing rows to sorted groups."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basaltic.session import shared_dir, ship

#: White space as the contracts define it, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"
#: Characters of text handled at once in a Python worker.
SLICE_CHARS = 8_000_000
#: Longest word that a worker remembers, so that a memory of so many words is bounded in bytes, too.
KEPT_CHARS = 64


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes a frame as Parquet in the shared folder and reads it back; this cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/basaltic/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a stored frame, from which nothing is read any more: neither by the caller nor by a frame that isn't stored yet."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow by a function of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


class Memory:
    """A bounded memory of what words came to: a word is kept when it is seen for the second time, so that the many that never come
    again take no room, nor do those above KEPT_CHARS. When it is full, it starts anew."""

    def __init__(self, most: int):
        self.most, self.kept = most, {}
        self.door = bytearray(1 << 22)  # a byte for each hash that has been seen

    def offer(self, word, value) -> None:
        if len(word) > KEPT_CHARS:
            return
        at = hash(word) & 0x3FFFFF
        if not self.door[at]:
            self.door[at] = 1
            return
        if len(self.kept) >= self.most:
            self.kept.clear()
            self.door = bytearray(1 << 22)
        self.kept[word] = value


_tool: dict = {}


def tool(make: Callable, *args):
    """make(*args), kept in a Python worker for its later tasks. A worker holds one tool, the latest: what other operators have
    remembered is let go, so that workers of long sessions stay small."""
    key = (make, args)
    if key not in _tool:
        _tool.clear()
        gc.collect()
        _tool[key] = make(*args)
    return _tool[key]


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str | T.StructType) -> DataFrame:
    """map_arrow with state that is set up once per task: make() returns the function for one record batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            if batch.num_rows and (out := one(batch)) is not None:
                yield out
        pa.default_memory_pool().release_unused()  # an idle worker gives the batches' room back

    return map_arrow(df, run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; a null text is an empty one."""
    return [x or "" for x in batch.column(column).to_pylist()]


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Yields the runs of equal keys from batches that are sorted by the key; only one run is held at a time."""
    import numpy as np

    held: list[pa.Table] = []
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and k[lo] != at:
                run, held = [pa.concat_tables(held)], []
                yield run.pop()
            held.append(t.slice(lo, hi - lo))
            at = k[lo]
    if held:
        yield pa.concat_tables(held)


def partitions_of(df: DataFrame) -> int:
    """How many partitions a scan has: the measure of its bytes that Spark itself uses."""
    return max(1, df._jdf.queryExecution().toRdd().getNumPartitions())


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links as (id, component): component is the smallest id that can be reached.

    Alternates two map-reduce steps on edges: each node hooks its larger, then its smaller neighbours on to the smallest
    node it sees. The number of rounds grows with the logarithm of a component's size; a hub costs one aggregated row.
    Every round is written to the shared folder, so lost executors cost one round. Null ends and loops count as no link.
    """
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    pairs = stored(ends.where("u is not null and v is not null and u > v").distinct(), "pairs")
    before = None
    while True:
        # every node's larger neighbours hook on to its smallest neighbour (or itself)
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = pairs.select(F.col("v").alias("c"), F.col("u").alias("w")).join(least.withColumnRenamed("u", "c"), "c").select(F.col("w").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        # every node's smaller neighbours and the node itself hook on to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        last, pairs = pairs, stored(small.where("u > v").distinct(), "pairs")
        dropped(last)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component"))
