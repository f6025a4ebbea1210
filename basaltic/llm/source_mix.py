"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

The mix is a row of slots of equal size. Slot i has the point frac(i * golden ratio) of the unit interval, and the cumulative
target shares say which source owns that point, so every stretch of the schedule is mixed as the whole is. Each source's
documents stand in a shuffled order and are cut into blocks of a slot's size; the k-th slot of a source takes its block
k modulo the number of blocks.

Prefix sums over a source are made in two steps (sums of small groups, then within a group), so no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basaltic.llm.common import SPACE, stored

#: The fractional part of the golden ratio.
GOLDEN = 0.6180339887498949
#: Slots that a mix has at least where words allow it; words of a slot at least and at most.
LEAST_SLOTS, SLOT_LEAST, SLOT_MOST = 1 << 20, 16, 2048
#: Groups that a source's shuffled documents are dealt to; slots of a group in ranking; cells of the unit interval.
GROUPS, SLOT_GROUP, CELLS = 4096, 4096, 1024


def size_of(text: Column) -> Column:
    """Number of words; a null text has none."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{SPACE}]+|[{SPACE}]+\\z", "")
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, f"[{SPACE}]+"))).cast("long")


def targets(sizes: DataFrame, most_times: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Of each source: source, source_size, weight, target and total. One row per source.

    Sources by code point, null last, take the weights in turn and share the total. No target exceeds most_times its
    source's size: those that would are held there, and the rest share what is left by weight. With caps ordered by how
    soon they bind (cap / weight), the held ones are the first k for which the level that the rest then reach is no
    higher than the next cap.
    """
    by_name = W.orderBy(F.asc_nulls_last("source"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double")
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    own = own.withColumn("cap", most_times * F.col("source_size").cast("double")).withColumn("bind", F.col("cap") / F.col("weight"))
    before = W.orderBy("bind", F.asc_nulls_last("source")).rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    led = own.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    led = led.withColumn("level", level)
    # the level rises while caps bind; it is final at the first source whose cap does not
    final = F.min(F.when(F.col("bind") >= F.col("level"), F.struct("bind", "level"))).over(everything)["level"]
    return led.withColumn("final", final).select(
        "source", "source_size", "weight", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("final"))).alias("target"), "total"
    )


def slot_size(total: int) -> int:
    """Words of a slot: as fine as LEAST_SLOTS asks, within the bounds."""
    return max(SLOT_LEAST, min(SLOT_MOST, total // LEAST_SLOTS))


def schedule(sources: DataFrame, total: int, words: int, most_times: int = 3) -> DataFrame:
    """The slots: slot, s (the source's number), rank among the source's slots, block and pass."""
    spark = sources.sparkSession
    n = -(-total // words)
    run = W.orderBy("s").rowsBetween(W.unboundedPreceding, 0)
    share = sources.select("s", "source_size", (F.sum("target").over(run) / total).alias("hi"))
    share = share.withColumn("lo", F.coalesce(F.lag("hi").over(W.orderBy("s")), F.lit(0.0)))
    share = share.withColumn("hi", F.when(F.lead("s").over(W.orderBy("s")).isNull(), F.lit(2.0)).otherwise(F.col("hi")))
    cells = share.where("lo < hi").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS).cast("int"), F.least(F.lit(CELLS - 1), F.floor(F.col("hi") * CELLS).cast("int")))))
    point = F.col("id") * F.lit(GOLDEN) - F.floor(F.col("id") * F.lit(GOLDEN))
    slots = spark.range(n).select(F.col("id").alias("slot"), point.alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS).cast("int"))
    owned = slots.join(cells, "cell").where("u >= lo and u < hi").select("slot", "s", "source_size", F.floor(F.col("slot") / SLOT_GROUP).alias("g"))
    sums = owned.groupBy("s", "g").agg(F.count("*").alias("c"))
    sums = sums.select("s", "g", F.coalesce(F.sum("c").over(W.partitionBy("s").orderBy("g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = owned.join(sums, ["s", "g"]).withColumn("rank", F.col("before") + F.row_number().over(W.partitionBy("s", "g").orderBy("slot")) - 1)
    blocks = F.ceil(F.col("source_size") / words)
    return ranked.select("slot", "s", "rank", (F.col("rank") % blocks).alias("block"), F.floor(F.col("rank") / blocks).alias("pass")).where(F.col("pass") < most_times)


def mix(docs: DataFrame, most_times: int = 3, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target (of its source) and taken (words that the mix takes, repeats counted) of every row.

    A null source is a source; a null text has size 0 and gives nothing. Repeated rows are mixed each on its own; the shuffled
    order is by a hash of doc_id, then by doc_id and size, so that reruns agree. No row gives more than most_times its size.
    An empty table gives no rows. Other columns are left out.
    """
    sizes = stored(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), "sizes")
    sources = targets(sizes, most_times).withColumn("s", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))))
    sources = stored(sources, "sources")
    total = (sources.agg(F.max("total")).first() or [0])[0] or 0
    known = sources.select(F.col("source").alias("_source"), "s", "source_size", "target")
    rows = sizes.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    if not total:
        return rows.select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    words = slot_size(total)
    order = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    dealt = rows.withColumn("o", order).withColumn("g", F.conv(F.substring("o", 1, 8), 16, 10).cast("long") % GROUPS)
    # where each document begins in its source's shuffled stream
    sums = dealt.groupBy("s", "g").agg(F.sum("size").alias("c"))
    sums = sums.select("s", "g", F.coalesce(F.sum("c").over(W.partitionBy("s").orderBy("g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = W.partitionBy("s", "g").orderBy("o", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.join(sums, ["s", "g"]).withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.select("doc_id", "size", "source_size", "target", "s", "start")
    # the pieces of documents by block, and how often each block is taken
    end = F.col("start") + F.col("size")
    piece = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / words), F.floor((end - 1) / words))))
    piece = piece.withColumn("part", F.least(end, (F.col("block") + 1) * words) - F.greatest(F.col("start"), F.col("block") * words))
    times = schedule(sources, total, words, most_times).groupBy("s", "block").agg(F.count("*").alias("times"))
    keys = ["doc_id", "size", "source_size", "target", "s", "start"]
    taken = piece.join(times, ["s", "block"], "left").groupBy(*keys).agg(F.sum(F.col("part") * F.coalesce("times", F.lit(0))).alias("taken"))
    out = ["doc_id", "size", "source_size", "target", "taken"]
    return taken.select(*out).unionByName(placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*out))


def mixed(docs: DataFrame, most_times: int = 3, seed: str = "mix") -> DataFrame:
    """The documents, with all their columns, each as often as the mix takes it: taken / size, rounded half up.

    Rows of one id count together and are taken equally often; empty documents give nothing."""
    times = mix(docs, most_times, seed).groupBy("doc_id").agg(F.sum("taken").alias("_t"), F.sum("size").alias("_s"))
    times = times.where("_s > 0").select(F.col("doc_id").alias("_id"), F.floor(F.col("_t") / F.col("_s") + 0.5).cast("int").alias("_times")).where("_times > 0")
    rows = docs.select(F.col("doc_id").alias("_doc"), F.struct("*").alias("row"))  # no column's name can clash
    return rows.join(times, F.col("_doc").eqNullSafe(F.col("_id"))).select("row", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).select("row.*")
