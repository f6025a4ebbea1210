"""Collapsing of identical bodies."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Examples listed for a group besides its first member.
MOST_LISTED = 64


def duplicate_groups(rows: DataFrame, body: Column, position: str, name: str, listed: int = MOST_LISTED) -> DataFrame:
    """Groups of two or more rows with the same body: the first member by position, the count, and further members.

    Grouping is by SHA-256 of the body, aggregated before the shuffle, so a hot body never gathers in one row. Null bodies form no
    group: they count 0, for a filter on the hash would hash all bodies a second time. listed_members has the further members.
    """
    keyed = rows.select(F.sha2(body.cast("binary"), 256).alias("_h"), F.col(position).alias("_p"), F.col(name).alias("_n"))
    sizes = keyed.groupBy("_h").agg(F.count("_h").alias("count"), F.min(F.struct("_p", "_n")).alias("first")).where("count > 1")
    return sizes.select(F.col("first._p").alias("canonical"), F.col("first._n").alias("canonical_name"), "count", (F.col("count") - 1 > listed).alias("truncated"))


def listed_members(rows: DataFrame, body: Column, position: str, name: str, listed: int = MOST_LISTED) -> DataFrame:
    """canonical and members, the next members of each group in order of position, as many as are listed at most.

    Each task cuts its share of a group by rank before the shuffle, and so at most `listed` + 1 members of a group gather.
    """
    keyed = rows.select(F.sha2(body.cast("binary"), 256).alias("_h"), F.struct(F.col(position).alias("position"), F.col(name).alias("name")).alias("_m"))
    first = W.partitionBy("_h").orderBy("_m")
    kept = keyed.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= listed + 1)
    lists = kept.groupBy("_h").agg(F.array_sort(F.collect_list("_m")).alias("_l"), F.count("_h").alias("_c")).where("_c > 1")
    return lists.select(F.col("_l")[0]["position"].alias("canonical"), F.slice("_l", 2, listed).alias("members"))


def duplicate_totals(rows: DataFrame, body: Column) -> DataFrame:
    """One row: rows, distinct bodies, surplus copies and groups of two or more."""
    sizes = rows.select(F.sha2(body.cast("binary"), 256).alias("_h")).groupBy("_h").agg(F.count("_h").alias("n"))
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count_if(F.col("n") > 0).alias("unique_bodies"),
        F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("groups"),
    )
