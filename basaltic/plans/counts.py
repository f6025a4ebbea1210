"""Queries over counters, catalogues and versions."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltic.functions import symbols, text
from basaltic.operators import summary
from basaltic.plans.events import _events
from basaltic.sources.tables import table


def most_called(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brand of ten or less in its number that most parts name."""
    parts = table(spark, sf_dir, "part")
    return summary.most_called(parts, "p_brand", parts.where("p_partkey % 3 = 0").select("p_brand"), "p_brand")


def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    kind = F.when(F.col("event_type") == "error", "Unknown").otherwise(F.col("event_type"))
    return summary.run_counters(e, kind, F.col("event_id") % 7 == 0, F.floor("value").cast("long"), F.col("event_id"), F.col("user_id"))


def catalogue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as classes with as many properties as their key, regions as enums."""
    n = table(spark, sf_dir, "nation").select("n_name", F.sequence(F.lit(0), F.col("n_nationkey")).alias("properties"), symbols.is_boilerplate_type(F.concat(F.when(F.col("n_nationkey") % 2 == 0, "Object").otherwise("X"), F.col("n_name"))).alias("boilerplate"))
    return summary.catalogue_counts(n, table(spark, sf_dir, "region"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version texts: base, newer than, date tags, last segment, transient errors, compression names."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    mine = F.concat(F.lit("v1."), k % 12, F.lit("."), k % 5, F.lit("-beta"))
    date = F.concat(F.lit("Mon, "), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.when(k % 2 == 0, " Jan ").otherwise(" Nov "), F.lit("2024 10:00:00 GMT"))
    return s.select(
        "s_suppkey",
        F.array_join(F.transform(text.base_version(mine), lambda x: x.cast("string")), ".").alias("base"),
        text.is_newer(mine, F.lit("1.6.2")).alias("newer"),
        text.date_tag(date).alias("dated"),
        text.last_segment(F.concat(F.lit("https://h/releases/tag/"), mine)).alias("tag"),
        text.is_transient(F.when(k % 3 == 0, "dial: i/o timeout").otherwise("not found")).alias("transient"),
        text.compression_name(k % 6).alias("method"),
        text.short_hash(F.concat(F.lit("x#commit:"), F.lpad(F.lower(F.hex(k)), 10, "0")), "commit:").alias("hash"),
    )


QUERIES = {
    "most_called": (most_called, "SELECT p_brand AS name, count(*) AS sites FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_partkey % 3 = 0) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"),
    "run_counters": (
        run_counters,
        """SELECT count(*) AS files, count(*) FILTER (event_id % 7 <> 0) AS handled, count(*) FILTER (event_id % 7 = 0) AS skipped, greatest(CAST(sum(floor(value)) FILTER (event_id % 7 <> 0) AS BIGINT), max(event_id)) AS bytes,
        count(*) FILTER (event_id % 7 <> 0 AND event_type <> 'error') AS decompiled, count(DISTINCT user_id) AS groups FROM events""",
    ),
    "catalogue_counts": (catalogue_counts, "SELECT count(*) AS classes, count(*) FILTER (n_nationkey % 2 = 0) AS boilerplate, CAST(sum(n_nationkey + 1) AS BIGINT) AS properties, (SELECT count(*) FROM region) AS enums FROM nation"),
    "versions": (
        versions,
        """SELECT s_suppkey, '1.' || k % 12 || '.' || k % 5 AS base, k % 12 > 6 OR (k % 12 = 6 AND k % 5 > 2) AS newer, '2024.' || CASE WHEN k % 2 = 0 THEN '01' ELSE '11' END || '.' || lpad((k % 28 + 1)::VARCHAR, 2, '0') AS dated,
        'v1.' || k % 12 || '.' || k % 5 || '-beta' AS tag, k % 3 = 0 AS transient, CASE k % 6 WHEN 0 THEN 'None' WHEN 1 THEN 'Oodle' WHEN 2 THEN 'Brotli' WHEN 3 THEN 'ZStandard' ELSE 'Unknown(' || k % 6 || ')' END AS method,
        lpad(lower(printf('%x', k)), 10, '0')[1:7] AS hash FROM (SELECT s_suppkey, s_suppkey AS k FROM supplier)""",
    ),
}
