"""Queries over bodies: duplicate groups and totals."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltic.functions.symbols import normal_body
from basaltic.operators.dedupe import duplicate_groups, duplicate_totals
from basaltic.sources.tables import table


def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return duplicate_groups(docs, normal_body(F.col("text")), "doc_id", "source").orderBy(F.desc("count"), "canonical")


def norm_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("x = FUN_"), F.lower(F.hex("l_orderkey")), F.lit(" "), F.col("l_returnflag")).alias("body")
    )
    return duplicate_groups(items, normal_body(F.col("body")), "l_orderkey", "body").select("canonical", "count", "truncated").orderBy(F.desc("count"), "canonical")


def dup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_totals(table(spark, sf_dir, "documents"), normal_body(F.col("text")))


_NORMAL = r"regexp_replace(text, '(^|[^A-Za-z0-9_])(FUN|DAT|LAB|UNK|SUB)_[0-9A-Fa-f]+', '\1<SYM>', 'g')"

QUERIES = {
    "dup_groups": (
        dup_groups,
        f"""SELECT min(doc_id) AS canonical, arg_min(source, doc_id) AS canonical_name, count(*) AS "count", count(*) - 1 > 64 AS truncated
        FROM documents WHERE text IS NOT NULL GROUP BY {_NORMAL} HAVING count(*) > 1 ORDER BY 3 DESC, 1""",
    ),
    "norm_dups": (
        norm_dups,
        r"""SELECT min(l_orderkey) AS canonical, count(*) AS "count", count(*) - 1 > 64 AS truncated
        FROM lineitem GROUP BY regexp_replace('x = FUN_' || lower(printf('%x', l_orderkey)) || ' ' || l_returnflag, '(^|[^A-Za-z0-9_])(FUN|DAT|LAB|UNK|SUB)_[0-9A-Fa-f]+', '\1<SYM>', 'g')
        HAVING count(*) > 1""",
    ),
    "dup_totals": (
        dup_totals,
        f"""SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS unique_bodies, CAST(sum(n - 1) AS BIGINT) AS duplicates, count(*) FILTER (n > 1) AS groups
        FROM (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY {_NORMAL})""",
    ),
}
