"""Records out of line streams: a header opens a record, a total line closes it."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basaltic.functions.symbols import function_name
from basaltic.functions.text import trimmed

HEADER = r"^// (?:[A-Za-z_][A-Za-z0-9_]*:)?([0-9A-Fa-f]{4,16})\z"
TOTAL = "^// Total:"


def numbered_lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, n and line of whole texts, numbered from 0."""
    return rows.select(F.col(key), F.posexplode(F.split(F.col(text), "\n")).alias("n", "line"))


def split_records(lines: DataFrame, key: str, header: str = HEADER, total: str = TOTAL) -> DataFrame:
    """The lines with `record`, the number of their record within the key; lines outside any record are dropped.

    Islands by a running count of headers and totals, for each key in the order of n; an island that a total line opens is no record."""
    flagged = lines.withColumn("_h", F.col("line").rlike(header)).withColumn("_t", F.col("line").rlike(total))
    run = W.partitionBy(key).orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    # total lines count twice their islands apart: the last opener says which kind the island is
    opened = flagged.withColumn("record", F.sum(F.col("_h").cast("long")).over(run)).withColumn("_kind", F.last(F.when(F.col("_h"), "h").when(F.col("_t"), "t"), True).over(run))
    return opened.where("_kind = 'h'").drop("_t", "_kind").withColumnRenamed("_h", "is_header")


def record_metrics(lines: DataFrame, key: str) -> DataFrame:
    """Of each record: lines, bytes (a line feed each counted), address and signature, its first line with text after the header."""
    text = trimmed(F.col("line"))
    body = F.when(~F.col("is_header") & (text != ""), F.struct("n", text.alias("t")))
    return lines.groupBy(key, "record").agg(
        F.count("*").alias("lines"),
        F.sum(F.octet_length("line") + 1).alias("size_bytes"),
        F.max(F.when(F.col("is_header"), F.col("line"))).alias("header"),
        F.min(body)["t"].alias("signature"),
    )


def functions_of(records: DataFrame) -> DataFrame:
    """Records as functions: address (0x, lower case), name from the signature or made from the address, is_named."""
    digits = F.lower(F.regexp_extract("header", HEADER, 1))
    own = F.coalesce(function_name(F.col("signature")), F.lit(""))
    named = records.withColumn("address", F.concat(F.lit("0x"), digits)).withColumn("name", F.when(own != "", own).otherwise(F.concat(F.lit("FUN_"), digits)))
    from basaltic.functions.symbols import is_anonymous

    return named.withColumn("is_named", ~is_anonymous(F.col("name")))


def bodies_of(lines: DataFrame, key: str) -> DataFrame:
    """The text of each record without its header and separator lines."""
    kept = lines.where(~F.col("is_header") & ~F.col("line").startswith("// === "))
    rows = kept.groupBy(key, "record").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("_l"))
    return rows.select(key, "record", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("body"))
