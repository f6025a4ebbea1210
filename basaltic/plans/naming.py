"""Queries over records, names and classes."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltic.functions import symbols
from basaltic.operators import names, records, summary
from basaltic.sources.tables import table

#: In the driver's prose a line that begins with "The" stands for a header, one that begins with "Of" for a total.
_HEAD, _TOTAL = "^The ", "^Of[ .,]"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = records.numbered_lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    return records.split_records(lines, "doc_id", _HEAD, _TOTAL)


def record_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.record_metrics(_records(spark, sf_dir), "doc_id").select("doc_id", "record", "lines", "size_bytes", "signature")


def record_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.bodies_of(_records(spark, sf_dir), "doc_id")


def function_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a dump of functions, split, named and counted."""
    items = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    name = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("Order::run"), F.col("l_orderkey"))).otherwise(F.concat(F.lit("FUN_"), F.lower(F.hex("l_orderkey"))))
    dump = F.concat(F.lit("// "), F.lpad(F.hex("l_orderkey"), 8, "0"), F.lit("\n\nvoid "), name, F.lit("(int a)\n{ }\n// Total: 1\nlost"))
    lines = records.numbered_lines(items.select("l_orderkey", dump.alias("dump")), "l_orderkey", "dump")
    found = records.functions_of(records.record_metrics(records.split_records(lines, "l_orderkey"), "l_orderkey"))
    return found.select("address", "name", "size_bytes", "lines", "is_named", "signature", symbols.address_bucket(F.col("address")).alias("bucket"))


def named_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = function_index(spark, sf_dir)
    named = F.sum(F.col("is_named").cast("long"))
    return f.agg(F.count("*").alias("total"), named.alias("named"), (F.count("*") - named).alias("anonymous"), summary.percent(named, F.count("*")).alias("named_pct"), F.sum("size_bytes").alias("total_bytes"))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that a single supplier serves, by that supplier."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("Supplier::s"), F.col("l_suppkey")).alias("name"))
    return names.single_name(items, "l_orderkey", "name")


def name_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved names, each kept by the first order that claims it, none that is known already."""
    known = table(spark, sf_dir, "supplier").where("s_suppkey % 7 = 0").select(F.concat(F.lit("Supplier::s"), F.col("s_suppkey")).alias("n"))
    return names.first_claims(names.without_known(_resolved(spark, sf_dir), "new_name", known), "new_name", "l_orderkey")


def rename_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return names.overlaid(orders, "l_orderkey", "o_orderstatus", _resolved(spark, sf_dir), "name").select("l_orderkey", "name")


def hookable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions named of themselves or by resolution, with their old signature."""
    f = function_index(spark, sf_dir).select("address", "name", "signature")
    found = _resolved(spark, sf_dir).select(F.concat(F.lit("0x"), F.lower(F.lpad(F.hex("l_orderkey"), 8, "0"))).alias("address"), "new_name")
    return names.overlaid(f, "address", "name", found, "final").where(~symbols.is_anonymous(F.col("final"))).select("address", F.col("final").alias("name"), "signature")


def _owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    prefix = F.when(F.col("p_partkey") % 4 == 0, "UObject<a::b>").when(F.col("p_partkey") % 4 == 1, "std").otherwise(F.col("p_brand"))
    name = F.when(F.col("p_partkey") % 9 == 0, F.col("p_name")).otherwise(F.concat(prefix, F.lit("::"), F.col("p_type"), F.lit("::"), F.col("p_name")))
    return parts.select("p_partkey", name.alias("name")).withColumn("owner", symbols.owner_class(F.col("name")))


def class_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _owned(spark, sf_dir).select("p_partkey", "owner", symbols.is_boilerplate(F.col("owner")).alias("boilerplate"))


def class_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct owner classes with their flag."""
    return _owned(spark, sf_dir).where("owner <> ''").select(F.col("owner").alias("name")).distinct().withColumn("boilerplate", symbols.is_boilerplate(F.col("name")))


def game_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept and dropped rows of the view without engine functions."""
    rows = _owned(spark, sf_dir).withColumn("engine", symbols.is_engine_function(F.col("name")))
    return rows.groupBy("engine").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


def prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixed names against a catalogue of bare ones."""
    parts = table(spark, sf_dir, "part")
    bare = F.initcap(F.col("p_type"))
    asked = parts.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("U"), bare)).when(F.col("p_partkey") % 3 == 1, bare).otherwise(F.lower(bare)).alias("name"))
    catalogue = parts.where("p_partkey % 2 = 0").select(bare.alias("entry"))
    return names.prefix_lookup(asked, "name", catalogue, "entry").groupBy("matched").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


def labels_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with and without a label, by semi and anti join."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id")
    has = docs.join(labels, "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("labelled"))
    lacks = docs.join(labels, "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("unlabelled"))
    return has.join(lacks, "lang", "full").select("lang", F.coalesce("labelled", F.lit(0)).alias("labelled"), F.coalesce("unlabelled", F.lit(0)).alias("unlabelled"))


_SPLIT = f"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM documents),
    flags AS (SELECT *, regexp_matches(line, '{_HEAD}') AS h, regexp_matches(line, '{_TOTAL}') AS t FROM lines),
    islands AS (SELECT *, CAST(sum(h::INT) OVER w AS BIGINT) AS record, last_value(CASE WHEN h THEN 'h' WHEN t THEN 't' END IGNORE NULLS) OVER w AS kind FROM flags
        WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
    recs AS (SELECT * FROM islands WHERE kind = 'h')"""
_RESOLVED = "SELECT l_orderkey, min(l_suppkey) AS s FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1"
_FUNCTIONS = """SELECT '0x' || lower(printf('%08x', l_orderkey)) AS address, CASE WHEN l_orderkey % 3 = 0 THEN 'Order::run' || l_orderkey ELSE 'FUN_' || lower(printf('%x', l_orderkey)) END AS name,
    l_orderkey FROM (SELECT o_orderkey AS l_orderkey FROM orders)"""
_INDEX = f"SELECT address, name, CAST(12 + 1 + strlen('void ' || name || '(int a)') + 1 + 4 AS BIGINT) AS size_bytes, 4::BIGINT AS lines, l_orderkey % 3 = 0 AS is_named, 'void ' || name || '(int a)' AS signature, address[-6:-4] AS bucket FROM ({_FUNCTIONS})"
_OWNED = """SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE CASE WHEN p_partkey % 4 = 0 THEN 'UObject<a::b>' WHEN p_partkey % 4 = 1 THEN 'std' ELSE p_brand END || '::' || p_type END AS owner FROM part"""
_BOILER = "regexp_matches(owner, '^(?:" + "|".join(symbols.BOILERPLATE) + ")')"

QUERIES = {
    "record_split": (
        record_split,
        rf"""WITH {_SPLIT} SELECT doc_id, record, count(*) AS lines, CAST(sum(strlen(line) + 1) AS BIGINT) AS size_bytes, arg_min(trim(line), n) FILTER (NOT h AND trim(line) <> '') AS signature FROM recs GROUP BY 1, 2""",
    ),
    "record_bodies": (record_bodies, rf"WITH {_SPLIT} SELECT doc_id, record, string_agg(line, chr(10) ORDER BY n) AS body FROM recs WHERE NOT h GROUP BY 1, 2"),
    "function_index": (function_index, _INDEX),
    "named_percent": (
        named_percent,
        f"SELECT count(*) AS total, count(*) FILTER (is_named) AS named, count(*) FILTER (NOT is_named) AS anonymous, floor(count(*) FILTER (is_named) * 100.0 / count(*) * 100 + 0.5) / 100 AS named_pct, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM ({_INDEX})",
    ),
    "name_resolve": (
        name_resolve,
        f"SELECT min(l_orderkey) AS l_orderkey, 'Supplier::s' || s AS new_name FROM ({_RESOLVED}) WHERE s NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 = 0) GROUP BY s",
    ),
    "rename_overlay": (rename_overlay, f"SELECT o_orderkey AS l_orderkey, coalesce('Supplier::s' || s, o_orderstatus) AS name FROM orders LEFT JOIN ({_RESOLVED}) ON o_orderkey = l_orderkey"),
    "hookable": (
        hookable,
        f"""SELECT address, coalesce('Supplier::s' || s, name) AS name, 'void ' || name || '(int a)' AS signature FROM ({_FUNCTIONS}) f LEFT JOIN ({_RESOLVED}) r ON f.l_orderkey = r.l_orderkey
        WHERE NOT regexp_matches(coalesce('Supplier::s' || s, name), '^(FUN_|DAT_|LAB_|UNK_|SUB_)')""",
    ),
    "class_owner": (class_owner, f"SELECT p_partkey, owner, {_BOILER} AS boilerplate FROM ({_OWNED})"),
    "class_flags": (class_flags, f"SELECT DISTINCT owner AS name, {_BOILER} AS boilerplate FROM ({_OWNED}) WHERE owner <> ''"),
    "game_view": (game_view, f'SELECT owner <> \'\' AND {_BOILER} AS engine, count(*) AS n, min(p_partkey) AS "first" FROM ({_OWNED}) GROUP BY 1'),
    "prefix_lookup": (
        prefix_lookup,
        """WITH p AS (SELECT p_partkey, (SELECT string_agg(upper(w[1]) || lower(w[2:]), ' ' ORDER BY i) FROM (SELECT unnest(string_split(p_type, ' ')) AS w, unnest(range(0, len(string_split(p_type, ' ')))) AS i)) AS bare FROM part),
        a AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'U' || bare WHEN p_partkey % 3 = 1 THEN bare ELSE lower(bare) END AS name FROM p), c AS (SELECT DISTINCT bare AS e FROM p WHERE p_partkey % 2 = 0)
        SELECT matched, count(*) AS n, count(DISTINCT name) AS names FROM (SELECT name, coalesce(x.e, y.e) AS matched FROM a LEFT JOIN c x ON name = x.e
        LEFT JOIN c y ON y.e = CASE WHEN regexp_matches(name, '^[UAF][A-Z]') THEN name[2:] ELSE name END) GROUP BY 1""",
    ),
    "labels_semi": (
        labels_semi,
        "SELECT lang, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS labelled, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS unlabelled FROM documents GROUP BY 1",
    ),
}
