"""Queries over binary adapters, writers and streams."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltic.functions import symbols, text
from basaltic.operators.timeline import mapped_stage
from basaltic.plans.events import _PHASES, micros
from basaltic.session import shared_dir
from basaltic.sources import binary, files
from basaltic.sources.tables import table
from basaltic.streaming import status


def _le(n: Column) -> Column:
    """A 32-bit number as little-endian hex."""
    h = F.lpad(F.hex(n), 8, "0")
    return F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1)))


def asset_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as asset packages of two names each; every tenth one is broken."""
    s = table(spark, sf_dir, "supplier")
    names = [F.col("s_name"), F.concat(F.lit("Nation_"), F.col("s_nationkey"))]
    entries = F.concat(*(F.concat(_le(F.length(n)), F.hex(n.cast("binary")), F.lit("00000000")) for n in names))
    head = F.concat(F.when(F.col("s_suppkey") % 10 == 3, "00000000").otherwise("C1832A9E"), F.lit("F9FFFFFF"), F.lit("00000000" * 3), F.lit("00000000" * 4), F.lit("02000000"), F.lit("30000000"), F.lit("00000000"))
    made = s.select(F.col("s_suppkey").cast("string").alias("path"), F.unhex(F.concat(head, F.lit("00000000"), entries)).alias("content"))
    return binary.parse_assets(made).select("path", F.col("error").isNotNull().alias("failed"), "total_names", F.array_join("names", ",").alias("names"))


def asset_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = asset_names(spark, sf_dir).select(F.when(F.col("failed"), "x").alias("error"), "total_names")
    return binary.asset_totals(rows)


def class_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as classes of their regions, with two fields each, as C++-like text."""
    n = table(spark, sf_dir, "nation")
    field = lambda kind, name, dim: F.struct(F.lit(kind).alias("cpp_type"), F.lit(name).alias("name"), dim.alias("array_dim"))
    classes = n.select(
        F.col("n_name").alias("name"), F.when(F.col("n_regionkey") > 0, F.concat(F.lit("R"), F.col("n_regionkey"))).alias("super"), symbols.is_boilerplate_type(F.col("n_name")).alias("boilerplate"),
        F.array(field("float", "Health", F.lit(1)), field("TArray<FName>", "Tags", F.col("n_nationkey"))).alias("properties"),
    )
    return files.class_headers(classes)


def enum_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as enums of their nations."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("value"))).alias("values"))
    return files.enum_headers(n.select(F.concat(F.lit("E"), F.col("n_regionkey")).alias("name"), "values"))


def bucketed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written by address bucket and read back: rows of each bucket."""
    e = table(spark, sf_dir, "events").select("event_id", F.hex(F.col("event_id") * 409).alias("address"))
    path = f"{shared_dir(spark)}/basaltic/bucketed-{uuid.uuid4().hex}"
    files.write_bucketed(e, path, "address", 400)
    back = spark.read.schema("event_id long, address string, bucket string").json(path)
    return back.groupBy("bucket").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


def string_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of printable ASCII of six or more in the bytes of texts, by language."""
    runs = table(spark, sf_dir, "documents").select("lang", F.explode(text.ascii_runs(F.col("text").cast("binary"))).alias("run"))
    return runs.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("run")).alias("length"), F.max("run").alias("last"))


def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stateful fold over the event stream, run to its end; the last status of each run."""
    schema = table(spark, sf_dir, "events").schema
    source = status.event_source(spark, f"{sf_dir.rstrip('/')}/events.parquet", schema, 8, "parquet")
    phase = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in _PHASES.items() for x in p]), F.col("event_type")), F.lit("log"))
    events = source.select(
        F.col("user_id").alias("run"), (micros(F.col("ts")) * 1000 + F.col("event_id") % 1000).alias("position"), phase.alias("phase"),
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("t"), F.col("event_id"))).otherwise("").alias("target"), F.when(F.col("event_id") % 9 == 0, F.col("event_id")).otherwise(0).alias("files_total"),
    )
    base = f"{shared_dir(spark)}/basaltic/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = status.fold_status(events).writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    every = spark.read.schema(status.STATUS + ", batch int").parquet(f"{base}/out")
    last = every.groupBy("run").agg(F.max(F.struct("batch", "phase", "target", "files_total", "events")).alias("m"))
    return last.select("run", "m.phase", "m.target", "m.files_total", "m.events")


def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by stage; phases without one are unknown."""
    phase = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in _PHASES.items() for x in p]), F.col("event_type")), F.lit("log"))
    return table(spark, sf_dir, "events").groupBy(F.coalesce(mapped_stage(phase), F.lit("unknown")).alias("stage")).agg(F.count("*").alias("n"))


QUERIES = {
    "asset_names": (
        asset_names,
        "SELECT CAST(s_suppkey AS VARCHAR) AS path, s_suppkey % 10 = 3 AS failed, CASE WHEN s_suppkey % 10 <> 3 THEN 2::BIGINT END AS total_names, CASE WHEN s_suppkey % 10 <> 3 THEN s_name || ',Nation_' || s_nationkey END AS names FROM supplier",
    ),
    "asset_totals": (asset_totals, "SELECT count(*) FILTER (s_suppkey % 10 <> 3) AS parsed, count(*) FILTER (s_suppkey % 10 = 3) AS failed, 2 * count(*) FILTER (s_suppkey % 10 <> 3) AS total_names FROM supplier"),
    "class_text": (
        class_text,
        """SELECT n_name AS name, 'class ' || n_name || CASE WHEN n_regionkey > 0 THEN ' : public R' || n_regionkey ELSE '' END || ' {' || chr(10) || '    float Health;' || chr(10) || '    TArray<FName> Tags' || CASE WHEN n_nationkey > 1 THEN '[' || n_nationkey || ']' ELSE '' END || ';' || chr(10) || '};' AS text FROM nation""",
    ),
    "enum_text": (
        enum_text,
        """SELECT 'E' || n_regionkey AS name, 'enum class E' || n_regionkey || ' {' || chr(10) || string_agg('    ' || n_name || ' = ' || n_nationkey || ',', chr(10) ORDER BY n_nationkey) || chr(10) || '};' AS text FROM nation GROUP BY n_regionkey""",
    ),
    "bucketed_files": (bucketed_files, "SELECT lower(right('000000' || printf('%x', event_id * 409), 6)[1:3]) AS bucket, count(*) AS n, min(event_id) AS \"first\" FROM events GROUP BY 1"),
    "string_runs": (string_runs, None),
    "stream_status": (
        stream_status,
        """SELECT user_id AS run, arg_max(CASE event_type WHEN 'click' THEN 'execute' WHEN 'view' THEN 'scan' WHEN 'purchase' THEN 'install' WHEN 'signup' THEN 'recon' WHEN 'error' THEN 'skip' WHEN 'login' THEN 'tools' WHEN 'logout' THEN 'done' ELSE 'log' END, (epoch_us(ts), event_id)) AS phase,
        coalesce(arg_max('t' || event_id, (epoch_us(ts), event_id)) FILTER (event_id % 5 = 0), '') AS target, coalesce(arg_max(event_id, (epoch_us(ts), event_id)) FILTER (event_id % 9 = 0 AND event_id > 0), 0) AS files_total, count(*) AS events FROM events GROUP BY 1""",
    ),
    "stage_counts": (
        stage_counts,
        "SELECT CASE event_type WHEN 'click' THEN 'execute' WHEN 'view' THEN 'analysis' WHEN 'purchase' THEN 'tools' WHEN 'signup' THEN 'analysis' WHEN 'error' THEN 'unknown' WHEN 'login' THEN 'tools' WHEN 'logout' THEN 'done' ELSE 'execute' END AS stage, count(*) AS n FROM events GROUP BY 1",
    ),
}
