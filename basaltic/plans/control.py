"""Queries over tools, groups of files and displays."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltic.functions import routing, text
from basaltic.operators import control
from basaltic.plans.events import _events
from basaltic.plans.routes import _FILES, _RECON, _names, _recon
from basaltic.sources.tables import table


def _game_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as files of games by nation: main library, metadata, managed folder or other."""
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    name = F.when(k % 10 == 0, F.lit("/GameAssembly.dll")).when(k % 10 == 1, F.lit("/x_Data/il2cpp/global-metadata.dat")).when(k % 10 == 2, F.concat(F.lit("/x_Data/Managed/a"), k, F.lit(".dll"))).otherwise(F.concat(F.lit("/bin/b"), k, F.lit(".exe")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("g"), F.when(k % 10 == 1, n % 12).otherwise(n), name).alias("path"))


def file_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = control.grouped_files(_game_files(spark, sf_dir), "path")
    return g.groupBy("kind", "root").agg(F.count("*").alias("files"), F.min("path").alias("first"))


def content_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' containers by the folder above them that holds Content, else their grandparent."""
    s = table(spark, sf_dir, "supplier")
    files = s.select(F.concat(F.lit("r/n"), F.col("s_nationkey"), F.lit("/a/b/s"), F.col("s_suppkey"), F.lit(".pak")).alias("path"))
    folders = s.where("s_nationkey % 2 = 0").select(F.concat(F.lit("r/n"), F.col("s_nationkey"), F.lit("/Content")).alias("folder"))
    return control.content_root(files, folders, "path", "folder")


def main_executable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's main executable among orders as files."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    path = F.concat(F.when(k % 3 == 0, "x/Binaries/Win64/").otherwise("y/"), F.lit("o"), k, F.when(k % 7 == 0, "-Shipping.exe").when(k % 7 == 1, ".dll").otherwise(".exe"))
    return control.main_executable(o.select("o_custkey", path.alias("path"), F.floor("o_totalprice").alias("size")), "o_custkey", "path", "size", routing.TOOL_EXECUTABLES)


def tools_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools and runtimes that the routed files need, in the order in which these need them."""
    registry = control.Registry()
    registry.register(control.Recipe("managed", lambda: F.col("kind") == "Managed", lambda d: d, ("ilspycmd", "de4dot-cex")))
    registry.register(control.Recipe("native", lambda: F.col("kind").isin("Native", "UnrealEngine"), lambda d: d, ("ghidra", "strings", "ilspycmd")))
    registry.register(control.Recipe("never", lambda: F.lit(False), lambda d: d, ("retoc",)))
    routed = registry.route(_recon(spark, sf_dir))
    return control.required(routed, registry.requirements(spark), control.tool_table(spark), "c_custkey")


def tool_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools with versions by region and running operations by nation."""
    n = table(spark, sf_dir, "nation")
    tools = control.tool_table(spark)
    at = F.element_at(F.array(*(F.lit(t[0]) for t in control.TOOLS)), (F.col("n_nationkey") + 1).cast("int"))
    versions = n.where("n_nationkey < 8").select(at.alias("name"), F.when(F.col("n_regionkey") > 0, F.concat(F.lit("1."), F.col("n_regionkey"))).alias("version"), F.lit("1.2").alias("latest"))
    running = n.where("n_nationkey between 6 and 9").select(at.alias("name"), F.lit("installing").alias("state"))
    return control.tool_status(tools, versions, running)


def tool_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names that hold a needle in any case."""
    return control.searched(_names(spark, sf_dir), "BRAND#1", "name").groupBy("name").agg(F.count("*").alias("n"))


def display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return control.display_order(e, "event_type", F.when(F.col("event_type") != "error", F.col("user_id") % 50 + 1), F.col("event_id"))


def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.log_tail(_events(spark, sf_dir).select("user_id", "event_id", "us"), "user_id", [F.desc("us"), F.desc("event_id")], 5)


def rolled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and bytes of each file that events roll into by type."""
    e = _events(spark, sf_dir).select("event_type", "event_id", F.floor("value").cast("long").alias("size"))
    return control.rolled(e, "event_type", "event_id", "size", 1000).groupBy("event_type", "file").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def release_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned tags: cached while fresh, else live, else stale."""
    o = table(spark, sf_dir, "orders")
    cached = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("key"), F.concat(F.lit("v"), F.col("o_orderkey")).alias("tag"), (F.col("o_orderkey") * 10).alias("cached_at"))
    live = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("key"), F.concat(F.lit("Tool_"), F.col("o_orderkey"), F.lit("_build")).alias("tag"))
    return control.fresh_or_stale(cached, live, F.lit(20000)).select("key", text.clean_tag(F.col("tag")).alias("tag"))


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of each page's bytes."""
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha256"), F.octet_length("html").cast("long").alias("size"))


_NAMES = "['diec', 'ilspycmd', 'strings', 'de4dot-cex', 'ghidra', 'nofuserex', 'confuserex-killer', 'proxycall-remover', 'idr', 'goresym', 'retoc', 'il2cppdumper']"
_GAME = "(SELECT c_custkey AS k, c_nationkey AS n, CASE c_custkey % 10 WHEN 0 THEN 'g' || c_nationkey || '/GameAssembly.dll' WHEN 1 THEN 'g' || c_nationkey % 12 || '/x_Data/il2cpp/global-metadata.dat' WHEN 2 THEN 'g' || c_nationkey || '/x_Data/Managed/a' || c_custkey || '.dll' ELSE 'g' || c_nationkey || '/bin/b' || c_custkey || '.exe' END AS path FROM customer)"

QUERIES = {
    "file_groups": (
        file_groups,
        f"""SELECT kind, root, count(*) AS files, min(path) AS "first" FROM (SELECT path, CASE WHEN k % 10 = 0 AND n IN (SELECT n % 12 FROM {_GAME} WHERE k % 10 = 1) THEN 'UnityIL2CPP' WHEN k % 10 = 2 THEN 'UnityMono' ELSE 'Standalone' END AS kind,
        CASE WHEN k % 10 = 2 OR (k % 10 = 0 AND n IN (SELECT n % 12 FROM {_GAME} WHERE k % 10 = 1)) THEN 'g' || n ELSE '' END AS root FROM {_GAME}) GROUP BY 1, 2""",
    ),
    "content_roots": (content_roots, "SELECT 'r/n' || s_nationkey || '/a/b/s' || s_suppkey || '.pak' AS path, 'r/n' || s_nationkey || CASE WHEN s_nationkey % 2 = 0 THEN '' ELSE '/a' END AS root FROM supplier"),
    "main_executable": (
        main_executable,
        """SELECT o_custkey, arg_min(path, (o, CASE WHEN o = 0 THEN 0 ELSE -size END, path)) AS executable FROM (SELECT o_custkey, (CASE WHEN k % 3 = 0 THEN 'x/Binaries/Win64/' ELSE 'y/' END) || 'o' || k || CASE WHEN k % 7 = 0 THEN '-Shipping.exe' ELSE '.exe' END AS path,
        CASE WHEN k % 3 = 0 AND k % 7 = 0 THEN 0 WHEN k % 3 = 0 THEN 1 ELSE 2 END AS o, CAST(floor(o_totalprice) AS BIGINT) AS size FROM (SELECT *, o_orderkey AS k FROM orders) WHERE k % 7 <> 1) GROUP BY 1""",
    ),
    "tools_needed": (tools_needed, f"""WITH need(recipe, pos, tool, runtime) AS (VALUES ('managed', 0, 'ilspycmd', 'dotnet'), ('managed', 1, 'de4dot-cex', ''), ('native', 0, 'ghidra', 'java'), ('native', 1, 'strings', ''), ('native', 2, 'ilspycmd', 'dotnet'))
        SELECT tool, runtime, CAST(row_number() OVER (ORDER BY min(key * 10 + pos)) AS INTEGER) AS place FROM need JOIN (SELECT CASE WHEN kind = 'Managed' THEN 'managed' ELSE 'native' END AS recipe, min(c_custkey) AS key FROM {_RECON} WHERE kind IN ('Managed', 'Native', 'UnrealEngine') GROUP BY 1) USING (recipe) GROUP BY 1, 2"""),
    "tool_board": (
        tool_board,
        f"""SELECT name, (['detector', 'decompiler', 'analyzer', 'deobfuscator', 'decompiler', 'deobfuscator', 'unpacker', 'deobfuscator', 'decompiler', 'analyzer', 'extractor', 'extractor'])[i] AS category,
        coalesce(n_regionkey > 0 AND i <= 8, false) AS installed, coalesce(n_regionkey > 0 AND i <= 8 AND n_regionkey <> 2, false) AS update_available, CASE WHEN i BETWEEN 7 AND 10 THEN 'installing' ELSE 'idle' END AS state
        FROM (SELECT unnest({_NAMES}) AS name, unnest(range(1, 13)) AS i) LEFT JOIN nation ON n_nationkey = i - 1""",
    ),
    "tool_search": (tool_search, f"SELECT name, count(*) AS n FROM {_FILES} WHERE lower(name) LIKE '%brand#1%' GROUP BY 1"),
    "display_order": (display_order, "SELECT event_type, coalesce(min(CASE WHEN event_type <> 'error' THEN user_id % 50 + 1 END), 999) AS first_step, min(event_id) AS first_seen FROM events GROUP BY 1"),
    "log_tail": (log_tail, "SELECT user_id, event_id, epoch_us(ts) AS us FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5"),
    "rolled_files": (
        rolled_files,
        """WITH RECURSIVE e AS (SELECT event_type, CAST(floor(value) AS BIGINT) AS size, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events),
        sums AS (SELECT *, sum(size) OVER (PARTITION BY event_type ORDER BY r) AS upto FROM e),
        walk AS (SELECT event_type, CAST(0 AS BIGINT) AS file, CAST(1 AS BIGINT) AS a FROM e WHERE r = 1 UNION ALL
        SELECT w.event_type, w.file + 1, (SELECT min(s.r) + 1 FROM sums s WHERE s.event_type = w.event_type AND s.r >= w.a AND s.upto - w.upto + w.size >= 1000) FROM (SELECT walk.*, s.upto, s.size FROM walk JOIN sums s ON s.event_type = walk.event_type AND s.r = walk.a) w),
        spans AS (SELECT event_type, file, a, lead(a) OVER (PARTITION BY event_type ORDER BY file) AS b FROM walk)
        SELECT event_type, file, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM spans JOIN e USING (event_type) WHERE r >= a AND (b IS NULL OR r < b) GROUP BY 1, 2""",
    ),
    "release_tags": (release_tags, "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 AND (o_orderkey % 2 = 1 OR o_orderkey < 1640) THEN 'Tool_' || o_orderkey || '_build' ELSE CAST(o_orderkey AS VARCHAR) END AS tag FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0"),
    "content_hashes": (content_hashes, "SELECT page_id, sha256(html) AS sha256, strlen(html) AS size FROM pages"),
}
