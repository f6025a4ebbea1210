"""Queries over classification, routing and file layout."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltic.functions import routing, symbols
from basaltic.functions.globs import glob_pattern
from basaltic.operators import paths, summary
from basaltic.sources.tables import table


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier and part names as file names, some of them of skipped kinds."""
    s = table(spark, sf_dir, "supplier").select(F.concat("s_name", F.lit(".dll")).alias("name"))
    p = table(spark, sf_dir, "part").select(
        F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("System."), F.col("p_brand"), F.lit(".dll")))
        .when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("MonoMod."), F.col("p_size"), F.lit(".dll")))
        .when(F.col("p_partkey") % 5 == 2, F.concat(F.lit("kernel"), F.col("p_size"), F.lit(".dll")))
        .otherwise(F.concat(F.lit("Mono."), F.col("p_brand"), F.lit(".exe")))
        .alias("name")
    )
    return s.union(p)


def skip_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = routing.skip_reason(F.col("name"), include=("system.brand#11.dll",), custom=("monomod.7.dll",))
    return _names(spark, sf_dir).groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


def skip_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pattern table joined to all names: how many names each glob meets."""
    found = [F.struct(F.lit(c).alias("category"), F.lit(g).alias("glob"), F.lower("name").rlike(glob_pattern(g.lower())).alias("hit")) for c, globs in routing.SKIP_GLOBS.items() for g in globs]
    rows = _names(spark, sf_dir).select("name", F.explode(F.filter(F.array(*found), lambda x: x["hit"])).alias("x"))
    return rows.groupBy("x.category", "x.glob").agg(F.count("*").alias("n"))


def _recon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as classified files: kind by market segment, compiler and obfuscator by nation, packed by balance."""
    c = table(spark, sf_dir, "customer")
    kinds = F.element_at(F.array(*map(F.lit, ["Managed", "Native", "UnityMono", "UnityIL2CPP", "UnrealEngine", "Unknown"])), (F.col("c_custkey") % 6 + 1).cast("int"))
    compiler = F.when(F.col("c_nationkey") % 3 == 0, "Borland Delphi 7").otherwise(F.lit(None).cast("string"))
    obfuscator = F.when(F.col("c_nationkey") % 4 == 0, "ConfuserEx").when(F.col("c_nationkey") % 4 == 1, "Babel").otherwise("")
    group = F.when(F.col("c_custkey") % 11 == 0, "Unreal").when(F.col("c_custkey") % 11 == 1, "UnityMono").otherwise("Standalone")
    return c.select("c_custkey", routing.overridden_kind(kinds, group).alias("kind"), compiler.alias("compiler"), obfuscator.alias("obfuscator"), (F.col("c_acctbal") < 0).alias("packed"))


def recipe_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _recon(spark, sf_dir)
    return r.select(
        "c_custkey",
        "kind",
        routing.recipe(F.col("kind"), F.col("compiler"), F.col("obfuscator"), F.col("packed")).alias("recipe"),
        routing.needs_deobfuscation(F.col("obfuscator"), F.col("packed")).alias("needs_deobfuscation"),
        routing.deobfuscator(F.col("obfuscator")).alias("tool"),
    )


def recipe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run summary over routed files."""
    routed = recipe_route(spark, sf_dir)
    made = summary.run_summary(routed, F.col("recipe").isNull(), F.col("c_custkey") % 10 == 3, F.col("kind"), F.col("recipe"))
    return made.select("total", "skipped", "failed", "success", F.to_json("by_kind").alias("by_kind"), F.to_json("by_recipe").alias("by_recipe"))


def mangled_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by language as type names."""
    words = table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", "[^\\w]+")).alias("name"))
    return routing.mangled_ratio(words, "lang", "name")


def obf_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of a document that holds a needle; every seventh line number of some documents gets one."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    marked = F.when((F.col("pos") + F.col("doc_id")) % 7 == 3, F.concat("line", F.lit(" Babel 2"))).when((F.col("pos") + F.col("doc_id")) % 7 == 5, F.concat(F.lit("x.Protect Confuser "), F.col("line"))).otherwise(F.col("line"))
    return routing.first_obfuscator(lines.withColumn("line", marked), "doc_id", "pos", "line")


def embedded_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of embedded payloads in texts, in the markers' order."""
    text = F.concat(F.when(F.col("doc_id") % 3 == 0, "ILMerge ").otherwise(""), F.col("text"), F.when(F.col("doc_id") % 2 == 0, " costura.dll").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(routing.marks(text, routing.EMBEDDED_MARKERS), ",").alias("signals"))


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: the URL without its scheme and query."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*", "")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.octet_length("html").cast("long").alias("size"), "html")


def ancestor_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page folders without an ancestor among them."""
    roots = _urls(spark, sf_dir).select(paths.parent(F.col("path")).alias("root")).distinct()
    nested = _urls(spark, sf_dir).where("page_id % 3 = 0").select(paths.clean_path(F.col("path")).alias("root")).distinct()
    return paths.topmost(roots.union(nested).distinct(), "root")


def nearest_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the longest root above them."""
    roots = _urls(spark, sf_dir).where("page_id % 4 = 0").select(paths.parent(F.col("path")).alias("root")).distinct()
    return paths.nearest_root(_urls(spark, sf_dir).select("page_id", "path"), "path", roots, "root").groupBy("root").agg(F.count("*").alias("n"))


def representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's largest order, urgent ones first."""
    o = table(spark, sf_dir, "orders")
    files = o.select("o_custkey", F.concat(F.lit("o/"), F.col("o_orderkey"), F.when(F.col("o_orderpriority") == "1-URGENT", ".pak").otherwise(".ucas")).alias("path"), F.floor("o_totalprice").alias("size"))
    return paths.representative(files, "o_custkey", "path", "size", ".pak")


def companion_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as folders: those that hold the main file and, somewhere below, the other; and siblings of a stem."""
    s = table(spark, sf_dir, "supplier")
    rows = s.select(F.explode(F.array(
        F.concat(F.lit("n"), F.col("s_nationkey"), F.when(F.col("s_suppkey") % 2 == 0, "/GameAssembly.dll").otherwise("/other.dll")),
        F.concat(F.lit("n"), F.col("s_nationkey"), F.lit("/d"), F.col("s_suppkey"), F.when(F.col("s_suppkey") % 5 == 0, "/x/global-metadata.DAT").otherwise("/x/y.dat")),
        F.concat(F.lit("p"), F.col("s_nationkey"), F.lit("/f"), F.col("s_suppkey"), F.when(F.col("s_suppkey") % 3 == 0, ".pak").otherwise(".utoc")),
        F.concat(F.lit("p"), F.col("s_nationkey"), F.lit("/f"), F.col("s_suppkey") + 1, F.when(F.col("s_suppkey") % 4 == 0, ".utoc").otherwise(".pak")),
    )).alias("path"))
    one = paths.companions(rows, "path", "GameAssembly.dll", "global-metadata.dat").withColumn("kind", F.lit("companion"))
    return one.unionByName(paths.sibling_folders(rows, "path", ".pak", ".utoc").withColumn("kind", F.lit("sibling")))


def common_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "customer").select(F.concat(F.lit("data/"), F.lit("c/"), F.col("c_nationkey"), F.lit("/"), F.col("c_custkey"), F.lit(".bin")).alias("path"))
    return paths.common_folder(files, "path")


def addr_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(symbols.address_bucket(F.hex(F.col("event_id") * 4099 + 5368709120)).alias("bucket"))
    return e.groupBy("bucket").agg(F.count("*").alias("n"))


def ext_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.extension_counts(_urls(spark, sf_dir), "path")


def file_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.file_index(_urls(spark, sf_dir).select(F.concat("path", F.lit("/"), F.col("page_id")).alias("path"), "html"), "path", "html")


def folder_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.folder_statistics(_urls(spark, sf_dir), "path", "size")


_FILES = """(SELECT s_name || '.dll' AS name FROM supplier UNION ALL SELECT CASE p_partkey % 5 WHEN 0 THEN 'System.' || p_brand || '.dll' WHEN 1 THEN 'MonoMod.' || p_size || '.dll'
    WHEN 2 THEN 'kernel' || p_size || '.dll' ELSE 'Mono.' || p_brand || '.exe' END FROM part)"""
_RE = {c: "|".join("(?:" + glob_pattern(g.lower()).replace("\\z", "$") + ")" for g in globs) for c, globs in sorted(routing.SKIP_GLOBS.items())}
_RECON = """(SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'UnrealEngine' WHEN c_custkey % 11 = 1 THEN 'UnityMono' ELSE (['Managed', 'Native', 'UnityMono', 'UnityIL2CPP', 'UnrealEngine', 'Unknown'])[c_custkey % 6 + 1] END AS kind,
    c_nationkey % 3 = 0 AS delphi, CASE c_nationkey % 4 WHEN 0 THEN 'ConfuserEx' WHEN 1 THEN 'Babel' ELSE '' END AS obf, c_acctbal < 0 AS packed FROM customer)"""
_ROUTED = f"""(SELECT c_custkey, kind, CASE WHEN kind = 'Managed' AND obf = 'ConfuserEx' THEN 'dotnet-confuserex' WHEN kind = 'Native' AND delphi THEN 'delphi' WHEN kind = 'Managed' AND obf = '' AND NOT packed THEN 'dotnet-generic'
    WHEN kind = 'UnityIL2CPP' THEN 'unity-il2cpp' WHEN kind = 'Native' THEN 'native' WHEN kind = 'UnrealEngine' THEN 'ue5' WHEN kind = 'UnityMono' THEN 'unity-mono' END AS recipe,
    obf <> '' OR packed AS needs_deobfuscation, CASE WHEN obf = 'ConfuserEx' THEN 'de4dot' ELSE '' END AS tool FROM {_RECON})"""
_URLS = "(SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*', '') AS path, strlen(html) AS size, html FROM pages)"
_CLEAN = lambda c: f"array_to_string(list_filter(string_split({c}, '/'), lambda x: x <> '' AND x <> '.'), '/')"
_PARENT = "regexp_replace(path, '[/]?[^/]*$', '')"

QUERIES = {
    "skip_list": (
        skip_list,
        f"SELECT coalesce(CASE WHEN low = 'system.brand#11.dll' THEN NULL WHEN low = 'monomod.7.dll' THEN 'custom' {' '.join(f'''WHEN regexp_matches(low, '{r}') THEN '{c}' ''' for c, r in _RE.items())} END, 'kept') AS reason, count(*) AS n, count(DISTINCT name) AS names FROM (SELECT name, lower(name) AS low FROM {_FILES}) GROUP BY 1",
    ),
    "skip_patterns": (
        skip_patterns,
        " UNION ALL ".join(f"SELECT '{c}' AS category, '{g}' AS glob, count(*) AS n FROM {_FILES} WHERE regexp_matches(lower(name), '{glob_pattern(g.lower()).replace(chr(92) + 'z', '$')}') HAVING count(*) > 0" for c, globs in routing.SKIP_GLOBS.items() for g in globs),
    ),
    "recipe_route": (recipe_route, f"SELECT * FROM {_ROUTED}"),
    "recipe_summary": (
        recipe_summary,
        f"""WITH r AS (SELECT *, recipe IS NULL AS sk, c_custkey % 10 = 3 AS er FROM {_ROUTED}),
        k AS (SELECT '{{' || string_agg('"' || kind || '":' || n, ',' ORDER BY kind) || '}}' AS by_kind FROM (SELECT kind, count(*) AS n FROM r GROUP BY 1)),
        c AS (SELECT '{{' || string_agg('"' || recipe || '":' || n, ',' ORDER BY recipe) || '}}' AS by_recipe FROM (SELECT recipe, count(*) AS n FROM r WHERE recipe IS NOT NULL GROUP BY 1))
        SELECT count(*) AS total, count(*) FILTER (sk) AS skipped, count(*) FILTER (NOT sk AND er) AS failed, count(*) FILTER (NOT sk AND NOT er) AS success, any_value(by_kind) AS by_kind, any_value(by_recipe) AS by_recipe FROM r, k, c""",
    ),
    "mangled_ratio": (
        mangled_ratio,
        r"""SELECT lang, count(*) AS total, avg(m::INT) AS ratio, count(*) >= 20 AND avg(m::INT) >= 0.4 AS flagged FROM (SELECT lang, regexp_matches(w, '[^\x00-\x7e]') OR regexp_full_match(w, '[a-z]{1,2}') AS m
        FROM (SELECT lang, unnest(regexp_split_to_array(text, '[^0-9A-Za-z_]+')) AS w FROM documents) WHERE w <> '') GROUP BY 1""",
    ),
    "obf_first": (
        obf_first,
        """SELECT doc_id, arg_min(CASE WHEN line LIKE '%ConfuserEx%' THEN 'ConfuserEx' WHEN line LIKE '%Confuser%' THEN 'Confuser' ELSE 'Babel' END, pos) AS obfuscator
        FROM (SELECT doc_id, pos, CASE (pos + doc_id) % 7 WHEN 3 THEN line || ' Babel 2' WHEN 5 THEN 'x.Protect Confuser ' || line ELSE line END AS line FROM
        (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents)) WHERE line LIKE '%Confuser%' OR line LIKE '%Babel%' GROUP BY 1""",
    ),
    "embedded_markers": (
        embedded_markers,
        "SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 2 = 0 OR contains(text, 'costura.') THEN 'Costura.Fody resources' END, CASE WHEN contains(text, 'Costura.AssemblyLoader') THEN 'Costura.Fody loader' END, CASE WHEN contains(text, 'AssemblyResolve') THEN 'AssemblyResolve hook' END, CASE WHEN doc_id % 3 = 0 OR contains(text, 'ILMerge') THEN 'ILMerge signature' END, CASE WHEN contains(text, 'ILRepack') THEN 'ILRepack signature' END) AS signals FROM documents",
    ),
    "ancestor_dedupe": (
        ancestor_dedupe,
        f"WITH r AS (SELECT DISTINCT {_PARENT} AS root FROM {_URLS} UNION SELECT DISTINCT {_CLEAN('path')} FROM {_URLS} WHERE page_id % 3 = 0) SELECT root FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE starts_with(lower({_CLEAN('r.root')}), lower({_CLEAN('o.root')}) || '/'))",
    ),
    "nearest_root": (
        nearest_root,
        f"""WITH r AS (SELECT DISTINCT {_PARENT} AS root FROM {_URLS} WHERE page_id % 4 = 0), j AS (SELECT page_id, root, row_number() OVER (PARTITION BY page_id ORDER BY length(root) DESC) AS k
        FROM {_URLS} JOIN r ON lower({_CLEAN('path')}) = lower({_CLEAN('root')}) OR starts_with(lower({_CLEAN('path')}), lower({_CLEAN('root')}) || '/')) SELECT root, count(*) AS n FROM j WHERE k = 1 GROUP BY 1""",
    ),
    "representative": (
        representative,
        """SELECT o_custkey, arg_min(path, (CASE WHEN path LIKE '%.pak' THEN 0 ELSE 1 END, -size, path)) AS representative FROM (SELECT o_custkey, 'o/' || o_orderkey || CASE WHEN o_orderpriority = '1-URGENT' THEN '.pak' ELSE '.ucas' END AS path, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders) GROUP BY 1""",
    ),
    "companion_folders": (
        companion_folders,
        """SELECT DISTINCT 'n' || s_nationkey AS folder, 'companion' AS kind FROM supplier WHERE s_suppkey % 2 = 0 AND s_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 5 = 0)
        UNION ALL SELECT DISTINCT 'p' || n, 'sibling' FROM (SELECT s_nationkey AS n, s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'pak' ELSE 'utoc' END AS x FROM supplier UNION ALL SELECT s_nationkey, s_suppkey + 1, CASE WHEN s_suppkey % 4 = 0 THEN 'utoc' ELSE 'pak' END FROM supplier) a
        WHERE x = 'pak' AND EXISTS (SELECT 1 FROM (SELECT s_nationkey AS n, s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'pak' ELSE 'utoc' END AS x FROM supplier UNION ALL SELECT s_nationkey, s_suppkey + 1, CASE WHEN s_suppkey % 4 = 0 THEN 'utoc' ELSE 'pak' END FROM supplier) b WHERE b.n = a.n AND b.k = a.k AND b.x = 'utoc')""",
    ),
    "common_folder": (common_folder, "SELECT 'data/c' || CASE WHEN count(DISTINCT c_nationkey) = 1 THEN '/' || min(c_nationkey) ELSE '' END AS folder FROM customer"),
    "addr_bucket": (addr_bucket, "SELECT lower(right(printf('%x', event_id * 4099 + 5368709120), 6)[1:3]) AS bucket, count(*) AS n FROM events GROUP BY 1"),
    "ext_stats": (ext_stats, rf"SELECT lower(regexp_extract(path, '(\.[^./\\]+)$', 1)) AS ext, count(*) AS files FROM {_URLS} GROUP BY 1"),
    "file_index": (file_index, "SELECT count(*) AS file_count, CAST(sum(strlen(html)) AS BIGINT) AS total_bytes, CAST(sum(length(html) - length(replace(html, chr(10), ''))) AS BIGINT) AS total_lines FROM pages"),
    "folder_statistics": (
        folder_statistics,
        f"""SELECT (SELECT count(*) FROM pages) AS files, (SELECT CAST(sum(strlen(html)) AS BIGINT) FROM pages) AS bytes, count(DISTINCT f) AS folders FROM (SELECT array_to_string(p[1:i], '/') AS f FROM (SELECT p, unnest(range(1, len(p))) AS i FROM (SELECT list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM {_URLS})))""",
    ),
}
