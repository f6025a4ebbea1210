"""Queries over strings: noise, categories, URL tokens, literals, callees."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltic.functions import symbols, text
from basaltic.operators.names import real_callees
from basaltic.sources.tables import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimmed non-empty lines of documents, the URLs of pages, and the literals of their source."""
    each = lambda a: F.explode(F.transform(a, text.trimmed)).alias("line")  # noqa: E731 - trimmed once: no filter is pushed into an explode
    docs = table(spark, sf_dir, "documents").select(each(F.split("text", "\n")))
    pages = table(spark, sf_dir, "pages")
    return docs.union(pages.select(each(F.array("url")))).union(pages.select(each(symbols.string_literals(F.col("html"))))).where("line <> ''")


_BLANK = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_LINES = rf"""(SELECT regexp_replace(line, '^{_BLANK}|{_BLANK}$', '', 'g') AS line FROM (
    SELECT unnest(string_split(text, chr(10))) AS line FROM documents UNION ALL SELECT url FROM pages
    UNION ALL SELECT unnest(list_distinct(list_filter(list_transform(regexp_extract_all(html, '"(?:\\.|[^"\\])*"'), lambda x: x[2:-2]), lambda x: x <> ''))) FROM pages))"""

_NOISE = r"""(strlen(line) < 4 OR regexp_full_match(line, '[\d.,]+') OR regexp_full_match(line, '</?[a-zA-Z][^>]*>')
    OR (NOT contains(line, ' ') AND regexp_full_match(line, '[A-Za-z0-9+/=]{40,}')) OR regexp_full_match(line, '\.[a-zA-Z0-9]{1,10}')
    OR regexp_full_match(line, '(?i)[a-z]+/[a-z0-9.+-]+')
    OR length(regexp_replace(line, '[^\p{L}\p{M}\p{N}\p{P}\p{S} ]', '', 'g')) / length(line)::DOUBLE < 0.7)"""


def string_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return lines.groupBy(text.is_noise(F.col("line")).alias("noise")).agg(F.count("*").alias("n"), F.sum(F.octet_length("line")).alias("n_bytes"))


def _categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _lines(spark, sf_dir).where(~text.is_noise(F.col("line")))
    return kept.select(F.explode(text.categories(F.col("line"))).alias("c")).select("c.category", "c.value").distinct()


def string_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and ends of each category's set; the sets themselves are the rows of category_values."""
    return _categories(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"), F.min("value").alias("first"), F.max("value").alias("last"))


def category_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _categories(spark, sf_dir).where("category <> 'interesting'").orderBy("category", "value")


_CATEGORY_ROWS = rf"""WITH kept AS (SELECT DISTINCT line FROM {_LINES} WHERE line <> '' AND NOT {_NOISE}),
    marked AS (SELECT line, regexp_matches(line, '(?i)^https?://|://') AS u, regexp_matches(line, '(?i)^[A-Z]:\\|[/\\][a-zA-Z0-9_.+-]+[/\\]') AS p,
        regexp_matches(line, '(?i)error|exception|fail|invalid|cannot|unable') AS e, regexp_matches(line, '^[A-Za-z_][A-Za-z0-9_.]*\s*=\s*.+') AS c,
        regexp_matches(line, '(?i)key|token|secret|password|api') AND (contains(line, '=') OR contains(line, ':')) AS k FROM kept),
    tokens AS (SELECT line, list_transform(regexp_extract_all(line, '(?i)https?://[^\s"''<>)\]}}`]+'), lambda x: regexp_replace(x, '[.,;:]+$', '')) AS t FROM marked WHERE u),
    rows AS (SELECT 'urls' AS category, unnest(CASE WHEN len(t) = 0 THEN [line] ELSE t END) AS value FROM tokens UNION ALL SELECT 'paths', line FROM marked WHERE p
        UNION ALL SELECT 'errors', line FROM marked WHERE e UNION ALL SELECT 'config', line FROM marked WHERE c UNION ALL SELECT 'api_keys', line FROM marked WHERE k
        UNION ALL SELECT 'interesting', line FROM marked WHERE NOT (u OR p OR e OR c OR k) AND strlen(line) > 20),
    sets AS (SELECT DISTINCT category, value FROM rows)"""


def url_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL tokens of lines that run two URLs and a tail together."""
    pages = table(spark, sf_dir, "pages")
    line = F.concat(F.lit("see "), F.col("url"), F.lit(", also "), F.col("url"), F.lit("?v=1)tail end"))
    return pages.select("page_id", F.posexplode(text.url_tokens(line)).alias("pos", "token"))


def string_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-seen distinct literals of each page."""
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(symbols.string_literals(F.col("html"))).alias("pos", "literal"))


def _callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.explode(symbols.call_sites(F.col("html"), F.lit("main"))).alias("callee"))


def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _callers(spark, sf_dir)


def callers_real(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call edges whose callee is real by its form or known: here, called on ten pages or more."""
    edges = _callers(spark, sf_dir)
    known = edges.groupBy("callee").agg(F.count("*").alias("n")).where("n >= 10").select("callee")
    return real_callees(edges, "callee", known)


_CALLERS = r"""SELECT page_id, callee FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(regexp_replace(html, '(?m)^[ \t]*//[^\n]*', '', 'g'), '([A-Za-z_][A-Za-z0-9_]*(?:(?:::|<[^>]*>)[A-Za-z0-9_~]*)*)\s*\(', 1))) AS callee FROM pages)
    WHERE callee NOT IN ('main', 'if', 'for', 'while', 'switch', 'return', 'sizeof', 'do', 'else', 'case', 'catch', '__assert', 'void', 'bool', 'char', 'uchar', 'wchar_t', 'short', 'ushort', 'int', 'uint', 'long', 'ulong', 'longlong', 'ulonglong', 'float', 'double', 'byte', 'code', 'undefined', 'undefined1', 'undefined2', 'undefined4', 'undefined8')
    AND NOT regexp_matches(callee, '^(?:CONCAT|ZEXT|SEXT|SUB)\d')"""


def scalar_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small text functions over event properties and URLs."""
    e = table(spark, sf_dir, "events")
    tag = text.log_tag(F.concat(F.lit("["), F.col("event_type"), F.lit("] value "), F.col("event_id").cast("string")), F.lit("none"))
    key = F.when(F.col("event_id") % 3 == 0, "LogToFile").when(F.col("event_id") % 3 == 1, "MaxFileSizeMB").otherwise("OutputDir")
    setting = text.typed_setting(key, F.when(F.col("event_id") % 6 == 3, "yes").when(F.col("event_id") % 7 == 1, "many").otherwise(F.col("event_id").cast("string")))
    return e.select(
        "event_id",
        tag["tool"].alias("tool"),
        tag["message"].alias("message"),
        text.human_size(F.col("event_id") * 1048).alias("size"),
        text.relative_time(F.col("event_id") * 37).alias("ago"),
        setting["kind"].alias("kind"),
        setting["value"].alias("setting"),
        text.tab_escaped(F.concat_ws("\t", "event_type", F.lit("x"))).alias("escaped"),
    )


def private_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Private-use characters and strings by language; every fifth document gets some."""
    t = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(""), F.substring("text", 1, 3))).otherwise(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("lang", t.alias("t"))
    return docs.groupBy("lang").agg(
        F.sum(text.removed(F.col("t"), r"[\x{E000}-\x{F8FF}]")).alias("characters"),
        F.sum(F.when(text.private_share(F.col("t")) > 0.3, 1).otherwise(0)).alias("strings"),
        F.sum(F.when(text.is_meaningful(F.substring("t", 1, 5)), 1).otherwise(0)).alias("meaningful"),
        F.sum(F.when(F.col("t") != "", 1).otherwise(0)).alias("total"),
    )


QUERIES = {
    "string_noise": (string_noise, f"SELECT {_NOISE} AS noise, count(*) AS n, CAST(sum(strlen(line)) AS BIGINT) AS n_bytes FROM {_LINES} WHERE line <> '' GROUP BY 1"),
    "string_categories": (string_categories, f'{_CATEGORY_ROWS} SELECT category, count(*) AS n, min(value) AS "first", max(value) AS "last" FROM sets GROUP BY 1'),
    "category_values": (category_values, f"{_CATEGORY_ROWS} SELECT category, value FROM sets WHERE category <> 'interesting'"),
    "url_tokens": (
        url_tokens,
        r"""SELECT page_id, CAST(i - 1 AS INT) AS pos, regexp_replace(t[i], '[.,;:]+$', '') AS token FROM (SELECT page_id, t, unnest(range(1, len(t) + 1)) AS i FROM
        (SELECT page_id, CASE WHEN len(f) = 0 THEN [line] ELSE f END AS t FROM (SELECT page_id, line, regexp_extract_all(line, '(?i)https?://[^\s"''<>)\]}`]+') AS f FROM
        (SELECT page_id, 'see ' || url || ', also ' || url || '?v=1)tail end' AS line FROM pages))))""",
    ),
    "string_refs": (
        string_refs,
        r"""SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY p) - 1 AS INT) AS pos, literal FROM (SELECT page_id, literal, min(i) AS p FROM
        (SELECT page_id, i, x[i][2:-2] AS literal FROM (SELECT page_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '"(?:\\.|[^"\\])*"') AS x FROM pages)))
        WHERE literal <> '' GROUP BY 1, 2)""",
    ),
    "callers": (callers, _CALLERS),
    "callers_real": (
        callers_real,
        rf"""WITH c AS ({_CALLERS}), k AS (SELECT callee FROM c GROUP BY 1 HAVING count(*) >= 10)
        SELECT page_id, callee FROM c WHERE NOT regexp_matches(callee, '^(?:switchD_|switchdataD_|caseD_)') AND (starts_with(callee, 'FUN_') OR contains(callee, '::') OR callee IN (SELECT callee FROM k))""",
    ),
    "scalar_text": (
        scalar_text,
        r"""SELECT event_id, event_type AS tool, 'value ' || event_id AS message,
        CASE WHEN n <= 0 THEN '' WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', floor(n / 1024.0 * 10 + 0.5) / 10) || ' KB' WHEN n < 1073741824 THEN printf('%.1f', floor(n / 1048576.0 * 10 + 0.5) / 10) || ' MB' ELSE printf('%.1f', floor(n / 1073741824.0 * 10 + 0.5) / 10) || ' GB' END AS size,
        CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS ago,
        CASE event_id % 3 WHEN 0 THEN 'bool' WHEN 1 THEN 'int' ELSE 'string' END AS kind,
        CASE event_id % 3 WHEN 0 THEN CASE WHEN event_id % 6 = 3 THEN 'true' WHEN event_id = 0 THEN 'false' END WHEN 1 THEN CASE WHEN event_id % 7 <> 1 THEN event_id::VARCHAR END ELSE CASE WHEN event_id % 7 = 1 THEN 'many' ELSE event_id::VARCHAR END END AS setting, event_type || '\t' || 'x' AS escaped
        FROM (SELECT event_id, event_type, event_id * 1048 AS n, event_id * 37 AS s FROM events)""",
    ),
    "private_use": (
        private_use,
        r"""SELECT lang, CAST(sum(length(t) - length(regexp_replace(t, '[\x{E000}-\x{F8FF}]', '', 'g'))) AS BIGINT) AS characters,
        count(*) FILTER ((length(t) - length(regexp_replace(t, '[\x{E000}-\x{F8FF}]', '', 'g'))) / length(t)::DOUBLE > 0.3) AS strings,
        count(*) FILTER (h = '' OR (NOT regexp_matches(h, '[\x{E000}-\x{F8FF}]') AND NOT regexp_matches(regexp_replace(h, '[\t\r\n]', '', 'g'), '[\x00-\x1f\x7f-\x{9f}]')
            AND length(regexp_replace(h, '[^\x20-\x7e\t\r\n]', '', 'g')) / length(h)::DOUBLE >= 0.95 AND length(regexp_replace(h, '[^A-Za-z0-9/._\-: {}<>]', '', 'g')) / length(h)::DOUBLE >= 0.6)) AS meaningful,
        count(*) FILTER (t <> '') AS total
        FROM (SELECT lang, t, substr(t, 1, 5) AS h FROM (SELECT lang, CASE WHEN doc_id % 5 = 0 THEN chr(57345) || chr(57346) || substr(text, 1, 3) ELSE text END AS t FROM documents)) GROUP BY 1""",
    ),
}
