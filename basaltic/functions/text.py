"""String predicates and extractions as column expressions. Lengths are in UTF-8 bytes where thresholds are."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

URL_TOKEN = "(?i)https?://[^\\s\"'<>)\\]}`]+"


def trimmed(c: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def removed(c: Column, pattern: str) -> Column:
    """How many characters of c the pattern's matches take up."""
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


def share(c: Column, pattern: str) -> Column:
    """Share of characters that match; null for an empty string."""
    return F.when(F.length(c) > 0, removed(c, pattern) / F.length(c))


def printable_share(c: Column) -> Column:
    """Letters, marks, numbers, punctuation, symbols and the plain space, as a share of all characters."""
    return share(c, r"[\p{L}\p{M}\p{N}\p{P}\p{S} ]")


def private_share(c: Column) -> Column:
    """Private-use characters, of all planes, as a share."""
    return share(c, r"\p{Co}")


def is_noise(c: Column) -> Column:
    """Strings that say nothing: short, numeric, one tag, base64-like, one extension, one media type, or unprintable."""
    return (
        (F.octet_length(c) < 4)
        | c.rlike(r"^[\d.,]+\z")
        | c.rlike(r"^</?[a-zA-Z][^>]*>\z")
        | (~c.contains(" ") & c.rlike(r"^[A-Za-z0-9+/=]{40,}\z"))
        | c.rlike(r"^\.[a-zA-Z0-9]{1,10}\z")
        | c.rlike(r"^(?i)[a-z]+/[a-z0-9.+-]+\z")
        | (F.coalesce(printable_share(c), F.lit(0.0)) < 0.7)
    )


def is_url(c: Column) -> Column:
    return c.rlike(r"(?i)^https?://|://")


def url_tokens(c: Column) -> Column:
    """The URLs in a line without trailing punctuation; the whole line if there is none."""
    found = F.transform(F.regexp_extract_all(c, F.lit(URL_TOKEN), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:]+\z", ""))
    return F.when(F.size(found) == 0, F.array(c)).otherwise(found)


def is_path(c: Column) -> Column:
    return c.rlike(r"(?i)^[A-Z]:\\|[/\\][a-zA-Z0-9_.+-]+[/\\]")


def is_error(c: Column) -> Column:
    return c.rlike("(?i)error|exception|fail|invalid|cannot|unable")


def is_setting(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z_][A-Za-z0-9_.]*\s*=\s*.+")


def is_key(c: Column) -> Column:
    return c.rlike("(?i)key|token|secret|password|api") & (c.contains("=") | c.contains(":"))


def categories(c: Column) -> Column:
    """(category, value) of every category that a line belongs to; a line in none is interesting if longer than 20 bytes."""
    plain = {"paths": is_path(c), "errors": is_error(c), "config": is_setting(c), "api_keys": is_key(c)}
    entry = lambda kind, value: F.struct(F.lit(kind).alias("category"), value.alias("value"))
    none = ~is_url(c)
    for test in plain.values():
        none = none & ~test
    empty = F.filter(F.array(entry("", c)), lambda x: F.lit(False))
    urls = F.when(is_url(c), F.transform(url_tokens(c), lambda u: entry("urls", u))).otherwise(empty)
    rest = [F.when(test, F.array(entry(kind, c))).otherwise(empty) for kind, test in plain.items()]
    return F.concat(urls, *rest, F.when(none & (F.octet_length(c) > 20), F.array(entry("interesting", c))).otherwise(empty))


def is_meaningful(c: Column) -> Column:
    """Decoded text that looks like text: nothing private-use or control, printable, mostly of identifier characters."""
    bad = c.rlike(r"[\x{E000}-\x{F8FF}\x{FFFD}]") | F.regexp_replace(c, r"[\t\r\n]", "").rlike(r"\p{Cc}")
    good = (share(c, r"[\x20-\x7e\t\r\n]") >= 0.95) & (share(c, r"[A-Za-z0-9/._\-: {}<>]") >= 0.6)
    return (F.length(c) == 0) | (~bad & good)


def tab_escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\t"), F.lit("\\t")), F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))


def ascii_runs(content: Column, least: int = 6) -> Column:
    """Runs of printable ASCII in binary content."""
    return F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(f"[\\x20-\\x7e]{{{least},}}"), F.lit(0))


def line_count(c: Column) -> Column:
    """Number of line feeds."""
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def log_tag(c: Column, tool: Column) -> Column:
    """[tool] message as (tool, message); a line without a tag belongs to the current tool."""
    tag = F.regexp_extract(c, r"(?s)^\[([^\]]+)\] (.*)\z", 1)
    return F.struct(F.when(tag != "", tag).otherwise(tool).alias("tool"), F.when(tag != "", F.regexp_extract(c, r"(?s)^\[[^\]]+\] (.*)\z", 1)).otherwise(c).alias("message"))


def progress_line(c: Column) -> Column:
    """Progress lines as (kind, number, text): fn:<n>:<name>, and KEYWORD:<rest> for the six keywords."""
    step = c.rlike(r"^fn:\d+:")
    kind = F.when(step, F.lit("fn")).otherwise(F.lower(F.regexp_extract(c, "^(EXTRACTED|EXTRACT_COUNT|REWROTE|RESIDUAL|MODE|KEY):", 1)))
    rest = F.when(step, F.regexp_extract(c, r"(?s)^fn:\d+:(.*)\z", 1)).otherwise(F.regexp_extract(c, r"(?s)^[A-Z_]+:(.*)\z", 1))
    number = F.when(step, F.regexp_extract(c, r"^fn:(\d+):", 1)).otherwise(F.regexp_extract(rest, r"^\s*(\d+)", 1))
    return F.struct(kind.alias("kind"), number.try_cast("long").alias("number"), rest.alias("text"))


def download_line(c: Column) -> Column:
    """'Downloading X... n%' and 'a / b MB' as (name, percent, done_mb, total_mb)."""
    get = lambda p, i, kind: F.regexp_extract(c, p, i).try_cast(kind)
    amounts = r"([\d.]+)\s*/\s*([\d.]+)\s*MB"
    return F.struct(
        F.regexp_extract(c, r"Downloading (.+?)\.\.\.", 1).alias("name"),
        get(r"(\d+(?:\.\d+)?)%", 1, "double").alias("percent"),
        get(amounts, 1, "double").alias("done_mb"),
        get(amounts, 2, "double").alias("total_mb"),
    )


# Settings that are not text.
BOOL_SETTINGS = (
    "SkipSystemLibs", "KeepIntermediates", "GenerateCallgraph", "GenerateDotFiles", "StopOnFirstError", "PreferSystemTools", "AutoUpdateCheck", "AutoUpdateTools",
    "AutoUpdateApp", "GeneratePDB", "DecompileProjectMode", "LogToFile", "LogTimestamps", "AllowDynamicExecution", "SandboxWarning", "UE5ExtractPAK", "UE5SDKDump",
    "UE5ExtractStrings", "UE5GhidraDecompile", "UE5NameResolution", "UE5BuildIndexes", "UE5ExportHookable",
)
INT_SETTINGS = ("StepTimeoutMinutes", "MaxFileSizeMB", "ConcurrentTargets", "DownloadRetries", "DownloadTimeoutMinutes")


def typed_setting(key: Column, value: Column) -> Column:
    """A setting's text as (kind, value), the kind by the key: bool, int or string. A value that is none of the kind is null."""
    yes, no = value.isin("true", "1", "yes"), value.isin("false", "0", "no")
    whole = F.when(value.rlike(r"\A[+-]?[0-9]+\z"), value.try_cast("long").cast("string"))
    kind = F.when(key.isin(*BOOL_SETTINGS), "bool").when(key.isin(*INT_SETTINGS), "int").otherwise("string")
    return F.struct(kind.alias("kind"), F.when(kind == "bool", F.when(yes, "true").when(no, "false")).when(kind == "int", whole).otherwise(value).alias("value"))


def human_size(n: Column) -> Column:
    """B, KB, MB or GB in steps of 1024 with one decimal; empty for none."""
    over = lambda power: F.concat(F.format_string("%.1f", n / F.lit(float(1 << power))), F.lit({10: " KB", 20: " MB", 30: " GB"}[power]))
    return F.when(F.coalesce(n, F.lit(0)) <= 0, "").when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, over(10)).when(n < 1 << 30, over(20)).otherwise(over(30))


def relative_time(seconds: Column) -> Column:
    """Seconds ago as just now, minutes, hours or days."""
    part = lambda size, unit: F.concat(F.floor(seconds / size).cast("string"), F.lit(f"{unit} ago"))
    return F.when(seconds < 60, "just now").when(seconds < 3600, part(60, "m")).when(seconds < 86400, part(3600, "h")).otherwise(part(86400, "d"))


def clean_tag(c: Column) -> Column:
    """A release tag without v, V and the frame of one tool's tags; generic tags are empty."""
    bare = F.regexp_replace(F.regexp_replace(c, "^v", ""), "^V", "")
    bare = F.when(bare.startswith("Ghidra_"), F.regexp_replace(F.substring(bare, 8, 1 << 30), r"_build\z", "")).otherwise(bare)
    return F.when((F.lower(bare) == "latest") | bare.isin("releases", ""), "").otherwise(bare)


def base_version(c: Column) -> Column:
    """Major, minor and patch as an array of ints, null if unparsable: without v, up to the first hyphen."""
    parts = F.transform(F.split(F.regexp_extract(c, r"^v?([^-]*)", 1), r"\."), lambda x: x.try_cast("int"))
    return F.when(F.forall(parts, lambda x: x.isNotNull()), parts)


def is_newer(latest: Column, current: Column) -> Column:
    """An unparsable latest is never newer; an unparsable current always is older."""
    pad = lambda a: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.coalesce(F.get(a, i), F.lit(0)))
    new, old = base_version(latest), base_version(current)
    return F.when(new.isNull(), F.lit(False)).when(old.isNull(), F.lit(True)).otherwise(pad(new) > pad(old))


def banner_version(c: Column) -> Column:
    """Between the first two quotes of the first line."""
    return F.regexp_extract(F.substring_index(c, "\n", 1), '"([^"]*)"', 1)


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url, r"/+\z", ""), "/"), -1)


# What error texts of the time-out family hold, in any case.
TRANSIENT = ("loadsystemroots", "0x80072ee2", "timeout", "timed out", "deadline exceeded")


def is_transient(c: Column) -> Column:
    """Error texts of the time-out family."""
    return F.lower(c).rlike("|".join(TRANSIENT))


def matched_assets(assets: DataFrame, release: str, name: str, glob: str) -> DataFrame:
    """The assets of each release that meet the glob; of a release without any, those that hold the glob's literal parts in order,
    whatever the case."""
    from basaltic.functions.globs import glob_pattern

    parts = [f"\\Q{p}\\E" for p in glob.lower().split("*") if p]
    hit, loose = F.col(name).rlike(glob_pattern(glob)), F.lower(name).rlike("(?s)" + ".*?".join(parts))
    exact = assets.where(hit).select(F.col(release).alias("_release")).distinct()
    marked = assets.join(exact, F.col(release).eqNullSafe(F.col("_release")), "left")
    return marked.where(hit | (F.col("_release").isNull() & loose)).drop("_release")


def date_tag(c: Column) -> Column:
    """An HTTP date as YYYY.MM.DD; null if it is none."""
    day = F.regexp_extract(c, r"^\w{3}, (\d{2}) (\w{3}) (\d{4}) ", 1)
    month = F.array_position(F.array(*map(F.lit, ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"))), F.regexp_extract(c, r"^\w{3}, \d{2} (\w{3}) \d{4} ", 1))
    return F.when((day != "") & (month > 0), F.concat_ws(".", F.regexp_extract(c, r"^\w{3}, \d{2} \w{3} (\d{4}) ", 1), F.lpad(month.cast("string"), 2, "0"), day))


def short_hash(c: Column, marker: str) -> Column:
    """Seven characters after a marker; empty if it isn't there."""
    return F.regexp_extract(c, f"\\Q{marker}\\E([0-9a-f]{{7}})", 1)


def compression_name(c: Column) -> Column:
    names = ("None", "Oodle", "Brotli", "ZStandard")
    return F.when(c.between(0, 3), F.element_at(F.array(*map(F.lit, names)), (c + 1).cast("int"))).otherwise(F.concat(F.lit("Unknown("), c.cast("string"), F.lit(")")))
