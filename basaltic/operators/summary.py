"""Summaries, statistics and ranked samples."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basaltic.operators.paths import extension


def run_summary(rows: DataFrame, skipped: Column, error: Column, kind: Column, recipe: Column) -> DataFrame:
    """One row: total, skipped, failed and success (in that order of precedence), and counts by kind and by recipe as maps.

    Kinds and recipes are counted first, so the maps are built of one row each; empty recipes don't count."""
    state = F.when(skipped, "skipped").when(error, "failed").otherwise("success")
    flat = rows.select(state.alias("s"), kind.alias("k"), F.coalesce(recipe, F.lit("")).alias("r")).groupBy("s", "k", "r").agg(F.count("*").alias("n"))
    total = flat.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        *(F.coalesce(F.sum(F.when(F.col("s") == s, F.col("n"))), F.lit(0)).alias(s) for s in ("skipped", "failed", "success")),
    )
    as_map = lambda c: flat.where(F.col(c) != "").groupBy(c).agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias({"k": "by_kind", "r": "by_recipe"}[c]))
    return total.crossJoin(F.broadcast(as_map("k"))).crossJoin(F.broadcast(as_map("r")))


def percent(part: Column, whole: Column) -> Column:
    """Percentage with two decimals, half up; 0 of nothing."""
    return F.when(whole > 0, F.floor(part * 100.0 / whole * 100 + 0.5) / 100).otherwise(0.0)


def extension_counts(files: DataFrame, path: str) -> DataFrame:
    """Files by extension, most first."""
    return files.groupBy(extension(F.col(path)).alias("ext")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "ext")


def folder_statistics(files: DataFrame, path: str, size: str) -> DataFrame:
    """One row: files, folders below the root, bytes."""
    from basaltic.operators.paths import ancestors

    folders = files.select(F.explode(ancestors(F.col(path))).alias("f")).distinct().agg(F.count("*").alias("folders"))
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).crossJoin(F.broadcast(folders))


def file_index(files: DataFrame, path: str, content: str) -> DataFrame:
    """One row over distinct paths: file_count, total_bytes, total_lines."""
    from basaltic.functions.text import line_count

    return files.dropDuplicates([path]).agg(
        F.count("*").alias("file_count"), F.coalesce(F.sum(F.octet_length(content)), F.lit(0)).alias("total_bytes"), F.coalesce(F.sum(line_count(F.col(content))), F.lit(0)).alias("total_lines")
    )


def first_of_each(rows: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The first rows of each key. Spark cuts each task's share before the shuffle."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def history(rows: DataFrame, key: str, path: str, newest: Column, most: int = 20) -> DataFrame:
    """Of each key the latest entry of each path, the newest so many."""
    rest = [c for c in rows.columns if c not in (key, path)]
    latest = rows.groupBy(key, path).agg(F.max(F.struct(newest.alias("_o"), *rest)).alias("_m")).select(key, path, "_m.*")
    return first_of_each(latest, key, [F.desc("_o"), F.col(path)], most).drop("_o")


def composition(rows: DataFrame, keys: list[Column], size: Column, position: Column) -> DataFrame:
    """Groups with count, total size and place of first sight."""
    return rows.groupBy(*keys).agg(F.count("*").alias("count"), F.coalesce(F.sum(size), F.lit(0)).alias("total_size"), F.min(position).alias("first_seen")).orderBy("first_seen")


def highest_framework(names: DataFrame, name: str, default: str = "10.0") -> DataFrame:
    """One row: the highest number among net<number> folder names, with one decimal."""
    number = F.regexp_extract(F.col(name), r"^net(\d+(?:\.\d+)?)", 1).try_cast("double")
    return names.agg(F.when(F.max(number).isNull(), F.lit(default)).otherwise(F.format_string("%.1f", F.max(number))).alias("version"))


def key_scores(units: DataFrame, group: str, unit: str, candidates: int = 256) -> DataFrame:
    """The best XOR candidate of each group: +2 printable, +1 tab or line break, -4 private use, -2 other; ties to the lowest.

    Equal units are counted first, so the candidates multiply distinct values only."""
    counted = units.groupBy(group, unit).agg(F.count("*").alias("_n"))
    tried = counted.withColumn("kb", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1))))
    c = F.col(unit).bitwiseXOR(F.col("kb"))
    points = F.when((c >= 0x20) & (c < 0x7F), 2).when(c.isin(9, 10, 13), 1).when((c >= 0xE000) & (c <= 0xF8FF), -4).otherwise(-2)
    scored = tried.groupBy(group, "kb").agg(F.sum(points * F.col("_n")).alias("score"))
    return scored.groupBy(group).agg(F.min(F.struct((-F.col("score")).alias("s"), "kb")).alias("_m")).select(group, F.col("_m.kb").alias("kb"), (-F.col("_m.s")).alias("score"))


def xor_decoded(units: Column, key: Column, magic: Column) -> Column:
    """Each UTF-16 unit with the key byte that the magic number's low bits pick, the magic number set in it, crossed out."""
    mask = F.element_at(key, (magic.bitwiseAND(F.size(key) - 1) + 1).cast("int")).bitwiseOR(magic).bitwiseAND(0xFFFF)
    return F.array_join(F.transform(units, lambda u: F.char(u.bitwiseXOR(mask).cast("long"))), "")


def agreement(rows: DataFrame, magic: str, text: str, size: int, floor: float = 0.65) -> DataFrame:
    """One row: the character-weighted share of meaningful texts, and whether each index that two or more magic numbers
    share has at least the floor's share of them."""
    from basaltic.functions.text import is_meaningful

    good, weight = is_meaningful(F.col(text)), F.greatest(F.lit(1), F.length(text))
    by = rows.groupBy(F.col(magic).bitwiseAND(size - 1).alias("_i")).agg(F.countDistinct(magic).alias("m"), F.avg(good.cast("double")).alias("g"), F.sum(weight).alias("w"), F.sum(F.when(good, weight).otherwise(0)).alias("gw"))
    return by.agg((F.sum("gw") / F.sum("w")).alias("confidence"), F.coalesce(F.bool_and((F.col("m") < 2) | (F.col("g") >= floor)), F.lit(True)).alias("agrees"))


def most_called(edges: DataFrame, callee: str, candidates: DataFrame, name: str) -> DataFrame:
    """One row: the candidate with the most call sites, the smallest name on ties, and the number; no row without any."""
    known = candidates.select(F.col(name).alias("_c")).distinct()
    counted = edges.join(known, F.col(callee) == F.col("_c"), "left_semi").groupBy(callee).agg(F.count("*").alias("sites"))
    best = counted.agg(F.min(F.struct((-F.col("sites")).alias("s"), F.col(callee).alias("n"))).alias("_m")).where("_m is not null")
    return best.select(F.col("_m.n").alias("name"), (-F.col("_m.s")).alias("sites"))


def run_counters(rows: DataFrame, kind: Column, skipped: Column, size: Column, running_total: Column, group: Column) -> DataFrame:
    """One row: all files, those not skipped with their bytes (at least the running total), decompiled ones (a kind other than Skipped
    and Unknown), and distinct groups."""
    known = ~F.coalesce(kind, F.lit("")).isin("", "Skipped", "Unknown")
    return rows.agg(
        F.count("*").alias("files"),
        F.count_if(~skipped).alias("handled"),
        F.count_if(skipped).alias("skipped"),
        F.greatest(F.coalesce(F.sum(F.when(~skipped, size)), F.lit(0)), F.coalesce(F.max(running_total), F.lit(0))).alias("bytes"),
        F.count_if(known & ~skipped).alias("decompiled"),
        F.countDistinct(group).alias("groups"),
    )


def catalogue_counts(classes: DataFrame, enums: DataFrame) -> DataFrame:
    """One row: classes, boilerplate classes, properties and enums. classes has properties and boilerplate."""
    own = classes.agg(F.count("*").alias("classes"), F.count_if("boilerplate").alias("boilerplate"), F.coalesce(F.sum(F.size("properties")), F.lit(0)).alias("properties"))
    return own.crossJoin(F.broadcast(enums.agg(F.count("*").alias("enums"))))


def merged_order(first: Column, second: Column) -> Column:
    """Distinct members of two arrays in the order in which they come."""
    return F.array_union(first, second)
