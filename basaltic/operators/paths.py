"""Path operators: prefix joins as equality joins over exploded ancestors."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def components(path: Column) -> Column:
    """Components of a path with either separator, without empty ones."""
    return F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda x: (x != "") & (x != "."))


def clean_path(path: Column) -> Column:
    return F.array_join(components(path), "/")


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)\z", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)\z", 1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\]?[^/\\]*\z", "")


def stem(name: Column) -> Column:
    """A name without its last extension, whole if nothing would be left."""
    cut = F.regexp_replace(name, r"\.[^.]*\z", "")
    return F.when(cut == "", name).otherwise(cut)


def has_component(path: Column, name: str) -> Column:
    return F.array_contains(F.transform(components(path), F.lower), name.lower())


def ancestors(path: Column, proper: bool = True) -> Column:
    """All ancestor paths, shortest first, and the path itself unless proper."""
    parts = components(path)
    top = F.size(parts) - (1 if proper else 0)
    return F.when(top >= 1, F.transform(F.sequence(F.lit(1), top), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).otherwise(F.array().cast("array<string>"))


def is_under(path: Column, folder: Column) -> Column:
    return F.startswith(path, F.concat(folder, F.lit("/")))


def common_folder(paths: DataFrame, path: str) -> DataFrame:
    """One row: the longest folder that all paths share. Counts ancestors, so it aggregates before the shuffle."""
    total = paths.agg(F.count("*").alias("n"))
    shared = paths.select(F.explode(ancestors(F.col(path))).alias("folder")).groupBy("folder").agg(F.count("*").alias("k"))
    best = shared.crossJoin(F.broadcast(total)).where("k = n").agg(F.max_by("folder", F.length("folder")).alias("folder"))
    return best.select(F.coalesce("folder", F.lit("")).alias("folder"))


def topmost(roots: DataFrame, path: str) -> DataFrame:
    """Roots without an ancestor among the roots, whatever the case."""
    low = roots.withColumn("_low", F.lower(clean_path(F.col(path))))
    above = low.select(F.col("_low").alias("_a")).distinct()
    under = low.select("_low", F.explode(ancestors(F.col("_low"))).alias("_anc")).join(above, F.col("_anc") == F.col("_a"), "left_semi").select("_low").distinct()
    return low.join(under, "_low", "left_anti").drop("_low")


def without_nested_builds(roots: DataFrame, path: str, name: str = "Builds") -> DataFrame:
    """Drops roots below a folder of that name if any root is not below one."""
    flagged = roots.withColumn("_b", has_component(F.col(path), name))
    plain = flagged.agg(F.coalesce(F.bool_or(~F.col("_b")), F.lit(False)).alias("_any"))
    return flagged.crossJoin(F.broadcast(plain)).where(~(F.col("_b") & F.col("_any"))).drop("_b", "_any")


def nearest_root(items: DataFrame, path: str, roots: DataFrame, root: str) -> DataFrame:
    """Items with `root`, the longest kept root that is an ancestor; items without one are dropped."""
    kept = roots.select(F.col(root).alias("root"), F.lower(clean_path(F.col(root))).alias("_r"))
    keyed = items.withColumn("_id", F.lower(clean_path(F.col(path))))
    found = keyed.select("_id", F.explode(ancestors(F.col("_id"), proper=False)).alias("_r")).join(kept, "_r").groupBy("_id").agg(F.max_by("root", F.length("_r")).alias("root"))
    return keyed.join(found, "_id").drop("_id")


def companions(files: DataFrame, path: str, main: str, other: str) -> DataFrame:
    """Folders that hold a file named main and, at any depth below, one named other."""
    lower = F.lower(base_name(F.col(path)))
    mains = files.where(lower == main.lower()).select(clean_path(parent(F.col(path))).alias("folder")).distinct()
    below = files.where(lower == other.lower()).select(F.explode(ancestors(F.col(path))).alias("folder")).distinct()
    return mains.join(below, "folder", "left_semi")


def sibling_folders(files: DataFrame, path: str, one: str, two: str) -> DataFrame:
    """Folders that hold a file with extension one and a file of the same stem with extension two."""
    keyed = files.select(clean_path(parent(F.col(path))).alias("folder"), F.lower(stem(base_name(F.col(path)))).alias("_s"), extension(F.col(path)).alias("_x"))
    return keyed.where(F.col("_x") == one).join(keyed.where(F.col("_x") == two).select("folder", "_s"), ["folder", "_s"], "left_semi").select("folder").distinct()


def representative(files: DataFrame, by: str, path: str, size: str, favoured: str) -> DataFrame:
    """Of each key the largest file of the favoured extension, else the largest; the smallest path wins ties."""
    rank = F.struct(F.when(extension(F.col(path)) == favoured, 0).otherwise(1).alias("o"), (-F.col(size)).alias("s"), F.col(path).alias("p"))
    return files.groupBy(by).agg(F.min(rank).alias("_m")).select(by, F.col("_m.p").alias("representative"))
