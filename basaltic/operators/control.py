"""Dimension tables, selections and displays around a run: tools, recipes, settings, groups of files, histories."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basaltic.operators.folds import folded
from basaltic.operators.paths import ancestors, base_name, clean_path, components, extension, parent

# Tools with category, way of installing, whether optional, and the runtime they need.
TOOLS = (
    ("diec", "detector", "github", False, ""), ("ilspycmd", "decompiler", "nuget", False, "dotnet"), ("strings", "analyzer", "url", True, ""),
    ("de4dot-cex", "deobfuscator", "github", False, ""), ("ghidra", "decompiler", "github", True, "java"), ("nofuserex", "deobfuscator", "url", False, "dotnet"),
    ("confuserex-killer", "unpacker", "url", False, "dotnet"), ("proxycall-remover", "deobfuscator", "url", False, "dotnet"), ("idr", "decompiler", "github", True, ""),
    ("goresym", "analyzer", "github", True, ""), ("retoc", "extractor", "github", True, ""), ("il2cppdumper", "extractor", "github", False, ""),
)


def tool_table(spark: SparkSession) -> DataFrame:
    """Tools in their order: pos, name, category, method, optional, runtime."""
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TOOLS)], "pos int, name string, category string, method string, optional boolean, runtime string")


@dataclass
class Recipe:
    """A plug-in: a predicate on classified files and a builder of tables from them."""

    name: str
    matches: Callable[[], Column]
    build: Callable[[DataFrame], DataFrame]
    tools: tuple[str, ...] = ()
    steps: tuple[str, ...] = ()
    shown: tuple[str, ...] | None = None


class Registry:
    """Recipes in order of priority; the first that fits a row takes it."""

    def __init__(self):
        self.recipes: list[Recipe] = []

    def register(self, recipe: Recipe, first: bool = False) -> Recipe:
        self.recipes.insert(0 if first else len(self.recipes), recipe)
        return recipe

    def route(self, rows: DataFrame, forced: str | None = None) -> DataFrame:
        """rows with `recipe` and, where none fits, the reason they are skipped. A forced name wins over all predicates."""
        chosen = F.lit(forced) if forced else F.when(F.lit(False), F.lit(""))
        for r in [] if forced else self.recipes:
            chosen = chosen.when(r.matches(), r.name)
        return rows.withColumn("recipe", chosen).withColumn("skip_reason", F.when(F.col("recipe").isNull(), "no matching recipe"))

    def run(self, routed: DataFrame, name: str, stage: str | None = None) -> DataFrame:
        """The tables a recipe builds of its rows; a stage that it hasn't gives its rows as they are."""
        recipe = next(r for r in self.recipes if r.name == name)
        own = routed.where(F.col("recipe") == name)
        return recipe.build(own) if stage in (None, "", *recipe.steps) else own

    def requirements(self, spark: SparkSession, shown: bool = False) -> DataFrame:
        """recipe, pos and tool of every recipe; for display those that it shows, if it has any."""
        return spark.createDataFrame([(r.name, i, t) for r in self.recipes for i, t in enumerate(r.shown if shown and r.shown else r.tools)], "recipe string, pos int, tool string")


def required(routed: DataFrame, needs: DataFrame, tools: DataFrame, order: str) -> DataFrame:
    """Distinct tools of the recipes in use with their runtimes and `place`, 1 for the tool that the files need first: by the first file
    of a recipe, then by the tool's place in that recipe. Only one row of each recipe is looked at in the window."""
    used = routed.where("recipe is not null").groupBy("recipe").agg(F.min(order).alias("_first")).join(needs, "recipe")
    first = used.groupBy("tool").agg(F.min(F.struct("_first", "pos")).alias("_at")).join(tools.select(F.col("name").alias("tool"), "runtime"), "tool")
    return first.select("tool", "runtime", F.row_number().over(W.orderBy("_at")).alias("place")).orderBy("place")


def tool_status(tools: DataFrame, versions: DataFrame, running: DataFrame) -> DataFrame:
    """Tools with installed version, latest version and the operation that is on: name, installed, update_available, state."""
    joined = tools.join(versions, "name", "left").join(running, "name", "left")
    known = F.coalesce("version", F.lit("")) != ""
    return joined.select("name", "category", known.alias("installed"), F.coalesce(known & (F.col("version") != F.col("latest")), F.lit(False)).alias("update_available"), F.coalesce("state", F.lit("idle")).alias("state"))


def searched(rows: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows that hold the query, whatever the case, in any of the columns; an empty query keeps all."""
    test = F.lit(query == "")
    for c in columns:
        test = test | F.lower(c).contains(query.lower())
    return rows.where(test)


def redacted(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", "***").otherwise("")


# How banner lines of a listing of types begin.
BANNERS = ("ilspycmd", "ICSharpCode")


def type_list(lines: DataFrame, line: str) -> DataFrame:
    """Names in a listing of types, each line a kind, a space and a name; blank lines, banners and generated names are left out."""
    bare = F.regexp_replace(line, r"\A\s+|\s+\z", "")
    kept = lines.select(bare.alias("_line")).where((F.col("_line") != "") & ~F.col("_line").rlike("^(?:" + "|".join(BANNERS) + ")"))
    return kept.select(F.regexp_replace("_line", r"\A[^ ]* ", "").alias("name")).where((F.col("name") != "") & ~F.col("name").contains("<"))


def flat_groups(groups: DataFrame) -> DataFrame:
    """path and kind of every file of groups, groups of unknown kind left out."""
    return groups.where(F.lower("kind") != "unknown").select(F.explode("files").alias("path"), "kind")


def grouped_files(files: DataFrame, path: str) -> DataFrame:
    """Files with `kind` and `root` of the first grouping that claims them: companions (the main library with metadata below its
    folder), managed folders of a data folder, else standalone.

    One pass of rule columns and one equality join; a claim is a branch of one CASE, so no pass has to leave out another's files."""
    clean = files.withColumn("_p", clean_path(F.col(path))).withColumn("_d", parent(F.col("_p")))
    name = F.lower(base_name(F.col("_p")))
    below = clean.where(name == "global-metadata.dat").select(F.explode(ancestors(F.col("_p"))).alias("_m")).distinct()
    marked = clean.join(below, F.col("_d") == F.col("_m"), "left")
    parts = components(F.col("_d"))
    managed = (F.lower(F.element_at(parts, -1)) == "managed") & F.coalesce(F.get(parts, F.size(parts) - 2).endswith("_Data"), F.lit(False)) & (F.size(parts) >= 2)
    companion = (name == "gameassembly.dll") & F.col("_m").isNotNull()
    kind = F.when(companion, "UnityIL2CPP").when(managed, "UnityMono").otherwise("Standalone")
    root = F.when(companion, F.col("_d")).when(managed, F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 2, F.lit(0))), "/")).otherwise("")
    return marked.withColumn("kind", kind).withColumn("root", root).drop("_p", "_d", "_m")


def content_root(files: DataFrame, folders: DataFrame, path: str, folder: str, marker: str = "Content", most: int = 5) -> DataFrame:
    """path and root: the nearest of up to five folders above that holds the marker folder, else the grandparent."""
    keyed = files.select(F.col(path).alias("_p"), clean_path(F.col(path)).alias("_c")).distinct()
    up = keyed.select("_p", "_c", F.posexplode(F.slice(F.reverse(ancestors(F.col("_c"))), 1, most)).alias("_k", "_a"))
    holds = folders.where(base_name(clean_path(F.col(folder))) == marker).select(parent(clean_path(F.col(folder))).alias("_h")).distinct()
    near = up.join(holds, F.col("_a") == F.col("_h"), "left_semi").groupBy("_p").agg(F.min(F.struct("_k", "_a"))["_a"].alias("_root"))
    return keyed.join(near, "_p", "left").select(F.col("_p").alias(path), F.coalesce("_root", parent(parent(F.col("_c")))).alias("root"))


def main_executable(files: DataFrame, by: str, path: str, size: str, excluded: tuple[str, ...]) -> DataFrame:
    """Of each key: the first shipping build under Binaries/Win64, else the largest there, else the largest executable."""
    name, clean = base_name(F.col(path)), clean_path(F.col(path))
    own = files.where((extension(F.col(path)) == ".exe") & ~F.lower(name).isin(*excluded))
    there = clean.contains("Binaries/Win64/")
    ship = there & name.endswith("-Shipping.exe")
    rank = F.struct(F.when(ship, 0).when(there, 1).otherwise(2).alias("o"), F.when(ship, F.lit(0)).otherwise(-F.col(size)).alias("s"), F.col(path).alias("p"))
    return own.groupBy(by).agg(F.min(rank).alias("_m")).select(by, F.col("_m.p").alias("executable"))


def display_order(rows: DataFrame, tool: str, step: Column, position: Column) -> DataFrame:
    """Tools by their first step, those without one last, else as first seen."""
    return rows.groupBy(tool).agg(F.coalesce(F.min(step), F.lit(999)).alias("first_step"), F.min(position).alias("first_seen")).orderBy("first_step", "first_seen")


def log_tail(rows: DataFrame, key: str, order: list[Column], most: int = 20) -> DataFrame:
    """The last messages of each key."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def rolled(rows: DataFrame, bucket: str, order: str, size: str, most: int = 1_500_000) -> DataFrame:
    """`file`, the number of the file in its bucket: a new one begins, and its size counts from nothing, once the one before holds the
    limit or more."""

    def step(state: tuple[int, int] | None, n: int | None) -> tuple[tuple[int, int], int]:
        file, held = state or (0, 0)
        if held >= most:
            file, held = file + 1, 0
        return (file, held + (n or 0)), file

    return folded(rows, bucket, [order], [size], step, "file")


def fresh_or_stale(cached: DataFrame, live: DataFrame, now: Column, hours: float = 1.0) -> DataFrame:
    """key and tag: the cached one while fresh, else the live one, else the stale one."""
    old = cached.select("key", F.col("tag").alias("_t"), (now - F.col("cached_at") <= hours * 3600).alias("_fresh"))
    joined = old.join(live.select("key", F.col("tag").alias("_l")), "key", "full")
    return joined.select("key", F.coalesce(F.when(F.col("_fresh"), F.col("_t")), "_l", "_t").alias("tag"))


@dataclass
class Settings:
    """Driver-side settings of a run: defaults, a file's values over them, and single keys patched."""

    output: str = "out"
    exclude: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    skip_enabled: bool = True
    categories: dict[str, bool] = field(default_factory=dict)
    api_token: str = ""

    def patched(self, key: str, value: object) -> Settings:
        if key not in {f.name for f in fields(self)}:
            raise KeyError(key)
        return Settings(**{f.name: value if f.name == key else getattr(self, f.name) for f in fields(self)})

    def shown(self) -> dict:
        return {f.name: "***" if f.name == "api_token" and self.api_token else getattr(self, f.name) for f in fields(self)}


def info_text(row: DataFrame) -> DataFrame:
    """A readable report of classified files: path, kind, compiler, obfuscator and recipe, one line each."""
    line = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.format_string(f"{label}: %s", F.col(c)))
    return row.select("path", F.concat_ws("\n", line("File", "path"), line("Kind", "kind"), line("Compiler", "compiler"), line("Obfuscator", "obfuscator"), line("Recipe", "recipe")).alias("text"))
