"""Name resolution of functions from the strings they hold, and its overlay on other tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basaltic.functions.symbols import is_qualified, real_callee_rule


def single_name(refs: DataFrame, key: str, text: str, accept: Column | None = None) -> DataFrame:
    """key and new_name of those keys that hold exactly one distinct acceptable text."""
    fit = refs.where(accept if accept is not None else is_qualified(F.col(text)))
    found = fit.groupBy(key).agg(F.min(text).alias("new_name"), F.max(text).alias("_other"))
    return found.where(F.col("new_name") == F.col("_other")).drop("_other")


def first_claims(candidates: DataFrame, name: str, position: str) -> DataFrame:
    """Of rows with the same name only the first by position; aggregated before the shuffle."""
    rest = [c for c in candidates.columns if c not in (name, position)]
    best = candidates.groupBy(name).agg(F.min(F.struct(position, *rest)).alias("_b"))
    return best.select(name, *(F.col(f"_b.{c}").alias(c) for c in [position, *rest])).select(*candidates.columns)


def without_known(candidates: DataFrame, name: str, known: DataFrame) -> DataFrame:
    """Candidates whose name is none of the known names (a one-column frame)."""
    return candidates.join(known.select(F.col(known.columns[0]).alias("_k")), F.col(name) == F.col("_k"), "left_anti")


def overlaid(rows: DataFrame, key: str, old: str, names: DataFrame, out: str) -> DataFrame:
    """Rows with the new name where there is one, else the old; names has key and new_name, one row a key."""
    named = names.select(F.col(key).alias("_key"), F.col("new_name").alias("_new"))
    return rows.join(named, rows[key] == F.col("_key"), "left").withColumn(out, F.coalesce("_new", old)).drop("_key", "_new")


def real_callees(edges: DataFrame, callee: str, known: DataFrame) -> DataFrame:
    """Edges whose callee is real by its form or a known name. The rule goes first, so only undecided edges meet the names,
    by equality and never by an OR in the join."""
    ruled = edges.withColumn("_rule", real_callee_rule(F.col(callee)))
    names = known.select(F.col(known.columns[0]).alias("_k")).distinct()
    unsure = ruled.where("_rule is null").join(names, F.col(callee) == F.col("_k"), "left_semi")
    return ruled.where("_rule").unionByName(unsure).drop("_rule")


def prefix_lookup(names: DataFrame, name: str, catalogue: DataFrame, entry: str) -> DataFrame:
    """names with `matched`: the catalogue's entry equal to the name, else to the name without its prefix letter, else null."""
    from basaltic.functions.symbols import bare_type

    own = catalogue.select(F.col(entry).alias("_e")).where("_e is not null").distinct()
    exact = own.withColumnRenamed("_e", "_x")
    bare = own.withColumnRenamed("_e", "_y")
    joined = names.join(exact, F.col(name) == F.col("_x"), "left").join(bare, bare_type(F.col(name)) == F.col("_y"), "left")
    return joined.withColumn("matched", F.coalesce("_x", "_y")).drop("_x", "_y")


def numbered(rows: DataFrame, by: str, order: list[Column], out: str = "rank") -> DataFrame:
    """Rank within a key."""
    return rows.withColumn(out, F.row_number().over(W.partitionBy(by).orderBy(*order)))
