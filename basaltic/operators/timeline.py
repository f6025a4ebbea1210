"""Event sequences in batch: carried values, transitions, throttling, folds, counters and display states."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basaltic.operators.folds import folded

# Pipeline phases by the stage that shows them; skip keeps the stage before.
STAGE_OF_PHASE = {"scan": "analysis", "recon": "analysis", "match": "analysis", "tools": "tools", "install": "tools", "download": "tools", "extract": "tools", "execute": "execute", "log": "execute", "done": "done"}
STAGE_ORDER = ("analysis", "tools", "execute", "done")


def mapped_stage(phase: Column) -> Column:
    """The stage of a phase; null keeps the one before."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in STAGE_OF_PHASE.items() for x in pair]), phase)


def carried(rows: DataFrame, key: str, order: list[str], value: Column, out: str) -> DataFrame:
    """The last non-empty value up to each row."""
    run = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(F.nullif(value, F.lit("")), True).over(run))


def final_status(rows: DataFrame, key: str, position: Column, phase: str, target: Column, total: Column) -> DataFrame:
    """The fold's end by key, as aggregates: last phase, last non-empty target, last non-zero total, events seen."""
    last = lambda c, test: F.max(F.when(test, F.struct(position.alias("p"), c.alias("v"))))["v"]
    return rows.groupBy(key).agg(
        last(F.col(phase), F.lit(True)).alias("phase"),
        F.coalesce(last(target, F.coalesce(target, F.lit("")) != ""), F.lit("")).alias("target"),
        F.coalesce(last(total, F.coalesce(total, F.lit(0)) != 0), F.lit(0)).alias("files_total"),
        F.count("*").alias("events"),
    )


def changes(rows: DataFrame, key: str, order: list[str], percent: Column, seconds: Column, gap: float = 1.0) -> DataFrame:
    """Rows whose whole percent changes, that reach 100, or that come a gap or more after the last row that was let through."""

    def step(state: tuple | None, p: int | None, s: float | None) -> tuple[tuple, int]:
        out = state is None or p != state[0] or (p is not None and p >= 100) or (s is not None and state[1] is not None and s - state[1] >= gap)
        return ((p, s), 1) if out else (state, 0)

    marked = rows.withColumn("_p", F.floor(percent)).withColumn("_s", seconds.cast("double"))
    return folded(marked, key, order, ["_p", "_s"], step, "_out").where("_out = 1").drop("_p", "_s", "_out")


def transitions(rows: DataFrame, key: str, order: list[str], value: str, out: str) -> DataFrame:
    """Rows whose value differs from the row before, with that earlier value."""
    return rows.withColumn(out, F.lag(value).over(W.partitionBy(key).orderBy(*order))).where(F.col(out).isNotNull() & (F.col(out) != F.col(value)))


def step_percent(step: Column, done: Column, total: Column) -> Column:
    """round((step + 1 if done) / total * 100), 0 without steps."""
    return F.when(total > 0, F.floor((step + done.cast("int")) / total * 100 + 0.5)).otherwise(0).cast("long")


def counters(rows: DataFrame, tool: str, position: Column, unit: Column, count: Column, finished: Column) -> DataFrame:
    """Per tool: item counts of finished steps add up; sizes replace one another."""
    size = unit == "KB"
    return rows.groupBy(tool).agg(
        F.coalesce(F.sum(F.when(~size & finished, count)), F.lit(0)).alias("completed"),
        F.max(F.when(size, F.struct(position.alias("p"), count.alias("v"))))["v"].alias("size_kb"),
        F.max(F.when(~size & ~finished, F.struct(position.alias("p"), count.alias("v"))))["v"].alias("current"),
    )


def tool_state(running: Column, failed: Column, skipped: Column, success: Column, counted: Column, fetching: Column, installed: Column, executing: Column) -> Column:
    """A tool's display state, the first that holds."""
    return F.when(running, "running").when(failed, "failed").when(skipped, "skipped").when(success | counted, "done").when(fetching, "installing").when(installed | executing, "ready").otherwise("checking")


def stage_status(stage: Column, active: Column, failed: Column) -> Column:
    """done before the active stage, active or error at it, pending after it."""
    place = lambda c: F.array_position(F.array(*map(F.lit, STAGE_ORDER)), c)
    return F.when(place(stage) < place(active), "done").when(place(stage) > place(active), "pending").when(failed, "error").otherwise("active")


def tight_pattern(rows: DataFrame, key: str, order: str, opcode: str, first: str, then: tuple[str, ...], reach: int = 24) -> DataFrame:
    """Rows with opcode `first` after which the others follow in that order within so many rows."""
    ahead = F.collect_list(opcode).over(W.partitionBy(key).orderBy(order).rowsBetween(1, reach))
    pattern = "(?s)" + ".*".join(f"(?:^|\u0001){o}(?:\u0001|$)" for o in then)
    joined = F.concat(F.lit("\u0001"), F.array_join(ahead, "\u0001\u0001"), F.lit("\u0001"))
    return rows.withColumn("_a", joined).where((F.col(opcode) == first) & F.col("_a").rlike(pattern)).drop("_a")
