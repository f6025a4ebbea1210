"""Queries over event sequences, samples and scores."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltic.operators import summary, timeline
from basaltic.sources.tables import table

#: Events stand for pipeline progress: phases by type, targets for logins alone, totals by the value.
_PHASES = {"click": "execute", "view": "scan", "purchase": "install", "signup": "recon", "error": "skip", "login": "tools", "logout": "done"}


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    seconds = F.unix_date(ts.cast("date")) * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds.cast("long") * 1000000 + (F.extract(F.lit("SECOND"), ts) * 1000000).cast("long")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    phase = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in _PHASES.items() for x in p]), F.col("event_type")), F.lit("log"))
    target = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("t"), F.col("event_id"))).otherwise("")
    return e.select("event_id", "user_id", "event_type", "value", micros(F.col("ts")).alias("us"), phase.alias("phase"), target.alias("target"), F.when(F.col("event_id") % 9 == 0, F.col("event_id")).otherwise(0).alias("total"))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    made = summary.run_summary(e, F.col("event_id") % 10 == 0, F.col("event_type") == "error", F.col("event_type"), F.when(F.col("user_id") % 3 == 0, "odd"))
    return made.select("total", "skipped", "failed", "success", F.to_json("by_recipe").alias("by_recipe"))


def sample_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three events of each user by time."""
    return summary.first_of_each(_events(spark, sf_dir).select("user_id", "event_id", "us"), "user_id", [F.col("us"), F.col("event_id")], 3)


def status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running status: stage and target carried forward."""
    e = _events(spark, sf_dir).withColumn("stage0", F.coalesce(timeline.mapped_stage(F.col("phase")), F.lit("")))
    e = timeline.carried(e, "user_id", ["us", "event_id"], F.col("stage0"), "stage")
    return timeline.carried(e, "user_id", ["us", "event_id"], F.col("target"), "last_target").select("user_id", "event_id", "stage", "last_target")


def status_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.final_status(_events(spark, sf_dir), "user_id", F.struct("us", "event_id"), "phase", F.col("target"), F.col("total"))


def tool_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    unit = F.when(F.col("event_id") % 4 == 0, "KB").otherwise("items")
    return timeline.counters(e, "event_type", F.struct("us", "event_id"), unit, F.col("event_id"), F.col("event_id") % 3 == 0)


def history_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select((F.col("user_id") % 10).alias("shard"), F.col("user_id").cast("string").alias("path"), "event_id", "us")
    return summary.history(rows, "shard", "path", F.struct("us", "event_id"))


def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    return summary.composition(rows, [F.col("event_type").alias("kind"), (F.col("user_id") % 4).alias("compiler")], F.floor("value"), F.col("event_id"))


def tool_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    has = lambda k: F.bool_or(F.col("event_id") % k == 0)
    flags = e.groupBy("user_id").agg(has(97).alias("running"), has(89).alias("failed"), has(83).alias("skipped"), has(79).alias("success"), has(73).alias("counted"), has(71).alias("fetching"), has(61).alias("installed"), has(59).alias("executing"), F.min("event_id").alias("first_step"))
    return flags.select("user_id", timeline.tool_state(*map(F.col, ("running", "failed", "skipped", "success", "counted", "fetching", "installed", "executing"))).alias("state"), "first_step")


def throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose whole value changes, that reach 100, or that come a day after the last one let through."""
    return timeline.changes(_events(spark, sf_dir), "user_id", ["us", "event_id"], F.col("value") / 10, F.col("us") / 1000000, 86400.0).select("user_id", "event_id")


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.transitions(_events(spark, sf_dir), "user_id", ["us", "event_id"], "event_type", "before").select("user_id", "event_id", "event_type", "before")


def stage_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's state while the user's last event is on."""
    last = timeline.final_status(_events(spark, sf_dir), "user_id", F.struct("us", "event_id"), "phase", F.col("target"), F.col("total"))
    active = F.coalesce(timeline.mapped_stage(F.col("phase")), F.lit("analysis"))
    rows = last.select("user_id", active.alias("active"), F.explode(F.array(*map(F.lit, timeline.STAGE_ORDER))).alias("stage"))
    percent = timeline.step_percent(F.col("user_id") % 4, F.col("user_id") % 2 == 0, F.lit(4))
    return rows.select("user_id", "stage", timeline.stage_status(F.col("stage"), F.col("active"), F.col("user_id") % 7 == 0).alias("status"), percent.alias("percent"))


def tight_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks after which a view and then a purchase follow within 6 events of the user."""
    e = _events(spark, sf_dir).select("user_id", "event_id", "event_type")
    return timeline.tight_pattern(e, "user_id", "event_id", "event_type", "click", ("view", "purchase"), 6).select("user_id", "event_id")


def key_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best XOR candidate for the first letters of part names, by size group."""
    units = table(spark, sf_dir, "part").select((F.col("p_size") % 16).alias("grp"), F.explode(F.transform(F.filter(F.split("p_name", ""), lambda c: c != ""), lambda c: F.ascii(c).bitwiseXOR(F.lit(0x5A)))).alias("unit"))
    return summary.key_scores(units, "grp", "unit")


def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character-weighted confidence and agreement of shared indexes over part names, some of them broken."""
    p = table(spark, sf_dir, "part")
    text = F.when(F.col("p_partkey") % 13 == 0, F.concat(F.lit("\ue001"), F.col("p_name"))).otherwise(F.col("p_name"))
    return summary.agreement(p.select(F.col("p_partkey").cast("int").alias("magic"), text.alias("t")), "magic", "t", 16)


_E = """(SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us, coalesce(CASE event_type WHEN 'click' THEN 'execute' WHEN 'view' THEN 'scan' WHEN 'purchase' THEN 'install' WHEN 'signup' THEN 'recon' WHEN 'error' THEN 'skip' WHEN 'login' THEN 'tools' WHEN 'logout' THEN 'done' END, 'log') AS phase,
    CASE WHEN event_id % 5 = 0 THEN 't' || event_id ELSE '' END AS target, CASE WHEN event_id % 9 = 0 THEN event_id ELSE 0 END AS total FROM events)"""
_STAGE = "CASE phase WHEN 'scan' THEN 'analysis' WHEN 'recon' THEN 'analysis' WHEN 'match' THEN 'analysis' WHEN 'tools' THEN 'tools' WHEN 'install' THEN 'tools' WHEN 'download' THEN 'tools' WHEN 'extract' THEN 'tools' WHEN 'execute' THEN 'execute' WHEN 'log' THEN 'execute' WHEN 'done' THEN 'done' END"
_W = "(PARTITION BY user_id ORDER BY us, event_id)"
_RUN = "(PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)"
_ANY = lambda k: f"bool_or(event_id % {k} = 0)"

QUERIES = {
    "run_summary": (
        run_summary,
        """SELECT count(*) AS total, count(*) FILTER (event_id % 10 = 0) AS skipped, count(*) FILTER (event_id % 10 <> 0 AND event_type = 'error') AS failed, count(*) FILTER (event_id % 10 <> 0 AND event_type <> 'error') AS success,
        '{"odd":' || count(*) FILTER (user_id % 3 = 0) || '}' AS by_recipe FROM events""",
    ),
    "sample_capped": (sample_capped, f"SELECT user_id, event_id, us FROM {_E} QUALIFY row_number() OVER {_W} <= 3"),
    "status_fold": (
        status_fold,
        f"SELECT user_id, event_id, last_value({_STAGE} IGNORE NULLS) OVER {_RUN} AS stage, last_value(nullif(target, '') IGNORE NULLS) OVER {_RUN} AS last_target FROM {_E}",
    ),
    "status_final": (
        status_final,
        f"SELECT user_id, arg_max(phase, (us, event_id)) AS phase, coalesce(arg_max(target, (us, event_id)) FILTER (target <> ''), '') AS target, coalesce(arg_max(total, (us, event_id)) FILTER (total <> 0), 0) AS files_total, count(*) AS events FROM {_E} GROUP BY 1",
    ),
    "tool_counters": (
        tool_counters,
        f"""SELECT event_type, CAST(coalesce(sum(event_id) FILTER (event_id % 4 <> 0 AND event_id % 3 = 0), 0) AS BIGINT) AS completed, arg_max(event_id, (us, event_id)) FILTER (event_id % 4 = 0) AS size_kb,
        arg_max(event_id, (us, event_id)) FILTER (event_id % 4 <> 0 AND event_id % 3 <> 0) AS "current" FROM {_E} GROUP BY 1""",
    ),
    "history_top20": (
        history_top20,
        f"""SELECT shard, path, event_id, us FROM (SELECT user_id % 10 AS shard, CAST(user_id AS VARCHAR) AS path, max_by(event_id, (us, event_id)) AS event_id, max(us) AS us FROM {_E} GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY shard ORDER BY us DESC, event_id DESC, path) <= 20""",
    ),
    "composition": (composition, 'SELECT event_type AS kind, user_id % 4 AS compiler, count(*) AS "count", CAST(sum(floor(value)) AS BIGINT) AS total_size, min(event_id) AS first_seen FROM events GROUP BY 1, 2'),
    "tool_state": (
        tool_state,
        f"""SELECT user_id, CASE WHEN {_ANY(97)} THEN 'running' WHEN {_ANY(89)} THEN 'failed' WHEN {_ANY(83)} THEN 'skipped' WHEN {_ANY(79)} OR {_ANY(73)} THEN 'done' WHEN {_ANY(71)} THEN 'installing' WHEN {_ANY(61)} OR {_ANY(59)} THEN 'ready' ELSE 'checking' END AS state, min(event_id) AS first_step FROM events GROUP BY 1""",
    ),
    "throttle": (
        throttle,
        f"""WITH RECURSIVE e AS (SELECT user_id, event_id, floor(value / 10) AS p, us / 1000000 AS s, row_number() OVER {_W} AS r FROM {_E}),
        walk AS (SELECT user_id, event_id, r, p AS last_p, s AS last_s, true AS shown FROM e WHERE r = 1 UNION ALL
        SELECT e.user_id, e.event_id, e.r, CASE WHEN go THEN e.p ELSE last_p END, CASE WHEN go THEN e.s ELSE last_s END, go
        FROM (SELECT e.*, last_p, last_s, e.p <> last_p OR e.p >= 100 OR e.s - last_s >= 86400 AS go FROM walk JOIN e ON e.user_id = walk.user_id AND e.r = walk.r + 1) e)
        SELECT user_id, event_id FROM walk WHERE shown""",
    ),
    "transitions": (transitions, f'SELECT user_id, event_id, event_type, before FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER {_W} AS "before" FROM {_E}) WHERE before IS NOT NULL AND before <> event_type'),
    "stage_states": (
        stage_states,
        f"""WITH l AS (SELECT user_id, coalesce({_STAGE}, 'analysis') AS active FROM (SELECT user_id, arg_max(phase, (us, event_id)) AS phase FROM {_E} GROUP BY 1)), s AS (SELECT unnest(['analysis', 'tools', 'execute', 'done']) AS stage)
        SELECT user_id, stage, CASE WHEN list_position(o, stage) < list_position(o, active) THEN 'done' WHEN list_position(o, stage) > list_position(o, active) THEN 'pending' WHEN user_id % 7 = 0 THEN 'error' ELSE 'active' END AS status,
        CAST(floor((user_id % 4 + CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END) / 4.0 * 100 + 0.5) AS BIGINT) AS percent FROM l, s, (SELECT ['analysis', 'tools', 'execute', 'done'] AS o)""",
    ),
    "tight_window": (
        tight_window,
        """WITH n AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
        SELECT DISTINCT a.user_id, a.event_id FROM n a JOIN n b ON a.user_id = b.user_id AND b.k > a.k AND b.k <= a.k + 6 AND b.event_type = 'view' JOIN n c ON a.user_id = c.user_id AND c.k > b.k AND c.k <= a.k + 6 AND c.event_type = 'purchase' WHERE a.event_type = 'click'""",
    ),
    "key_score": (
        key_score,
        """WITH u AS (SELECT p_size % 16 AS grp, xor(unicode(unnest(string_split(p_name, ''))), 90) AS unit FROM part), k AS (SELECT unnest(range(0, 256)) AS kb),
        s AS (SELECT grp, kb, sum(CASE WHEN c >= 32 AND c < 127 THEN 2 WHEN c IN (9, 10, 13) THEN 1 WHEN c >= 57344 AND c <= 63743 THEN -4 ELSE -2 END) AS score FROM (SELECT grp, kb, xor(unit, kb::INT) AS c FROM u, k) GROUP BY 1, 2)
        SELECT grp, CAST(kb AS INT) AS kb, CAST(score AS BIGINT) AS score FROM s QUALIFY row_number() OVER (PARTITION BY grp ORDER BY score DESC, kb) = 1""",
    ),
    "agreement": (
        agreement,
        r"""WITH t AS (SELECT p_partkey AS magic, CASE WHEN p_partkey % 13 = 0 THEN chr(57345) || p_name ELSE p_name END AS t FROM part), g AS (SELECT magic, greatest(1, length(t)) AS w, t = '' OR (NOT regexp_matches(t, '[\x{E000}-\x{F8FF}]')
        AND length(regexp_replace(t, '[^A-Za-z0-9/._\-: {}<>]', '', 'g')) / length(t)::DOUBLE >= 0.6) AS good FROM t), i AS (SELECT magic % 16 AS i, count(DISTINCT magic) AS m, avg(good::INT) AS g, sum(w) AS w, sum(CASE WHEN good THEN w ELSE 0 END) AS gw FROM g GROUP BY 1)
        SELECT sum(gw) / sum(w) AS confidence, bool_and(m < 2 OR g >= 0.65) AS agrees FROM i""",
    ),
}
