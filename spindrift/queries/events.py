"""E1 to E9 over the events table, and event-time extensions."""

from pyspark.sql import functions as F

from ..catalog import query
from ..session import folder
from ..sources.log import Log, snapshot_rules, write_stream
from ..sources.tables import activity_lines
from ..streaming import feedback as X

FEED = """e AS (SELECT user_id AS axis, event_id AS seq, CASE event_type WHEN 'error' THEN 'undefined' WHEN 'click' THEN 'delete' WHEN 'view' THEN 'prompt_update' WHEN 'signup' THEN 'create' ELSE 'score' END AS kind, CAST(json_extract(props, '$.k') AS INT) % 12 AS item, value AS target FROM events)"""
MOVES = "m AS (SELECT * FROM e WHERE kind IN ('score', 'undefined', 'delete'))"


def feed(t):
    kind = F.when(F.col("event_type") == "error", "undefined").when(F.col("event_type") == "click", "delete").when(F.col("event_type") == "view", "prompt_update").when(F.col("event_type") == "signup", "create").otherwise("score")
    item = (F.get_json_object("props", "$.k").cast("int") % 12).alias("item")
    return t.events.select(F.col("user_id").alias("axis"), F.col("event_id").alias("seq"), kind.alias("kind"), item, F.col("value").alias("target"))


def moves(t):
    return feed(t).where(F.col("kind").isin("score", "undefined", "delete"))


@query("E1_feedback_state", f"""
WITH {FEED}, {MOVES}, c AS (SELECT *, coalesce(max(seq) FILTER (WHERE kind <> 'score') OVER (PARTITION BY axis, item), -1) AS cleared FROM m),
g AS (SELECT axis, item, arg_max(kind, seq) AS kind, arg_max(target, seq) AS target, min(seq) FILTER (WHERE kind = 'score' AND seq > cleared) AS first_seq, max(seq) AS last_seq FROM c GROUP BY 1, 2)
SELECT axis, item, kind, CASE WHEN kind = 'score' THEN round(target, 4) END AS target, coalesce(first_seq, last_seq) AS first_seq FROM g WHERE kind <> 'delete'""")
def _(t):
    return X.feedback_state(moves(t)).withColumn("target", F.round("target", 4))


@query("E1_feedback_stream", f"""
WITH {FEED}, {MOVES}, l AS (SELECT axis, item, arg_max(kind, seq) AS kind FROM m GROUP BY 1, 2)
SELECT axis, count(*) FILTER (WHERE kind = 'score') AS moves, count(*) FILTER (WHERE kind = 'undefined') AS undefined FROM l GROUP BY axis""")
def _(t):
    """The events as a file stream through the stateful processor, run to its end; the last row of each axis."""
    spark = t.spark
    base = folder(spark, "stream")
    src = moves(t).select(F.col("axis").cast("string").alias("axis"), "seq", "kind", F.col("item").cast("string").alias("item"), "target")
    src.write.parquet(f"{base}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        s = X.feedback_stream(spark.readStream.schema(src.schema).parquet(f"{base}/in"))
        q = s.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    out = spark.read.schema(X.FeedbackProcessor.OUT).parquet(f"{base}/out")
    return out.groupBy("axis").agg(F.max_by("moves", "seq").alias("moves"), F.max_by("undefined", "seq").alias("undefined")).withColumn("axis", F.col("axis").cast("long"))


@query("E2_interaction_counters", f"""
WITH {FEED}, r AS (SELECT *, sum(CAST(kind = 'prompt_update' AS INT)) OVER (PARTITION BY axis ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS prior_revision FROM e)
SELECT axis, seq, prior_revision, row_number() OVER (PARTITION BY axis, prior_revision ORDER BY seq) - 1 AS b_interaction FROM r""")
def _(t):
    return X.counters(feed(t)).select("axis", "seq", F.col("prior_revision").cast("long").alias("prior_revision"), "b_interaction")


@query("E2_snapshot_log", f"""
WITH {FEED}, r AS (SELECT axis, seq, kind FROM e WHERE kind <> 'create' UNION ALL SELECT axis, min(seq) - 1, 'create' FROM e GROUP BY axis),
c AS (SELECT *, sum(CAST(kind = 'prompt_update' AS INT)) OVER (PARTITION BY axis ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS prior_revision FROM r)
SELECT axis, seq, kind, prior_revision, row_number() OVER (PARTITION BY axis, prior_revision ORDER BY seq) - 1 AS b_interaction FROM c""")
def _(t):
    """The events appended to a log in three commits: baselines, then the events of even and odd axes, each checked against the rules."""
    e = feed(t).select("axis", "seq", "kind")
    log = Log(t.spark, folder(t.spark, "snapshots"), e.schema)
    log.append(e.groupBy("axis").agg((F.min("seq") - 1).alias("seq"), F.lit("create").alias("kind")), snapshot_rules)
    for odd in (0, 1):
        log.append(e.where((F.col("kind") != "create") & (F.col("axis") % 2 == odd)), snapshot_rules)
    return X.counters(log.rows()).select("axis", "seq", "kind", F.col("prior_revision").cast("long").alias("prior_revision"), "b_interaction")


@query("E7_log_stream", "SELECT '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '] [' || event_type || '] [' || props || ']' AS value FROM events")
def _(t):
    """The events as a stream of lines that is appended to a log, and started once more: each batch is there once."""
    e = t.events.select("ts", "event_type", "props")
    e.write.parquet(f"{(base := folder(t.spark, 'session'))}/in")
    lines = activity_lines(t.spark.readStream.schema(e.schema).parquet(f"{base}/in"), "ts", "event_type", "props")
    log = Log(t.spark, f"{base}/log", lines.schema)
    for again in range(2):
        write_stream(lines, log, "session", f"{base}/checkpoint{again}").awaitTermination()
    return log.rows()


@query("E3_baseline_attach", f"WITH {FEED}, s AS (SELECT DISTINCT axis FROM e WHERE kind = 'create') SELECT axis, seq, kind FROM e UNION ALL SELECT axis, min(seq) - 1, 'create' FROM e WHERE axis NOT IN (FROM s) GROUP BY axis")
def _(t):
    e = feed(t)
    return X.attach_baseline(e, e.where("kind = 'create'"))


@query("E4_incremental_rank_pairs")
def _(t):
    return X.fold_pairs(moves(t).withColumn("item", F.col("item").cast("string")), 32)


@query("E6_fit_signature", f"WITH {FEED}, {MOVES} SELECT axis, count(DISTINCT (item, kind, target)) AS fits FROM m GROUP BY axis")
def _(t):
    m = moves(t).withColumn("sig", X.signature(F.col("item"), F.col("kind"), F.col("target")))
    return m.groupBy("axis").agg(F.count_distinct("sig").alias("fits"))


@query("E7_session_log", "SELECT user_id, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("E9_target_trace", f"""
WITH {FEED}, s AS (SELECT axis, seq, item, target AS raw, least(greatest(target, 0), 100) / 100 AS used FROM e WHERE kind = 'score'), b AS (SELECT *, lag(used) OVER (PARTITION BY axis, item ORDER BY seq) AS before FROM s)
SELECT axis, seq, item, round(raw, 4) AS raw, round(used, 6) AS used, CAST(least(floor(used * 10), 9) AS INT) AS bin, round(before, 6) AS before, concat_ws(',', CASE WHEN used <> raw / 100 THEN 'clamped' END, CASE WHEN used = before THEN 'unchanged' END, CASE WHEN used = 0.5 THEN 'neutral' END) AS warnings FROM b""")
def _(t):
    return X.target_trace(feed(t)).select("axis", "seq", "item", F.round("raw", 4).alias("raw"), F.round("used", 6).alias("used"), "bin", F.round("before", 6).alias("before"), "warnings")


@query("EXT_tumbling_window", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(t):
    return X.windowed(t.events, "ts", "event_type", "value", "6 hours").withColumn("total", F.round("total", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("EXT_sliding_window", "SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM events) GROUP BY 1, 2")
def _(t):
    return X.windowed(t.events, "ts", "event_type", "value", "12 hours", "6 hours").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("EXT_session_window", """
WITH g AS (SELECT user_id, ts, CAST(lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 12 HOUR AS INT) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, no""")
def _(t):
    return X.sessions(t.events, "ts", "user_id", "12 hours").select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n")


@query("EXT_cube_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("EXT_asof_join", "SELECT a.event_id, max(b.event_id) AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') a JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND b.event_id < a.event_id GROUP BY 1")
def _(t):
    from pyspark.sql import Window

    e = t.events.where("event_type IN ('purchase', 'view')").select("user_id", "event_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("event_type") == "view", F.col("event_id"))).over(w)
    return e.withColumn("last_view", last).where("event_type = 'purchase' AND last_view IS NOT NULL").select("event_id", "last_view")
