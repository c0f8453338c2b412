"""Registered queries that write and read back, or stream, with the batch result as oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicketflow.functions import rules as r
from wicketflow.plans.player_queries import MU_SQL
from wicketflow.operators import careers as c
from wicketflow.registry import query
from wicketflow.sources import matches as m
from wicketflow.sources import sinks
from wicketflow.sources.shared import fresh_path as shared
from wicketflow.streaming import live

CORE = "match_id, innings_number, over_number, ball_in_over, batting_team, bowling_team, batter, bowler, non_striker, runs_batter, runs_extras, runs_total, extra_type, is_wicket, wicket_type, dismissed_player, match_date, season"
CORE_LIST = CORE.split(", ")


def documents(t):
    path = shared(t.spark, "matches")
    m.as_documents(t.deliveries).write.json(path)
    # one document a line: the same schema without multiLine
    return t.spark.read.schema(m._DDL).json(path)


query("flatten_deliveries", f"SELECT {CORE} FROM deliveries")(lambda t: m.flatten(documents(t)).select(*CORE_LIST))
query("flatten_deliveries_full", f"SELECT {CORE}, format, venue, team_a, team_b, non_boundary, extras_wides, extras_noballs, extras_byes, extras_legbyes, fielder FROM deliveries")(
    lambda t: m.flatten(documents(t)).select(*CORE_LIST, "format", "venue", "team_a", "team_b", "non_boundary", "extras_wides", "extras_noballs", "extras_byes", "extras_legbyes", "fielder")
)
query("scan_match_info", "SELECT match_id, format, season, venue, team_a, team_b FROM matches")(
    lambda t: documents(t).select("match_id", F.col("info.match_type").alias("format"), "info.season", "info.venue", F.get("info.teams", 0).alias("team_a"), F.get("info.teams", 1).alias("team_b"))
)
query("delivery_count", "SELECT match_id, count(*) AS deliveries FROM deliveries GROUP BY match_id")(lambda t: m.delivery_count(documents(t)))


def by_format(t):
    path = shared(t.spark, "gold")
    mu = c.matchups(t.deliveries)
    sinks.write_by_format(mu, path)
    sinks.replace_formats(mu.where("format = 'ODI'").withColumn("runs", F.col("runs") + 1000), path, ["batter", "bowler", "format"])
    return t.spark.read.schema(mu.schema).parquet(path).select("batter", "bowler", "format", "runs")


query("sink_format_replace", f", {MU_SQL} SELECT batter, bowler, format, runs + CASE WHEN format = 'ODI' THEN 1000 ELSE 0 END AS runs FROM mu")(by_format)


def parquet_round(t):
    path = shared(t.spark, "silver")
    d = t.deliveries.select(*CORE_LIST, "format")
    sinks.write_by_format(d, path)
    return t.spark.read.schema(d.schema).parquet(path).where("format = 'T20'").select(*CORE_LIST)


query("sink_parquet", f"SELECT {CORE} FROM deliveries WHERE format = 'T20'")(parquet_round)
KEY = ["match_id", "innings_number", "over_number", "ball_in_over"]
query("upsert_deliveries", f"SELECT {', '.join(KEY)} FROM deliveries WHERE innings_number = 2")(
    lambda t: sinks.unseen(t.deliveries.unionAll(t.deliveries.where("over_number < 3")), t.deliveries.where("innings_number = 1"), KEY).select(*KEY)
)
query("replace_match_scorecards", "SELECT match_id, CAST(sum(runs_total) AS BIGINT) + CASE WHEN match_id IN ('m1', 'm4') THEN 7 ELSE 0 END AS runs FROM deliveries GROUP BY match_id")(
    lambda t: sinks.replaced_matches(t.deliveries.groupBy("match_id").agg(r.total("runs_total").alias("runs")), t.deliveries.where("match_id in ('m1', 'm4')").groupBy("match_id").agg((r.total("runs_total") + 7).alias("runs")))
)
query("union_by_name", "SELECT match_id, venue, CAST(NULL AS VARCHAR) AS winner FROM matches UNION ALL SELECT match_id, NULL, winner FROM matches")(
    lambda t: t.matches.select("match_id", "venue").unionByName(t.matches.select("match_id", "winner"), allowMissingColumns=True)
)


def finished(query_handle):
    query_handle.awaitTermination()
    if query_handle.exception():
        raise query_handle.exception()


def events(t):
    """events as a stream of files."""
    path = shared(t.spark, "events")
    t.raw("events").repartition(4).write.parquet(path)
    return live.source(t.spark, path, t.raw("events").schema, 1)


def stream_ingest(t):
    out, mark = shared(t.spark, "ingested"), shared(t.spark, "mark")
    stream = events(t)
    for _ in range(2):  # the second run finds nothing new
        finished(live.ingest(stream, out, mark))
    return t.spark.read.parquet(out).select("event_id", "user_id", "event_type")


def plain(sql: str):
    """An oracle over the raw tables only."""
    from wicketflow import registry

    def add(name, f):
        query(name)(f)
        registry.ORACLES[name] = sql

    return add


plain("SELECT event_id, user_id, event_type FROM events")("stream_ingest", stream_ingest)


# events arrive in six files by time; some come late, in the last but one file, and every third twice, a file later
ARRIVAL = "CAST(floor((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) * 4 / ((SELECT max(epoch_us(ts)) FROM events) - (SELECT min(epoch_us(ts)) FROM events) + 1)) AS INT)"
ARRIVED = f"""WITH first AS (SELECT *, CASE WHEN event_id % 10 = 7 THEN 4 ELSE {ARRIVAL} END AS file FROM events),
arrived AS (SELECT * FROM first UNION ALL SELECT * REPLACE (file + 1 AS file) FROM first WHERE event_id % 3 = 0),
marks AS (SELECT file + 1 AS file, max(max(ts)) OVER (ORDER BY file) - INTERVAL 2 DAY AS mark FROM arrived GROUP BY file),
parted AS (SELECT arrived.*, coalesce(ts < mark, false) AS late FROM arrived LEFT JOIN marks USING (file)) """


def arriving(t):
    """The folder of those files, and their schema: as many as there are in ARRIVED, written one after the other."""
    path, e = shared(t.spark, "arriving"), t.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))
    us = F.unix_micros("ts")
    span = e.agg(F.min(us).alias("low"), F.max(us).alias("high"))
    first = e.crossJoin(F.broadcast(span)).withColumn("file", F.when(F.col("event_id") % 10 == 7, 4).otherwise(F.floor((us - F.col("low")) * 4 / (F.col("high") - F.col("low") + 1)).cast("int")))
    rows = first.unionByName(first.where("event_id % 3 = 0").withColumn("file", F.col("file") + 1)).drop("low", "high")
    for k in range(6):
        rows.where(F.col("file") == k).drop("file").coalesce(1).write.mode("append").parquet(path)
    return path, e.schema


def parted(t):
    path, out, mark = shared(t.spark, "arriving"), shared(t.spark, "parted"), shared(t.spark, "mark")
    path, schema = arriving(t)
    stream = live.source(t.spark, path, schema, 1)
    for _ in range(2):  # the second run finds nothing new
        finished(live.split_late(stream, "ts", "2 days", out, mark))
    return out, schema


def stream_late_rows(t):
    out, schema = parted(t)
    return live.parted(t.spark, out, schema).groupBy("epoch", "late").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")).where("n > 0")


plain(ARRIVED + "SELECT CAST(file AS BIGINT) AS epoch, late, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM parted GROUP BY file, late")("stream_late_rows", stream_late_rows)


def stream_dedupe(t):
    """Events once each, of those that came in time; the state holds two days of keys."""
    done, mark = shared(t.spark, "deduped"), shared(t.spark, "mark")
    out, schema = parted(t)
    kept = live.deduplicated(live.on_time(t.spark, out, schema, 1), "ts", ["event_id"], "2 days")
    finished(live.ingest(kept, done, mark))
    return t.spark.read.parquet(done).select("event_id", "user_id", "event_type")


plain(ARRIVED + "SELECT DISTINCT event_id, user_id, event_type FROM parted WHERE NOT late")("stream_dedupe", stream_dedupe)


def stream_latest(t):
    out, mark, path = shared(t.spark, "latest"), shared(t.spark, "mark"), shared(t.spark, "snapshots")
    e = t.raw("events").select("user_id", "ts", "event_id", "event_type")
    e.repartition(3).write.parquet(path)
    finished(live.changes(live.latest(live.source(t.spark, path, e.schema, 1), "user_id", "ts"), out, mark, ["user_id"], every=2))
    return live.current(t.spark, out, ["user_id"]).select("user_id", "event_id", "event_type")


plain("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")("stream_live_latest", stream_latest)
IN_ORDER = f"WITH sliced AS (SELECT *, {ARRIVAL} AS file FROM events) "


def in_order(t, columns):
    """events in four files by time, one after the other."""
    path, e = shared(t.spark, "ordered"), t.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))
    us = F.unix_micros("ts")
    low, high = e.agg(F.min(us), F.max(us)).first()
    for k in range(4):
        e.where(F.floor((us - low) * 4 / (high - low + 1)) == k).select(*columns).coalesce(1).write.mode("append").parquet(path)
    return live.source(t.spark, path, e.select(*columns).schema, 1)


def stream_live_users(t):
    """The latest event of each user heard of within ten hours of the last event; the state forgets the others."""
    out, mark = shared(t.spark, "users"), shared(t.spark, "mark")
    rows = live.live_rows(in_order(t, ["user_id", "ts", "event_id", "event_type"]), ["user_id"], "ts", "10 hours")
    finished(live.changes(rows, out, mark, ["user_id"], every=2))
    return live.current(t.spark, out, ["user_id"]).select("user_id", "event_id", "event_type")


LAST = "(SELECT max(ts) FROM events) - INTERVAL 10 HOUR"
plain(f"SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND date_trunc('milliseconds', ts) > date_trunc('milliseconds', {LAST})")("stream_live_users", stream_live_users)


def stream_user_totals(t):
    """Events and value of each user since the last silence of two days, as seen at the end of each file, for users heard of since."""
    out, mark = shared(t.spark, "totals"), shared(t.spark, "mark")
    rows = live.live_rows(in_order(t, ["user_id", "ts", "event_id", "value"]), ["user_id"], "ts", "2 days", sums={"n": "1", "cents": "round(value * 100)"})
    finished(live.changes(rows, out, mark, ["user_id"]))
    return live.current(t.spark, out, ["user_id"]).select("user_id", "n", "cents")


# a user's state goes when a file's end is two days past the user's last event, before the next file
plain(IN_ORDER + """, ends AS (SELECT file, max(max(ts)) OVER (ORDER BY file) AS mark FROM sliced GROUP BY file),
each AS (SELECT user_id, file, max(ts) AS last, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM sliced GROUP BY user_id, file),
cut AS (SELECT user_id, max(ends.file) AS gone FROM (SELECT each.user_id, ends.file, max(last) AS last, max(mark) AS mark FROM ends JOIN each ON each.file <= ends.file GROUP BY ALL) x JOIN ends USING (file) WHERE date_diff('millisecond', last, x.mark) >= 172800000 GROUP BY user_id)
SELECT user_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM each LEFT JOIN cut USING (user_id) WHERE gone IS NULL OR file > gone GROUP BY user_id""")("stream_user_totals", stream_user_totals)  # fmt: skip


def stream_scoreboard(t):
    path, mark, out = shared(t.spark, "balls"), shared(t.spark, "mark"), shared(t.spark, "scores")
    d = t.deliveries.select("match_id", "innings_number", "runs_total", "is_wicket", "extra_type")
    d.repartition(4).write.parquet(path)
    key = ["match_id", "innings_number"]
    finished(live.changes(live.scoreboard(live.source(t.spark, path, d.schema, 1)), out, mark, key, every=2))
    return live.current(t.spark, out, key)


def stream_windows(t):
    """Hourly activity of the events that came in time; windows two days before the latest event are closed."""
    mark, done = shared(t.spark, "mark"), shared(t.spark, "windows")
    out, schema = parted(t)
    rows = live.windowed_activity(live.on_time(t.spark, out, schema, 1), late="2 days").select(F.col("window.start").alias("start"), "event_type", "n")
    finished(live.changes(rows, done, mark, ["start", "event_type"]))
    return live.current(t.spark, done, ["start", "event_type"]).select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


plain(ARRIVED + "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM parted WHERE NOT late GROUP BY 1, 2")("stream_windows", stream_windows)
query("stream_scoreboard", "SELECT match_id, innings_number, CAST(sum(runs_total) AS BIGINT) AS runs, count_if(is_wicket) AS wickets, count_if(legal) AS balls FROM flags GROUP BY ALL")(stream_scoreboard)
