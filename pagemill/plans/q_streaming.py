"""Contract queries that run as streams over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import logs as batch
from pagemill.plans.contract import register
from pagemill.plans.q_logs import _LIMITED, _PINGS, _THROTTLED, job_kind
from pagemill.plans.q_text import _agent, _ip, _UA_SQL
from pagemill.sources.storage import shared_folder
from pagemill.sources.tables import table
from pagemill.streaming import logs, ordered


def _events(spark, d):
    return logs.event_stream(spark, f"{d}/events.parque[t]")


def _local(df):
    """Timestamps as the tables have them, without zone."""
    return df.select(*(F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else c for c, t in df.dtypes))


@register("stream_workers", f"WITH {_PINGS} SELECT * FROM w")
def stream_workers(spark, d):
    pings = _events(spark, d).select((F.col("user_id") % 40).alias("ip"), F.col("event_type").alias("host"), "ts", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("os"), F.col("event_id") % 5)).alias("platform"))
    return _local(logs.drain(logs.heartbeats(pings, keys=["ip", "host"], ts="ts", platform="platform"), shared_folder(spark, "workers"), mode="complete"))


@register(
    "stream_beacons",
    f"WITH u AS ({_UA_SQL}) SELECT event_id, ts, CASE WHEN regexp_matches(ua, 'iPhone|iPad|Android|Mobile') THEN 'mobile' ELSE 'desktop' END AS device, CASE WHEN event_id % 3 = 0 THEN ip ELSE '172.17.0.1' END AS ip, CASE WHEN contains(ua, 'Windows NT 10') THEN 'Windows 10/11' WHEN contains(ua, 'Windows NT') THEN 'Windows' WHEN contains(ua, 'Mac OS X') OR contains(ua, 'Macintosh') THEN 'macOS ' || replace(regexp_extract(ua, 'Mac OS X (\\d+[_.]\\d+)', 1), '_', '.') WHEN contains(ua, 'iPhone') THEN 'iOS/iPadOS' WHEN contains(ua, 'Android') THEN 'Android' WHEN contains(ua, 'Linux') THEN 'Linux' ELSE 'unknown' END AS os, CASE WHEN contains(ua, 'Edg/') THEN 'Edge' WHEN contains(ua, 'Opera') THEN 'Opera' WHEN contains(ua, 'Chrome/') AND NOT contains(ua, 'Chromium') THEN 'Chrome' WHEN contains(ua, 'Firefox/') THEN 'Firefox' WHEN contains(ua, 'Safari/') AND NOT contains(ua, 'Chrome') THEN 'Safari' ELSE 'unknown' END AS browser, CASE WHEN event_id % 3 = 0 THEN ip IN ('10.1.2.3', '172.16.9.9', '192.168.0.7', '127.0.0.1', '169.254.1.1', 'fe80::1') ELSE true END AS lan FROM u",
)
def stream_beacons(spark, d):
    key = F.col("event_id")
    rows = logs.beacons(_events(spark, d), agent=_agent(key), forwarded=F.when(key % 3 == 0, _ip(key)).otherwise(""), real=F.lit(None).cast("string"), peer=F.lit("172.17.0.1"))
    return _local(logs.drain(rows, shared_folder(spark, "beacons")))


def _to_end(spark, d, label, build, **options):
    return _local(ordered.drain_to_end(spark, f"{d}/events.parque[t]", shared_folder(spark, label), build, **options))


@register("stream_limiter", _LIMITED)
def stream_limiter(spark, d):
    return _to_end(spark, d, "limiter", lambda events: ordered.limiter(events.filter("event_type = 'error' or event_id is null").select("event_id", "user_id", "ts"), ip="user_id", ts="ts", order="event_id", window=600_000))


@register("stream_upsert", f"WITH {_PINGS} SELECT * FROM w")
def stream_upsert(spark, d):
    pings = _events(spark, d).select((F.col("user_id") % 40).alias("ip"), F.col("event_type").alias("host"), "ts", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("os"), F.col("event_id") % 5)).alias("platform"))
    return _local(logs.upsert_workers(pings, shared_folder(spark, "upsert"), keys=["ip", "host"], ts="ts", platform="platform", parts=8).read().drop("platform_at"))


@register("stream_ring", "SELECT event_id, ts FROM events WHERE event_id >= (SELECT max(event_id) FROM events) - 5000")
def stream_ring(spark, d):
    return _local(logs.keep_ring(_events(spark, d).select("event_id", "ts"), shared_folder(spark, "ring"), id="event_id").read())


@register("stream_throttle", _THROTTLED)
def stream_throttle(spark, d):
    sure = F.col("event_type").isin("signup", "purchase")
    return _to_end(spark, d, "throttle", lambda events: ordered.throttled(events.select("user_id", "event_id", "ts", "event_type"), by="user_id", ts="ts", order="event_id", always=sure, gap=86_400.0))


#: Jobs in order of their events: a job that falls silent for 600 s while it runs is lost, and begins anew.
_LOST = """WITH RECURSIVE j AS (SELECT event_id // 6 AS job, ts, row_number() OVER (PARTITION BY event_id // 6 ORDER BY ts, event_id) AS n, lead(ts) OVER (PARTITION BY event_id // 6 ORDER BY ts, event_id) AS after,
 CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'claim' WHEN 'click' THEN 'heartbeat' WHEN 'error' THEN 'cancel' ELSE CASE WHEN event_id % 2 = 0 THEN 'finish' ELSE 'fail' END END AS kind FROM events),
e AS (SELECT *, coalesce(after > ts + INTERVAL 600 SECONDS, {last}) AS silent FROM j),
r AS (SELECT job, ts, n, silent, CASE WHEN kind = 'claim' THEN n ELSE 0 END AS cl, CASE WHEN kind = 'cancel' THEN n ELSE 0 END AS ca, CASE WHEN kind IN ('finish', 'fail') THEN n ELSE 0 END AS en FROM e WHERE n = 1
 UNION ALL SELECT job, ts, n, silent, CASE WHEN kind = 'claim' THEN n WHEN gone THEN 0 ELSE cl END, CASE WHEN kind = 'cancel' THEN n WHEN gone THEN 0 ELSE ca END, CASE WHEN kind IN ('finish', 'fail') THEN n WHEN gone THEN 0 ELSE en END
 FROM (SELECT e.job, e.ts, e.n, e.silent, e.kind, r.cl, r.ca, r.en, r.silent AND (r.cl > 0 OR r.ca > 0) AS gone FROM r JOIN e ON e.job = r.job AND e.n = r.n + 1))
SELECT job, ts AS last_seen, ts + INTERVAL 600 SECONDS AS lost_at FROM r WHERE silent AND cl > 0 AND en = 0 AND (ca = 0 OR cl < ca)"""


def _jobs_of(events):
    return events.select("ts", "event_id", F.floor(F.col("event_id") / 6).alias("job"), job_kind().alias("kind"))


@register("stream_reaper", _LOST.format(last="true"))
def stream_reaper(spark, d):
    return _to_end(spark, d, "reaper", lambda events: ordered.lost_jobs(_jobs_of(events), job="job", ts="ts", order="event_id", kind="kind"))


@register("lost_jobs", _LOST.format(last="ts + INTERVAL 600 SECONDS < (SELECT max(ts) FROM events)"))
def lost_jobs(spark, d):
    events = table(spark, d, "events")
    latest = events.agg(F.max("ts").alias("as_of"))
    return _local(batch.lost_jobs(_jobs_of(events).crossJoin(F.broadcast(latest)), job="job", ts="ts", order="event_id", kind="kind", as_of=F.col("as_of")))


@register("stream_sessions", "SELECT user_id, event_id, ts AS opened, ts + CASE WHEN event_type = 'view' THEN INTERVAL 600 SECONDS ELSE INTERVAL 28800 SECONDS END AS expires FROM events WHERE ts + CASE WHEN event_type = 'view' THEN INTERVAL 600 SECONDS ELSE INTERVAL 28800 SECONDS END < (SELECT max(ts) FROM events)")
def stream_sessions(spark, d):
    """Sessions that have expired by the last event: those that `valid_sessions` rejects."""
    life = F.when(F.col("event_type") == "view", 600).otherwise(28_800)
    late = table(spark, d, "events").agg(F.max("ts") + F.expr(f"interval {ordered.LATE}")).first()[0]
    return _to_end(spark, d, "sessions", lambda events: ordered.expired_sessions(events, by="user_id", id="event_id", ts="ts", lifetime=life), end=str(late))


@register("stream_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    return _local(logs.drain(logs.windowed_counts(_events(spark, d), ts="ts", by="event_type", late=None), shared_folder(spark, "windows"), mode="complete"))


@register(
    "stream_lost_jobs",
    """WITH b AS (SELECT event_id // 6 AS job, ts FROM events), s AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 600 SECONDS THEN 0 ELSE 1 END AS opens FROM b WINDOW w AS (PARTITION BY job ORDER BY ts)),
n AS (SELECT *, sum(opens) OVER (PARTITION BY job ORDER BY ts) AS session FROM s) SELECT job, count(*) AS beats, max(ts) AS last_beat, max(ts) + INTERVAL 600 SECONDS AS lost_at FROM n GROUP BY job, session""",
)
def stream_lost_jobs(spark, d):
    beats = _events(spark, d).select("ts", F.floor(F.col("event_id") / 6).alias("job"))
    return _local(logs.drain(logs.silent_spans(beats, ts="ts", by="job", late=None), shared_folder(spark, "lost"), mode="complete"))
