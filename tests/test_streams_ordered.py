"""Ordered streams over files that come out of the order of time, against the batch forms."""

import pytest
from pyspark.sql import functions as F

from pagemill.operators import logs as batch
from pagemill.plans.q_streaming import _jobs_of, _local
from pagemill.streaming import logs, ordered

LATE = "6 days"


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    """Events in twelve files of some days each, later ones before earlier ones."""
    folder = tmp_path_factory.mktemp("mixed")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for n in (1, 0, 3, 2, 5, 4, 7, 6, 9, 8, 11, 10):
        part = events.filter(F.floor((F.dayofmonth("ts") - 1) / 2.6) == n).orderBy(F.xxhash64("event_id"))
        part.coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    return f"{folder}/events.parque[t]", events.withColumn("ts", F.col("ts").cast("timestamp"))


def both(stream, want):
    assert sorted(map(tuple, stream.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_limiter_in_order_of_time(spark, mixed, tmp_path):
    pattern, events = mixed
    build = lambda rows: ordered.limiter(rows.filter("event_type = 'error' or event_id is null").select("event_id", "user_id", "ts"), ip="user_id", ts="ts", order="event_id", window=900_000, limit=3, late=LATE)
    want = batch.rate_limited(events.filter("event_type = 'error'").select("event_id", "user_id", "ts"), ip="user_id", ts="ts", order="event_id", window=900_000, limit=3)
    got = ordered.drain_to_end(spark, pattern, str(tmp_path / "s"), build, files=1)
    both(got, want)
    assert got.select("blocked").distinct().count() == 2


def test_throttle_in_order_of_time(spark, mixed, tmp_path):
    pattern, events = mixed
    sure = F.col("event_type") == "signup"
    options = {"by": "user_id", "ts": "ts", "order": "event_id", "always": sure, "gap": 200_000.0}
    got = ordered.drain_to_end(spark, pattern, str(tmp_path / "s"), lambda rows: ordered.throttled(rows.select("user_id", "event_id", "ts", "event_type"), late=LATE, **options), files=2)
    want = batch.throttled(events.select("user_id", "event_id", "ts", "event_type"), **options)
    both(got, want)
    assert 0 < want.count() < events.count()


def test_lost_jobs_once_and_state_goes(spark, mixed, tmp_path):
    pattern, events = mixed
    options = {"job": "job", "ts": "ts", "order": "event_id", "kind": "kind", "after": 3000}
    for end, name in (("2024-01-15 06:00:00", "half"), ("9000-01-01 00:00:00", "all")):
        got = ordered.drain_to_end(spark, pattern, str(tmp_path / name), lambda rows: ordered.lost_jobs(_jobs_of(rows), late="40 days", **options), files=3, end=end if name == "all" else "2024-02-24 06:00:00")
        want = batch.lost_jobs(_jobs_of(events).withColumn("as_of", F.lit(end).cast("timestamp")), as_of=F.col("as_of"), **options)
        both(got, want)
        assert want.count() > 20
    left = {v: spark.read.format("statestore").option("stateVarName", v).load(f"{tmp_path}/all/state") for v in ("rows", "state", "timer")}
    assert left["rows"].count() == 0
    waiting = left["state"].select("key._key0", F.get_json_object("value.json", "$[0]").alias("claimed"), F.get_json_object("value.json", "$[1]").alias("cancelled"))
    assert waiting.filter("claimed > 0 or cancelled > 0").count() == 0  # only jobs that nobody has claimed wait on


def test_lost_jobs_like_the_reaper_for_jobs_without_gaps(spark):
    rows = [(1, 0, "claim"), (1, 500, "heartbeat"), (2, 0, "create"), (3, 0, "claim"), (3, 10, "finish"), (4, 0, "claim"), (4, 5, "cancel"), (5, 0, "cancel"), (6, 900, "claim"), (None, 0, "claim")]
    events = spark.createDataFrame([(i, job, kind, f"2024-01-01 00:{s // 60:02}:{s % 60:02}") for i, (job, s, kind) in enumerate(rows)], "event_id long, job long, kind string, at string").withColumn("ts", F.to_timestamp("at"))
    as_of = F.to_timestamp(F.lit("2024-01-01 00:19:00"))
    found = batch.lost_jobs(events, job="job", ts="ts", order="event_id", kind="kind", as_of=as_of)
    reaped = batch.reap_lost(batch.latest_jobs(events, job="job", ts=["ts", "event_id"], kind="kind").withColumn("error", F.lit("")), status="status", heartbeat="last_seen", error="error", as_of=as_of)
    assert sorted((r.job or 0) for r in found.collect()) == sorted((r.job or 0) for r in reaped.collect()) == [0, 1, 4]
    assert batch.lost_jobs(events.limit(0), job="job", ts="ts", order="event_id", kind="kind", as_of=as_of).count() == 0


def test_sessions_valid_at_several_times(spark, mixed, tmp_path):
    pattern, events = mixed
    life = F.when(F.col("event_type") == "view", 600).otherwise(200_000)
    for n, day in enumerate(("2024-01-03", "2024-01-12", "2024-01-25")):
        marker = f"2024-02-{int(day[-2:]) + 9:02} 12:00:00" if int(day[-2:]) + 9 < 30 else "2024-03-05 12:00:00"
        got = ordered.drain_to_end(spark, pattern, str(tmp_path / str(n)), lambda rows: ordered.expired_sessions(rows, by="user_id", id="event_id", ts="ts", lifetime=life, late="40 days"), end=marker)
        as_of = F.lit(f"{day} 12:00:00").cast("timestamp")
        gone = batch.expired(events.filter(F.col("ts") <= as_of), ts="ts", lifetime=life, as_of=as_of).filter("not valid")
        both(got.select("event_id", "expires"), gone.select("event_id", "expires"))
        assert gone.count() > 0


def test_rows_later_than_the_watermark_go(spark, tmp_path):
    """The watermark of the batch before counts, up to which rows have been judged."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    for n, day in enumerate((20, 21, 1, 22)):
        spark.createDataFrame([(n, None, 7, "error", 0.0, "")], schema).withColumn("ts", F.expr(f"timestamp_ntz '2024-01-{day:02} 00:00:00'")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e.parquet")
    build = lambda rows: ordered.limiter(rows.select("event_id", "user_id", "ts"), ip="user_id", ts="ts", order="event_id")
    got = _local(ordered.drain_to_end(spark, f"{tmp_path}/e.parque[t]", str(tmp_path / "s"), build, files=1))
    assert sorted(r.event_id for r in got.collect()) == [0, 1, 3]
    assert logs.LATE == "10 minutes"


def test_keys_share_the_waiting_rows_and_timers_of_shards(spark, tmp_path, monkeypatch):
    """Far more keys than shards: the store holds no entry a key but what the rule keeps."""
    monkeypatch.setattr(ordered, "SHARDS", 4)
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    rows = spark.range(600).select(F.col("id").alias("event_id"), F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id)").alias("ts"), (F.col("id") % 300).alias("user_id"), F.lit("error").alias("event_type"), F.lit(0.0).alias("value"), F.lit("").alias("props"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/e.parquet")
    build = lambda events: ordered.expired_sessions(events.filter("event_id is not null or user_id is null"), by="user_id", id="event_id", ts="ts", lifetime=F.lit(400))
    got = ordered.drain_to_end(spark, f"{tmp_path}/e.parque[t]", str(tmp_path / "s"), build, end="2024-01-01 00:16:40")  # watermark at 00:06:40
    assert sorted((r.user_id, r.event_id) for r in got.collect()) == []
    state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(f"{tmp_path}/s/state")
    assert 0 < state("timer").count() <= 4 and 0 < state("state").count() <= 4


def test_sessions_of_one_key_expire_in_order():
    rule, state, told = ordered.Sessions(), None, []
    for n, (at, life) in enumerate(((0, 50), (1, 10), (2, 30), (3, 10))):
        _, state = rule.step(state, at, (n, life / 1_000_000))
    while rule.due(state) is not None:
        answers, state = rule.expire(state)
        told += answers
    assert told == [(1, 1, 11), (3, 3, 13), (2, 2, 32), (0, 0, 50)] and state is None
