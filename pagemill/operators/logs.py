"""Jobs, workers and access logs in batch form. As-of times are parameters, never the clock."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.operators.folds import flag_in_order, walk_in_order

#: Fixed values, in seconds or counts: heartbeat of a lost job, of a live worker; failures in a window that block.
LOST_AFTER, ALIVE_WITHIN, FAIL_MAX, FAIL_WINDOW = 600, 30, 8, 300


def worker_rollup(pings: DataFrame, *, keys: list[str], ts: str, platform: str) -> DataFrame:
    """Per worker: first and last ping, their number, and the last platform that is not null."""
    return pings.groupBy(*keys).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count("*").alias("ping_count"), F.max_by(platform, F.when(F.col(platform).isNotNull(), F.col(ts))).alias("platform"))


def worker_marks(pings: DataFrame, *, keys: list[str], ts: str, platform: str) -> DataFrame:
    """The roll-up with the time of the platform, which is what it takes to merge two of them."""
    known = F.when(F.col(platform).isNotNull(), F.col(ts))
    return pings.groupBy(*keys).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count("*").alias("ping_count"), F.max_by(platform, known).alias("platform"), F.max(known).alias("platform_at"))


def merge_marks(old: DataFrame, new: DataFrame, *, keys: list[str]) -> DataFrame:
    """Roll-up of the pings of both."""
    return old.unionByName(new).groupBy(*keys).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("ping_count").alias("ping_count"), F.max_by("platform", "platform_at").alias("platform"), F.max("platform_at").alias("platform_at"))


def alive_workers(rollup: DataFrame, *, as_of: Column, within: int = ALIVE_WITHIN) -> DataFrame:
    """Workers with their age in seconds and whether they are alive."""
    age = F.round((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp"))) / 1e6, 1)
    return rollup.withColumn("age", age).withColumn("alive", F.col("age") < within)


def login_status(events: DataFrame, *, user: str, status: str, order: str, ts: str, as_of: Column) -> DataFrame:
    """Per user: the status of the last event, and its age in seconds."""
    state = events.groupBy(user).agg(F.max_by(status, order).alias("status"), F.max(ts).alias("last_seen"), F.max(as_of).alias("_as_of"))
    return alive_workers(state, as_of=F.col("_as_of")).select(user, "status", "age")


def latest_jobs(events: DataFrame, *, job: str, ts: list, kind: str) -> DataFrame:
    """Latest state of each job from its events: create, claim, heartbeat, cancel, finish, fail.
    A cancelled pending job is over; a cancelled running one is cancelling until it ends."""
    at = F.struct(*ts)
    when = lambda *kinds: F.max(F.when(F.col(kind).isin(*kinds), at))
    folded = events.groupBy(job).agg(when("claim").alias("claimed"), when("cancel").alias("cancelled"), when("finish", "fail").alias("ended"), F.max_by(kind, F.when(F.col(kind).isin("finish", "fail"), at)).alias("how"), F.max(at).alias("seen"))
    state = (
        F.when(F.col("ended").isNotNull() & F.col("claimed").isNotNull(), F.when(F.col("cancelled") < F.col("ended"), "cancelled").when(F.col("how") == "finish", "done").otherwise("failed"))
        .when(F.col("cancelled").isNotNull() & F.col("claimed").isNotNull() & (F.col("claimed") < F.col("cancelled")), "cancelling")
        .when(F.col("cancelled").isNotNull(), "cancelled")
        .when(F.col("claimed").isNotNull(), "running")
        .otherwise("pending")
    )
    return folded.select(job, state.alias("status"), F.col("seen")[ts[0]].alias("last_seen"))


def reap_lost(jobs: DataFrame, *, status: str, heartbeat: str, error: str, as_of: Column, after: int = LOST_AFTER) -> DataFrame:
    """Running or cancelling jobs without a heartbeat since as_of - after: failed, keeping an error they have."""
    lost = F.col(status).isin("running", "cancelling") & (F.col(heartbeat).isNull() | (F.col(heartbeat) < as_of - F.make_interval(secs=F.lit(after))))
    return jobs.filter(lost).withColumn(status, F.lit("failed")).withColumn(error, F.coalesce(F.nullif(F.col(error), F.lit("")), F.lit("heartbeat lost")))


class Lost:
    """When a job is lost: its state, from its events in order, is [claimed, cancelled, ended, seen], of
    which the first three say at which of its events they came last (0: never), and the number of events."""

    def __init__(self, after: int = LOST_AFTER):
        self.after = after * 1_000_000

    def step(self, state, at: int, values: tuple):
        claimed, cancelled, ended, _, n = state or [0, 0, 0, 0, 0]
        kind = values[0]
        n += 1
        return [], [n if kind == "claim" else claimed, n if kind == "cancel" else cancelled, n if kind in ("finish", "fail") else ended, at, n]

    def due(self, state) -> int | None:
        """A job that nobody has claimed waits as long as it takes."""
        return state[3] + self.after if state and (state[0] or state[1]) else None

    def expire(self, state):
        claimed, cancelled, ended, seen, _ = state
        lost = claimed and not ended and (not cancelled or claimed < cancelled)
        return [(seen, seen + self.after)] if lost else [], None


def lost_jobs(events: DataFrame, *, job: str, ts: str, order: str, kind: str, as_of: Column, after: int = LOST_AFTER) -> DataFrame:
    """(job, last_seen, lost_at) of each time up to as_of at which a running or cancelling job had been silent
    for more than `after` seconds. It is failed then: later events of the job begin it anew."""
    rule = Lost(after)

    def walk(rows):
        name, state, now, begun = None, None, 0, False

        def silent(until: int) -> list[tuple]:
            nonlocal state
            due = rule.due(state)
            if due is None or due >= until:
                return []
            answers, state = rule.expire(state)
            return [(name, *answer) for answer in answers]

        for of, at, what, until in rows:
            if not begun or of != name:
                yield from silent(now)
                name, state, now, begun = of, None, until, True
            if at <= now:
                yield from silent(at)
                _, state = rule.step(state, at, (what,))
        yield from silent(now)

    rows = events.select(job, _micros(ts).alias("_at"), F.col(order).alias("_order"), kind, F.unix_micros(as_of.cast("timestamp")).alias("_until"))
    found = walk_in_order(rows, by=[job], order=["_at", "_order"], columns=[job, "_at", kind, "_until"], schema=f"{job} {dict(events.dtypes)[job]}, seen long, due long", walk=walk)
    return found.select(job, F.timestamp_micros("seen").alias("last_seen"), F.timestamp_micros("due").alias("lost_at"))


def failures_in_window(tries: DataFrame, *, ip: str, ts: str, window: int = FAIL_WINDOW, limit: int = FAIL_MAX) -> DataFrame:
    """Failures of an address in the trailing window before each of its tries, all tries counting."""
    before = W.partitionBy(ip).orderBy(_micros(ts)).rangeBetween(-window * 1_000_000 + 1, -1)
    return tries.withColumn("recent", F.count("*").over(before)).withColumn("blocked", F.col("recent") >= limit)


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def limit_rule(window: int = FAIL_WINDOW, limit: int = FAIL_MAX):
    """Is a try blocked? The state is the times of counted failures, `limit` at most."""

    def decide(kept, at):
        kept = [t for t in kept or () if at - t < window * 1_000_000]
        blocked = len(kept) >= limit
        return blocked, kept if blocked else [*kept, at]

    return decide


def throttle_rule(gap: float = 0.6):
    """Is a line sent? The state is the time of the last one sent."""

    def decide(last, at, sure):
        send = bool(sure) or last is None or at - last >= gap * 1_000_000
        return send, at if send else last

    return decide


def rate_limited(tries: DataFrame, *, ip: str, ts: str, order: str, window: int = FAIL_WINDOW, limit: int = FAIL_MAX) -> DataFrame:
    """Tries with `blocked`; a blocked try does not count as a failure for later ones, so the decision
    feeds back. The tries of an address stream by in order; at most `limit` times of it are held."""
    return flag_in_order(tries, by=[ip], order=[ts, order], values=[_micros(ts)], decide=limit_rule(window, limit), out="blocked")


def throttled(lines: DataFrame, *, by: str, ts: str, order: str, always: Column, gap: float = 0.6) -> DataFrame:
    """Lines that are always sent, and others at least gap seconds after the last line sent."""
    return flag_in_order(lines, by=[by], order=[ts, order], values=[_micros(ts), always], decide=throttle_rule(gap), out="_send").filter("_send").drop("_send")


def beats_of_running(beats: DataFrame, jobs: DataFrame, *, job: str, status: str = "status") -> DataFrame:
    """The heartbeats that count: those of jobs that are running."""
    return beats.join(jobs.filter(F.col(status) == "running").select(job).distinct(), job, "left_semi")


def expired(entries: DataFrame, *, ts: str, lifetime: Column, as_of: Column) -> DataFrame:
    """Entries with `expires` and whether they are still valid at as_of."""
    return entries.withColumn("expires", F.col(ts) + F.make_interval(secs=lifetime)).withColumn("valid", F.col("expires") >= as_of)


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of several tables."""
    parts: Iterator[DataFrame] = (df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items())
    out = next(parts)
    for part in parts:
        out = out.union(part)
    return out
