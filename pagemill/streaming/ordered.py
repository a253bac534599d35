"""Streams judged in the order of their events, with timers.

A rule that depends on what it decided before needs the rows of a key in order of time, but a
stream brings them late and mixed. Rows wait in list state until the watermark has passed them and
are then judged in order; an event-time timer says when to look again, be it for the next
row or for something that falls due without one. Keys are dealt by hash to a fixed number of shards,
which wait, wake and are judged as one: a shard's few calls to the state store serve all its keys,
and a key has calls of its own only for the state that its rule keeps. That goes when the rule keeps
nothing. A task holds the waiting rows of one shard. Rows later than the watermark are dropped.

The rules are those of the batch forms (`operators.logs`), so a stream gives what the batch gives
over all rows up to the watermark. `drain_to_end` closes a stream of finite input: after it has run
over what is there, it runs once more over a marker row that moves the watermark on.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

from pagemill.operators.logs import FAIL_MAX, FAIL_WINDOW, LOST_AFTER, Lost, limit_rule, throttle_rule
from pagemill.schemas import EVENTS
from pagemill.streaming.logs import LATE, drain, event_stream

#: Rows handed to list state at once; shards of keys.
CHUNK, SHARDS = 5000, 2048
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: State that holds lists and timers is kept by this provider.
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Flags:
    """A rule that tells a flag of each row: decide(state, *values) gives flag and next state."""

    def __init__(self, decide: Callable):
        self.decide = decide

    def step(self, state, at: int, values: tuple):
        flag, state = self.decide(state, *values)
        return [(flag,)], state

    def due(self, state) -> int | None:
        return None

    def expire(self, state):
        return [], state


class _InOrder(StatefulProcessor):
    """Rows are (key, at, order..., values..., row...), keys as text; a rule's answer to a row is given with
    the row, what falls due without one is given with the key alone."""

    def __init__(self, rule, schema: StructType, n_order: int, n_values: int, out: list[str], with_row: bool):
        self.rule, self.schema, self.n_order, self.n_values, self.out, self.with_row = rule, schema, n_order, n_values, out, with_row

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.schema)
        self.kept = handle.getMapState("kept", "key string", "json string")
        self.state = handle.getValueState("state", "json string")  # [due, key] of each key for which something falls due
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, at: int | None, always: bool = False) -> None:
        """One timer a shard, in milliseconds: at the earliest of what it waits for."""
        old = self.timer.get()[0] if self.timer.exists() else None
        if at is None or (not always and old is not None and old <= at):
            return
        if old is not None and not always:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues):
        held, first, places = [], None, None
        for row in rows:
            places = places or [row.__fields__.index(name) for name in self.schema.names]
            held.append(tuple([row[i] for i in places]))
            first = held[-1][1] if first is None else min(first, held[-1][1])
            if len(held) == CHUNK:
                self.rows.appendList(held)
                held = []
        if held:
            self.rows.appendList(held)
        if first is not None:
            self._wake(-(-first // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        waiting = [tuple(row) for row in self.rows.get()] if self.rows.exists() else []
        ready = sorted((row for row in waiting if row[1] <= mark), key=lambda row: row[: 2 + self.n_order])
        rest = [row for row in waiting if row[1] > mark]
        dues = json.loads(self.state.get()[0]) if self.state.exists() else []
        any_kept = self.kept.exists()
        kept: dict = {}
        told: list[tuple] = []

        def state_of(name: str):
            found = self.kept.getValue((name,)) if any_kept and self.kept.containsKey((name,)) else None
            return json.loads(found[0]) if found else None

        def expire(name: str, until: int) -> None:
            while (due := self.rule.due(kept[name][1])) is not None and due < until:
                answers, kept[name][1] = self.rule.expire(kept[name][1])
                told.extend((name, *answer) for answer in answers)

        values = slice(2 + self.n_order, 2 + self.n_order + self.n_values)
        for row in ready:
            name = row[0]
            if name not in kept:
                state = state_of(name)
                kept[name] = [state is not None, state]
            expire(name, row[1])
            answers, kept[name][1] = self.rule.step(kept[name][1], row[1], row[values])
            told.extend((*row[values.stop :], *answer) if self.with_row else (name, *answer) for answer in answers)
        for due, name in dues:
            if due < mark and name not in kept:
                kept[name] = [True, state_of(name)]
        for name in kept:
            expire(name, mark)
        left = [[due, name] for due, name in dues if name not in kept]
        for name, (was, state) in kept.items():
            if state is not None:
                self.kept.updateValue((name,), (json.dumps(state),))
                if (due := self.rule.due(state)) is not None:
                    left.append([due, name])
            elif was:
                self.kept.removeKey((name,))
        if rest:
            self.rows.put(rest)
        elif waiting:
            self.rows.clear()
        if left:
            self.state.update((json.dumps(left),))
        elif dues:
            self.state.clear()
        times = [-(-min(row[1] for row in rest) // 1000)] if rest else []
        times += [min(due for due, _ in left) // 1000 + 1] if left else []
        self._wake(min(times, default=None), always=True)
        answer_of = Row(*self.out)
        for answer in told:
            yield answer_of(*answer)


def in_event_order(stream: DataFrame, *, by: list[str], ts: str, order: list[str], values: list[Column], rule, answer: str, with_row: bool = True, late: str = LATE) -> DataFrame:
    """What rule answers to the rows of each key in order of (ts, order). The answer's columns, as DDL,
    follow those of the row, or those of the key (with_row=False)."""
    plain = [F.unix_micros(c).alias(c) if t == "timestamp" else F.col(c) for c, t in stream.dtypes]
    given = [f"_order{i}" for i in range(len(order))], [f"_value{i}" for i in range(len(values))], [f"_row{i}" for i in range(len(stream.columns) if with_row else 0)]
    marked = stream.withWatermark(ts, late)
    rows = marked.select(ts, *(F.col(c).alias(f"_key{i}") for i, c in enumerate(by)), F.unix_micros(ts).alias("_at"), *(F.col(c).alias(n) for c, n in zip(order, given[0], strict=True)), *(v.alias(n) for v, n in zip(values, given[1], strict=True)), *(c.alias(n) for c, n in zip(plain, given[2], strict=False)))
    # A marker moves the watermark and is no row: its key is null. The condition names ts so that it stays above the watermark.
    rows = rows.filter(F.col("_key0").isNotNull() | F.col(ts).isNull())
    keys = StructType([StructField(c, rows.schema[f"_key{i}"].dataType) for i, c in enumerate(by)])
    named = F.to_json(F.struct(*(F.col(f"_key{i}").alias(c) for i, c in enumerate(by))))
    rows = rows.select(ts, F.pmod(F.xxhash64(*(f"_key{i}" for i in range(len(by)))), F.lit(SHARDS)).alias("_key0"), named.alias("_name"), "_at", *given[0], *given[1], *given[2])
    schema = StructType([rows.schema[n] for n in ("_name", "_at", *given[0], *given[1], *given[2])])
    told = StructType.fromDDL(answer)
    if with_row:
        wanted = StructType([*schema.fields[2 + len(order) + len(values) :], *told])
    else:
        wanted = StructType([rows.schema["_name"], *told])
    names = [f"c{i}" for i in range(len(wanted))]
    wanted = StructType([StructField(name, field.dataType) for name, field in zip(names, wanted, strict=True)])
    processor = _InOrder(rule, schema, len(order), len(values), names, with_row)
    out = rows.groupBy("_key0").transformWithState(processor, wanted, "append", "EventTime")
    if not with_row:
        out = out.withColumn("_keys", F.from_json("c0", keys))
        return out.select(*(F.col("_keys")[c].alias(c) for c in by), *(F.col(n).alias(c) for n, c in zip(names[1:], told.names, strict=True)))
    final, kinds = list(stream.columns) + told.names, dict(stream.dtypes)
    return out.select(*((F.timestamp_micros(n) if kinds.get(c) == "timestamp" and i < len(stream.columns) else F.col(n)).alias(c) for i, (n, c) in enumerate(zip(names, final, strict=True))))


def limiter(tries: DataFrame, *, ip: str, ts: str, order: str, window: int = FAIL_WINDOW, limit: int = FAIL_MAX, late: str = LATE) -> DataFrame:
    """Tries with `blocked`, judged in order of time; state holds at most `limit` counted failures of an
    address and the tries that the watermark has not passed."""
    return in_event_order(tries, by=[ip], ts=ts, order=[order], values=[F.unix_micros(ts)], rule=Flags(limit_rule(window, limit)), answer="blocked boolean", late=late)


def throttled(lines: DataFrame, *, by: str, ts: str, order: str, always: Column, gap: float = 0.6, late: str = LATE) -> DataFrame:
    """Lines that are sent; state is the time of the last one sent."""
    flagged = in_event_order(lines, by=[by], ts=ts, order=[order], values=[F.unix_micros(ts), always], rule=Flags(throttle_rule(gap)), answer="_send boolean", late=late)
    return flagged.filter("_send").drop("_send")


def lost_jobs(events: DataFrame, *, job: str, ts: str, order: str, kind: str, after: int = LOST_AFTER, late: str = LATE) -> DataFrame:
    """(job, last_seen, lost_at) of each job that is running or being cancelled when nothing has come from it for
    `after` seconds: once, by a timer. State of a job goes then, and when an ended one has fallen silent."""
    rule = Lost(after)
    out = in_event_order(events, by=[job], ts=ts, order=[order], values=[F.col(kind)], rule=rule, answer="seen long, due long", with_row=False, late=late)
    return out.select(job, F.timestamp_micros("seen").alias("last_seen"), F.timestamp_micros("due").alias("lost_at"))


class Sessions:
    """Live sessions of a key, as a heap of [expires, opened, id]; what expires is told once and forgotten."""

    def step(self, state, at: int, values: tuple):
        name, seconds = values
        state = state or []
        heapq.heappush(state, [at + int(seconds * 1_000_000), at, name])
        return [], state

    def due(self, state) -> int | None:
        return state[0][0] if state else None

    def expire(self, state):
        gone = heapq.heappop(state)
        return [(gone[2], gone[1], gone[0])], state or None


def expired_sessions(opened: DataFrame, *, by: str, id: str, ts: str, lifetime: Column, late: str = LATE) -> DataFrame:
    """(by, id, opened, expires) of each session when its lifetime has passed; state holds live ones only."""
    kind = dict(opened.dtypes)[id]
    out = in_event_order(opened, by=[by], ts=ts, order=[id], values=[F.col(id), lifetime.cast("double")], rule=Sessions(), answer=f"id {kind}, opened long, expires long", with_row=False, late=late)
    return out.select(by, F.col("id").alias(id), F.timestamp_micros("opened").alias("opened"), F.timestamp_micros("expires").alias("expires"))


def drain_to_end(spark: SparkSession, pattern: str, folder: str, build: Callable[[DataFrame], DataFrame], *, end: str = "9000-01-01 00:00:00", files: int = 100) -> DataFrame:
    """All that build makes of the events below pattern, and of their end: a first run takes what is
    there, a second one goes on from its checkpoint with a marker of time `end`, which moves the
    watermark to `end` less the lateness."""
    markers = f"{folder}/markers"
    path = spark._jvm.org.apache.hadoop.fs.Path(markers)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    before = spark.conf.get(_PROVIDER, None)

    def run() -> DataFrame:
        spark.conf.set(_PROVIDER, _ROCKS)
        try:
            return drain(build(event_stream(spark, pattern, files=files).union(event_stream(spark, f"{markers}/*"))), folder)
        finally:
            spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)

    run()
    marker = spark.range(1).select(F.lit(end).cast("timestamp_ntz").alias("ts"))
    empty = StructType.fromDDL(EVENTS)
    marker.select(*(F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in empty)).write.mode("overwrite").parquet(f"{markers}/end")
    return run()
