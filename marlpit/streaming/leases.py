"""Leases of jobs and presence of workers as keyed state: transformWithStateInPandas with value states, timers and TTL.

A job's commands, in order of (at, seq), are enqueue, claim, renew, finish, fail and retry. Every one is answered by a row:
whether it was accepted, and the job after it. Time is the commands' own, so the answers don't depend on how rows fall into
batches: a lease that a later command finds run out is closed first, and a timer on the watermark closes the others. Either
way a row says so, with the command 'expire', no seq, and the time at which the lease ended.

A claim takes a queued job and one attempt; only the owner renews, finishes or fails it, and only before the lease runs
out. Failing, or a lease running out, puts the job back into the queue, or ends it when no attempt is left. Jobs that ended
stay ended: their last state is kept for `keep`, in which a repeated enqueue or a claim is refused; retry gives a failed
one RETRY_ATTEMPTS more. A job that nobody enqueued can't be claimed. The time of the first start is kept over attempts.

In order within a batch of a stream; rows of an earlier time that come in a later batch are taken as they come. A table
that isn't a stream is sorted before it is dealt, so that a job of any number of commands streams through."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Attempts that a retry by hand adds.
RETRY_ATTEMPTS = 3
ENDED = ("succeeded", "failed")
STATE = "status string, attempts int, allowed int, owner string, until long, started long, ended long"
ANSWER = "job_id long, seq long, command string, at timestamp, accepted boolean, status string, attempts int, owner string, first_started timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Job:
    """A job's state. Times are milliseconds; `until` is the lease's end, `allowed` how many attempts it may take."""

    status: str
    attempts: int
    allowed: int
    owner: str = ""
    until: int = 0
    started: int = 0
    ended: int = 0

    def closed(self, now: int) -> Job:
        """Without its lease: queued again, or failed if this was its last attempt."""
        if self.attempts >= self.allowed:
            return replace(self, status="failed", owner="", until=0, ended=now)
        return replace(self, status="queued", owner="", until=0)

    def at(self, now: int) -> Job:
        return self.closed(self.until) if self.status == "running" and now >= self.until else self


def answer(job: Job | None, command: str, owner: str, now: int, max_attempts: int, lease_ms: int) -> tuple[bool, Job | None]:
    """Whether the command is accepted, and the job after it. The lease must have been looked at already."""
    if command == "enqueue" and job is None:
        return True, Job("queued", 0, max_attempts)
    if job is None:
        return False, None
    if command == "claim" and job.status == "queued" and owner:
        return True, replace(job, status="running", attempts=job.attempts + 1, owner=owner, until=now + lease_ms, started=job.started or now)
    if command == "retry" and job.status == "failed":
        return True, replace(job, status="queued", allowed=job.attempts + RETRY_ATTEMPTS, ended=0)
    if job.status != "running" or owner != job.owner:
        return False, job
    if command == "renew":
        return True, replace(job, until=now + lease_ms)
    if command == "finish":
        return True, replace(job, status="succeeded", owner="", until=0, ended=now)
    if command == "fail":
        return True, job.closed(now)
    return False, job


def _ms(at: pd.Timestamp) -> int:
    return int(at.value // 1_000_000)


def _frame(rows: list[tuple], columns: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in columns.split(", ")])
    for c in columns.split(", "):
        name, kind = c.split()
        if kind == "timestamp":
            out[name] = pd.to_datetime(out[name], unit="ms")
        elif kind in ("long", "int"):
            out[name] = out[name].astype("Int64" if kind == "long" else "Int32")
    return out


class _Leases(StatefulProcessor):
    """of_stream: rows come in any order, and timers close leases. A table's rows are in order, and nothing comes after them."""

    def __init__(self, max_attempts: int, lease_ms: int, keep_ms: int, of_stream: bool) -> None:
        self.max_attempts, self.lease_ms, self.keep_ms, self.of_stream = max_attempts, lease_ms, keep_ms, of_stream

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)

    def _save(self, before: Job | None, job: Job | None) -> None:
        """The state, with the timer that goes with it: the lease's end, or when an ended job is forgotten."""
        due = lambda j: 0 if j is None else j.until if j.status == "running" else j.ended + self.keep_ms if j.status in ENDED else 0
        if self.of_stream and due(before) != due(job):
            if due(before):
                self.handle.deleteTimer(due(before))
            if due(job):
                self.handle.registerTimer(due(job))
        if job is not None:
            self.job.update((job.status, job.attempts, job.allowed, job.owner, job.until, job.started, job.ended))

    def _load(self) -> Job | None:
        return Job(*self.job.get()) if self.job.exists() else None

    def _expired(self, key, job: Job) -> tuple:
        after = job.at(job.until)
        return key[0], None, "expire", job.until, True, after.status, after.attempts, after.owner, after.started or None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = job = self._load()
        frames = [pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")] if self.of_stream else rows
        for frame in frames:
            out = []
            for seq, command, owner, at in zip(frame["seq"], frame["command"], frame["owner"], frame["at"]):
                now = _ms(at)
                if job and job.at(now) != job:
                    out.append(self._expired(key, job))
                    job = job.at(now)
                accepted, job = answer(job, command, owner if isinstance(owner, str) else "", now, self.max_attempts, self.lease_ms)
                out.append((key[0], seq, command, now, accepted, *((job.status, job.attempts, job.owner, job.started or None) if job else (None, None, None, None))))
            if out:
                yield _frame(out, ANSWER)
        self._save(before, job)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        job, now = self._load(), expiredTimerInfo.getExpiryTimeInMs()
        if job is None:
            return
        if job.status == "running" and job.until <= now:
            self._save(replace(job, until=0, status="queued"), job.at(now))  # this timer is gone already
            yield _frame([self._expired(key, job)], ANSWER)
        elif job.status in ENDED and job.ended + self.keep_ms <= now:
            self.job.clear()

    def close(self) -> None:
        pass


def use_rocks(spark: SparkSession) -> None:
    """The state store that these operators need, and its coordinator, which a session has only once its streams were asked for."""
    _ = spark.streams
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def lease_answers(commands: DataFrame, max_attempts: int = 3, lease_ms: int = 120_000, keep_ms: int = 7 * 86_400_000, late: str = "1 minute") -> DataFrame:
    """commands (job_id, seq, command, owner, at): a row for each with accepted and the job's state after it, and one for
    each lease that ran out. Of a table, leases that no later command meets stay open. Commands without a job or a time have no answer."""
    use_rocks(commands.sparkSession)
    stream = commands.isStreaming
    known = commands.where("job_id is not null and at is not null").select("job_id", "seq", "command", "owner", "at")
    known = known.withWatermark("at", late) if stream else known.repartition("job_id").sortWithinPartitions("job_id", "at", "seq")
    processor = _Leases(max_attempts, lease_ms, keep_ms, of_stream=stream)
    return known.groupBy("job_id").transformWithStateInPandas(processor, ANSWER, "Append" if stream else "Update", "EventTime" if stream else "None")


WORKER = "worker string, change string, at timestamp, info string"


class _Presence(StatefulProcessor):
    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Twice the time, so that the timer finds the worker that it is about.
        self.seen = handle.getValueState("seen", "until long, info string", ttlDurationMs=2 * self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        last = None
        for frame in rows:
            newest = frame.sort_values("at", kind="stable").iloc[-1]
            if last is None or newest["at"] >= last["at"]:
                last = newest
        known = self.seen.exists()
        if known:
            self.handle.deleteTimer(self.seen.get()[0])
        info = last["info"] if isinstance(last["info"], str) else ""
        self.seen.update((now + self.ttl_ms, info))
        self.handle.registerTimer(now + self.ttl_ms)
        if not known:
            yield _frame([(key[0], "came", now, info)], WORKER)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.seen.exists() and self.seen.get()[0] <= expiredTimerInfo.getExpiryTimeInMs():
            info = self.seen.get()[1]
            self.seen.clear()
            yield _frame([(key[0], "gone", expiredTimerInfo.getExpiryTimeInMs(), info)], WORKER)

    def close(self) -> None:
        pass


def worker_presence(beats: DataFrame, ttl_ms: int = 90_000) -> DataFrame:
    """A stream of beats (worker, at, info): a row when a worker comes, and one when no beat of it has come for ttl_ms of the
    cluster's clock. State of workers that are gone has gone too."""
    use_rocks(beats.sparkSession)
    known = beats.where("worker is not null").select("worker", "at", "info")
    return known.groupBy("worker").transformWithStateInPandas(_Presence(ttl_ms), WORKER, "Update", "ProcessingTime")
