"""Streams over files that come one after another, restarted from their checkpoints."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marlpit.plans import operations
from marlpit.streaming import leases
from marlpit.streaming.queue import JobQueue

SF = "/root/testdata/sf0.001"
COMMANDS = "job_id long, seq long, command string, owner string, at timestamp"
ZERO = datetime(2024, 1, 1)


def second(s):
    return ZERO + timedelta(seconds=s)


def by_hand(rows, most, lease, keep=None):
    """The answers of one job's commands (seq, command, owner, second), in order of time."""
    out, job = [], None
    for seq, command, owner, now in sorted(rows, key=lambda r: (r[3], r[0])):
        if job and job["status"] == "running" and now >= job["until"]:
            over = job["attempts"] >= job["allowed"]
            job |= {"status": "failed" if over else "queued", "owner": ""}
        ok = False
        if command == "enqueue" and job is None:
            job, ok = {"status": "queued", "attempts": 0, "allowed": most, "owner": "", "until": 0, "first": None}, True
        elif job and command == "claim" and job["status"] == "queued" and owner:
            job |= {"status": "running", "attempts": job["attempts"] + 1, "owner": owner, "until": now + lease, "first": job["first"] or now}
            ok = True
        elif job and command == "retry" and job["status"] == "failed":
            job |= {"status": "queued", "allowed": job["attempts"] + 3}
            ok = True
        elif job and job["status"] == "running" and job["owner"] == owner and command in ("renew", "finish", "fail"):
            ok = True
            if command == "renew":
                job["until"] = now + lease
            elif command == "finish":
                job |= {"status": "succeeded", "owner": ""}
            else:
                job |= {"status": "failed" if job["attempts"] >= job["allowed"] else "queued", "owner": ""}
        out.append((seq, ok, *((job["status"], job["attempts"], job["owner"], job["first"] and second(job["first"])) if job else (None,) * 4)))
    return out


def answers(rows):
    return {(r.job_id, r.seq): (r.accepted, r.status, r.attempts, r.owner, r.first_started) for r in rows if r.command != "expire"}


def random_commands(n=400, jobs=6):
    rng = random.Random(5)
    kinds = ["enqueue", "claim", "claim", "renew", "finish", "fail", "fail", "retry", "nonsense"]
    return [(rng.randrange(jobs), i, rng.choice(kinds), rng.choice(["a", "a", "b", ""]), second(i * rng.choice([1, 1, 7]) + i * 13)) for i in range(n)]


def expected_of(rows, most, lease):
    out = {}
    for job in {r[0] for r in rows}:
        own = [(seq, c, o, int((at - ZERO).total_seconds())) for j, seq, c, o, at in rows if j == job]
        out |= {(job, seq): tuple(rest) for seq, *rest in by_hand(own, most, lease)}
    return out


def test_answers_to_a_table(spark):
    rows = random_commands()
    frame = spark.createDataFrame([*rows, (None, 1, "enqueue", "a", ZERO), (1, 9999, "enqueue", "a", None)], COMMANDS).repartition(5)
    assert answers(leases.lease_answers(frame, 2, 60_000).collect()) == expected_of(rows, 2, 60)
    assert leases.lease_answers(frame.where("seq < 0"), 2, 60_000).count() == 0


class Drops:
    """Files that a stream finds one by one."""

    def __init__(self, spark, root, schema):
        self.spark, self.root, self.schema, self.n = spark, root, schema, 0

    def put(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.root}/made{self.n}")
        os.makedirs(f"{self.root}/in", exist_ok=True)
        for f in os.listdir(f"{self.root}/made{self.n}"):
            if f.endswith(".parquet"):
                os.rename(f"{self.root}/made{self.n}/{f}", f"{self.root}/in/{self.n}.parquet")

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.root}/in")


def run(out, root, **kw):
    found = []
    q = out.writeStream.foreachBatch(lambda d, i: found.extend(d.collect())).option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return found


def test_leases_over_restarts(spark, tmp_path):
    drops = Drops(spark, str(tmp_path), COMMANDS)
    job = lambda j, *steps: [(j, seq, c, o, second(s)) for seq, c, o, s in steps]
    drops.put(job(1, (1, "enqueue", "", 0), (2, "claim", "a", 1)) + job(2, (1, "enqueue", "", 0), (2, "claim", "a", 1), (3, "finish", "a", 2)) + job(3, (1, "claim", "a", 0)))
    first = run(leases.lease_answers(drops.stream(), 2, 60_000, late="0 seconds"), tmp_path)
    # a restart: job 1 is a's still, job 2 stays ended, job 1's lease runs out
    drops.put(job(1, (3, "claim", "b", 30), (4, "renew", "b", 31)) + job(2, (4, "claim", "b", 40), (5, "enqueue", "", 41), (6, "retry", "", 42)))
    drops.put(job(9, (1, "enqueue", "", 200)))
    drops.put(job(9, (2, "enqueue", "", 201)))
    second_run = run(leases.lease_answers(drops.stream(), 2, 60_000, late="0 seconds"), tmp_path)
    # b takes it over; a's own words come too late; the last attempt ends it
    drops.put(job(1, (5, "claim", "b", 300), (6, "renew", "a", 301), (7, "finish", "a", 302)))
    drops.put(job(9, (3, "enqueue", "", 900)))
    drops.put(job(9, (4, "enqueue", "", 901)) + job(1, (8, "claim", "a", 901)))
    third = run(leases.lease_answers(drops.stream(), 2, 60_000, late="0 seconds"), tmp_path)
    said = answers(first + second_run + third)
    assert [said[1, s][:4] for s in range(1, 9)] == [
        (True, "queued", 0, ""), (True, "running", 1, "a"), (False, "running", 1, "a"), (False, "running", 1, "a"),
        (True, "running", 2, "b"), (False, "running", 2, "b"), (False, "running", 2, "b"), (False, "failed", 2, ""),
    ]
    assert said[1, 5][4] == second(1) and [said[2, s][:2] for s in (3, 4, 5, 6)] == [(True, "succeeded")] + [(False, "succeeded")] * 3 and said[3, 1][:2] == (False, None)
    expired = [(r.job_id, r.at, r.status, r.attempts) for r in first + second_run + third if r.command == "expire"]
    assert expired == [(1, second(61), "queued", 1), (1, second(360), "failed", 2)]


def test_ended_jobs_are_forgotten_after_a_while(spark, tmp_path):
    drops = Drops(spark, str(tmp_path), COMMANDS)
    for rows in ([(1, 1, "enqueue", "", ZERO), (1, 2, "claim", "a", second(1)), (1, 3, "finish", "a", second(2))], [(1, 4, "enqueue", "", second(50))], [(2, 1, "enqueue", "", second(500))], [(2, 2, "enqueue", "", second(501))], [(1, 5, "enqueue", "", second(600))]):
        drops.put(rows)
    said = answers(run(leases.lease_answers(drops.stream(), 2, 60_000, keep_ms=100_000, late="0 seconds"), tmp_path))
    assert said[1, 4][:2] == (False, "succeeded") and said[1, 5][:2] == (True, "queued")


def test_workers_come_and_go(spark, tmp_path):
    import time

    drops = Drops(spark, str(tmp_path), "worker string, at timestamp, info string")
    drops.put([("a", ZERO, "x"), ("a", second(1), "y"), ("b", ZERO, None), (None, ZERO, "z")])
    found = []
    q = leases.worker_presence(drops.stream(), ttl_ms=4_000).writeStream.foreachBatch(lambda d, i: found.extend(d.collect())).option("checkpointLocation", f"{tmp_path}/checkpoint").outputMode("update").trigger(processingTime="1 second").start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            if sum(r.change == "gone" for r in found) >= 2:
                break
    finally:
        q.stop()
    assert sorted((r.worker, r.change, r.info) for r in found) == [("a", "came", "y"), ("a", "gone", "y"), ("b", "came", ""), ("b", "gone", "")]


def test_queue_takes_each_notice_once(spark, tmp_path):
    drops = Drops(spark, str(tmp_path), "job_id long, at timestamp")
    queue = JobQueue(spark, f"file://{tmp_path}/queue")
    assert queue.waiting().count() == 0
    drops.put([(1, ZERO), (1, second(5)), (2, second(1)), (None, second(2)), (3, None)])
    queue.announce(drops.stream()).awaitTermination()
    drops.put([(1, second(20)), (4, second(21))])
    queue.announce(drops.stream()).awaitTermination()  # a restart goes on from the checkpoint
    assert sorted(r.job_id for r in queue.waiting().collect()) == [1, 2, 4]
    held = {(r.job_id, r.batch) for r in queue.announced().collect()}
    for batch in {b for _, b in held}:  # replayed batches change nothing
        rows = queue.announced().where(F.col("batch") == batch).select("job_id", "at").collect()
        queue.write_batch(spark.createDataFrame(rows, "job_id long, at timestamp"), batch)
    assert {(r.job_id, r.batch) for r in queue.announced().collect()} == held and queue.announced().count() == 3
    first = [r.job_id for r in queue.take("t1", 2).collect()]
    assert sorted(first) == [1, 2] and sorted(r.job_id for r in queue.take("t1", 2).collect()) == [1, 2]
    assert [r.job_id for r in queue.waiting().collect()] == [4] and [r.job_id for r in queue.take("t2", 9).collect()] == [4]
    assert queue.waiting().count() == 0 and queue.take("t3", 9).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_lease_query(spark):
    got = operations.lease_commands(spark, SF).where("command <> 'expire'").collect()
    events = {r.event_id: r.user_id for r in spark.read.parquet(f"{SF}/events.parquet").collect()}
    rows = [(events[r.seq], r.seq, r.command, f"w{r.seq % 3}", int((r.at - ZERO).total_seconds() * 1000)) for r in got]
    assert len(got) == len(events)
    by_job = {}
    for j, seq, c, o, ms in rows:
        by_job.setdefault(j, []).append((seq, c, o, ms))
    expected = {(j, seq): (ok, status, n, owner) for j, own in by_job.items() for seq, ok, status, n, owner, _ in by_hand(own, 3, 2 * 86_400_000)}
    assert {(r.job_id, r.seq): (r.accepted, r.status, r.attempts, r.owner) for r in got} == expected
    assert len({r.status for r in got}) >= 4
