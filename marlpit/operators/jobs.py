"""Job lifecycle: claims, leases, recovery, backoff, stuck jobs, stage states. `now` is always given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.schema import BACKOFF_SECONDS, FINAL_STATUSES, JOB_MOVES, LEASE_SECONDS, LECTURE_STATUSES, STAGE_OF_JOB, STAGES, STUCK_QUEUED_SECONDS, STUCK_RUNNING_SECONDS


def due(now: Column) -> Column:
    return (F.col("status") == "queued") & (F.col("next_attempt_at") <= now)


def claim(jobs: DataFrame, now: Column) -> DataFrame:
    """Due jobs become running, with a lease and one attempt more."""
    hit = due(now)
    lease = now + F.make_dt_interval(secs=F.lit(LEASE_SECONDS))
    return jobs.select(
        "job_id",
        F.when(hit, "running").otherwise(F.col("status")).alias("status"),
        (F.col("attempt_count") + hit.cast("int")).alias("attempt_count"),
        F.when(hit, lease).otherwise(F.col("lease_expires_at")).alias("lease_expires_at"),
        hit.alias("claimed"),
    )


def recover(jobs: DataFrame, now: Column) -> DataFrame:
    """Expired leases: failed if no attempt is left, else queued and due; the lecture of a failed job fails too."""
    expired = (F.col("status") == "running") & (F.col("lease_expires_at") < now)
    spent = expired & (F.col("attempt_count") >= F.col("max_attempts"))
    return jobs.select(
        "job_id",
        F.when(spent, "failed").when(expired, "queued").otherwise(F.col("status")).alias("status"),
        F.when(expired & ~spent, now).otherwise(F.col("next_attempt_at")).alias("next_attempt_at"),
        F.when(expired, F.lit(None)).otherwise(F.col("lease_expires_at")).alias("lease_expires_at"),
        F.when(spent, "FAILED").alias("lecture_status"),
    )


def backoff(jobs: DataFrame, failed_at: Column) -> DataFrame:
    """When a job that just failed runs again: the base doubled for each attempt made; NULL when none is left."""
    wait = F.lit(BACKOFF_SECONDS) * F.pow(F.lit(2), F.greatest(F.col("attempt_count") - 1, F.lit(0)))
    again = F.col("attempt_count") < F.col("max_attempts")
    return jobs.select("job_id", F.when(again, wait.cast("long")).alias("wait_seconds"), F.when(again, failed_at + F.make_dt_interval(secs=wait)).alias("next_attempt_at"))


def stuck(jobs: DataFrame, now: Column) -> DataFrame:
    age = F.make_dt_interval
    overdue = (F.col("status") == "queued") & (F.col("next_attempt_at") < now - age(secs=F.lit(STUCK_QUEUED_SECONDS)))
    long = (F.col("status") == "running") & (F.col("queued_at") < now - age(secs=F.lit(STUCK_RUNNING_SECONDS)))
    return jobs.withColumn("kind", F.when(overdue, "queued_overdue").when(long, "long_running")).where("kind is not null").select("job_id", "kind")


def legal_moves(changes: DataFrame) -> DataFrame:
    """changes (job_id, before, after) with legal."""
    moves = F.array(*[F.concat_ws(">", F.lit(a), F.lit(b)) for a, b in JOB_MOVES])
    return changes.withColumn("legal", F.array_contains(moves, F.concat_ws(">", "before", "after")))


def stage_states(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """jobs (job_id, status, current_stage), runs (job_id, stage, status, duration_ms, started_at): (job_id, stage, state, duration_ms).

    Stages before the current one are done, all of them when the job succeeded; the current one is as the job's status says;
    later ones are pending. A stage's time is that of its last run, if that succeeded."""
    place = F.array_position(F.array(*map(F.lit, STAGES)), F.col("current_stage")) - 1
    grid = jobs.select("job_id", "status", place.alias("current"), F.posexplode(F.array(*map(F.lit, STAGES))).alias("pos", "stage"))
    here = F.create_map(*[F.lit(x) for pair in STAGE_OF_JOB.items() for x in pair])
    state = (
        F.when((F.col("status") == "succeeded") | F.coalesce(F.col("pos") < F.col("current"), F.lit(False)), "done")
        .when(F.coalesce(F.col("pos") == F.col("current"), F.lit(False)), F.coalesce(here[F.col("status")], F.lit("pending")))
        .otherwise("pending")
    )
    last = last_runs(runs).select("job_id", "stage", F.when(F.col("status") == "succeeded", F.col("duration_ms")).alias("duration_ms"))
    return grid.select("job_id", "stage", state.alias("state")).join(last, ["job_id", "stage"], "left")


def last_runs(runs: DataFrame) -> DataFrame:
    """The last run of each stage of a job; ties on start go to the larger remaining keys."""
    order = Window.partitionBy("job_id", "stage").orderBy(F.desc("started_at"), F.desc("tie"), F.desc("tie2"), F.desc("status"), F.desc_nulls_last("duration_ms"))
    return runs.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("job_id", "stage", "status", "duration_ms")


def orphans(objects: DataFrame, lectures: DataFrame, references: DataFrame, cutoff: Column) -> DataFrame:
    """objects (path, created_at), lectures (lecture_id, user_id), references (path): path and the first reason that holds, NULL for those to keep.

    A path is owner/lecture/...; objects of unknown age, or younger than cutoff, are kept."""
    parts = F.split("path", "/")
    own = lectures.select(F.col("lecture_id").cast("string").alias("l"), F.col("user_id").alias("owner"))
    met = objects.withColumns({"n": F.size(parts), "first": parts[0], "second": F.get(parts, 1)}).join(own, F.col("second") == F.col("l"), "left")
    met = met.join(references.select("path", F.lit(True).alias("used")).distinct(), "path", "left")
    reason = F.when(F.col("n") < 3, "unexpected_location").when(F.col("l").isNull(), "lecture_missing").when(F.col("first") != F.col("owner"), "owner_mismatch").when(F.col("used").isNull(), "unreferenced")
    return met.select("path", F.when(F.col("created_at") <= cutoff, reason).alias("reason"))


def lecture_moves(changes: DataFrame) -> DataFrame:
    """changes (before, after: lecture statuses) with legal.

    Any lecture that isn't final may fail. QUEUED follows UPLOADED, FAILED and every stage. A queued lecture enters any stage,
    and a stage is followed by the next status in order."""
    order = F.array(*map(F.lit, LECTURE_STATUSES))
    at, to = F.array_position(order, F.col("before")), F.array_position(order, F.col("after"))
    legal = (
        F.when(F.col("before") == F.col("after"), False)
        .when(F.col("after") == "FAILED", ~F.col("before").isin(FINAL_STATUSES))
        .when(F.col("after") == "QUEUED", F.col("before").isin("UPLOADED", "FAILED", *STAGES))
        .when(F.col("before") == "QUEUED", F.col("after").isin(STAGES))
        .when(F.col("before").isin(STAGES), to == at + 1)
        .otherwise(False)
    )
    return changes.withColumn("legal", legal)


def resume_waiting(jobs: DataFrame, implemented: list[str], now: Column) -> DataFrame:
    """Waiting jobs whose stage exists now are queued and due."""
    hit = (F.col("status") == "waiting") & F.col("current_stage").isin(implemented)
    return jobs.withColumns({"status": F.when(hit, "queued").otherwise(F.col("status")), "next_attempt_at": F.when(hit, now).otherwise(F.col("next_attempt_at")), "resumed": F.coalesce(hit, F.lit(False))})


def due_jobs(jobs: DataFrame, now: Column, limit: int = 50) -> DataFrame:
    """The ids of at most `limit` due jobs, longest due first."""
    return jobs.where(due(now)).orderBy("next_attempt_at", "job_id").select("job_id", "next_attempt_at").limit(limit)


def advance(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """The stage driver's step. done (job_id, expected_stage, outcome): a job moves on only if it is running in that stage.

    succeeded: to the next stage, after the last to succeeded; unavailable: waiting; failed: failed. won tells the rows that
    moved from those that came too late (false) and those that weren't asked for (null)."""
    met = jobs.join(done.select("job_id", "expected_stage", "outcome"), "job_id", "left")
    won = F.when(F.col("outcome").isNotNull(), F.coalesce((F.col("status") == "running") & (F.col("current_stage") == F.col("expected_stage")), F.lit(False)))
    following = F.get(F.array(*map(F.lit, STAGES)), F.array_position(F.array(*map(F.lit, STAGES)), F.col("current_stage")).cast("int"))
    moved = F.coalesce(won, F.lit(False))
    met = met.withColumn("won", won).withColumn("following", following)
    status = F.when(F.col("outcome") == "failed", "failed").when(F.col("outcome") == "unavailable", "waiting").when(F.col("following").isNull(), "succeeded").otherwise("running")
    stage = F.when((F.col("outcome") == "succeeded") & F.col("following").isNotNull(), F.col("following")).otherwise(F.col("current_stage"))
    return met.withColumns({"status": F.when(moved, status).otherwise(F.col("status")), "current_stage": F.when(moved, stage).otherwise(F.col("current_stage"))}).drop("following", "expected_stage", "outcome")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and the old ones whose key has none."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def first_submissions(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of every key; rows without a key never conflict."""
    first = Window.partitionBy(key).orderBy(*order)
    return rows.where(F.col(key).isNotNull()).withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth").unionByName(rows.where(F.col(key).isNull()))


def rate_limited(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """events (operation, subject, at, id) with the count in their fixed window, allowed, remaining and retry_after."""
    at = F.unix_timestamp(F.col("at").cast("timestamp"))
    e = events.withColumn("window", F.floor(at / seconds).cast("long"))
    n = F.row_number().over(Window.partitionBy("operation", "subject", "window").orderBy("at", "id")).cast("long")
    e = e.withColumn("n", n)
    return e.select(
        "id", "n", (F.col("n") <= limit).alias("allowed"), F.greatest(F.lit(limit) - F.col("n"), F.lit(0)).alias("remaining"), F.greatest(F.lit(1), (F.col("window") + 1) * seconds - at).alias("retry_after")
    )
