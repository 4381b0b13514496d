"""A queue of job notifications as files: announced by a stream, taken in order, each once.

A notification says only that a job may be ready; who takes it must still claim the job. Every write goes to a folder named
after what it belongs to, the stream's batch or the caller's take, and replaces that folder whole. So a batch that is
replayed after a failure, and a take that is repeated, leave the queue as it was."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlpit.sources.files import exists
from marlpit.streaming.live import dedupe_notifications

NOTICE = "job_id long, at timestamp"


@dataclass(frozen=True)
class JobQueue:
    """folder holds announced/batch=N, taken/take=NAME and the stream's checkpoint."""

    spark: SparkSession
    folder: str

    def write_batch(self, batch: DataFrame, batch_id: int) -> None:
        """The rows of one batch of a stream. Writing it again changes nothing."""
        batch.select("job_id", "at").write.mode("overwrite").parquet(f"{self.folder}/announced/batch={batch_id}")

    def announce(self, notices: DataFrame, ttl: str = "30 seconds", **trigger) -> StreamingQuery:
        """Starts a stream that puts notices (job_id, at) into the queue, a job once within ttl."""
        known = dedupe_notifications(notices.where("job_id is not null and at is not null"), ttl)
        writer = known.writeStream.foreachBatch(self.write_batch).option("checkpointLocation", f"{self.folder}/checkpoint").outputMode("append")
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def _read(self, kind: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{kind}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def announced(self) -> DataFrame:
        return self._read("announced", f"{NOTICE}, batch long")

    def taken(self) -> DataFrame:
        return self._read("taken", f"{NOTICE}, batch long, take string")

    def waiting(self) -> DataFrame:
        """Notifications that nobody has taken: job_id, at, batch."""
        return self.announced().join(self.taken().select("job_id", "batch"), ["job_id", "batch"], "left_anti").select("job_id", "at", "batch")

    def take(self, name: str, limit: int) -> DataFrame:
        """The first `limit` notifications that wait, oldest first, as the take called name. A take that exists is given back as
        it is. Takes are one caller's at a time; a job's claim decides between two."""
        path = f"{self.folder}/taken/take={name}"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            self.waiting().orderBy("batch", "at", "job_id").limit(limit).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(f"{NOTICE}, batch long").parquet(path)
