"""Dispatch of download jobs from a stored queue: claimed, sent, marked.

Jobs lie in a Store; a tick is two of its batches. The first writes the claims (QUEUED or FAILED jobs become SENDING, with one
attempt more) before anything is sent, so a job is never sent by a tick that did not claim it; the second writes what
became of them. A tick that stops between the two leaves its jobs SENDING; they fail once `lease` seconds have passed, and later
ticks claim them anew. A retried tick claims and sends what its first attempt did, since it reads what that read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.functions.text import redact
from reelgrid.operators.merge import may_change
from reelgrid.operators.rank import top_per_key
from reelgrid.sources.store import Store
from reelgrid.streaming.feeds import once

JOB = "job_id long, item_id long, status string, attempts int, error string, changed_at long"
BUCKETS = 16
#: Attempts of a job, and seconds after which a job that is being sent counts as lost.
TRIES, LEASE = 5, 600


def jobs_of(spark: SparkSession, home: str) -> Store:
    return Store(spark, f"{home}/jobs", JOB, "job_id", lambda rows: top_per_key(rows, ["job_id"], [F.desc("batch")]), BUCKETS)


def queued(spark: SparkSession, home: str, jobs: DataFrame, n: int) -> None:
    """Adds jobs(job_id, item_id, changed_at) to the queue as batch n; of ids that are known, or come twice, the stored or first one stays."""
    store = jobs_of(spark, home)
    new = top_per_key(jobs.where("job_id IS NOT NULL"), ["job_id"], [F.asc("changed_at"), F.asc("item_id")]).join(store.read(n).select("job_id"), "job_id", "left_anti")
    store.add(new.select("job_id", "item_id", F.lit("QUEUED").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"), "changed_at"), n)


def ticked(spark: SparkSession, home: str, n: int, now: int, send: Callable[[DataFrame], DataFrame], most: int | None = None, tries: int = TRIES, lease: int = LEASE) -> DataFrame:
    """One tick at `now` as batches n and n + 1: claims free jobs, the longest waiting first (`most` of them if given), lets
    send(claimed) -> (job_id, error) send them (error null: sent; a job it does not name failed), and marks them.

    Returns the jobs that it touched. Errors are stored without secrets.
    """
    store = jobs_of(spark, home)
    store.compact(n, list(range(BUCKETS)))
    held = store.read(n)
    lost = held.where((F.col("status") == "SENDING") & (F.col("changed_at") <= now - lease))
    lost = lost.withColumns({"status": F.lit("FAILED"), "error": F.lit("lost while it was sent")})
    free = held.where(F.col("status") != "SENDING").unionByName(lost)
    free = free.where(may_change(F.col("status"), F.lit("SENDING")) & (F.col("attempts") < tries))
    if most is not None:
        free = free.orderBy("changed_at", "job_id").limit(most)
    claimed = free.withColumns({"status": F.lit("SENDING"), "attempts": F.col("attempts") + 1, "changed_at": F.lit(now).cast("long")})
    # Lost jobs that may not be tried again end as failed.
    spent = lost.where(F.col("attempts") >= tries).withColumn("changed_at", F.lit(now).cast("long"))
    store.add(once(claimed.unionByName(spent), f"{home}/step/claimed"), n)
    mine = store.changes(n).where("status = 'SENDING'")
    answers = send(mine).groupBy("job_id").agg(F.max("error").alias("answer"), F.lit(True).alias("answered"))  # one word against it is enough
    told = F.when(F.col("answered"), F.col("answer")).otherwise("no answer")
    done = mine.join(answers, "job_id", "left").withColumns({"error": redact(told), "status": F.when(told.isNull(), "SENT").otherwise("FAILED")})
    store.add(once(done.select(*store.schema.names), f"{home}/step/done"), n + 1)
    return store.changes(n + 1).unionByName(store.changes(n).where("status = 'FAILED'"))
