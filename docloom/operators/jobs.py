"""The ingest queue as tables: claim order, rotation, positions, status and sweeps.

``jobs`` has id, library_id, requested_by, source, status, attempts, cancel_req, lease_until, created_at,
updated_at, cur, total. A ``now`` is always passed in, so that a plan gives one result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ATTEMPTS, LEASE_SECONDS = 3, 300
OPEN = ("queued", "running")
#: Jobs of a status report.
STATUS_LIMIT = 25


def claimable(now: Column, max_attempts: int = MAX_ATTEMPTS) -> Column:
    """Waiting, or running under a lease that has ended; attempts left and no cancel asked."""
    free = (F.col("status") == "queued") | ((F.col("status") == "running") & (F.col("lease_until") < now))
    return free & (F.col("attempts") < max_attempts) & ~F.col("cancel_req")


def claim_order(jobs: DataFrame, now: Column) -> DataFrame:
    """library_id, requested_by, id, place: claimable jobs of each queue, oldest first."""
    order = Window.partitionBy("library_id", "requested_by").orderBy("created_at", "id")
    return jobs.where(claimable(now)).withColumn("place", F.row_number().over(order)).select("library_id", "requested_by", "id", "place")


def waiting_queues(jobs: DataFrame, editors: DataFrame, now: Column) -> DataFrame:
    """Distinct queues with claimable work whose requester may still write there."""
    queues = jobs.where(claimable(now)).select("library_id", F.col("requested_by").alias("user_id")).distinct()
    return queues.join(editors, ["library_id", "user_id"], "left_semi").select("library_id", F.col("user_id").alias("requested_by"))


def rotation(order: DataFrame) -> DataFrame:
    """Rounds of at most one job a queue: the place in its queue is a job's round."""
    return order.select("id", F.col("place").alias("round"), "library_id", "requested_by")


def positions(jobs: DataFrame) -> DataFrame:
    """id, position: how many open jobs of the library have an id up to this one."""
    order = Window.partitionBy("library_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    return jobs.where(F.col("status").isin(*OPEN)).select("id", F.count("*").over(order).alias("position"))


def swept(jobs: DataFrame, now: Column, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """id, status of running jobs whose lease ended and that cannot go on."""
    ended = (F.col("status") == "running") & (F.col("lease_until") < now)
    return jobs.where(ended & (F.col("cancel_req") | (F.col("attempts") >= max_attempts))).select("id", F.when(F.col("cancel_req"), "cancelled").otherwise("failed").alias("status"))


def retried(status_permanent: Column, attempts: Column, max_attempts: int = MAX_ATTEMPTS) -> Column:
    """What a failed attempt becomes."""
    return F.when(status_permanent | (attempts >= max_attempts), "failed").otherwise("queued")


def status_view(jobs: DataFrame, now: Column) -> DataFrame:
    """id, status, percent, stalled, elapsed_seconds of every job."""
    percent = F.when(F.col("total") > 0, F.floor(100 * F.col("cur") / F.col("total"))).cast("int")
    stalled = (F.col("status") == "running") & (F.col("lease_until") < now)
    until = F.when(F.col("status").isin(*OPEN), now).otherwise(F.col("updated_at"))
    seconds = F.floor((F.unix_micros(until.cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1_000_000).cast("long")
    return jobs.select("id", "status", percent.alias("percent"), F.coalesce(stalled, F.lit(False)).alias("stalled"), seconds.alias("elapsed_seconds"))


def progress(cur: Column, total: Column) -> Column:
    """Count and whole percents (halves to even); empty without a total."""
    shown = F.concat(cur.cast("string"), F.lit("/"), total.cast("string"), F.lit(" ("), F.rint(100 * cur / total).cast("long").cast("string"), F.lit("%)"))
    return F.coalesce(F.when(total > 0, shown), F.lit(""))


def disposition(status: Column, permanent: Column) -> Column:
    """Whether a failed job could have gone on: permanent or exhausted; null for any other job."""
    return F.when(status == "failed", F.when(permanent, "permanent").otherwise("exhausted"))


def active(jobs: DataFrame) -> DataFrame:
    """Open jobs, oldest first."""
    return jobs.where(F.col("status").isin(*OPEN)).orderBy("created_at", "id")


def recent(jobs: DataFrame, most: int = STATUS_LIMIT) -> DataFrame:
    """The first ``most`` jobs, open ones first, then by last change, then by id."""
    return jobs.orderBy(F.col("status").isin(*OPEN).desc(), F.desc("updated_at"), F.desc("id")).limit(most)


def unclaimable(jobs: DataFrame, editors: DataFrame, now: Column) -> DataFrame:
    """id, status, permanent of jobs that fail as their requester may no longer write there.

    Waiting jobs, and those running or being cancelled whose lease has ended. ``editors`` has library_id, user_id.
    """
    free = (F.col("status") == "queued") | (F.col("status").isin("running", "cancelling") & (F.col("lease_until") < now))
    may = editors.select("library_id", F.col("user_id").alias("requested_by"))
    lost = jobs.where(free).join(may, ["library_id", "requested_by"], "left_anti")
    return lost.select("id", F.lit("failed").alias("status"), F.lit(True).alias("permanent"))


def latest_by_source(jobs: DataFrame) -> DataFrame:
    """source, id, status of the newest job of each source; combined before the shuffle."""
    return jobs.groupBy("source").agg(F.max_by(F.struct("id", "status"), F.struct("created_at", "id")).alias("j")).select("source", "j.id", "j.status")


def sync_plan(shown: DataFrame, held: DataFrame, latest: DataFrame) -> DataFrame:
    """source, action (skip, push, retire) over documents shown by a source, those held, and their last jobs.

    ``shown`` has source, modified; ``held`` has source, ingested_at; ``latest`` has source, status, updated_at.
    Open work is left alone; a refusal stands until the document changes; what was ingested after its last
    change is current; a held document that is no longer shown is retired unless work on it is open.
    """
    rows = shown.withColumn("_shown", F.lit(True)).join(held.withColumn("_held", F.lit(True)), "source", "full").join(latest, "source", "left")
    busy = F.coalesce(F.col("status").isin(*OPEN), F.lit(False))
    refused = F.coalesce((F.col("status") == "failed") & (F.col("updated_at") >= F.col("modified")), F.lit(False))
    current = F.coalesce(F.col("ingested_at") >= F.col("modified"), F.lit(False))
    action = (
        F.when(F.col("_shown") & (busy | refused | current), "skip").when(F.col("_shown"), "push").when(busy, "skip").otherwise("retire")
    )
    return rows.select("source", action.alias("action"))
