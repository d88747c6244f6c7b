"""The ingest queue as a stream: events of jobs in, their states out.

An event has job_id, at, kind (enqueued, claimed, progress, failed, done, cancel), attempt, permanent, cur,
total. Every write of a worker names the attempt it claimed; one that is not the current attempt of a running
job changes nothing (a lost claim). A claim holds for LEASE_SECONDS; a job whose lease ends without a word is
queued again, or failed when its attempts are used up, or cancelled when that was asked.

``fold`` is the rule itself, over one job's events in order. ``states`` applies it to a table, ``stream`` to a
stream with one state a job. A lease is judged when the job's next event comes; a job that never gets one is
found by the sweep over the state table (operators.jobs.swept), so the stream needs no timers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.operators.jobs import LEASE_SECONDS, MAX_ATTEMPTS

STATE = "status string, attempts int, cancel_req boolean, cur long, total long, lease_until double"
OUT = f"job_id long, {STATE}"


@dataclass
class Job:
    status: str = "new"
    attempts: int = 0
    cancel_req: bool = False
    cur: int = 0
    total: int = 0
    lease_until: float = 0.0


def expired(job: Job, now: float) -> Job:
    """A running job whose lease ended before now."""
    if job.status == "running" and job.lease_until < now:
        job.status = "cancelled" if job.cancel_req else "failed" if job.attempts >= MAX_ATTEMPTS else "queued"
    return job


def fold(job: Job, event: dict) -> Job:
    """The job after one event; ``at`` is seconds."""
    at, kind = float(event["at"]), event["kind"]
    job = expired(job, at)
    mine = job.status == "running" and event.get("attempt") == job.attempts
    if kind == "enqueued" and job.status == "new":
        job.status = "queued"
    elif kind == "claimed" and job.status == "queued" and job.attempts < MAX_ATTEMPTS and not job.cancel_req:
        job.status, job.attempts, job.lease_until = "running", job.attempts + 1, at + LEASE_SECONDS
    elif kind == "progress" and mine:
        job.cur, job.total, job.lease_until = int(event.get("cur") or 0), int(event.get("total") or 0), at + LEASE_SECONDS
    elif kind == "done" and mine:
        job.status = "done"
    elif kind == "failed" and mine:
        job.status = "cancelled" if job.cancel_req else "failed" if event.get("permanent") or job.attempts >= MAX_ATTEMPTS else "queued"
    elif kind == "cancel":
        if job.status == "queued":
            job.status = "cancelled"
        elif job.status == "running":
            job.cancel_req = True
    return job


def _events(frame: pd.DataFrame) -> list[dict]:
    return frame.sort_values(["at", "kind"]).where(frame.notna(), None).to_dict("records")


def states(events: DataFrame) -> DataFrame:
    """The state of every job after all its events; a job's events are few, jobs are the unit of work."""
    kind = events.select("job_id").schema[0].dataType.simpleString()

    def last(frame: pd.DataFrame) -> pd.DataFrame:
        job = Job()
        for e in _events(frame):
            job = fold(job, e)
        return pd.DataFrame([{"job_id": frame["job_id"].iloc[0], **asdict(job)}])

    return events.groupBy("job_id").applyInPandas(last, OUT.replace("job_id long", f"job_id {kind}"))


def stream(events: DataFrame) -> DataFrame:
    """State changes of a stream of events, in update mode."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job = Job(*state.get) if state.exists else Job()
        for e in sorted((e for frame in frames for e in _events(frame)), key=lambda e: e["at"]):
            job = fold(job, e)
        state.update(tuple(asdict(job).values()))
        yield pd.DataFrame([{"job_id": key[0], **asdict(job)}])

    return events.groupBy("job_id").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
