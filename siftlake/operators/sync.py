"""Peers and jobs: Bloom filters of addresses, deltas between stores, peer liveness, job states."""

from __future__ import annotations

import contextlib
import enum
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PEER_TTL, PEER_LIMIT, STALE_AFTER = 120, 32, 300


def bloom_filter(addresses: DataFrame, column: str, expected: int, rate: float = 0.01) -> bytes:
    """M-09: a serialised filter without false negatives; ``expected`` and ``rate`` bound its size."""
    jvm = addresses.sparkSession._jvm
    filter_ = addresses._jdf.stat().bloomFilter(column, max(expected, 1), rate)
    out = jvm.java.io.ByteArrayOutputStream()
    filter_.writeTo(out)
    return bytes(out.toByteArray())


def might_contain(spark, data: bytes, value: str) -> bool:
    jvm = spark._jvm
    filter_ = jvm.org.apache.spark.util.sketch.BloomFilter.readFrom(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    return filter_.mightContain(value)


def peer_delta(local: DataFrame, remote: DataFrame, key: list[str]) -> DataFrame:
    """M-10: rows of ``local`` that ``remote`` lacks, exactly."""
    return local.join(remote.select(*key), key, "left_anti")


def live_peers(peers: DataFrame, now: float) -> DataFrame:
    """J-04: peers seen within ``PEER_TTL`` seconds of ``now``, the latest ``PEER_LIMIT`` (a limit of the protocol)."""
    latest = peers.groupBy("peer_id").agg(F.max("last_seen").alias("last_seen"))
    return latest.where(F.lit(now) - F.col("last_seen") < PEER_TTL).orderBy(F.desc("last_seen"), "peer_id").limit(PEER_LIMIT)


def stale_peers(peers: DataFrame, now: float) -> DataFrame:
    """J-05."""
    return peers.where(F.lit(now) - F.col("last_sync") > STALE_AFTER)


class JobState(enum.Enum):
    QUEUED = "queued"
    PROCESSING = "processing"
    COMPLETED = "completed"
    FAILED = "failed"
    CANCELLED = "cancelled"


MOVES = {
    JobState.QUEUED: {JobState.PROCESSING, JobState.CANCELLED},
    JobState.PROCESSING: {JobState.COMPLETED, JobState.FAILED, JobState.CANCELLED},
}


@dataclass
class Job:
    filename: str
    job_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    state: JobState = JobState.QUEUED
    created_at: float = field(default_factory=time.time)
    rows_processed: int = 0
    error: str | None = None


class JobQueue:
    """J-06: the driver's registry of jobs with guarded moves."""

    def __init__(self):
        self.jobs: dict[str, Job] = {}

    def enqueue(self, filename: str) -> Job:
        job = Job(filename)
        self.jobs[job.job_id] = job
        return job

    def move(self, job_id: str, state: JobState, **changes) -> Job:
        job = self.jobs[job_id]
        if state not in MOVES.get(job.state, ()):
            raise ValueError(f"a {job.state.value} job cannot become {state.value}")
        job.state = state
        for k, v in changes.items():
            setattr(job, k, v)
        return job

    def claim(self) -> Job | None:
        """The oldest queued job, moved to processing."""
        queued = sorted((j for j in self.jobs.values() if j.state is JobState.QUEUED), key=lambda j: j.created_at)
        return self.move(queued[0].job_id, JobState.PROCESSING) if queued else None

    def page(self, offset: int = 0, limit: int = 50) -> list[Job]:
        """Newest first, at most 200 (a page)."""
        return sorted(self.jobs.values(), key=lambda j: -j.created_at)[offset : offset + min(limit, 200)]


class JobLog:
    """M-14: job states that outlive the driver: JSON lines below a folder, one file for each move."""

    SCHEMA = "job_id string, kind string, state string, at double, about string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, job: Job, kind: str, **about) -> None:
        row = (job.job_id, kind, job.state.value, time.time(), json.dumps(about, default=str))
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("append").json(self.path)

    @contextlib.contextmanager
    def running(self, kind: str, **about) -> Iterator[dict]:
        """A job around a block, which may add to what is told of it; fails with the block."""
        queue = JobQueue()
        job, done = queue.enqueue(kind), {}
        self.put(job, kind, **about)
        self.put(queue.move(job.job_id, JobState.PROCESSING), kind, **about)
        try:
            yield done
        except Exception as e:
            self.put(queue.move(job.job_id, JobState.FAILED), kind, **about, error=str(e)[:1000])
            raise
        self.put(queue.move(job.job_id, JobState.COMPLETED), kind, **about, **done)

    def latest(self, job_id: str | None = None, limit: int = 200) -> list[dict]:
        """The last state of one job, or of the latest (a page of ``limit``)."""
        moves = self.spark.read.schema(self.SCHEMA).json(self.path)
        moves = moves if job_id is None else moves.where(F.col("job_id") == job_id)
        last = moves.groupBy("job_id").agg(F.min("at").alias("created"), F.max_by(F.struct("kind", "state", "about"), F.col("at")).alias("last"))
        rows = last.select("job_id", "created", "last.*").orderBy(F.desc("created"), "job_id").limit(limit).collect()
        return [{k: v for k, v in r.asDict().items() if k != "about"} | json.loads(r.about) for r in rows]
