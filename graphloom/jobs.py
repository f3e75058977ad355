"""Commands in the background: a bounded queue, states, progress and cancellation."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import SparkSession


class Job:
    """PENDING, RUNNING, COMPLETED, FAILED or CANCELLED, with progress from 0 to 1."""

    def __init__(self, tag: str):
        self.tag, self.status, self.progress, self.error = tag, "PENDING", 0.0, None
        self.future: Future | None = None

    def result(self, timeout: float | None = None):
        return self.future.result(timeout)


class Runner:
    """Runs functions one after another off the main thread; Spark jobs carry the job's tag."""

    def __init__(self, spark: SparkSession, depth: int = 9):
        self.spark, self.depth = spark, depth
        self.pool = ThreadPoolExecutor(1)
        self.jobs: list[Job] = []
        self.lock = threading.Lock()

    def submit(self, f: Callable, *args, **kwargs) -> Job | None:
        """None when the queue is full."""
        with self.lock:
            self.jobs = [j for j in self.jobs if j.status in ("PENDING", "RUNNING")]
            if len(self.jobs) >= self.depth:
                return None
            job = Job(f"job-{uuid.uuid4().hex}")
            self.jobs.append(job)

        def work():
            if job.status == "CANCELLED":
                return None
            job.status = "RUNNING"
            self.spark.addTag(job.tag)
            try:
                out = f(*args, **kwargs)
                job.status, job.progress = ("FAILED", job.progress) if out is None else ("COMPLETED", 1.0)
                return out
            except BaseException as e:
                job.status = "CANCELLED" if job.status == "CANCELLED" else "FAILED"
                job.error = e
                raise
            finally:
                self.spark.removeTag(job.tag)

        job.future = self.pool.submit(work)
        return job

    def cancel(self, job: Job) -> None:
        job.status = "CANCELLED"
        self.spark.interruptTag(job.tag)

    def close(self) -> None:
        self.pool.shutdown(wait=True)
