"""Independent Spark jobs side by side, so that one's last tasks do not idle the cluster."""

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

JOBS = 8


def concurrently(spark: SparkSession, jobs: Iterable[Callable]) -> list:
    """Results of the jobs, in order. Each thread inherits the caller's job properties and context."""
    ready = [
        inheritable_thread_target(spark)(partial(copy_context().run, job)) for job in jobs
    ]
    with ThreadPoolExecutor(JOBS) as pool:
        return [future.result() for future in [pool.submit(job) for job in ready]]
