"""Runs named queries side by side and keeps a log of rows, columns, seconds and status."""

from __future__ import annotations

import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from larder.sources.files import write_csv

LOG = "query_name string, rows_returned bigint, columns int, execution_time_sec double, status string"
POLL_SEC = 0.02
BROADCAST = "spark.sql.autoBroadcastJoinThreshold"
PACKED = 8  # times that columns grow from Parquet, by whose size Spark judges a scan, to rows at the driver
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # known from Spark 4.1 on
GRACE_SEC = 10.0  # for a cancelled query to end; one that hangs outside Spark's jobs is left behind


class _Run:
    """One query in a thread and a job group of its own."""

    def __init__(self, spark: SparkSession, name: str, build: Callable[[], DataFrame], path: str | None):
        self.name, self.group = name, f"audit-{name}-{uuid.uuid4().hex}"
        self.entry: tuple[int, int, str] | None = None
        self.seconds = 0.0
        self._spark, self._build, self._path = spark, build, path
        self._stopped = False
        self._thread = InheritableThread(target=self._work, session=spark, daemon=True)
        self._start = time.monotonic()
        self._thread.start()

    def _work(self) -> None:
        # Interrupting task threads could hurt file clients, so tasks end at their next check.
        self._spark.sparkContext.setJobGroup(self.group, self.name, interruptOnCancel=False)
        self._spark.sparkContext.setLocalProperty("spark.scheduler.pool", self.group)
        try:
            seen = Observation()
            df = self._build()
            if self._stopped:  # cancelled between two jobs: nothing is written late
                return
            counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
            if self._path:
                write_csv(counted, self._path)
            else:
                counted.write.format("noop").mode("overwrite").save()
            entry = (seen.get["rows"], len(df.columns), "SUCCESS")
        except Exception as error:
            entry = (0, 0, f"FAILED: {str(error) or type(error).__name__}")
        if not self._stopped:
            self.seconds = time.monotonic() - self._start
            self.entry = entry

    def ended(self, limit_sec: float | None) -> bool:
        if not self._thread.is_alive():
            return True
        if limit_sec is None or time.monotonic() - self._start <= limit_sec:
            return False
        self._stopped = True
        if self.entry is not None:  # it ended in this very moment
            return True
        until = time.monotonic() + GRACE_SEC
        while self._thread.is_alive() and time.monotonic() < until:  # a query may start another job after the first is gone
            self._spark.sparkContext.cancelJobGroup(self.group)
            self._thread.join(0.1)
        self.seconds = time.monotonic() - self._start
        self.entry = (0, 0, f"FAILED: stopped after {limit_sec:g} seconds")
        return True

    def cancel(self) -> None:
        self._stopped = True
        self._spark.sparkContext.cancelJobGroup(self.group)


@contextmanager
def _own_disk(spark: SparkSession) -> Iterator[None]:
    """What a query shuffled is deleted on all executors when it ends, not once the driver has collected its garbage: a large driver seldom does."""
    before = spark.conf.get(CLEAN_UP) if spark.conf.isModifiable(CLEAN_UP) else None
    if before is not None:
        spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(CLEAN_UP, before)


@contextmanager
def _shared_driver(spark: SparkSession, at_once: int) -> Iterator[None]:
    """Queries that run side by side share what one alone may send to the driver for a broadcast; larger tables are dealt out."""
    before = spark.conf.get(BROADCAST)
    if not before.strip().startswith("-"):  # else there are no broadcasts
        whole = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
        spark.conf.set(BROADCAST, str(whole // (at_once * PACKED)))
    try:
        yield
    finally:
        spark.conf.set(BROADCAST, before)


def query_audit(spark: SparkSession, queries: Mapping[str, Callable[[], DataFrame]], folder: str | None = None, *,
                at_once: int = 4, limit_sec: float | None = None) -> DataFrame:
    """One log row per query, in the order given. A query that fails is logged and the run goes on.

    Up to ``at_once`` queries run side by side, each in its own job group, so small ones fill the
    executors that a large one's last tasks leave idle; in a session with ``spark.scheduler.mode`` FAIR they
    share the cores evenly, else the first one comes first. One that takes more than ``limit_sec`` is
    cancelled and logged as failed; its time counts from its own start. While it lasts, the session's queries share one
    limit for broadcasts (see ``_shared_driver``), and each one's shuffled rows go when it ends. Results go to CSV under
    ``folder``, or are computed and dropped without one. Rows are counted while they are written, so no query runs twice.
    """
    if at_once < 1:
        raise ValueError("at_once must be at least 1")
    waiting, active, done = deque(queries.items()), [], {}
    with _shared_driver(spark, at_once), _own_disk(spark):
        _run_all(spark, waiting, active, done, folder, at_once, limit_sec)
    log = [(name, run.entry[0], run.entry[1], round(run.seconds, 2), run.entry[2]) for name, run in ((n, done[n]) for n in queries)]
    return spark.createDataFrame(log, LOG)


def _run_all(spark: SparkSession, waiting: deque, active: list[_Run], done: dict[str, _Run], folder: str | None, at_once: int, limit_sec: float | None) -> None:
    try:
        while waiting or active:
            while waiting and len(active) < at_once:
                name, build = waiting.popleft()
                active.append(_Run(spark, name, build, f"{folder.rstrip('/')}/{name}" if folder else None))
            for run in list(active):
                if run.ended(limit_sec):
                    active.remove(run)
                    done[run.name] = run
            time.sleep(POLL_SEC)
    finally:
        for run in active:  # the audit itself was interrupted
            run.cancel()


def audit_summary(log: DataFrame) -> DataFrame:
    """Queries run, how many succeeded, their rows and seconds."""
    return log.agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(F.col("status") == "SUCCESS").alias("succeeded"),
        F.sum("rows_returned").alias("rows_returned"),
        F.round(F.sum("execution_time_sec"), 2).alias("execution_time_sec"),
    )
