"""Watchers of folders, one for each, and the progress of runs that readers can poll."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Seconds for which a finished run stays readable (a fixed value).
RETAIN = 90.0

_LOCK = threading.Lock()
_RUNS: dict[str, Run] = {}


def percent(done: Column, total: Column) -> Column:
    """100 at most, to one place; null without a total."""
    return F.when(total > 0, F.round(F.least(F.lit(100.0), 100.0 * done / total), 1))


def seconds_left(done: Column, total: Column, elapsed: Column) -> Column:
    """As long as what is left takes at the speed so far; null before anything is done."""
    return F.when((total > 0) & (done > 0), F.round(F.greatest(F.lit(0.0), elapsed * (total - done) / done), 1))


@dataclass
class Run:
    root: str
    operation: str
    phase: str = "starting"
    detail: str = ""
    done: int = 0
    total: int | None = None
    started: float = field(default_factory=time.time)
    finished: float | None = None
    error: str | None = None

    def set_phase(self, phase: str, total: int | None = None, detail: str = "") -> None:
        with _LOCK:
            self.phase, self.total, self.done, self.detail = phase, total, 0, detail

    def advance(self, by: int = 1) -> None:
        with _LOCK:
            self.done += by

    def finish(self, error: str | None = None) -> None:
        with _LOCK:
            self.phase, self.error, self.finished = "failed" if error else "done", error, time.time()

    def snapshot(self) -> dict:
        elapsed, share, left = (self.finished or time.time()) - self.started, None, None
        if self.total:
            share = round(min(100.0, 100.0 * self.done / self.total), 1)
            if self.done and self.finished is None:
                left = round(max(0.0, elapsed * (self.total - self.done) / self.done), 1)
        elif self.finished is not None:
            share = 100.0
        return {"root": self.root, "operation": self.operation, "phase": self.phase, "detail": self.detail, "done": self.done, "total": self.total, "percent": share, "running": self.finished is None, "elapsed_s": round(elapsed, 1), "eta_s": left, "error": self.error}


def current(root: str) -> Run | None:
    """The folder's run, if one is running or ended a short while ago."""
    with _LOCK:
        run = _RUNS.get(root)
        if run is not None and run.finished is not None and time.time() - run.finished > RETAIN:
            run = _RUNS.pop(root) and None
        return run


@contextmanager
def track(root: str, operation: str) -> Iterator[Run]:
    """Publish a run and end it whatever happens; a run within a run of the same folder reports into the outer one."""
    with _LOCK:
        outer = _RUNS.get(root)
        nested = outer is not None and outer.finished is None
        run = outer if nested else _RUNS.setdefault(root, Run(root, operation)) if outer is None else Run(root, operation)
        _RUNS[root] = run
    if nested:
        yield run
        return
    try:
        yield run
    except BaseException as e:
        run.finish(f"{type(e).__name__}: {e}"[:300])
        raise
    run.finish()


def _name(root: str) -> str:
    return f"watch {root.rstrip('/')}"


def watcher(spark: SparkSession, root: str):
    """The folder's running stream, if there is one."""
    return next((q for q in spark.streams.active if q.name == _name(root) and q.isActive), None)


def start_watcher(spark: SparkSession, root: str, start: Callable[[str], object]) -> dict:
    """Start a stream for the folder, by start(query name); one that runs already stays the only one."""
    if watcher(spark, root) is None:
        start(_name(root))
    return watcher_status(spark, root)


def stop_watcher(spark: SparkSession, root: str) -> dict:
    if (q := watcher(spark, root)) is not None:
        q.stop()
    return watcher_status(spark, root)


def watcher_status(spark: SparkSession, root: str) -> dict:
    if (q := watcher(spark, root)) is None:
        return {"running": False, "root": root}
    last = q.lastProgress
    return {"running": True, "root": root, "batches": last.batchId + 1 if last else 0, "rows": last.numInputRows if last else 0, "error": str(q.exception()) if q.exception() else None}
