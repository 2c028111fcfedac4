"""A progress line on a terminal: finished tasks of the running stages."""

from __future__ import annotations

import contextlib
import sys
import threading
from typing import TextIO

from pyspark.sql import SparkSession

from bundleloom.options import Options


def wanted(o: Options, out: TextIO) -> bool:
    """Only on a terminal, and not for quiet, verbose or dry runs."""
    return not (o.quiet or o.verbose or o.dry_run or o.no_progress) and out.isatty()


@contextlib.contextmanager
def shown(spark: SparkSession, on: bool = True, out: TextIO | None = None, every: float = 0.2):
    """Draw the line while the body runs; nothing if not ``on``."""
    if not on:
        yield
        return
    out, done, tracker = out or sys.stderr, threading.Event(), spark.sparkContext.statusTracker()

    def draw() -> None:
        while not done.wait(every):
            stages = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s]
            ready, total = sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages)
            out.write(f"\rOptimizing pack: {ready}/{total} tasks ")
            out.flush()

    thread = threading.Thread(target=draw, daemon=True)
    thread.start()
    try:
        yield
    finally:
        done.set()
        thread.join()
        out.write("\n")
