"""The engine: scan, optimize, plan, report, write."""

from __future__ import annotations

import logging
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundleloom.operators import summary
from bundleloom.operators.optimize import has_media, optimize, settle_method
from bundleloom.options import Options
from bundleloom.plans import progress
from bundleloom.sinks import archive
from bundleloom.sources import pack
from bundleloom.staging import scope, stage

log = logging.getLogger("bundleloom")


class PackError(RuntimeError):
    """A file of the pack couldn't be read."""


class PackEngine:
    """One pack: ``PackEngine(spark, path).write("out.zip")``; each step is also a DataFrame of its own."""

    def __init__(self, spark: SparkSession, path: str, options: Options = Options()):
        self.spark, self.path, self.options = spark, path, options

    def index(self) -> DataFrame:
        """Paths and sizes, no payload is read."""
        return pack.read_index(self.spark, self.path)

    def scan(self) -> DataFrame:
        files = pack.read_pack(self.spark, self.path)
        return files.repartition(self.options.threads) if files.rdd.getNumPartitions() < self.options.threads else files

    def optimized(self) -> DataFrame:
        media_files = has_media(self.index())  # by the index: no payload is read to choose the plan
        return settle_method(optimize(self.scan(), self.options, media_files), self.options)

    def summary(self) -> DataFrame:
        return summary.pack_summary(self.optimized())

    def plan_archive(self) -> tuple[DataFrame, DataFrame]:
        return archive.plan(self.optimized(), self.options)

    def write(self, out: str | None = None) -> dict:
        """Run the build: optimize, report, and write unless it is a dry run.  Unreadable files fail it."""
        o, out, began = self.options, out or self.options.out, time.monotonic()
        bar = progress.wanted(o, sys.stderr)
        with scope(), progress.shown(self.spark, bar):
            done = stage(self.optimized(), "optimized")
            if (error := summary.first_error(done).first()[0]) is not None:
                raise PackError(error)
            if not bar:
                for r in summary.log_rows(done, o).orderBy("rel").toLocalIterator():
                    log.info("%s", r.line)
            for r in summary.notes(done).orderBy("rel").toLocalIterator():
                log.info("note: %s", r.note)
            totals = summary.pack_summary(done)
            result = totals.first().asDict()
            if o.dry_run:
                log.info("dry run: %d files would go to %s", result["files"], out)
                return result | {"out": None}
            result |= archive.write(done, out, o)
            line = summary.done_line(*(F.col(c) for c in ("files", "optimized", "orig_bytes", "new_bytes")), F.lit(result["dedup_saved"]))
            text = totals.select(line.alias("line")).first().line
        log.info("%s", f"{text} in {time.monotonic() - began:.3f}s" if bar else text)
        return result | {"out": os.path.abspath(out)}
