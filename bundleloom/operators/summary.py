"""Reports over the optimized table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bundleloom.functions.report import human_bytes, log_row, percent_smaller
from bundleloom.options import Options


def pack_summary(optimized: DataFrame) -> DataFrame:
    """files, optimized, orig_bytes, new_bytes, pct_smaller: one row, also for an empty table."""
    out = optimized.agg(
        F.count("*").alias("files"), F.count_if("changed").alias("optimized"),
        F.coalesce(F.sum("orig"), F.lit(0)).cast("long").alias("orig_bytes"), F.coalesce(F.sum("new"), F.lit(0)).cast("long").alias("new_bytes"),
    )
    return out.withColumn("pct_smaller", percent_smaller(F.col("orig_bytes"), F.col("new_bytes")))


def log_rows(optimized: DataFrame, o: Options = Options()) -> DataFrame:
    """``(rel, line)`` of the files that a report lists, by path."""
    shown = F.lit(True) if o.verbose else F.lit(not o.quiet) & F.col("changed") & (F.col("new") < F.col("orig"))
    return optimized.filter(shown).select("rel", log_row(F.col("rel"), F.col("orig"), F.col("new")).alias("line"))


def notes(optimized: DataFrame) -> DataFrame:
    """``(rel, note)`` of the files with something to say, quiet or not."""
    return optimized.filter("note <> ''").select("rel", "note")


def first_error(optimized: DataFrame) -> DataFrame:
    """One row: the error of the first unreadable path, or null."""
    return optimized.agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.struct("rel", "ordinal"))).alias("error"))


def done_line(files: Column, optimized: Column, orig: Column, new: Column, saved: Column) -> Column:
    """The closing line of a run."""
    pct = F.format_string("%.1f", F.bround(percent_smaller(orig, new), 1))
    text = F.concat(F.lit("done: "), files.cast("string"), F.lit(" files, "), optimized.cast("string"), F.lit(" optimized, "), human_bytes(orig), F.lit(" -> "), human_bytes(new), F.lit(" ("), pct, F.lit("% smaller)"))
    return F.when(saved > 0, F.concat(text, F.lit(", "), human_bytes(saved), F.lit(" deduped"))).otherwise(text)
