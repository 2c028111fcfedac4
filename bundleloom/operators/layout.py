"""Content dedup and archive layout.

Bodies are told apart by method and SHA-256 of their content, the first path owning each.  Offsets are an
exclusive running sum in path order.  A global running sum has no key, so it is made in two steps: rows are
range-partitioned by path and written with the number of their range, each range sums for itself, and the
range totals (one row each) shift it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bundleloom.staging import stage

LOCAL, CENTRAL = 30, 46
LIMIT = 0xFFFFFFFF


def content_key(data: Column) -> Column:
    return F.sha2(data, 256)


def entries(files: DataFrame) -> DataFrame:
    """``files(rel, ordinal, method, hash)`` -> with owner_rel and is_owner; payloads stay behind.

    The owner is the least (rel, ordinal) of a body, by aggregation and an equi-join: partial sums keep a
    body that very many files share from landing in one task.
    """
    key = ["method", "hash"]
    first = files.groupBy(*key).agg(F.min(F.struct("rel", "ordinal")).alias("o"))
    out = files.join(first, key)
    return out.select(*files.columns, F.col("o.rel").alias("owner_rel"), (F.struct("rel", "ordinal") == F.col("o")).alias("is_owner"))


def local_length(rel: Column, uncomp: Column, comp: Column) -> Column:
    """Bytes of a body's record: header, name, 64-bit extra where sizes need it, payload."""
    extra = F.when((uncomp >= LIMIT) | (comp >= LIMIT), 20).otherwise(0)
    return (F.lit(LOCAL) + F.octet_length(rel) + extra + comp).cast("long")


def central_length(rel: Column, uncomp: Column, comp: Column, offset: Column) -> Column:
    """Bytes of a directory record; its extra holds only the fields that need 64 bits."""
    big = [F.when(x >= LIMIT, 8).otherwise(0) for x in (uncomp, comp, offset)]
    total = big[0] + big[1] + big[2]
    return (F.lit(CENTRAL) + F.octet_length(rel) + F.when(total > 0, total + 4).otherwise(0)).cast("long")


def running_offsets(rows: DataFrame, order: list[str], length: str, out: str = "local_offset", parts: int | None = None) -> DataFrame:
    """``rows`` with the exclusive running sum of ``length`` in ``order``, without a single-task window."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once: both uses below see the same ranges, whatever a second sampling would give
    ranged = stage(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranged = ranged.withColumn("_here", F.coalesce(F.sum(length).over(own), F.lit(0)))
    totals = ranged.groupBy("_part").agg(F.sum(length).alias("_sum"))  # one row for each partition
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    return ranged.join(F.broadcast(totals), "_part").withColumn(out, F.col("_here") + F.col("_ahead")).drop("_part", "_here", "_ahead")


def dedup_savings(rows: DataFrame) -> DataFrame:
    """One row: bytes saved by entries that share a body (30, the name, and the compressed body each)."""
    saved = F.sum(F.when(~F.col("is_owner"), F.lit(LOCAL) + F.octet_length("rel") + F.col("comp_size")))
    return rows.agg(F.coalesce(saved, F.lit(0)).cast("long").alias("dedup_saved"))
