"""Shared pieces: texts and rows some MB at a time, seeded ranks, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bundleloom.staging import stage, unstage


def text_slices(batch: pa.RecordBatch, most: int = 4_000_000, column: int = 1) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of a batch of some MB of text (by default its second column), so that few texts are Python strings at once."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < batch.num_rows:
        done = int(size[at - 1]) if at else 0
        end = max(at + 1, int(size.searchsorted(done + most, side="right")))
        part = batch.slice(at, end - at)
        yield part, part.column(column).to_pylist()
        at = end


def give_back() -> None:
    """Return what a task has freed to the system: Python workers live on and would keep it from other processes."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def per_batch(fn: Callable[[pa.Array, list], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow body for two-column input (id, text): ``fn(ids, texts)`` gives the batch to return."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                yield fn(part.column(0), texts)
        give_back()

    return run


def by_place(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named c0, c1, ... so that no helper column can clash with one of them."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def place(docs: DataFrame, name: str) -> str:
    """The name that :func:`by_place` gives a column."""
    return f"c{docs.columns.index(name)}"


def map_rows(docs: DataFrame, text_col: str, fn: Callable[[pa.RecordBatch, list], pa.RecordBatch], more: str = "") -> DataFrame:
    """Whole rows of ``docs``, columns by place, through ``fn(part, texts)``, some MB of text at a time.

    ``fn`` gives rows of the same columns, and of those that ``more`` declares.
    """
    plain = by_place(docs)
    at = docs.columns.index(text_col)
    schema = StructType([*plain.schema.fields, *(StructType.fromDDL(more).fields if more else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, column=at):
                yield fn(part, texts)
        give_back()

    return plain.mapInArrow(run, schema)


def few(staged: DataFrame, most: int = 100_000) -> DataFrame:
    """A staged table of narrow rows as a join side: broadcast if it has been counted to be small, else merged."""
    return F.broadcast(staged) if staged.count() <= most else staged.hint("merge")


def seeded(seed: int, *cols: Column) -> Column:
    """A reproducible 64-bit number for a row, from its values alone."""
    return F.xxhash64(F.lit(seed), *cols)


def connected_components(edges: DataFrame, max_rounds: int = 60, merge: bool = False) -> DataFrame:
    """Components of an undirected graph: ``edges(a, b)`` longs -> ``(node, root)``, root the smallest node.

    Alternating large-star and small-star rounds.  Each round is two aggregations by key (combined on the
    map side) and two equi-joins against a table with one row per key, so a hub with a third of all edges
    is split by adaptive skew handling.  Each round is staged in the shared folder; only its checksum
    reaches the driver.  Self loops and nulls are ignored; an empty edge table gives an empty result.
    merge: join by sort and merge at every size, so that no round is gathered on the driver to be broadcast.
    """

    def narrowed(e: DataFrame) -> DataFrame:
        return e.filter("a is not null and b is not null and a <> b").distinct()

    def joined(side: DataFrame) -> DataFrame:
        return side.hint("merge") if merge else side

    def large_star(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = joined(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")))
        up = both.filter("b > a")
        return narrowed(up.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")))

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("low"))
        moved = down.join(joined(low), "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        return narrowed(moved.union(low.select("a", F.col("low").alias("b"))))

    def checksum(e: DataFrame) -> tuple:
        row = e.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("a", "b"), 20))).first()
        return row[0], row[1]

    now = stage(narrowed(edges.select("a", "b")), "edges")
    last, said = None, checksum(now)
    for _ in range(max_rounds):
        if said == last or not said[0]:
            break
        after = stage(small_star(large_star(now)), "edges")
        unstage(now)
        now, last, said = after, said, checksum(after)
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
