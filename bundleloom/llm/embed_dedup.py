"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors of one label are linked at cosine >= ``least``, that is squared distance <= D2 = 2 - 2*least.
A seeded random rotation, made once for each vector and kept, spreads the distance evenly over the coordinates,
which are cut into ``BLOCKS`` low-dimensional blocks; a linked pair must be within its share D2 / BLOCKS in at
least one block.  Each block is range-joined on a grid over its first coordinates, more of them for labels of
more vectors, with cells as wide as that share's radius: a row is compared with its own cell and half of the
neighbouring ones, so each pair meets once a block.

First only ids and the block's slice travel, in half precision with room for its rounding; rows that have a
partner there go on, with their vectors.  A task then checks its pairs in the block, verifies them by the exact
cosine in double precision, and counts a pair only in the first block that holds it: one test, on the kept
coordinates, says for every block whether it does.

Equal vectors are joined beforehand and stand as one row with a count.  Large cells are cut into chunks
compared pair by pair in tasks of their own.  A task returns counts of links by row and a spanning forest
of its links, never all pairs.

Defined cases: unusable vectors (null, empty, zero, null or non-finite components), null labels and null
ids link with nothing and are their own component (a null id has a null component and is kept); vectors
of different lengths are never compared, and there may be any number of lengths; repeated rows of one id count as vectors each.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundleloom.llm.common import connected_components, few, stage
from bundleloom.llm.simhash import Forest
from bundleloom.llm.vectors import cosine, matrix, own, unit, usable

LEAST = 0.98
BLOCKS = 8
#: Coordinates of each block that make up its grid: two for labels of up to so many vectors, one more for each
#: further factor of seven, which is about what a coordinate divides them by.
GRID, MOST_GRID = 2, 5
GRID_ROWS = 100_000
CHUNK = 2048
SLACK = 1e-9
#: Error of a coordinate (at most 1) in half precision, and of its difference.
HALF = 2.0**-10


@functools.lru_cache(8)
def rotation(n: int, seed: int = 17) -> np.ndarray:
    """A seeded random rotation of n dimensions."""
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))[0]


def parts(n: int) -> list[slice]:
    """Block slices of n rotated coordinates."""
    k = min(BLOCKS, n)
    return [slice(n * i // k, n * (i + 1) // k) for i in range(k)]


def _half(dims: int) -> list[tuple]:
    """Half of the neighbours of a cell: those after it in lexical order."""
    return [o for o in itertools.product((-1, 0, 1), repeat=dims) if o > (0,) * dims]


def _budget(least: float, n: int) -> float:
    """Squared distance allowed in one block of n dimensions, with room for rounding."""
    return (2 - 2 * least) / len(parts(n)) * (1 + 1e-6) + SLACK


def in_block(r: np.ndarray, i: np.ndarray, j: np.ndarray, block: slice, budget: float) -> np.ndarray:
    """True for pairs of rows that a block holds; the same numbers, summed alike, in every task."""
    gap = r[i, block] - r[j, block]
    return np.einsum("ij,ij->i", gap, gap) <= budget


def _by_size(b: pa.RecordBatch, *names: str):
    """Parts of a batch with the same values of some integer columns."""
    keys = np.stack([b.column(c).to_numpy().astype(np.int64) for c in names], axis=1)
    for key in np.unique(keys, axis=0):
        yield (*key.tolist(), b.filter(pa.array((keys == key).all(axis=1))))


def _rotated(batches):
    """Rows with their rotated unit vector."""
    for b in batches:
        for n, part in _by_size(b, "n"):
            r = unit(matrix(part.column("v"))) @ rotation(n)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, r.size + 1, n, dtype=np.int32)), pa.array(r.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "r"])


def _cells(least: float, b: pa.RecordBatch):
    """For each block and neighbour: (block number, its slice of the rows, cell of each row, side).

    side 0 at home, 1 as a visitor to an earlier neighbour cell.
    """
    for n, grid, part in _by_size(b, "n", "grid"):
        r = matrix(part.column("r"))
        width = max(1e-3, np.sqrt(_budget(least, n)) * (1 + 1e-9))
        for p, s in enumerate(parts(n)):
            dims = min(grid, s.stop - s.start)
            home = np.floor(r[:, s.start : s.start + dims] / width).astype(np.int64)
            for o in [(0,) * dims, *_half(dims)]:
                cell = np.zeros(len(r), dtype=np.int64)
                for c in (home - np.array(o)).T:
                    cell = cell * (1 << 12) + c + (1 << 11)
                yield part, p, r[:, s], cell, int(any(o))


KEY = ["label", "n", "part", "cell"]


def _counted(least: float):
    """Rows and homes in each cell, as counts of each batch."""

    def run(batches):
        for b in batches:
            for part, p, _, cell, side in _cells(least, b):
                labels = part.column("label").dictionary_encode()
                keys, many = np.unique(np.stack([labels.indices.to_numpy().astype(np.int64), cell]), axis=1, return_counts=True)
                k = len(many)
                n = pa.array(np.full(k, part.column("n")[0].as_py(), np.int32))
                yield pa.RecordBatch.from_arrays(
                    [labels.dictionary.take(pa.array(keys[0])), n, pa.array(np.full(k, p, np.int32)), pa.array(keys[1]), pa.array(many), pa.array(many * (side == 0))],
                    [*KEY, "rows", "homes"],
                )

    return run


def _placed(least: float):
    """Where each row is compared, with the block's slice in half precision."""

    def run(batches):
        for b in batches:
            for part, p, block, cell, side in _cells(least, b):
                k = part.num_rows
                same = lambda x: pa.array(np.full(k, x, np.int32))
                raw = np.ascontiguousarray(block.astype(np.float16))
                ends = np.arange(0, raw.nbytes + 1, raw.nbytes // k, dtype=np.int32)
                packed = pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(ends), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([part.column("label"), part.column("n"), same(p), pa.array(cell), part.column("k"), same(side), packed], [*KEY, "k", "side", "slice"])

    return run


def _near(sub: np.ndarray, side: np.ndarray, half: np.ndarray, budget: float):
    """Pairs (home, other) of rows within a squared distance in a block, some millions tried at a time.

    Home with home once, home with visitor always; of two chunks only across them.
    """
    norm = np.einsum("ij,ij->i", sub, sub)
    home = np.flatnonzero(side == 0)
    step = max(1, 4_000_000 // max(1, len(sub)))
    for lo in range(0, len(home), step):
        a = home[lo : lo + step]
        x, y = np.nonzero(norm[a, None] + norm[None, :] - 2 * sub[a] @ sub.T <= budget)
        x = a[x]
        ok = ((side[y] == 1) | (x < y)) & (x != y) & ((half[x] == 0) | (half[x] != half[y]))
        yield x[ok], y[ok]


def _partnered(least: float):
    """Rows of a cell (or of two chunks of it) that may have a partner there."""

    def run(t: pa.Table) -> pa.Table:
        sub = np.frombuffer(b"".join(t["slice"].to_pylist()), np.float16).reshape(t.num_rows, -1).astype(np.float64)
        side, half = t["side"].to_numpy(), t["half"].to_numpy()
        room = (np.sqrt(_budget(least, t["n"][0].as_py())) + HALF * np.sqrt(sub.shape[1])) ** 2 + SLACK
        keep = np.zeros(t.num_rows, dtype=bool)
        for x, y in _near(sub, side, half, room):
            keep[x] = keep[y] = True
        return t.filter(pa.array(keep)).drop_columns(["slice"])

    return run


def _compare(least: float):
    def run(t: pa.Table) -> pa.Table:
        k, rep, many, side, half = (t[c].to_numpy() for c in ("k", "rep", "many", "side", "half"))
        part = int(t["part"][0].as_py())
        raw, r = matrix(t["v"]), matrix(t["r"])
        n = raw.shape[1]
        cuts, budget = parts(n), _budget(least, n)
        links, forest = np.zeros(len(rep), dtype=np.int64), Forest(len(rep))
        for x, y in _near(np.ascontiguousarray(r[:, cuts[part]]), side, half, budget + SLACK):
            for at in range(0, len(x), 200_000):
                i, j = x[at : at + 200_000], y[at : at + 200_000]
                first = in_block(r, i, j, cuts[part], budget)
                for c in cuts[:part]:  # counted by an earlier block?
                    first &= ~in_block(r, i, j, c, budget)
                i, j = i[first], j[first]
                hit = cosine(raw[i], raw[j]) >= least
                i, j = i[hit], j[hit]
                np.add.at(links, i, many[j])
                np.add.at(links, j, many[i])
                forest.join(i, j)
        child = np.flatnonzero(forest.up != np.arange(len(rep)))
        mine = np.flatnonzero(links)
        return pa.table({
            "a": pa.array(np.append(rep[child], k[mine]), pa.int64()),
            "b": pa.array(np.append(rep[forest.up[child]], k[mine]), pa.int64()),
            "links": pa.array(np.append(np.zeros(len(child), np.int64), links[mine]), pa.int64()),
        })

    return run


def near_duplicates(table: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``table`` (vec_id, embedding, label)."""
    every = table.select(F.col("vec_id").cast("long").alias("id"), F.col("label"), F.col("embedding"))
    rows = own(table, "label").filter("id is not null and label is not null")
    alike = rows.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("many")).withColumn("n", F.size("v"))
    label, v = dict(alike.dtypes)["label"], dict(alike.dtypes)["v"]
    turned = alike.mapInArrow(_rotated, f"label {label}, v {v}, rep long, many long, n int, r array<double>")
    # k tells apart different vectors of one id; written with the rows, so it is settled once
    reps = stage(turned.withColumn("k", F.monotonically_increasing_id()), "vectors")
    sizes = stage(reps.groupBy("label", "n").agg(F.count("*").alias("rows")), "vector-labels")
    deeper = F.ceil(F.log(F.greatest(F.lit(1.0), F.col("rows") / GRID_ROWS)) / F.log(F.lit(7.0)))
    grid = F.least(F.lit(MOST_GRID), F.lit(GRID) + deeper).cast("int").alias("grid")
    gridded = reps.join(few(sizes.select("label", "n", grid)), ["label", "n"]).select("label", "n", "grid", "k", "r")
    key = f"label {label}, n int, part int, cell long"
    counts = gridded.mapInArrow(_counted(least), f"{key}, rows long, homes long").groupBy(*KEY).agg(F.sum("rows").alias("rows"), F.sum("homes").alias("homes"))
    big = few(stage(counts.filter("rows > 1 and homes > 0").select(*KEY, F.ceil(F.col("rows") / CHUNK).cast("int").alias("chunks")), "vector-cells"))
    placed = gridded.mapInArrow(_placed(least), f"{key}, k long, side int, slice binary").join(big, KEY)
    mine = F.pmod(F.xxhash64("k", F.lit(9)), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least(o, mine).alias("lo"), F.greatest(o, mine).alias("hi"), F.when(o == mine, 0).when(o > mine, 1).otherwise(2).alias("half")))
    placed = placed.withColumn("c", F.explode(pairs)).select(*KEY, "c.lo", "c.hi", "c.half", "k", "side", "slice")
    live = placed.groupBy(*KEY, "lo", "hi").applyInArrow(_partnered(least), f"{key}, lo int, hi int, half int, k long, side int")
    # what is left is small or truly similar: only now the vectors are fetched
    full = stage(live, "vector-partners").hint("merge").join(reps.select("k", "rep", "many", "v", "r"), "k")
    # rows of links: ids that hang together, and for each vector (a = b = k) its number of links
    found = full.groupBy(*KEY, "lo", "hi").applyInArrow(_compare(least), "a long, b long, links long")
    found = stage(found, "vector-links")
    roots = connected_components(found.filter("links = 0")).select(F.col("node").alias("rep"), "root")
    links = found.filter("links > 0").groupBy(F.col("a").alias("k")).agg(F.sum("links").alias("links"))
    ids = reps.select("label", "v", "k", "rep", "many").join(roots, "rep", "left").join(links, "k", "left")
    ids = ids.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    named = rows.join(ids, ["label", "v"]).select("id", "n_links", "root")
    rest = every.withColumn("v", F.col("embedding").cast("array<double>"))
    rest = rest.filter(F.col("id").isNull() | F.col("label").isNull() | ~usable(F.col("v")))
    rest = rest.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("root"))
    out = named.unionByName(rest)
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("root").alias("component_id"), F.coalesce(F.col("id") == F.col("root"), F.lit(True)).alias("kept"))


def digest(table: DataFrame) -> DataFrame:
    return near_duplicates(table)
