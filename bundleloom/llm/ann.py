"""Approximate nearest neighbours: a vantage-point tree for each shard of the rows.

The top levels of the tree are made once, from a bounded sample, and cut the rows into cells; a cell larger than
``SHARD`` is dealt over several shards by id.  Every row goes to its one shard, which builds its part
of the tree.  A query goes only to cells that its radius admits: that of its k-th neighbour in the sample.  On
unit vectors the largest cosine is the smallest chord, a metric, so cells and subtrees are skipped when the
triangle inequality, with its bound stretched by ``factor``, puts them beyond the k-th distance found so far.
Factor 1 gives exact search; larger factors skip more.

Queries go through a tree together: a visit to a node handles all queries that need it.  Vectors of one
direction are stored once in a shard with their smallest ids.  All rows within rounding of the k-th place are
kept, and ranked by their exact cosine (extended precision, rounded to double) and id.

Defined cases: unusable vectors (null, empty, zero, null or non-finite components) and null ids take no
part; vectors of different lengths are never compared; repeated rows of one id count as one candidate
each, except that a query never finds its own id; a repeated query row is searched once, and different vectors of
one query id are ranked each for itself; fewer than k candidates give fewer rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bundleloom.llm.common import few, seeded, stage
from bundleloom.llm.vectors import fine_cosine, fine_unit, matrix, own, unit

K = 5
FACTOR = 1.15
LEAF = 96
#: Rows of a shard (of 64 components; longer vectors count for more) and queries of a block, about.
SHARD = 64_000
BLOCK = 50_000
#: Rows sampled for the top of the tree, and its most and least cells.
SAMPLE = 2048
CELLS, SOME_CELLS = 1024, 8
#: Room for rounding in cosines and in chords.
NEAR, FAR = 1e-12, 1e-7


def chord(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cosines))


def vantage(rows: np.ndarray, at: np.ndarray, rng) -> np.ndarray:
    """The row, of a few tried, whose distances to others spread the most."""
    trial, others = rows[rng.choice(at, 8)], rows[rng.choice(at, 64)]
    return trial[int(chord(trial @ others.T).std(axis=1).argmax())]


class Tree:
    """Vantage-point tree over unit rows: median splits by rank, so equal distances can't unbalance it."""

    def __init__(self, rows: np.ndarray, seed: int = 5):
        self.rows, self.order = rows, np.arange(len(rows))
        self.rng = np.random.default_rng(seed)
        self.root = self._build(0, len(rows))

    def _build(self, lo: int, hi: int):
        if hi - lo <= LEAF:
            return (lo, hi)
        at = self.order[lo:hi]
        point = vantage(self.rows, at, self.rng)
        d = chord(self.rows[at] @ point)
        rank = np.argsort(d, kind="stable")
        self.order[lo:hi] = at[rank]
        mid = (hi - lo) // 2
        d = d[rank]
        return point, (d[0], d[mid - 1]), (d[mid], d[-1]), self._build(lo, lo + mid), self._build(lo + mid, hi)

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(distances, places in rows) of the k nearest found of each query; missing ones are inf, -1."""
        q, row = self.near(queries, k, factor)
        d = chord(np.einsum("ij,ij->i", queries[q], self.rows[row]))
        order = np.lexsort((d, q))
        q, row, d = q[order], row[order], d[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        q, row, d, nth = (x[nth < k] for x in (q, row, d, nth))
        best, who = np.full((len(queries), k), np.inf), np.full((len(queries), k), -1)
        best[q, nth], who[q, nth] = d, row
        return best, who

    def near(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs: of each query the k nearest rows found, and all within rounding of the last of them."""
        self.q, self.k, self.factor = queries, k, factor
        self.best = np.full((len(queries), k), -np.inf)  # the k largest cosines, ascending
        self.seen: list[tuple] = []
        self._visit(self.root, np.arange(len(queries)))
        if not self.seen:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        q, row, s = (np.concatenate(x) for x in zip(*self.seen))
        ok = s >= self.best[q, 0] - NEAR
        return q[ok], row[ok]

    def _visit(self, node, qs: np.ndarray) -> None:
        if not len(qs):
            return
        if len(node) == 2:
            at = self.order[node[0] : node[1]]
            s = self.q[qs] @ self.rows[at].T
            better = s.max(axis=1) >= self.best[qs, 0] - NEAR
            qs, s = qs[better], s[better]
            if len(qs):
                both = np.hstack([self.best[qs], s])
                self.best[qs] = np.sort(np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :], axis=1)
                i, j = np.nonzero(s >= self.best[qs, :1] - NEAR)
                self.seen.append((qs[i], at[j], s[i, j]))
            return
        point, inner, outer, left, right = node
        d = chord(self.q[qs] @ point)
        bounds = [np.maximum(0, np.maximum(lo - d, d - hi)) for lo, hi in (inner, outer)]
        first_left = bounds[0] <= bounds[1]
        for child, bound, mine in ((left, bounds[0], first_left), (right, bounds[1], ~first_left)):
            self._near(child, qs[mine], bound[mine])
        for child, bound, mine in ((left, bounds[0], ~first_left), (right, bounds[1], first_left)):
            self._near(child, qs[mine], bound[mine])

    def _near(self, child, qs, bound) -> None:
        self._visit(child, qs[bound * self.factor <= chord(self.best[qs, 0]) + FAR])


class Top:
    """The top levels: vantage points and median distances from a sample; a cell is a path of inner and outer sides."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, depth: int, seed: int = 3):
        self.ids, self.rows, self.splits = ids, rows, {}
        rng = np.random.default_rng(seed)
        todo = [(1, np.arange(len(rows)))]
        while todo:
            name, at = todo.pop()
            if name >> depth or len(at) < 16:
                continue
            point = vantage(rows, at, rng)
            d = chord(rows[at] @ point)
            half = float(np.median(d))
            self.splits[name] = (point, half)
            todo += [(2 * name, at[d <= half]), (2 * name + 1, at[d > half])]

    def cells(self, rows: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        out = np.ones(len(rows), dtype=np.int64)
        for name in sorted(self.splits):
            point, half = self.splits[name]
            mine = np.flatnonzero(out == name)
            out[mine] = 2 * name + (chord(rows[mine] @ point) > half)
        return out

    def admitted(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) for the cells that each query's radius, its k-th distance within the sample, reaches."""
        s = queries @ self.rows.T
        s[ids[:, None] == self.ids[None, :]] = -np.inf
        radius = np.full(len(queries), 2.0)
        if s.shape[1] >= k:
            kth = np.partition(s, s.shape[1] - k, axis=1)[:, -k]
            radius[np.isfinite(kth)] = chord(kth[np.isfinite(kth)])
        out, todo = [], [(1, np.arange(len(queries)))]
        while todo:
            name, at = todo.pop()
            if name not in self.splits:
                out.append((at, np.full(len(at), name)))
                continue
            point, half = self.splits[name]
            d = chord(queries[at] @ point)
            todo.append((2 * name, at[(d - half) * factor <= radius[at] + FAR]))
            todo.append((2 * name + 1, at[(half - d) * factor <= radius[at] + FAR]))
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _top(rows: DataFrame, count: int, shards: int) -> dict[int, Top]:
    """A top for each vector length that the sample holds; others are one cell."""
    share = min(1.0, 4 * SAMPLE / max(1, count))
    mark, upto = seeded(29, F.col("id")), min(2**63 - 1, int(-(2**63) + share * 2**64))
    some = rows.filter(mark <= upto).orderBy(mark, "id").limit(SAMPLE).select("id", "v", "n").toArrow()
    depth = max(0, min(CELLS, max(SOME_CELLS if count > 4 * SAMPLE else 1, shards)) - 1).bit_length()
    n = some["n"].to_numpy()
    out = {}
    for length in np.unique(n):
        part = some.filter(pa.array(n == length))
        out[int(length)] = Top(part["id"].to_numpy(), unit(matrix(part["v"])), depth)
    return out


def _by_length(b: pa.RecordBatch):
    n = b.column("n").to_numpy()
    for length in np.unique(n):
        yield int(length), b.filter(pa.array(n == length))


def _placed(tops: dict[int, Top]):
    """Rows with their cell."""

    def run(batches):
        for b in (part for batch in batches for part in _by_length(batch)):
            top = tops.get(b[0])
            cell = top.cells(unit(matrix(b[1].column("v")))) if top else np.ones(b[1].num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([*b[1].columns, pa.array(cell)], [*b[1].schema.names, "cell"])

    return run


def _routed(tops: dict[int, Top], k: int, factor: float):
    """Queries, once for each cell that admits them."""

    def run(batches):
        for length, b in (part for batch in batches for part in _by_length(batch)):
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                if top := tops.get(length):
                    i, cell = top.admitted(part.column("id").to_numpy(), unit(matrix(part.column("v"))), k, factor)
                else:
                    i, cell = np.arange(part.num_rows), np.ones(part.num_rows, np.int64)
                took = part.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([*took.columns, pa.array(cell)], [*took.schema.names, "cell"])

    return run


FOUND = "query_id long, ask long, vec_id long, score double"


def _search(k: int, factor: float):
    def run(shard: pa.Table, block: pa.Table) -> pa.Table:
        out = {"query_id": [], "ask": [], "vec_id": [], "score": []}
        if shard.num_rows and block.num_rows:
            ids, qids, asks = shard["id"].to_numpy(), block["id"].to_numpy(), block["ask"].to_numpy()
            rank = np.argsort(ids, kind="stable")
            raw, ids = matrix(shard["v"])[rank], ids[rank]
            qraw = matrix(block["v"])
            # one direction once, with its first k ids that are not the query's own
            u = fine_unit(raw)
            keys = np.ascontiguousarray(u + 0.0).view(np.dtype((np.void, u.shape[1] * 8))).ravel()
            _, first, of = np.unique(keys, return_index=True, return_inverse=True)
            by = np.argsort(of, kind="stable")
            cut = np.searchsorted(of[by], np.arange(len(first) + 1))
            # one place more: the query's own direction may hold no other id
            q, w = Tree(u[first]).near(unit(qraw), k + 1, factor)
            order = np.argsort(q, kind="stable")
            q, w = q[order], w[order]
            edge = np.searchsorted(q, np.arange(len(qids) + 1))
            for i in range(len(qids)):
                c = [x for y in w[edge[i] : edge[i + 1]] for x in itertools.islice((x for x in by[cut[y] : cut[y + 1]] if ids[x] != qids[i]), k)]
                if not c:
                    continue
                c = np.array(c)
                s = fine_cosine(qraw[i], raw[c])
                top = np.lexsort((ids[c], -s))[:k]
                out["query_id"] += [qids[i]] * len(top)
                out["ask"] += [asks[i]] * len(top)
                out["vec_id"] += ids[c[top]].tolist()
                out["score"] += s[top].tolist()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table({n: pa.array(c, t) for (n, c), t in zip(out.items(), kinds)})

    return run


def nearest(table: DataFrame, is_query: Column, k: int = K, factor: float = FACTOR, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row that ``is_query`` (on ``vec_id``) marks."""
    rows = own(table, is_query.alias("asks")).filter("id is not null").withColumn("n", F.size("v"))
    total = rows.agg(F.count("*"), F.count_if("asks"), F.sum(F.greatest("n", F.lit(64)))).first()
    blocks = max(1, -(-total[1] // block))
    tops = _top(rows, total[0], -(-(total[2] or 0) // (64 * shard)))
    v = dict(rows.dtypes)["v"]
    placed = stage(rows.select("id", "v", "n").mapInArrow(_placed(tops), f"id long, v {v}, n int, cell long"), "ann-cells")
    # shards of each cell: a row for each cell and vector length
    cells = stage(placed.groupBy("n", "cell").agg(F.ceil(F.count("*") * F.greatest("n", F.lit(64)) / (64 * shard)).cast("int").alias("shards")), "ann-shards")
    cells = few(cells)
    every = lambda m: F.explode(F.sequence(F.lit(0), m - 1))
    of = lambda m, seed, *c: F.pmod(F.xxhash64(F.lit(seed), *c), m).cast("int")
    left = placed.join(cells, ["n", "cell"]).withColumn("s", of(F.col("shards"), 1, "id")).withColumn("b", every(F.lit(blocks))).select("n", "cell", "s", "b", "id", "v")
    asking = rows.filter("asks").select("id", "v", "n").dropDuplicates(["id", "v"]).withColumn("ask", F.xxhash64("v"))
    routed = asking.mapInArrow(_routed(tops, k, factor), f"id long, v {v}, n int, ask long, cell long")
    right = routed.join(cells, ["n", "cell"]).withColumn("b", of(F.lit(blocks), 2, "id")).withColumn("s", every(F.col("shards"))).select("n", "cell", "s", "b", "id", "ask", "v")
    keys = ["n", "cell", "s", "b"]
    part = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k, factor), FOUND)
    order = Window.partitionBy("query_id", "ask").orderBy(F.desc("score"), "vec_id")
    best = part.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def digest(table: DataFrame) -> DataFrame:
    """The registered search: queries are the ids divisible by 50."""
    return nearest(table, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))
