"""SimHash near-duplicates: fingerprints of word shingles, linked by bit-sliced comparison.

Fingerprints are made from whole texts.  Distinct fingerprints are bucketed by the pigeonhole rule (of
``radius + extra`` bit blocks, at least ``extra`` agree), so every pair within the radius shares a bucket.
Within buckets the 64 bit planes are stored vertically, one bit per row; comparing all rows with the rows
``d`` places on is a shift and an exclusive or of each plane, and carry-save counters of a few bits hold
all distances at once.  A block of rows is abandoned once every distance in it is over the radius.
Large buckets are cut into chunks compared pair by pair in tasks of their own; each task returns a
spanning forest of its links, never all pairs.

:func:`near` is the search for a radius too wide for buckets (a Jaccard similarity of 0.8): fingerprints of
``WORDS`` * 64 bits, every one compared with every other.  The planes of the first 128 bits are compared as above,
and all bits are counted where these lie within ``FIRST``.

Defined cases: null or empty texts have no words and fingerprint zero, linked like any other; texts of
fewer words than a shingle are hashed whole; null ids take part but never name a component (a component
of null ids only has a null id); repeated rows give repeated results.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bundleloom.llm.common import by_place, connected_components, give_back, place, stage, text_slices

SEED = 42
RADIUS = 4
#: Rows of one bucket compared in one task; larger buckets are cut into chunks of this many.
CHUNK = 4096
#: Rows that one comparing task holds at a time, about.
TASK_ROWS = 60_000

#: Words of a wide fingerprint, bits of the first two that may differ, and of them all.  Sets of similarity 0.8 lie
#: beyond FIRST with a chance of at most 2.7e-9, beyond RADIUS_WIDE of 8.1e-11 (four shingles against five; 7.8e-13
#: and 1.3e-17 for sets of many); unrelated ones within RADIUS_WIDE with one of 1.7e-12.
WORDS = 6
FIRST = 52
RADIUS_WIDE = 124
#: Wide fingerprints of one chunk, and words of a plane compared at a time.
SIDE = 16_384
LANE_WORDS = 4096

#: For each byte, its eight bits as eight 8-bit counters in one number.
_SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype=np.uint64)


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 of each shingle of the lower-cased (A-Z) words, repeats included."""
    if not text:
        return []
    flat = b" ".join(text.encode("utf-8", "surrogatepass").lower().split())
    if not flat:
        return []
    h = xxhash.xxh64_intdigest
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    if len(gaps) < width:
        return [h(flat, SEED)]
    starts = [0, *(gaps[: len(gaps) - width + 2] + 1).tolist()][: len(gaps) - width + 2]
    ends = [*gaps[width - 1 :].tolist(), len(flat)]
    return [h(flat[s:e], SEED) for s, e in zip(starts, ends)]


def fingerprints(texts: list, width: int) -> np.ndarray:
    """64-bit majority of the shingle hashes of each text; zero where there are none."""
    each = [shingle_hashes(t, width) for t in texts]
    lens = np.array([len(x) for x in each], dtype=np.int64)
    return majority(np.fromiter(itertools.chain.from_iterable(each), dtype=np.uint64, count=int(lens.sum())), lens)


def majority(flat: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A fingerprint for each run of ``lens`` hashes: the bits set in over half of them."""
    out = np.zeros(len(lens), dtype=np.uint64)
    if not lens.sum():
        return out
    used = np.flatnonzero(lens)
    first = np.cumsum(lens) - lens
    # cut into runs of at most 255 hashes, whose 8-bit counters can't overflow
    cuts = np.concatenate([np.arange(first[i], first[i] + lens[i], 255) for i in used])
    of = np.searchsorted(cuts, first[used])
    small = np.add.reduceat(_SPREAD[flat.view(np.uint8).reshape(-1, 8)], cuts, axis=0).view(np.uint8).reshape(-1, 64)
    counts = np.add.reduceat(small, of, axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > lens[used, None], axis=1, bitorder="little")
    out[used] = bits.view(np.uint64).ravel()
    return out


def wide(flat: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Fingerprints of ``WORDS`` words each: the majority of the hashes, then of remixes of them (SplitMix64)."""
    out = [majority(flat, lens)]
    for k in range(1, WORDS):
        z = flat + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(majority(z ^ (z >> np.uint64(31)), lens))
    return np.stack(out, axis=1)


def fingerprint(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)``: the fingerprint of every whole text as a signed long."""

    def run(batches):
        for b in batches:
            for part, texts in text_slices(b):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints(texts, width).view(np.int64))], ["id", "fp"])
        give_back()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "id long, fp long")


# ---------------------------------------------------------------- bit-sliced comparison


def _bits(fps: np.ndarray) -> np.ndarray:
    """The bits of each fingerprint, a row each."""
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes, stored vertically: row b holds bit b of all fingerprints (of one word, or a row of words), 64 of them in a word."""
    n = -(-len(fps) // 64) * 64
    bits = _bits(fps)
    full = np.zeros((bits.shape[1], n), dtype=np.uint8)
    full[:, : len(fps)] = bits.T
    return np.packbits(full, axis=1, bitorder="little").view(np.uint64)


def _shifted(planes: np.ndarray, d: int, words: int) -> np.ndarray:
    """Lane i of the result is lane i + d of the planes."""
    w, s = divmod(d, 64)
    out = np.zeros((planes.shape[0], words), dtype=np.uint64)
    part = planes[:, w : w + words + 1]
    out[:, : min(words, part.shape[1])] = part[:, :words] >> np.uint64(s)
    if s and part.shape[1] > 1:
        over = part[:, 1 : words + 1] << np.uint64(64 - s)
        out[:, : over.shape[1]] |= over
    return out


def within(left: np.ndarray, right: np.ndarray, radius: int, block: int = 256) -> np.ndarray:
    """Lanes (as bits) whose planes (64, or a multiple) differ in at most ``radius`` places.

    Carry-save: each plane's difference is added to a vertical counter; a lane that passes the radius is
    marked over for good, and a block of words is abandoned once all its lanes are over.
    """
    width = max(1, radius.bit_length())
    words = left.shape[1]
    out = np.zeros(words, dtype=np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for at in range(0, words, block):
        a, b = left[:, at : at + block], right[:, at : at + block]
        counter = [np.zeros(a.shape[1], dtype=np.uint64) for _ in range(width)]
        over = np.zeros(a.shape[1], dtype=np.uint64)
        for p in range(0, len(left), 2):
            # two planes at once: a full adder on the lowest counter bit
            x, y = a[p] ^ b[p], a[p + 1] ^ b[p + 1]
            half = counter[0] ^ x
            carry = (counter[0] & x) | (half & y)
            counter[0] = half ^ y
            for k in range(1, width):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            over |= carry
            if p >= 14 and p % 8 == 6:
                if (_beyond(counter, over, radius) == full).all():
                    break
        else:
            out[at : at + block] = ~_beyond(counter, over, radius)
    return out


def _beyond(counter: list, over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose vertical counter is over the radius."""
    more, same = over.copy(), ~np.zeros_like(over)
    for k in reversed(range(len(counter))):
        if (radius >> k) & 1:
            same = same & counter[k]
        else:
            more |= same & counter[k]
            same = same & ~counter[k]
    return more


def lanes(bits: np.ndarray, n: int) -> np.ndarray:
    """Places of the set lanes below n."""
    words = np.flatnonzero(bits)
    if not len(words):
        return words
    found = np.flatnonzero(np.unpackbits(bits[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").ravel())
    at = words[found // 64] * 64 + found % 64
    return at[at < n]


class Forest:
    """Union-find over places 0..n-1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Hook whole arrays of links, then flatten, until they all agree."""
        up = self.up
        while True:
            x, y = up[a], up[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(flat := up[up], up):
                up[:] = flat

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(places, the place each hangs on), without those that hang on none."""
        child = np.flatnonzero(self.up != np.arange(len(self.up)))
        return child, self.up[child]


def hooked(fps: np.ndarray, bucket: np.ndarray, side: np.ndarray, radius: int, confirm: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, the place each hangs on): a spanning forest of the links among rows that share a bucket.

    side: 0 for rows compared with all others of their bucket; in a bucket of two chunks, 1 and 2 mark
    the chunks, and only links across them are looked for.  confirm, if given, decides about pairs of places
    within the radius that are not joined yet.
    """
    _, inverse, sizes = np.unique(bucket, return_inverse=True, return_counts=True)
    order = np.lexsort((inverse, -sizes[inverse]))
    fps, side, inverse = fps[order], side[order], inverse[order]
    sizes = sizes[inverse]
    n, forest = len(fps), Forest(len(fps))
    planes = planes_of(fps)
    for d in range(1, int(sizes[0])):
        active = int(np.searchsorted(-sizes, -d, side="left"))  # rows of buckets larger than d come first
        words = -(-active // 64)
        hit = lanes(within(planes[:, :words], _shifted(planes, d, words), radius), min(active, n - d))
        if len(hit):
            hit = hit[(inverse[hit] == inverse[hit + d]) & ((side[hit] == 0) | (side[hit] != side[hit + d]))]
            if confirm is not None and len(hit := hit[forest.up[hit] != forest.up[hit + d]]):
                hit = hit[confirm(order[hit], order[hit + d])]
            forest.join(hit, hit + d)
    child, up = forest.links()
    return order[child], order[up]


def link_sorted(fps: np.ndarray, bucket: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among fingerprints that share a bucket; see :func:`hooked`."""
    a, b = hooked(fps, bucket, side, radius)
    return fps[a], fps[b]


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which wide fingerprints differ, row by row."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def crossed(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in a, places in b) of all pairs whose first 128 bits lie within ``FIRST``, some rows of b at a time.

    The planes of a are compared with each row of b spread over whole words.
    """
    if not len(a) or not len(b):
        return
    planes = planes_of(a[:, :2])
    words = planes.shape[1]
    step = min(len(b), max(1, LANE_WORDS // words))
    left, spread = np.tile(planes, step), np.uint64(0) - _bits(b[:, :2]).T.astype(np.uint64)
    for at in range(0, len(b), step):
        right = np.repeat(spread[:, at : at + step], words, axis=1)
        hit = lanes(within(left[:, : right.shape[1]], right, FIRST, block=4096), 64 * right.shape[1])
        i, j = hit % (64 * words), at + hit // (64 * words)
        yield i[i < len(a)], j[i < len(a)]


def link_wide(fps: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links, as places, among wide fingerprints within ``RADIUS_WIDE``: of all (side 0), or across sides 1 and 2."""
    a, forest = np.flatnonzero(side != 2), Forest(len(fps))
    b = np.flatnonzero(side == 2) if side.any() else a
    for i, j in crossed(fps[a], fps[b]):
        i, j = a[i], b[j]
        new = forest.up[i] != forest.up[j]
        i, j = i[new], j[new]
        hit = apart(fps[i], fps[j]) <= RADIUS_WIDE
        forest.join(i[hit], j[hit])
    return forest.links()


def chunk_pairs(key: str, chunks: Column) -> Column:
    """The pairs of chunks (lo, hi) that a row meets others in, chunk numbers by hash, and its side: 0 where both are its own."""
    mine = F.pmod(F.xxhash64(key, F.lit(5)), chunks).cast("int")
    return F.transform(F.sequence(F.lit(0), chunks - 1), lambda o: F.struct(F.least(o, mine).alias("lo"), F.greatest(o, mine).alias("hi"), F.when(o == mine, 0).when(o > mine, 1).otherwise(2).alias("side")))


def near(wides: DataFrame, rows: int) -> DataFrame:
    """``(a, b)``: keys of wide fingerprints ``(key, fp)``, linked so that all pairs within ``RADIUS_WIDE`` are joined.

    Every pair of chunks is a task of its own, so fingerprints (and nothing else) travel once for each ``SIDE`` of them.
    """
    placed = wides.select("key", "fp", F.explode(chunk_pairs("key", F.lit(max(1, -(-rows // SIDE))))).alias("p"))

    def compare(t: pa.Table) -> pa.Table:
        keys, side = t["key"].to_numpy(), t["side"].to_numpy()
        a, b = link_wide(np.frombuffer(b"".join(t["fp"].to_pylist()), np.uint64).reshape(-1, WORDS), side)
        return pa.table({"a": keys[a], "b": keys[b]})

    return placed.select("key", "fp", "p.lo", "p.hi", "p.side").groupBy("lo", "hi").applyInArrow(compare, "a long, b long")


def blocks_for(rows: int, radius: int) -> tuple[int, int]:
    """(bit blocks, blocks that must agree) so that buckets of evenly spread fingerprints stay small."""
    extra = 1
    while extra < 4 and rows / 2 ** (64 * extra / (radius + extra)) > 128:
        extra += 1
    return radius + extra, extra


def links(distinct: DataFrame, rows: int, radius: int = RADIUS) -> DataFrame:
    """``(a, b)``: links that join every pair of distinct fingerprints (column ``fp``) within the radius."""
    blocks, agree = blocks_for(rows, radius)
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for i, combo in enumerate(itertools.combinations(range(blocks), agree)):
        mask = sum(((1 << (edge[b + 1] - edge[b])) - 1) << edge[b] for b in combo)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("key")))
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.table", "k.key")
    sizes = keyed.groupBy("table", "key").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = keyed.join(sizes, ["table", "key"])
    # large buckets: chunk numbers by hash, one task for each pair of chunks
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    placed = keyed.select("fp", "table", "key", "n", F.explode(chunk_pairs("fp", chunks)).alias("p"))
    slots = max(1, -(-rows * len(keys) // TASK_ROWS))
    one = F.xxhash64("table", "key", "p.lo", "p.hi")
    slot = F.when(F.col("n") > CHUNK, one).otherwise(F.pmod(one, F.lit(slots)))
    placed = placed.select("fp", one.alias("bucket"), F.col("p.side").alias("side"), slot.alias("slot"))

    def compare(t: pa.Table) -> pa.Table:
        fps, bucket, side = (t[c].to_numpy() for c in ("fp", "bucket", "side"))
        a, b = link_sorted(fps.view(np.uint64), bucket, side, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return placed.groupBy("slot").applyInArrow(compare, "a long, b long")


def components(docs: DataFrame, width: int = 5, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, component)`` for each row of ``docs``."""
    marked = stage(fingerprint(docs, width, id_col, text_col), "simhash")
    classes = stage(marked.groupBy("fp").agg(F.min("id").alias("low")), "simhash-classes")
    found = connected_components(links(classes.select("fp"), classes.count(), radius))
    of = classes.join(found, classes.fp == found.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    of = stage(of, "simhash-roots")
    lows = of.groupBy("root").agg(F.min("low").alias("component"))
    named = of.join(lows, "root").select("fp", "component")
    return marked.join(named, "fp").select("id", "fp", "component")


def digest(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, fingerprint as hex, component_id."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return components(docs, width).select(F.col("id").alias("doc_id"), hexed.alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, radius: int = RADIUS) -> DataFrame:
    """One document of each component, the one with the smallest id; rows without an id are kept.

    Rows that repeat the kept id are reduced to the first by content.
    """
    return keep_lowest(docs, components(docs.filter(F.col("doc_id").isNotNull()), width, radius))


def keep_lowest(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id names its component in ``(id, component)``, and those without an id."""
    own, doc_id = by_place(docs), F.col(place(docs, "doc_id"))
    kept = named.filter("id = component").groupBy(F.col("id").alias("kept_id")).agg(F.count("*").alias("rows"))
    kept = stage(kept, "simhash-kept")
    # the ids grow with the documents: one plan at every size, never a broadcast
    hit = own.join(kept.hint("merge"), doc_id == F.col("kept_id"), "left_semi")
    rest = own.filter(doc_id.isNull())
    again = kept.filter("rows > 1")
    if not again.isEmpty():
        # only rows that repeat an id are brought together
        one = hit.join(again.hint("merge"), doc_id == F.col("kept_id"), "left_semi").groupBy(doc_id.alias("kept_id")).agg(F.min(F.struct(*own.columns)).alias("row"))
        hit = hit.join(again.hint("merge"), doc_id == F.col("kept_id"), "left_anti").unionByName(one.select("row.*"))
    return hit.unionByName(rest).toDF(*docs.columns)
