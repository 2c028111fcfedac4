"""Exact near-duplicates: documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

The SimHash operator at a similarity: fingerprints propose the pairs, exact intersections decide.
Sets are XXH64 of the shingles SimHash uses, made from whole texts; equal sets are one class.

* a set of s shingles needs ceil(0.8 s) of them in some other set.  Hashes are dealt out by value, packed by
  slice and bucket; each bucket tells the slices how many of a set's shingles it has seen elsewhere, and
  most sets drop out.  Shingles that repeat within a slice are settled there and sent once.
* of the rest, the SimHash search (:func:`simhash.near`) compares each fingerprint with all others, bit plane by
  bit plane.  Linked pairs lie some ten of 64 bits apart, and up to 17 were seen, too far for buckets and for
  64 bits to tell from unrelated pairs; so the fingerprints have 384, and a radius that leaves out a pair of
  similarity 0.8 with a chance of at most 3e-9.
* what the search joins, directly or through others, meets whole in one task, large groups chunk by chunk in tasks
  of their own.  There the planes are compared once more, and pairs within the radius that are not joined yet are
  intersected.  Tasks return spanning forests.

The driver gets counts and checksums only, no sets and no sample of them.

Defined cases: null or empty texts have the empty set, all one class; texts of fewer words than a shingle
are hashed whole; rows without an id take no part and are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundleloom.llm.common import connected_components, give_back, stage, text_slices
from bundleloom.llm.simhash import FIRST, RADIUS_WIDE, SEED, WORDS, apart, chunk_pairs, hooked, keep_lowest, near, shingle_hashes, wide

#: Hashes of one bucket, sets of one chunk, and sets one comparing task holds, about.
BUCKET = 1_500_000
CHUNK = 2048
TASK_SETS = 2048
#: Not read any more: nothing is sampled for the driver.  Callers may still set it.
SAMPLE = 4_000


def needed(n: np.ndarray) -> np.ndarray:
    """Shingles that a set of n must share with one that is 0.8 similar or more: ceil(4n / 5)."""
    return (4 * n + 4) // 5


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Ascending distinct shingle hashes."""
    return np.unique(np.array(shingle_hashes(text, width), dtype=np.uint64))


def key_of(hashes: np.ndarray) -> int:
    """A signed number for a whole set."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - 2**63


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def classes_of(docs: DataFrame, width: int) -> DataFrame:
    """``(id, key, n)``: the number and the size of each text's set."""

    def run(batches):
        for b in batches:
            for part, texts in text_slices(b):
                each = [shingle_set(t, width) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([key_of(s) for s in each], pa.int64()), pa.array([len(s) for s in each], pa.int64())], ["id", "key", "n"])
        give_back()

    return _own(docs).mapInArrow(run, "id long, key long, n long")


# ---------------------------------------------------------------- sets that share enough at all

DEALT = "slice long, bucket long, data binary"


def _pack(hashes: np.ndarray, place: np.ndarray) -> bytes:
    """Five low bytes of each hash, then the places byte by byte (whose upper bytes are mostly zero)."""
    return np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes() + np.ascontiguousarray(place.astype(np.int32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    n = len(raw) // 9
    hashes = np.zeros((n, 8), np.uint8)
    hashes[:, :5] = raw[: 5 * n].reshape(n, 5)
    return hashes.view(np.uint64).ravel(), np.ascontiguousarray(raw[5 * n :].reshape(4, n).T).view(np.int32).ravel()


def _deal(width: int, buckets: int):
    def run(batches):
        for b in batches:
            for _, texts in text_slices(b):
                sets = {key_of(s): s for t in texts if len(s := shingle_set(t, width))}
                if not sets:
                    continue
                keys, size = np.array(list(sets), np.int64), np.array([len(s) for s in sets.values()], np.int64)
                flat, place = np.concatenate(list(sets.values())), np.repeat(np.arange(len(size)), size)
                rank = np.argsort(flat, kind="stable")
                flat, place = flat[rank], place[rank]
                twin = flat[1:] == flat[:-1]
                again = np.append(twin, False) | np.append(False, twin)
                here = np.bincount(place[again], minlength=len(size))
                # settled here: sent once, as place -1
                first = ~np.append(False, twin)
                flat, place = flat[first], np.where(again, -1, place)[first]
                of = ((flat >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                used, at = np.unique(of, return_index=True)
                ends = [*at[1:].tolist(), len(flat)]
                name = xxhash.xxh64_intdigest(keys.tobytes(), SEED) - 2**63
                head = np.concatenate([keys, needed(size) - here]).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * (len(used) + 1), pa.int64()), pa.array([-1 - name % buckets, *used.tolist()], pa.int64()), pa.array([head, *(_pack(flat[s:e], place[s:e]) for s, e in zip(at.tolist(), ends))], pa.binary())], ["slice", "bucket", "data"]
                )

    return run


def _seen(t: pa.Table) -> pa.Table:
    """For each slice, how many hashes of each of its sets the bucket holds from elsewhere too."""
    if t["bucket"][0].as_py() < 0:
        return t
    each = [_unpack(x) for x in t["data"].to_pylist()]
    hashes = np.concatenate([h for h, _ in each])
    rank = np.argsort(hashes, kind="stable")
    twin = hashes[rank][1:] == hashes[rank][:-1]
    again = np.zeros(len(hashes), bool)
    again[rank] = np.append(twin, False) | np.append(False, twin)
    out, at = [], 0
    for _, place in each:
        mine = place[again[at : at + len(place)] & (place >= 0)]
        at += len(place)
        out.append(np.bincount(mine).astype(np.int32).tobytes())
    return pa.table({"slice": t["slice"], "bucket": t["bucket"], "data": pa.array(out, pa.binary())})


def _enough(t: pa.Table) -> pa.Table:
    """Sets of a slice that share as many shingles as they need."""
    head = np.array([b < 0 for b in t["bucket"].to_pylist()])
    data = t["data"].to_pylist()
    keys, missing = np.frombuffer(data[int(np.flatnonzero(head)[0])], np.int64).reshape(2, -1)
    missing = missing.copy()
    for i in np.flatnonzero(~head):
        n = np.frombuffer(data[i], np.int32)
        missing[: len(n)] -= n
    return pa.table({"key": keys[missing <= 0]})


def sharing(docs: DataFrame, width: int, hashes: int) -> DataFrame:
    """``key`` of every set that may have a similar other one."""
    buckets = max(1, -(-hashes // BUCKET))
    dealt = _own(docs).mapInArrow(_deal(width, buckets), DEALT)
    told = dealt.groupBy("bucket").applyInArrow(_seen, DEALT)
    return told.groupBy("slice").applyInArrow(_enough, "key long").distinct()


# ---------------------------------------------------------------- candidates and links


def _sets(width: int):
    def run(batches):
        for b in batches:
            for _, texts in text_slices(b):
                each = [s for t in texts if len(s := shingle_set(t, width))]
                if each:
                    fps = wide(np.concatenate(each), np.array([len(s) for s in each], np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array([key_of(s) for s in each], pa.int64()), pa.array([f.tobytes() for f in fps], pa.binary()), pa.array([s.tobytes() for s in each], pa.binary())], ["key", "fp", "hashes"])
        give_back()

    return run


def link_sets(sets: list, fps: np.ndarray, bucket: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links, as places, of the sets of one bucket at Jaccard 0.8 or more; fps are wide, side as for fingerprints."""
    size = np.array([len(s) for s in sets], np.int64)
    end = np.cumsum(size)
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(values), bool)

    def similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = (apart(fps[a], fps[b]) <= RADIUS_WIDE) & (5 * np.minimum(size[a], size[b]) >= 4 * np.maximum(size[a], size[b]))
        for k in np.flatnonzero(ok):
            i, j = a[k], b[k]
            own = flat[end[i] - size[i] : end[i]]
            mark[own] = True
            both = int(np.count_nonzero(mark[flat[end[j] - size[j] : end[j]]]))
            mark[own] = False
            ok[k] = 5 * both >= 4 * (size[i] + size[j] - both)
        return ok

    return hooked(fps[:, :2], bucket, side, FIRST, similar)


def links(sets: DataFrame) -> DataFrame:
    """``(a, b)``: links that join every similar pair of ``(key, fp, hashes)``."""
    rows = sets.count()
    group = stage(connected_components(near(sets.select("key", "fp"), rows), merge=True), "jaccard-groups")
    sizes = group.groupBy("root").agg(F.count("*").alias("n"))
    # large groups: chunk numbers by hash, one task for each pair of chunks
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    placed = group.join(sizes.hint("merge"), "root").select("node", "root", "n", F.explode(chunk_pairs("node", chunks)).alias("p"))
    one = F.xxhash64("root", "p.lo", "p.hi")
    # small groups share tasks; sets of different groups are told apart by their bucket
    slot = F.when(F.col("n") > CHUNK // 8, one).otherwise(F.pmod(one, F.lit(max(1, -(-rows // TASK_SETS)))))
    placed = placed.select("node", one.alias("bucket"), F.col("p.side").alias("side"), slot.alias("slot"))
    full = placed.join(sets.hint("merge"), placed.node == sets.key).select("slot", "bucket", "side", "key", "fp", "hashes")

    def compare(t: pa.Table) -> pa.Table:
        keys, bucket, side = (t[c].to_numpy() for c in ("key", "bucket", "side"))
        sets = [np.frombuffer(x, np.uint64) for x in t["hashes"].to_pylist()]
        a, b = link_sets(sets, np.frombuffer(b"".join(t["fp"].to_pylist()), np.uint64).reshape(-1, WORDS), bucket, side)
        return pa.table({"a": keys[a], "b": keys[b]})

    return full.groupBy("slot").applyInArrow(compare, "a long, b long")


def components(docs: DataFrame, width: int = 5) -> DataFrame:
    """``(id, component)`` for each row of ``docs``, all of which have an id: the smallest id that similar pairs lead to."""
    # all sides grow with the documents: one plan at every size, never a broadcast, which the driver would gather
    marked = stage(classes_of(docs, width), "jaccard-classes")
    classes = stage(marked.groupBy("key").agg(F.min("id").alias("low"), F.first("n").alias("n")), "jaccard-keys")
    hashes = classes.agg(F.sum("n")).first()[0] or 0
    live = stage(classes.join(sharing(docs, width, hashes).hint("merge"), "key", "left_semi").select("low").distinct(), "jaccard-live")
    own = _own(docs).toDF("doc_id", "text").join(live.hint("merge"), F.col("doc_id") == F.col("low"), "left_semi")
    sets = stage(_own(own).mapInArrow(_sets(width), "key long, fp binary, hashes binary").dropDuplicates(["key"]), "jaccard-sets")
    found = connected_components(links(sets), merge=True).hint("merge")
    of = stage(classes.join(found, classes.key == found.node, "left").select("key", "low", F.coalesce("root", "key").alias("root")), "jaccard-roots")
    lows = of.groupBy("root").agg(F.min("low").alias("component"))
    named = of.join(lows.hint("merge"), "root").select("key", "component")
    return marked.join(named.hint("merge"), "key").select("id", "component")


def keep_one(docs: DataFrame, width: int = 5) -> DataFrame:
    """One document of each component, the one with the smallest id; rows without an id are kept."""
    return keep_lowest(docs, components(docs.filter(F.col("doc_id").isNotNull()), width))
