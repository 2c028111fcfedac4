"""Mixing sources to target weights by subset-sum budget fitting.

Each source's target is met by whole copies of all its documents (as many as fit) and, for the remaining
budget, a subset: documents are counted by exact length, a proportional share of each length is taken,
and bounded-knapsack dynamic programming over the lengths settles the rest to the word.  The documents
that fill the counts are those with the smallest seeded hash, so reruns agree.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; documents of
size 0 are never taken; an empty table gives an empty result; repeated rows count as documents each (of
rows alike in source, size and id any may be taken, which gives the same rows).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bundleloom.llm.common import give_back, map_rows, place, seeded, stage, text_slices

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 23
#: Documents of one source and length ranked in one task; more are cut by hash first.
SPLIT = 20_000
#: Words of a source's budget that dynamic programming settles.
ROOM = 1 << 20


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``(source, total)`` -> also ``target``: weights by code point order of the sources, null last.

    Resharing the excess of capped sources by weight settles at one level for all others; with sources in
    order of cap/weight that level follows from running sums.  One row per source, so one task is enough.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    t = totals.withColumn("weight", weight.cast("double")).withColumn("cap", (F.col("total") * most).cast("double"))
    upward = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy(F.lit(1))
    before = upward.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("pot", F.sum("total").over(everything).cast("double") * share)
    t = t.withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("level", (F.col("pot") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.col("rest"))
    open_ = F.col("level") * F.col("weight") <= F.col("cap")  # once true, true for all that follow
    level = F.min(F.when(open_, F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)
    return t.select("source", "total", F.coalesce(F.least("cap", level["level"] * F.col("weight")), F.col("cap")).alias("target"))


def fill(lengths: np.ndarray, counts: np.ndarray, budget: int, room: int = ROOM) -> np.ndarray:
    """How many documents of each length to take so that their lengths sum as near ``budget`` as they can.

    lengths ascending and positive.  A proportional share is taken first, and dynamic programming settles the
    last ``room`` words, whatever the lengths, in memory of that order.  Where the budget is within ``room`` no
    sum is nearer; otherwise what is left over or short is never more than half the longest length.
    A document longer than ``room`` words takes no part in the programme and is added where that comes nearer.
    """
    whole = int((lengths * counts).sum())
    if budget <= 0 or not len(lengths):
        return np.zeros(len(lengths), dtype=np.int64)
    if budget >= whole:
        return counts.copy()
    take = np.minimum(counts, np.floor(counts * (budget / whole)).astype(np.int64))
    left = budget - int((take * lengths).sum())
    # the programme gets the last words of the budget, by taking more or giving back
    short = int(np.searchsorted(lengths, room, side="right"))
    room = min(budget, room)
    for i in reversed(range(len(lengths))):
        size = int(lengths[i])
        more = min(int(counts[i] - take[i]), (left - room) // size) if left > room else -min(int(take[i]), -(-(room - left) // size))
        take[i] += more
        left -= more * size
    if short and left > 0:
        left -= _settle(lengths[:short], counts[:short], take[:short], left)
    spare = [i for i in range(short, len(lengths)) if take[i] < counts[i]]
    if spare and abs(left - int(lengths[near := min(spare, key=lambda i: abs(left - int(lengths[i])))])) < abs(left):
        take[near] += 1
    return take


def _settle(lengths: np.ndarray, counts: np.ndarray, take: np.ndarray, left: int) -> int:
    """Bounded knapsack: raises ``take`` by a sum as near ``left`` as there is, and gives that sum."""
    top = left + int(lengths[-1])
    reached, by = np.zeros(top + 1, dtype=bool), np.full(top + 1, -1, dtype=np.int32)  # which item first reached each sum
    reached[0] = True
    items: list[tuple[int, int]] = []
    for i in range(len(lengths)):
        spare, size = min(int(counts[i] - take[i]), top // int(lengths[i])), 1
        while spare > 0 and not reached[left]:
            n = min(size, spare)
            w = n * int(lengths[i])
            new = ~reached[w:]
            new &= reached[: top + 1 - w]
            by[w:][new] = len(items)
            reached[w:] |= new
            items.append((i, n))
            spare, size = spare - n, size * 2
        if reached[left]:
            break
    sums = np.flatnonzero(reached)
    found = at = int(sums[np.abs(sums - left).argmin()])
    while at:
        i, n = items[by[at]]
        take[i] += n
        at -= n * int(lengths[i])
    return found


def plan(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """From ``(source, size)`` rows, for each source and size: n, total, target, copies of all (epochs) and picks.

    A task holds the lengths of one source, a row each, and no documents.
    """
    hist = stage(sizes.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-lengths")
    goal = targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total")), weights, share, most)
    h, g = hist.alias("h"), goal.alias("g")
    joined = h.join(g, F.col("h.source").eqNullSafe(F.col("g.source"))).select("h.source", "size", "n", "total", "target")

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by("size")
        size, n = (t[c].to_numpy().astype(np.int64) for c in ("size", "n"))
        total, target = t["total"][0].as_py(), t["target"][0].as_py()
        epochs = int(target // total) if total else 0
        picks, some = np.zeros(len(size), np.int64), size > 0
        picks[some] = fill(size[some], n[some], round(target) - epochs * total)
        return t.append_column("epochs", pa.array(np.where(some, epochs, 0), pa.int64())).append_column("picks", pa.array(picks, pa.int64()))

    out = "source string, size long, n long, total long, target double, epochs long, picks long"
    return stage(joined.groupBy("source").applyInArrow(one, out), "mix-plan")


def words_in(texts: list) -> pa.Array:
    """Words of each whole text."""
    return pa.array([len(t.encode("utf-8", "surrogatepass").split()) if t else 0 for t in texts], pa.int64())


def counted(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, source, size)``: words of each whole text."""

    def run(batches):
        for b in batches:
            for part, texts in text_slices(b, column=2):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), words_in(texts)], ["id", "source", "size"])
        give_back()

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col("source").cast("string"), F.col("text").cast("string"))
    return own.mapInArrow(run, "id long, source string, size long")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of each document.

    The picks of a length are its documents with the smallest seeded hash (63 bits), then id.  Lengths with many
    documents are cut into parts of one range of that hash each, so parts change the work and never a pick.
    """
    sized = stage(counted(docs), "mix-sizes")
    # a null source gets a key of its own; the plan grows with sources and lengths: joined by shuffle, never broadcast
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key")
    chosen = plan(sized.select("source", "size"), weights, share, most).select(key, "size", "n", "total", "target", "epochs", "picks")
    mark = F.shiftrightunsigned(seeded(seed, F.col("id")), 1)
    placed = sized.select("id", "source", "size", key, mark.alias("mark")).join(chosen.hint("merge"), ["key", "size"])
    parts = F.ceil(F.col("n") / SPLIT)
    placed = placed.withColumn("part", F.shiftright(F.shiftright("mark", 31) * parts, 32))
    undecided = (F.col("picks") > 0) & (F.col("picks") < F.col("n"))
    group = ["key", "size", "part"]
    # rank within a part; earlier parts of a large group are known by their counts alone
    ranked = placed.filter(undecided).withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("mark", "id")))
    cut = placed.filter(undecided & (F.col("n") > SPLIT)).groupBy(*group).agg(F.count("*").alias("m"))
    ahead = F.coalesce(F.sum("m").over(Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = cut.select(*group, ahead.alias("ahead"))
    picked = F.when(F.col("rank") + F.coalesce("ahead", F.lit(0)) <= F.col("picks"), 1).otherwise(0)
    told = ["id", "source", "size", "total", "target"]
    settled = ranked.join(cut.hint("merge"), group, "left").select(*told, (F.col("epochs") + picked).alias("copies"))
    simple = placed.filter(~undecided).select(*told, (F.col("epochs") + (F.col("picks") > 0).cast("long")).alias("copies"))
    out = settled.unionByName(simple)
    return out.select(F.col("id").alias("doc_id"), "source", "size", F.col("total").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def digest(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def take(docs: DataFrame) -> DataFrame:
    """The mixed documents themselves: each row as often as the mix takes it.

    Rows that share an id are told apart by source and size; among rows alike in these too, the copies that
    the mix takes of them all are dealt out evenly.
    """
    own = mix(docs).filter("copies > 0").groupBy(F.col("doc_id").alias("id"), "source", "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).alias("o")
    doc_id, source, text = (F.col(place(docs, c)) for c in ("doc_id", "source", "text"))
    flat = map_rows(docs, "text", lambda part, texts: part.append_column("words", words_in(texts)), "words long")
    on = doc_id.cast("long").eqNullSafe(F.col("o.id")) & source.cast("string").eqNullSafe(F.col("o.source")) & (F.col("words") == F.col("o.size"))
    hit = flat.join(own.hint("merge"), on)
    # rows alike in all three: told apart by a place, so that their copies come out exactly
    at = F.row_number().over(Window.partitionBy("id", "o.source", "size").orderBy(text))
    each = F.floor(F.col("copies") / F.col("rows")) + F.when(at <= F.col("copies") % F.col("rows"), 1).otherwise(0)
    columns = [f"c{i}" for i in range(len(docs.columns))]
    once = hit.filter("rows = 1").select(*columns, F.col("copies").alias("each"))
    alike = hit.filter("rows > 1").select(*columns, each.alias("each")).filter("each > 0")
    again = F.explode(F.sequence(F.lit(1), F.col("each").cast("int")))
    return once.unionByName(alike).select(*columns, again.alias("copy")).select(*columns).toDF(*docs.columns)
