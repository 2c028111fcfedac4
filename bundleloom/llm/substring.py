"""Substring dedup by recompression: words covered by a repeated window of ``window`` words are removed.

Recompression rounds give every document a shorter sequence of symbols.  A round first renames each
maximal run of one symbol, then each adjacent pair whose left symbol falls in one half of the alphabet
and whose right symbol falls in the other.  Names are hashes of what they stand for, in place of a dictionary that
Spark rounds would keep for the whole corpus: each map task names by itself, and all give equal runs and pairs the same name and equal substrings get the same interior symbols.  Each symbol also
carries the stretch of words that settles it.  A window's symbol is one of those settled inside it, the one
whose stretch has the smallest hash, or the window itself where there is none: equal windows have equal symbols.

Round 1 (Spark): symbols held by windows of different groups of documents are found by exchanging names.
At a high level each few neighbouring symbols are exchanged by 128-bit name: where they also start earlier,
all windows inside do too, which settles copies and long passages with a row for some tens of words.
Round 2 (Spark): only other windows under a shared symbol are compared, by 128-bit hashes of their words, and
the first of each, by document and start, is left alone.  Names and hashes travel as packed arrays, one
row for each pair of map and reduce task with something to tell; each map task combines its own repeats first, so a passage that
a third of all documents share is sent once by each task.  Round 3 removes words and digests the rest.

Defined cases: windows are ordered by (doc_id, start) alone, null ids last as one id, so repeated rows (same
id, same text) lose nothing to each other, and different texts of one id are told apart by their hash; null or empty texts have no words; texts are read whole, words
unchanged; shorter documents than a window lose nothing.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundleloom.llm.common import stage, text_slices

WINDOW = 20
#: Rounds of recompression for the symbols of windows; and for long pieces, of so many symbols each.
LEVELS = 2
LONG_LEVEL, LONG_WIDTH = 10, 3
#: Words that one task holds at a time, about.
GROUP_WORDS = 700_000
NULL_ID = (1 << 63) - 1
#: Bytes of packed names or hashes that one reduce task should hold, about.
REDUCE_BYTES = 10_000_000

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_33, _29 = np.uint64(33), np.uint64(29)


def mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Name of a pair: a 64-bit hash of its two names, in order."""
    h = x >> _29
    h ^= x
    h *= _A
    if h.shape == y.shape or y.size == 1:
        h += y
    else:
        h = h + y
    t = h >> _33
    h ^= t
    h *= _B
    np.right_shift(h, _29, out=t)
    h ^= t
    h *= _C
    np.right_shift(h, _33, out=t)
    h ^= t
    return h


class Words:
    """Two independent 64-bit hashes of each word of some texts, end to end, with a break between texts."""

    def __init__(self, texts: list):
        vocab: defaultdict = defaultdict()
        vocab.default_factory = vocab.__len__
        rows = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
        self.lens = np.array([len(r) for r in rows], dtype=np.int64)
        n = int(self.lens.sum())
        ids = np.fromiter(map(vocab.__getitem__, chain.from_iterable(rows)), dtype=np.int64, count=n)
        both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in vocab), dtype=np.uint64).reshape(-1, 2)
        self.h1, self.h2 = (both[ids, k] if n else np.zeros(0, np.uint64) for k in (0, 1))
        self.first = np.cumsum(self.lens) - self.lens
        self.doc = np.repeat(np.arange(len(rows)), self.lens)


def window_hash(h: np.ndarray, window: int) -> np.ndarray:
    """Hash of each window of consecutive words, by doubling."""
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, at, power, size = None, 0, h, 1
    while size <= window:
        if window & size:
            part = power[at : at + n]
            out = mix(part, np.full(1, at + 1, np.uint64)) if out is None else mix(out, part)
            at += size
        power = mix(power[:-size], power[size:]) if len(power) > size else power[:0]
        size *= 2
    return out


class Symbols:
    """A sequence of symbols: two hashes of what each stands for, its text, where it starts, what settles it."""

    def __init__(self, w: Words):
        self.name, self.also, self.doc = w.h1, w.h2, w.doc
        self.start = np.arange(len(self.name), dtype=np.int64)
        self.lo, self.hi = self.start, self.start + 1
        self.level = 0

    def round(self, settle: bool = True) -> Symbols:
        """One round of recompression: runs, then pairs.  Without ``settle``, lo and hi are left behind."""
        for step in (_runs, _pairs):
            step(self, settle)
        self.level += 1
        return self


def _near(lo, hi, doc, at, left):
    """Stretch of the neighbour to the left or right of places ``at``; unsettled (-1) at a text's edge."""
    to = at - 1 if left else at + 1
    safe = np.clip(to, 0, len(doc) - 1)
    inside = (to >= 0) & (to < len(doc)) & (doc[safe] == doc[at])
    return np.where(inside, lo[safe], -1), np.where(inside, hi[safe], -1)


def _runs(x: Symbols, settle: bool) -> None:
    """Each maximal run of one symbol becomes one symbol, settled by its neighbours, which must differ."""
    n = len(x.name)
    if not n:
        return
    same = (x.name[1:] == x.name[:-1]) & (x.doc[1:] == x.doc[:-1])
    if not same.any():
        head = tail = np.arange(n)
    else:
        head = np.flatnonzero(np.append(True, ~same))
        tail = np.append(head[1:], n) - 1
        many = np.flatnonzero(tail > head)
        size, mark = (tail - head + 1)[many].astype(np.uint64), np.full(1, 1000 + x.level, np.uint64)
        name, also = x.name[head], x.also[head]
        name[many], also[many] = mix(mix(name[many], size), mark), mix(mix(also[many], size), mark)
    if settle:
        before, _ = _near(x.lo, x.hi, x.doc, head, True)
        right, after = _near(x.lo, x.hi, x.doc, tail, False)
        bad = (before < 0) | (right < 0) | (x.lo[head] < 0) | (x.lo[tail] < 0)
        x.lo, x.hi = np.where(bad, -1, before), np.maximum(after, x.hi[tail])
    if head is not tail:
        x.name, x.also, x.doc, x.start = name, also, x.doc[head], x.start[head]


def _pairs(x: Symbols, settle: bool) -> None:
    """Pairs across the two halves of the alphabet become one symbol."""
    n = len(x.name)
    if not n:
        return
    half = (mix(x.name, np.full(1, x.level + 1, np.uint64)) & np.uint64(1)).astype(bool)
    joins = np.append(~half[:-1] & half[1:] & (x.doc[:-1] == x.doc[1:]), False)
    pair = np.flatnonzero(joins)
    keep = np.flatnonzero(np.append(True, ~joins[:-1]))
    if settle:
        # a lone symbol is settled by its right neighbour if it is in the left half, else by its left one
        at = np.arange(n)
        to = np.where(half, at - 1, at + 1)
        safe = np.clip(to, 0, n - 1)
        inside = (to == safe) & (x.doc[safe] == x.doc)
        side_lo, side_hi = np.where(inside, x.lo[safe], -1), x.hi[safe]
        bad = (side_lo < 0) | (x.lo < 0)
        x.lo, x.hi = np.where(bad, -1, np.minimum(x.lo, side_lo))[keep], np.maximum(x.hi, side_hi)[keep]
    name, also = x.name.copy(), x.also.copy()
    name[pair], also[pair] = mix(name[pair], name[pair + 1]), mix(also[pair], also[pair + 1])
    x.name, x.also, x.doc, x.start = name[keep], also[keep], x.doc[keep], x.start[keep]


_ODD = 0x9E3779B97F4A7C15


def stretch_hash(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of the words lo..hi-1 of each symbol: all that settles it, so that chance repeats are few."""
    power = np.full(len(h) + 1, _ODD, dtype=np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * power[:-1], out=sums[1:])
    back = np.full(len(h) + 1, pow(_ODD, -1, 1 << 64), dtype=np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    return mix((sums[hi] - sums[lo]) * back[lo], (hi - lo).astype(np.uint64))


_LOG2 = np.array([0] + [i.bit_length() - 1 for i in range(1, 256)])


def window_symbols(w: Words, x: Symbols, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of windows that lie in one text, symbol of each, symbols that stand in several places)."""
    if len(w.h1) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    starts = np.flatnonzero(w.doc[: len(w.doc) - window + 1] == w.doc[window - 1 :])
    ok = np.flatnonzero((x.lo >= 0) & (x.hi - x.lo <= window))
    lo, hi = x.lo[ok], x.hi[ok]
    names = stretch_hash(w.h1, lo, hi)
    # both ends rise from symbol to symbol, so a window's symbols are a range
    upto = np.arange(len(w.h1) + 1)
    a = np.searchsorted(lo, upto, side="left")[starts]
    b = np.searchsorted(hi, upto, side="right")[starts + window]
    none = np.flatnonzero(a >= b)
    out = np.empty(len(starts), dtype=np.uint64)
    out[none] = mix(window_hash(w.h1, window)[starts[none]], np.full(1, 99, np.uint64)) if len(none) else 0
    multi = np.append(_repeated(names), _repeated(out[none]))
    some = np.flatnonzero(a < b)
    if len(some):
        # smallest of names[a:b] by two overlapping powers of two
        a, b = a[some], b[some]
        k = _LOG2[b - a]
        table = [names]
        for i in range(int(k.max())):
            p = table[-1].copy()
            np.minimum(p[: -(1 << i)], p[1 << i :], out=p[: -(1 << i)])
            table.append(p)
        flat = np.concatenate(table)
        base = k * len(names)
        out[some] = np.minimum(flat[base + a], flat[base + b - (1 << k)])
    return starts, out, multi


def long_pieces(x: Symbols, w: Words, width: int, window: int) -> tuple[np.ndarray, ...]:
    """(two hashes, text, start, length) of each ``width`` neighbouring symbols that span a window or more."""
    n = len(x.name) - width + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    end = np.append(x.start[1:], len(w.h1))
    length = end[width - 1 :] - x.start[:n]
    ok = np.flatnonzero((x.doc[:n] == x.doc[width - 1 :]) & (length >= window))
    one, two = window_hash(x.name, width)[ok], window_hash(x.also, width)[ok]
    return one, two, x.doc[ok], x.start[ok] - w.first[x.doc[ok]], length[ok]


# ---------------------------------------------------------------- rounds


def _groups(batches):
    """Rows of a task, some ``GROUP_WORDS`` words at a time; the text is a row's second column."""
    rows, size = [], 0
    for batch in batches:
        for b, texts in text_slices(batch):
            for row in zip(b.column(0).to_pylist(), texts, *(b.column(i).to_pylist() for i in range(2, b.num_columns))):
                rows.append(row)
                size += len(row[1] or "") // 5 + 1
                if size >= GROUP_WORDS:
                    yield rows
                    rows, size = [], 0
    if rows:
        yield rows


def _ids(rows) -> np.ndarray:
    return np.array([NULL_ID if r[0] is None else r[0] for r in rows], dtype=np.int64)


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    return ((x >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _owned(prefix: str) -> tuple[str, str, str]:
    """Columns that say whose a part's places are: runs of (id, hash of the text, number of places)."""
    return f"{prefix}_id", f"{prefix}_th", f"{prefix}_n"


def _sent(names: tuple, ids: np.ndarray, ths: np.ndarray, parts: list) -> pa.RecordBatch:
    """One row for each bucket that gets something.  A part is (bucket of each place, row of each place, prefix, (column, array), ...)."""
    some = np.unique(np.concatenate([to for to, *_ in parts]))
    cells: dict[str, list] = {c: [b""] * len(some) for c in names[1:]}
    for to, doc, prefix, *columns in parts:
        to = np.searchsorted(some, to)
        order = np.lexsort((doc, to))
        to, doc = to[order], doc[order]
        cut = np.searchsorted(to, np.arange(len(some) + 1))
        used = np.flatnonzero(np.diff(cut))
        head = np.flatnonzero(np.append(True, (to[1:] != to[:-1]) | (doc[1:] != doc[:-1]))) if len(to) else np.zeros(0, np.int64)
        of, size = doc[head], np.diff(np.append(head, len(to))).astype(np.int32)
        edge = np.searchsorted(to[head], np.arange(len(some) + 1)) if len(to) else cut
        for name, array in zip(_owned(prefix), (ids[of], ths[of], size)):
            for b in used:
                cells[name][b] += array[edge[b] : edge[b + 1]].tobytes()
        for name, array in columns:
            array = array[order]
            for b in used:
                cells[name][b] += array[cut[b] : cut[b + 1]].tobytes()
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(cells[c], pa.binary()) for c in names[1:])], list(names))


def _schema(names: tuple) -> str:
    return ", ".join(f"{c} {'int' if c == 'bucket' else 'binary'}" for c in names)


def _unpacked(column, kind) -> np.ndarray:
    parts = [np.frombuffer(x, kind) for x in column.to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _owners(t: pa.Table, prefix: str) -> tuple[np.ndarray, np.ndarray]:
    """(id, text hash) of each place of a part."""
    i, th, n = (_unpacked(t[c], k) for c, k in zip(_owned(prefix), (np.int64, np.int64, np.int32)))
    return np.repeat(i, n), np.repeat(th, n)


def _keys(ids: np.ndarray, ths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, text hashes) without repeats, in order, and the place of each pair among them."""
    order = np.lexsort((ths, ids))
    i, th = ids[order], ths[order]
    head = np.append(True, (i[1:] != i[:-1]) | (th[1:] != th[:-1])) if len(i) else np.zeros(0, bool)
    at = np.empty(len(ids), dtype=np.int64)
    at[order] = np.cumsum(head) - 1
    return i[head], th[head], at


def _told(buckets: int, names: tuple, parts: list) -> pa.Table:
    """Answers dealt by the hash of their document's id and text; a part is (prefix, column, values, ids, text hashes)."""
    sent, all_ids, all_ths, base = [], [], [], 0
    for prefix, column, values, ids, ths in parts:
        i, th, at = _keys(ids, ths)
        sent.append((_bucket(_mixed(i, th), buckets)[at], at + base, prefix, (column, values)))
        all_ids.append(i)
        all_ths.append(th)
        base += len(i)
    return pa.Table.from_batches([_sent(names, np.concatenate(all_ids), np.concatenate(all_ths), sent)])


def _assembled(parts: list):
    """applyInArrow body: one row for each document with its packed answers; a part is (prefix, column, type)."""

    def run(t: pa.Table) -> pa.Table:
        got = [(*_owners(t, prefix), _unpacked(t[column], kind)) for prefix, column, kind in parts]
        ids, ths, at = _keys(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))
        out, base = {"id": pa.array(ids, pa.int64()), "th": pa.array(ths, pa.int64())}, 0
        for (_, column, _), (i, _, values) in zip(parts, got):
            mine = at[base : base + len(i)]
            base += len(i)
            order = np.argsort(mine, kind="stable")
            cut, values = np.searchsorted(mine[order], np.arange(len(ids) + 1)), values[order]
            out[column] = pa.array([values[cut[k] : cut[k + 1]].tobytes() for k in range(len(ids))], pa.binary())
        return pa.table(out)

    return run


def _repeated(x: np.ndarray) -> np.ndarray:
    """The values that occur more than once, ascending."""
    x = np.sort(x)
    return np.unique(x[1:][x[1:] == x[:-1]])


#: How an entry was sent: alone in its group; standing for several of its group; an answer to pass on.
ALONE, SEVERAL, ANSWER = 0, 1, 2
FIRST = ("bucket", *_owned("s"), "names", "kinds", *_owned("p"), "h1", "h2", "spans", *_owned("q"), "done")


def _span(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    return start.astype(np.int64) << 32 | length.astype(np.int64)


def _mixed(ids: np.ndarray, ths: np.ndarray) -> np.ndarray:
    """A hash of id and text, so that many texts of one id (null ids are one) are dealt apart."""
    return mix(ids.astype(np.uint64), ths.astype(np.uint64))


def shared_symbols(docs: DataFrame, buckets: int, window: int, levels: int) -> DataFrame:
    """``(id, th, names, spans)``, one row a document: symbols that a document shares with another place, and long
    pieces (start << 32 | length) that also start earlier."""

    def send(batches):
        for rows in _groups(batches):
            w, ids, ths = Words([r[1] for r in rows]), _ids(rows), np.array([r[2] for r in rows], dtype=np.int64)
            x = Symbols(w)
            for _ in range(levels):
                x.round()
            starts, symbol, multi = window_symbols(w, x, window)
            if not len(starts):
                continue
            for _ in range(LONG_LEVEL - levels):
                x.round(settle=False)
            h1, h2, of, at, length = long_pieces(x, w, LONG_WIDTH, window)
            spans = _span(at, length)
            late, head = _later(h1, h2, ids[of], at)
            # symbols: once for each stretch of windows, then once for each document
            doc = w.doc[starts]
            edge = np.flatnonzero(np.append(True, (symbol[1:] != symbol[:-1]) | (doc[1:] != doc[:-1])))
            s, d = symbol[edge], doc[edge]
            order = np.lexsort((d, s))
            s, d = s[order], d[order]
            new = np.append(True, (s[1:] != s[:-1]) | (d[1:] != d[:-1]))
            s, d = s[new], d[new]
            first = np.append(True, s[1:] != s[:-1])
            several = ~(first & np.append(first[1:], True)) | np.isin(s, multi)  # of several documents or places here
            kind = np.where(several[first], SEVERAL, ALONE).astype(np.uint8)
            own, answer = d[first], d[several]
            places, told = np.append(own, answer), _bucket(_mixed(ids[answer], ths[answer]), buckets)
            parts = [
                (np.append(_bucket(s[first], buckets), told), places, "s", ("names", np.append(s[first], s[several])), ("kinds", np.append(kind, np.full(len(answer), ANSWER, np.uint8)))),
                (_bucket(h1[head], buckets), of[head], "p", ("h1", h1[head]), ("h2", h2[head]), ("spans", spans[head])),
                (_bucket(_mixed(ids[of[late]], ths[of[late]]), buckets), of[late], "q", ("done", spans[late])),
            ]
            yield _sent(FIRST, ids, ths, parts)

    def meet(t: pa.Table) -> pa.Table:
        names, kinds, (ids, ths) = _unpacked(t["names"], np.uint64), _unpacked(t["kinds"], np.uint8), _owners(t, "s")
        asks = kinds != ANSWER
        shared = _repeated(names[asks])
        out = ~asks | (kinds == ALONE) & np.isin(names, shared)
        one = ("s", "names", names[out], ids[out], ths[out])
        h1, h2, span, (ids, ths) = _unpacked(t["h1"], np.uint64), _unpacked(t["h2"], np.uint64), _unpacked(t["spans"], np.int64), _owners(t, "p")
        late, _ = _later(h1, h2, ids, span >> 32)
        done_i, done_t = _owners(t, "q")
        two = ("q", "spans", np.append(_unpacked(t["done"], np.int64), span[late]), np.append(done_i, ids[late]), np.append(done_t, ths[late]))
        return _told(buckets, TOLD, [one, two])

    met = docs.mapInArrow(send, _schema(FIRST)).groupBy("bucket").applyInArrow(meet, _schema(TOLD))
    ready = _assembled([("s", "names", np.uint64), ("q", "spans", np.int64)])
    return met.groupBy("bucket").applyInArrow(ready, "id long, th long, names binary, spans binary")


TOLD = ("bucket", *_owned("s"), "names", *_owned("q"), "spans")


def _inside(starts: np.ndarray, spans: np.ndarray, window: int) -> np.ndarray:
    """True for windows (starts in their text) that lie in one of the packed spans."""
    begin, last = spans >> 32, (spans >> 32) + (spans & 0xFFFFFFFF) - window
    order = np.argsort(begin, kind="stable")
    begin, last = begin[order], np.maximum.accumulate(last[order])
    at = np.searchsorted(begin, starts, side="right") - 1
    return (at >= 0) & (last[np.maximum(at, 0)] >= starts)


SECOND = ("bucket", *_owned("w"), "h1", "h2", "starts", *_owned("q"), "done")


def later_windows(docs: DataFrame, symbols: DataFrame, buckets: int, window: int, levels: int) -> DataFrame:
    """``(id, th, starts)``: packed starts of windows whose words also start earlier, one row a document.

    Windows inside a long piece that also starts earlier are known to, and are left out; the first of equal
    windows is never inside one, so what is left is decided rightly by itself.
    """

    def send(batches):
        for rows in _groups(batches):
            w, ids, ths = Words([r[1] for r in rows]), _ids(rows), np.array([r[2] for r in rows], dtype=np.int64)
            x = Symbols(w)
            for _ in range(levels):
                x.round()
            starts, symbol, _ = window_symbols(w, x, window)
            cut = np.searchsorted(w.doc[starts], np.arange(len(rows) + 1))
            hit = [np.zeros(0, np.int64)]
            for i, r in enumerate(rows):
                wanted, known = np.unique(np.frombuffer(r[3], np.uint64)), np.frombuffer(r[4], np.int64)
                if len(wanted) and cut[i] < cut[i + 1]:
                    part = symbol[cut[i] : cut[i + 1]]
                    ok = wanted[np.minimum(np.searchsorted(wanted, part), len(wanted) - 1)] == part
                    if len(known):
                        ok &= ~_inside(starts[cut[i] : cut[i + 1]] - w.first[i], known, window)
                    hit.append(cut[i] + np.flatnonzero(ok))
            at = starts[np.concatenate(hit)]
            if not len(at):
                continue
            doc = w.doc[at]
            h1, h2, start = window_hash(w.h1, window)[at], window_hash(w.h2, window)[at], (at - w.first[doc]).astype(np.int32)
            late, head = _later(h1, h2, ids[doc], start)
            parts = [
                (_bucket(h1[head], buckets), doc[head], "w", ("h1", h1[head]), ("h2", h2[head]), ("starts", start[head])),
                (_bucket(_mixed(ids[doc[late]], ths[doc[late]]), buckets), doc[late], "q", ("done", start[late])),
            ]
            yield _sent(SECOND, ids, ths, parts)

    def meet(t: pa.Table) -> pa.Table:
        h1, h2, start, (ids, ths) = _unpacked(t["h1"], np.uint64), _unpacked(t["h2"], np.uint64), _unpacked(t["starts"], np.int32), _owners(t, "w")
        late, _ = _later(h1, h2, ids, start)
        done_i, done_t = _owners(t, "q")
        return _told(buckets, LATE, [("q", "starts", np.append(_unpacked(t["done"], np.int32), start[late]), np.append(done_i, ids[late]), np.append(done_t, ths[late]))])

    sent = _joined(docs, symbols.filter(F.octet_length("names") > 0), "inner").select("d.id", "text", "d.th", "names", "spans")
    met = sent.mapInArrow(send, _schema(SECOND)).groupBy("bucket").applyInArrow(meet, _schema(LATE))
    return met.groupBy("bucket").applyInArrow(_assembled([("q", "starts", np.int32)]), "id long, th long, starts binary")


LATE = ("bucket", *_owned("q"), "starts")


def _joined(docs: DataFrame, told: DataFrame, how: str) -> DataFrame:
    """Documents with what was found about them, by id and text; one plan at every size, never a broadcast."""
    on = (F.coalesce(F.col("d.id"), F.lit(NULL_ID)) == F.col("t.id")) & (F.col("d.th") == F.col("t.th"))
    return docs.alias("d").join(told.hint("merge").alias("t"), on, how)


def _later(h1, h2, owner, start) -> tuple[np.ndarray, np.ndarray]:
    """(places whose hash also stands at a smaller (owner, start), one place for the first of each hash)."""
    if not len(h1):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(h1)
    a, b = h1[order], h2[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():  # two texts under one 64-bit hash: sort by both
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    head = np.flatnonzero(np.append(True, ~same))
    _, rank = np.unique(owner, return_inverse=True)
    key = (rank.astype(np.int64) << 32 | start.astype(np.int64))[order]
    low = np.repeat(np.minimum.reduceat(key, head), np.diff(np.append(head, len(key))))
    first = np.flatnonzero(key == low)
    of = np.searchsorted(head, first, side="right")
    first = first[np.append(True, of[1:] != of[:-1])]
    return order[key != low], order[first]


def _kept(text: str | None, starts: list | None, spans: list | None, window: int) -> tuple[int, int, bytes]:
    """(words, removed, kept words joined) of one text."""
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    if not starts and not spans:
        return len(words), 0, b" ".join(words)
    at = np.unique(np.frombuffer(b"".join(starts or []), np.int32)).astype(np.int64)
    span = np.unique(np.frombuffer(b"".join(spans or []), np.int64))
    step = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(step, np.append(at, span >> 32), 1)
    np.subtract.at(step, np.append(at + window, (span >> 32) + (span & 0xFFFFFFFF)), 1)
    keep = np.cumsum(step[:-1]) == 0
    kept = [w for w, k in zip(words, keep.tolist()) if k]
    return len(words), len(words) - len(kept), b" ".join(kept)


def removal(docs: DataFrame, window: int = WINDOW, levels: int = LEVELS) -> DataFrame:
    """``(id, text, starts, spans)``: each row of ``docs`` with the packed windows and spans to remove."""
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, int(-(-size * 0.35 // REDUCE_BYTES)))
    symbols = stage(shared_symbols(own, buckets, window, levels), "symbols")
    late = later_windows(own, symbols, buckets, window, levels).select("id", "th", "starts", F.lit(None).cast("binary").alias("spans"))
    late = late.unionByName(symbols.filter(F.octet_length("spans") > 0).select("id", "th", F.lit(None).cast("binary").alias("starts"), "spans"))
    late = late.groupBy("id", "th").agg(F.collect_list("starts").alias("starts"), F.collect_list("spans").alias("spans"))
    return _joined(own, late, "left").select("d.id", "text", "starts", "spans")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""

    def run(batches):
        for b, texts in (part for batch in batches for part in text_slices(batch)):
            rows = [_kept(t, s, p, WINDOW) for t, s, p in zip(texts, b.column(2).to_pylist(), b.column(3).to_pylist())]
            n, gone, sha = [r[0] for r in rows], [r[1] for r in rows], [hashlib.sha256(r[2]).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return removal(docs).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, text)`` with the kept words of each text joined by one space; untouched texts as they were."""

    def run(batches):
        for b, texts in (part for batch in batches for part in text_slices(batch)):
            texts = [_kept(t, s, p, window)[2].decode("utf-8", "surrogatepass") if s or p else t for t, s, p in zip(texts, b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return removal(docs, window).mapInArrow(run, "doc_id long, text string")
