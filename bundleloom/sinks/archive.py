"""The archive: bodies deflated in parallel, laid out by DataFrame, written into one file by the tasks.

Every record's place is known beforehand, so each task writes its own runs of the file, bodies first and then the
directory; the driver gets counts, adds the closing records and renames.  Where tasks don't see the folder of the
archive, the driver writes, and holds one partition at a time.
"""

from __future__ import annotations

import os
import struct
import tempfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundleloom.functions.paths import utf8_flag
from bundleloom.operators import layout
from bundleloom.options import Options
from bundleloom.schema import DEFLATE, STORE
from bundleloom.staging import is_staged, stage

#: 1980-01-01 00:00, read-only DOS attributes.
DOS_DATE, DOS_TIME, ATTRIBUTES = 0x0021, 0, 1
LIMIT, MANY = 0xFFFFFFFF, 0xFFFF
#: Bytes that a task gathers before it writes them, about.
RUN_BYTES = 4 << 20


def deflate(data: bytes) -> bytes:
    """Raw deflate at the best level."""
    c = zlib.compressobj(9, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


def bodies(owners: DataFrame) -> DataFrame:
    """``owners(rel, ordinal, method, hash, data)`` -> with crc, sizes and the compressed payload."""
    schema = "rel string, ordinal bigint, method int, hash string, crc bigint, uncomp_size bigint, comp_size bigint, payload binary"

    def run(batches):
        for b in batches:
            out = [d if m == STORE else deflate(d) for d, m in zip(b.column("data").to_pylist(), b.column("method").to_pylist())]
            sizes = pa.array([len(x) for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("rel", "ordinal", "method", "hash", "crc", "uncomp_size")), sizes, pa.array(out, pa.binary())], [x.split()[0] for x in schema.split(", ")])

    own = owners.select("rel", "ordinal", "method", "hash", F.crc32("data").alias("crc"), F.octet_length("data").cast("long").alias("uncomp_size"), "data")
    return own.mapInArrow(run, schema)


def plan(optimized: DataFrame, o: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(bodies with offsets and payloads, directory entries), from ``optimized`` (rel, ordinal, method, data).

    The files are transformed once and the bodies deflated once: both are staged in the shared folder.
    """
    if not is_staged(optimized):
        optimized = stage(optimized.select("rel", "ordinal", "method", "data"), "optimized")
    keyed = optimized.select("rel", "ordinal", "method", layout.content_key(F.col("data")).alias("hash"), "data")
    if o.dedup == "off":
        keyed = keyed.withColumn("hash", F.concat("hash", F.lit("/"), F.col("ordinal").cast("string"), F.lit("/"), "rel"))
    marked = layout.entries(keyed.drop("data"))
    owner = marked.filter("is_owner").select("method", "hash", "rel", "ordinal")
    made = stage(bodies(keyed.join(owner, ["method", "hash", "rel", "ordinal"])), "bodies")
    length = layout.local_length(F.col("rel"), F.col("uncomp_size"), F.col("comp_size"))
    placed = layout.running_offsets(made.drop("payload").withColumn("rec_len", length), ["rel", "ordinal"], "rec_len")
    body = placed.select("method", "hash", "crc", "uncomp_size", "comp_size", "rec_len", "local_offset")
    rows = marked.join(body, ["method", "hash"]).withColumn("flags", utf8_flag(F.col("rel")))
    full = made.join(body.select("method", "hash", "local_offset", "rec_len"), ["method", "hash"]).withColumn("flags", utf8_flag(F.col("rel")))
    return full, rows


def local_record(rel: bytes, flags: int, method: int, crc: int, uncomp: int, comp: int) -> bytes:
    big = uncomp >= LIMIT or comp >= LIMIT
    extra = struct.pack("<HHQQ", 1, 16, uncomp, comp) if big else b""
    a, b = (LIMIT, LIMIT) if big else (uncomp, comp)
    version = 45 if big else 20 if method == DEFLATE else 10
    return struct.pack("<IHHHHHIIIHH", 0x04034B50, version, flags, method, DOS_TIME, DOS_DATE, crc, b, a, len(rel), len(extra)) + rel + extra


def central_record(rel: bytes, flags: int, method: int, crc: int, uncomp: int, comp: int, offset: int) -> bytes:
    wide = [x for x in (uncomp, comp, offset) if x >= LIMIT]
    extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
    a, b, c = (min(x, LIMIT) for x in (uncomp, comp, offset))
    version = 45 if wide else 20 if method == DEFLATE else 10
    head = struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, version, version, flags, method, DOS_TIME, DOS_DATE, crc, b, a, len(rel), len(extra), 0, 0, 0, ATTRIBUTES, c)
    return head + rel + extra


def end_records(count: int, size: int, start: int) -> bytes:
    """The closing records, with their 64-bit forms where the short ones don't hold."""
    out = b""
    if count >= MANY or size >= LIMIT or start >= LIMIT or start + size >= LIMIT:
        out = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, count, count, size, start)
        out += struct.pack("<IIQI", 0x07064B50, 0, start + size, 1)
        return out + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, MANY, MANY, LIMIT, LIMIT, 0)
    return out + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, count, count, size, start, 0)


def _body(rel: bytes, flags: int, method: int, crc: int, uncomp: int, comp: int, payload: bytes) -> tuple[bytes, bytes]:
    return local_record(rel, flags, method, crc, uncomp, comp), payload


def _entry(*fields) -> tuple[bytes]:
    return (central_record(*fields),)


def _write_at(handle: int, pieces: list[bytes], at: int) -> None:
    rest = memoryview(pieces[0] if len(pieces) == 1 else b"".join(pieces))
    while rest:
        n = os.pwrite(handle, rest, at)
        rest, at = rest[n:], at + n


def put(records: DataFrame, path: str, make) -> tuple[int, int, int] | None:
    """Tasks write ``make(*fields)`` of each row ``(at, *fields)`` at its place: (records, bytes, end of the last one).

    None if a task doesn't see the file, which isn't made here: a folder of that name on another machine is another
    one.  A task that runs twice writes the same bytes to the same place.
    """

    def run(batches):
        n = size = end = 0
        try:
            handle = os.open(path, os.O_WRONLY)
        except OSError:
            for _ in batches:
                pass
            yield pa.RecordBatch.from_pydict({"seen": [False], "n": [0], "size": [0], "end": [0]})
            return
        try:
            held, begins, ends = [], 0, 0
            for b in batches:
                for at, *fields in zip(*(c.to_pylist() for c in b.columns)):
                    if held and (at != ends or ends - begins >= RUN_BYTES):
                        _write_at(handle, held, begins)
                        held = []
                    if not held:
                        begins = ends = at
                    made = make(*fields)
                    held += made
                    ends += sum(map(len, made))
                    n, size, end = n + 1, size + ends - at, max(end, ends)
            if held:
                _write_at(handle, held, begins)
            os.fsync(handle)
        finally:
            os.close(handle)
        yield pa.RecordBatch.from_pydict({"seen": [True], "n": [n], "size": [size], "end": [end]})

    done = records.mapInArrow(run, "seen boolean, n bigint, size bigint, end bigint").collect()  # one row for each task
    if not all(r.seen for r in done):
        return None
    return sum(r.n for r in done), sum(r.size for r in done), max((r.end for r in done), default=0)


def put_by_driver(records: DataFrame, path: str, make) -> tuple[int, int, int]:
    """What :func:`put` does, one partition at a time through the driver."""
    n = size = end = 0
    with open(path, "r+b", buffering=1 << 20) as f:
        for at, *fields in records.toLocalIterator():
            made = b"".join(make(*fields))
            if f.tell() != at:
                f.seek(at)
            f.write(made)
            n, size, end = n + 1, size + len(made), max(end, at + len(made))
    return n, size, end


def write(optimized: DataFrame, path: str, o: Options = Options()) -> dict:
    """Write the archive; gives entries, bodies, dedup_saved and the file's size.  The same input gives the same bytes."""
    full, rows = plan(optimized, o)
    fields = [F.col("rel").cast("binary"), "flags", "method", "crc", "uncomp_size", "comp_size"]
    length = layout.central_length(F.col("rel"), F.col("uncomp_size"), F.col("comp_size"), F.col("local_offset"))
    folder = os.path.dirname(os.path.abspath(path))
    handle, temp = tempfile.mkstemp(prefix=".bundleloom-", dir=folder)
    os.close(handle)
    try:
        rows = layout.running_offsets(rows.withColumn("cen_len", length), ["rel", "ordinal"], "cen_len", "at")
        saved = layout.dedup_savings(rows).first()[0]
        order = full.orderBy("local_offset").select(F.col("local_offset").alias("at"), *fields, "payload")  # so that runs are long
        n_bodies, size, start = put(order, temp, _body) or put_by_driver(order, temp, _body)
        order = rows.select((F.col("at") + start).alias("at"), *fields, "local_offset")
        n_rows, listed, end = put(order, temp, _entry) or put_by_driver(order, temp, _entry)
        end = max(start, end)
        if size < start or listed < end - start:
            raise RuntimeError(f"{path}: records don't fill their places")
        with open(temp, "r+b") as f:
            f.seek(end)
            f.write(end_records(n_rows, end - start, start))
            f.flush()
            os.fsync(f.fileno())
        os.chmod(temp, 0o644)
        os.replace(temp, path)
    except BaseException:
        if os.path.exists(temp):
            os.unlink(temp)
        raise
    return {"entries": n_rows, "bodies": n_bodies, "dedup_saved": saved, "size": os.path.getsize(path)}
