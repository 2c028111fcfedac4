import io
import os
import struct
import time
import zipfile
import zlib

import numpy as np
import pytest

from bundleloom import Options, PackEngine, PackError, extensions, lookup
from bundleloom.functions import media
from bundleloom.options import overlay, resolve
from bundleloom.sinks import archive
from bundleloom.sources import pack


def make_png(pixels, color, extra=b"", depth=8):
    h, w = pixels.shape[:2]
    rows = b"".join(bytes([y % 3]) + _filtered(pixels, y) for y in range(h))
    c = lambda t, b: struct.pack(">I", len(b)) + t + b + struct.pack(">I", zlib.crc32(t + b))
    return b"\x89PNG\r\n\x1a\n" + c(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, 0)) + extra + c(b"IDAT", zlib.compress(rows, 1)) + c(b"IEND", b"")


def _filtered(px, y):
    line, step = px[y].reshape(-1), px.shape[2]
    if y % 3 == 1:
        left = np.concatenate([np.zeros(step, np.uint8), line[:-step]])
        return (line - left).astype(np.uint8).tobytes()
    if y % 3 == 2:
        return (line - px[y - 1].reshape(-1)).astype(np.uint8).tobytes()
    return line.tobytes()


def chunk(t, b):
    return struct.pack(">I", len(b)) + t + b + struct.pack(">I", zlib.crc32(t + b))


def rgba(alpha):
    px = np.full((8, 8, 4), 200, np.uint8)
    px[..., 3] = alpha
    return px


RAMP = rgba(np.linspace(0, 255, 8).astype(np.uint8)[None, :].repeat(8, 0))
CUT = rgba(np.pad(np.full((6, 6), 255), 1).astype(np.uint8))


def test_png_keeps_pixels_and_drops_chunks():
    px = np.random.default_rng(1).integers(0, 4, (32, 32, 4)).astype(np.uint8)
    px[..., 3] = 255
    src = make_png(px, 6, chunk(b"tEXt", b"k\0v"))
    out, method, changed, _ = media.png(src, Options())
    assert changed and method == 0 and len(out) < len(src) and b"tEXt" not in out
    assert np.array_equal(media.samples(out)[2], px.ravel())


def test_png_passes():
    off = Options(png_recompress=False, png_strip_meta=False, png_lossy=False)
    src = make_png(CUT, 6)
    assert media.png(src, off)[0] == src
    apng = make_png(CUT, 6, chunk(b"acTL", bytes(8)))
    for data in (apng, b"\x89PNG\r\n\x1a\n\0\0", b"no", b"", src[:40]):
        assert media.png(data, Options()) == (data, 8, False, "")


@pytest.mark.parametrize("px,want", [(RAMP, True), (rgba(255), False), (CUT, False), (rgba(1), True), (rgba(0), False)])
def test_alpha(px, want):
    assert media.uses_alpha(make_png(px, 6)) is want


def test_alpha_of_what_cant_be_read():
    assert not media.uses_alpha(b"\x89PNG\r\n\x1a\n") and not media.uses_alpha(make_png(RAMP, 6)[:60])


def test_ogg():
    comment = b"\x03vorbis" + struct.pack("<I", 9) + b"encoder x" + struct.pack("<I", 1) + struct.pack("<I", 40) + b"t" * 40 + b"\x01"
    packets = [(2, 0, b"\x01vorbis" + bytes(23)), (0, 0, comment), (0, 0, b"\x05vorbis" + bytes(600)), (0, 64, b"aa" * 300), (4, 128, b"bb")]
    src = media.ogg_stream(packets, 77)
    out, method, changed, _ = media.ogg(src, Options())
    assert changed and method == 0 and len(out) < len(src)
    again = media.ogg_packets(out)
    assert [p[2] for p in again[2:]] == [p[2] for p in packets[2:]] and [p[1] for p in again[3:]] == [64, 128]
    assert again[1][2] == b"\x03vorbis" + bytes(8) + b"\x01"
    kept = media.ogg_packets(media.ogg(src, Options(ogg_strip_comments=False))[0])
    assert b"t" * 40 in kept[1][2]
    for data in (b"OggS", b"Ogg", b"", b"RIFFxxxx", src[:50]):
        assert media.ogg(data, Options()) == (data, 0, False, "")
    assert media.ogg(src, Options(ogg_optimize=False)) == (src, 0, False, "")


def test_ogg_checksum_is_the_plain_one_and_fast():
    def plain(page):
        r = 0
        for b in page:
            r ^= b << 24
            for _ in range(8):
                r = (r << 1 ^ (0x04C11DB7 if r & 0x80000000 else 0)) & 0xFFFFFFFF
        return r

    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 27, 500):
        page = rng.bytes(n)
        assert media.ogg_crc(page) == plain(page)
    page, began = bytes(16 << 20), time.process_time()
    assert media.ogg_crc(page) == 0 and time.process_time() - began < 0.7  # a step of Python for each byte takes over a second


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "pack"
    for rel, data in {
        "b/a.json": b'{ "a" : 1 } // c', "b/copy.json": b'{ "a" : 1 } // c', "_top.lang": b"# x\na=1", ".keep.json": b"{ }", "_u/z.bin": b"zz",
        ".git/x.json": b"{}", "b/c/.h/y.json": b"{}", "empty.txt": b"", "é.txt": b"e", "g.fsh": b"int a; // x\n'q'",
    }.items():
        p = root / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    os.symlink(root / "_u/z.bin", root / "link.bin")
    return root


KEPT = [".keep.json", "_top.lang", "_u/z.bin", "b/a.json", "b/copy.json", "empty.txt", "g.fsh", "é.txt"]


def test_directory_scan(spark, tree):
    rows = pack.read_pack(spark, str(tree)).orderBy("ordinal").collect()
    assert [r.rel for r in rows] == KEPT
    assert [r.rel for r in pack.read_index(spark, str(tree)).orderBy("ordinal").collect()] == KEPT
    assert bytes(rows[2].data) == b"zz" and all(r.error is None for r in rows)


def test_bad_inputs(spark, tmp_path):
    (tmp_path / "x.txt").write_text("x")
    (tmp_path / "none").mkdir()
    for p, kind in (("x.txt", ValueError), ("none", ValueError), ("missing", FileNotFoundError)):
        with pytest.raises(kind):
            pack.read_pack(spark, str(tmp_path / p))


def test_zip_scan(spark, tmp_path):
    p = tmp_path / "in.ZIP"
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("./a.json", "{ }")
        z.writestr(".d/b.txt", "b")
        z.writestr("d/", "")
        with pytest.warns(UserWarning):
            z.writestr(".d/b.txt", "b2")
    rows = pack.read_pack(spark, str(p)).orderBy("rel", "ordinal").collect()
    assert [(r.rel, bytes(r.data)) for r in rows] == [(".d/b.txt", b"b"), (".d/b.txt", b"b2"), ("a.json", b"{ }")]


def directory(data):
    """(name, offset, uncompressed bytes) by the central directory alone, as shared bodies need."""
    n, size, start = struct.unpack("<HII", data[-12:-2])
    out, at = [], start
    for _ in range(n):
        f = struct.unpack("<IHHHHHHIIIHHHHHII", data[at : at + 46])
        name = data[at + 46 : at + 46 + f[10]]
        off = f[16]
        ln, le = struct.unpack("<HH", data[off + 26 : off + 30])
        body = data[off + 30 + ln + le : off + 30 + ln + le + f[8]]
        raw = zlib.decompress(body, -15) if f[4] == 8 else body
        assert zlib.crc32(raw) == f[7] and len(raw) == f[9] and (f[5], f[6], f[15]) == (0, 0x21, 1)
        out.append((name.decode(), off, raw))
        at += 46 + f[10] + f[11]
    assert at == start + size
    return out


def test_write(spark, tree, tmp_path):
    out = tmp_path / "o.zip"
    r = PackEngine(spark, str(tree)).write(str(out))
    first = out.read_bytes()
    rows = directory(first)
    assert [x[0] for x in rows] == KEPT and r["entries"] == 8 and r["bodies"] == 7
    got = {n: d for n, _, d in rows}
    assert got["b/a.json"] == got["b/copy.json"] == b'{"a":1}' and got["_top.lang"] == b"a=1\n" and got["g.fsh"] == b"int a; \n'q'"
    assert r["dedup_saved"] == 30 + len("b/copy.json") + len(archive.deflate(b'{"a":1}'))
    PackEngine(spark, str(tree), Options(threads=3)).write(str(out))
    assert out.read_bytes() == first
    PackEngine(spark, str(tree), Options(dedup="off")).write(str(out))
    with zipfile.ZipFile(io.BytesIO(out.read_bytes())) as z:
        assert z.testzip() is None and z.namelist() == KEPT and z.read("é.txt") == b"e"
    assert not [p for p in os.listdir(tmp_path) if p.startswith(".bundleloom")]


def test_tasks_write_the_archive(spark, tmp_path, monkeypatch):
    rows = [(f"{'é' if i % 3 else 'd'}/{i}.txt", i, 8 * (i % 2), bytes([i % 7]) * (i * 5000 % 300_001)) for i in range(200)]
    files = spark.createDataFrame([(r, i, m, bytearray(d)) for r, i, m, d in rows], "rel string, ordinal long, method int, data binary").repartition(5)
    made = archive.write(files, str(tmp_path / "a.zip"))
    with monkeypatch.context() as m:
        m.setattr(archive, "put", lambda *_: None)  # the folder isn't seen by tasks
        assert archive.write(files, str(tmp_path / "b.zip")) == made
    data = (tmp_path / "a.zip").read_bytes()
    assert (tmp_path / "b.zip").read_bytes() == data and len(data) == made["size"]
    assert [(n, d) for n, _, d in directory(data)] == [(r, d) for r, _, _, d in sorted(rows, key=lambda r: r[0].encode())]

    def gathered(*_, **__):
        raise AssertionError("rows are sent to the driver")

    monkeypatch.setattr(type(files), "toLocalIterator", gathered)
    archive.write(files, str(tmp_path / "c.zip"))
    assert (tmp_path / "c.zip").read_bytes() == data
    assert archive.write(files.limit(0), str(tmp_path / "d.zip"))["size"] == 22
    missing = tmp_path / "none"
    assert archive.put(spark.range(3).selectExpr("id AS at", "binary('x') AS b"), str(missing), lambda b: (b,)) is None and not missing.exists()


def test_zip_directory_is_read_in_slices(tmp_path):
    p = tmp_path / "s.zip"
    p.write_bytes(b"in front of the archive")
    with zipfile.ZipFile(p, "a", zipfile.ZIP_DEFLATED) as z:
        z.comment = b"PK and more"
        for i in range(11):
            z.writestr(f"./{'é' if i % 2 else 'e'}/{i}.txt", b"%d" % i * i * 1000)
            z.writestr(f"{i}/", "")
        link = zipfile.ZipInfo("link")
        link.create_system, link.external_attr = 3, 0o120777 << 16
        z.writestr(link, "0.txt")
        with z.open(zipfile.ZipInfo("wide"), "w", force_zip64=True) as f:
            f.write(b"w" * 10)
    with zipfile.ZipFile(p) as z:
        want = [(m.filename, i, z.read(m)) for i, m in enumerate(z.infolist()) if not m.is_dir() and m.filename != "link"]
    for most in (1, 2, 5, 100):
        got, slices = [], list(pack.zip_slices(str(p), most))
        assert len(slices) == -(-24 // most) and sum(s.count for s in slices) == 24
        with open(p, "rb") as f:
            for s in slices:
                z, members = pack.zip_members(f, s)
                got += [(m.filename, i, z.read(m)) for m, i in members]
        assert got == want
    reader = pack._Reader(str(p), True)
    assert [len(r) for r in map(list, map(reader.read, reader.partitions()))] == [12]
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    with pytest.raises(zipfile.BadZipFile):
        pack.check(str(tmp_path / "bad.zip"))
    with zipfile.ZipFile(tmp_path / "many.zip", "w") as z:  # more entries than the short closing record counts
        for i in range(70_000):
            z.writestr(f"{i}", b"")
    parts = pack._Reader(str(tmp_path / "many.zip"), False).partitions()
    assert [(s.first, s.count) for s in parts] == [(0, 50_000), (50_000, 20_000)]
    assert next(pack._Reader(str(tmp_path / "many.zip"), True).read(parts[1]))[0] == "50000"


def test_dry_run_and_errors(spark, tree, tmp_path, monkeypatch):
    out = tmp_path / "o.zip"
    r = PackEngine(spark, str(tree), Options(dry_run=True)).write(str(out))
    assert r["files"] == 8 and not out.exists()
    (tree / "b/a.json").chmod(0)
    if not os.access(tree / "b/a.json", os.R_OK):
        with pytest.raises(PackError):
            PackEngine(spark, str(tree)).write(str(out))


def test_zip64_records():
    big = 1 << 33
    assert struct.unpack("<HHQQ", archive.local_record(b"a", 0, 8, 1, big, big)[-20:]) == (1, 16, big, big)
    assert struct.unpack("<HHQ", archive.central_record(b"a", 0, 8, 1, 5, 5, big)[-12:]) == (1, 8, big)
    assert len(archive.end_records(3, 10, 10)) == 22 and len(archive.end_records(70000, 10, 10)) == 98


def test_options(tmp_path):
    assert resolve(["p"], str(tmp_path))[0] == "p"
    assert resolve([], str(tmp_path))[0] is None
    path, o = resolve(["-v", "in.zip", "-png-level", "6", "-json-minify=false", "-threads", "0"], str(tmp_path))
    assert (path, o.verbose, o.png_level, o.json_minify, o.threads) == ("in.zip", True, 6, False, 1)
    _, o = resolve(["-skip-png", "p", "-skip-text"], str(tmp_path))
    assert (o.png_recompress, o.png_strip_meta, o.png_lossy, o.text_minify, o.json_minify) == (False, False, True, False, True)
    tree = {"quiet": False, "threads": 0, "json": {"minify": False}, "png": {"level": 3, "lossy_quant": None}, "other": 1}
    o = overlay(Options(quiet=True), tree)
    assert (o.quiet, o.json_minify, o.png_level, o.png_lossy, o.threads) == (True, False, 3, True, Options().threads)
    (tmp_path / "config.yml").write_text("json:\n  minify: false\npng:\n  keep_color_profile: true\n")
    pytest.importorskip("yaml")
    _, o = resolve(["p"], str(tmp_path))
    assert not o.json_minify and o.png_keep_color_profile
    _, o = resolve(["p", "-json-minify"], str(tmp_path))
    assert o.json_minify
    with pytest.raises(OSError):
        resolve(["-config", str(tmp_path / "no.yml"), "p"], str(tmp_path))


def test_registry():
    assert extensions() == sorted(extensions()) and lookup(".PNG").name == "png" and lookup(".apng") is None


def test_stream(spark, tmp_path):
    from bundleloom.streaming.arrivals import optimize_stream

    src = spark.createDataFrame([("a.json", 0, bytearray(b"{ }"), None)], "rel string, ordinal long, data binary, error string")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    optimize_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert bytes(spark.read.parquet(str(tmp_path / "out")).first().data) == b"{}"
