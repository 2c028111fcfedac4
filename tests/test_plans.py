"""Plans, plug-ins, outside tools, progress and staging."""

import io
import json
import struct
import time

import pytest
from pyspark.sql import functions as F

from bundleloom import Options, Optimizer, PackEngine, lookup, optimize, register
from bundleloom.functions import media, report
from bundleloom.operators import registry
from bundleloom.plans import progress
from bundleloom.sources import pack
from bundleloom.staging import scope, stage
from tests.test_pack import RAMP, chunk, make_png

FILES = "rel string, ordinal long, data binary, error string"


def files(spark, tmp_path, rows):
    df = spark.createDataFrame([(r, i, bytearray(d), None) for i, (r, d) in enumerate(rows)], FILES)
    df.write.parquet(str(tmp_path / "files"))
    return spark.read.parquet(str(tmp_path / "files"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_scan_without_media_two_with(spark, tmp_path):
    text = files(spark, tmp_path / "a", [("a.json", b"{ }"), ("b.fsh", b"'q' x  y"), ("c.lang", b"a=1")])
    plan = plan_of(optimize(text))
    assert plan.count("FileScan") == 1 and "Python" not in plan and "Arrow" not in plan
    mixed = files(spark, tmp_path / "b", [("a.json", b"{ }"), ("b.png", b"no")])
    plan = plan_of(optimize(mixed))
    assert plan.count("FileScan") == 2 and plan.count("MapInArrow") == 1
    summary = plan_of(optimize(text).agg(F.sum("new")))
    assert summary.count("FileScan") == 1


def test_unreadable_media_pass(spark):
    rows = [("a.png", 0, None, "gone"), ("b.ogg", 1, bytearray(b"OggS"), "half"), ("c.png", 2, None, None), ("d.txt", 3, None, "gone"), ("e.ogg", 4, bytearray(b"no"), None)]
    got = sorted(optimize(spark.createDataFrame(rows, FILES)).select("rel", "new", "method", "changed", "note", "data", "error").collect())
    assert [tuple(r)[:5] for r in got] == [("a.png", None, 8, None, ""), ("b.ogg", 4, 8, False, ""), ("c.png", None, 8, None, ""), ("d.txt", None, 8, None, ""), ("e.ogg", 2, 0, False, "")]
    assert [(r.data and bytes(r.data), r.error) for r in got] == [(None, "gone"), (b"OggS", "half"), (None, None), (None, "gone"), (b"no", None)]


def test_made_files_are_made_once_in_many_tasks(spark):
    from bundleloom.queries import _made

    made = spark.sparkContext.accumulator(0)

    def fn(k):
        made.add(1)
        return b"Riff%d" % k

    done = optimize(_made(spark.range(1000).coalesce(1), ".ogg", fn), media_files=True)
    counts = [r["count"] for r in done.select(F.spark_partition_id().alias("p"), "data").filter("data is not null").groupBy("p").count().collect()]
    assert sum(counts) == made.value == 1000 and max(counts) <= 1000 / 8 + 20


def test_own_optimizer_and_last_registration(spark, tmp_path):
    before = dict(registry._registry)
    try:
        register(Optimizer("upper", media=lambda data, o: (data.upper(), 0, True, "loud")), "UP", ".json")
        assert lookup(".JSON").name == lookup(".up").name == "upper"
        register(Optimizer("same", columns=lambda rel, data, o: (data, F.lit("kept"))), "json")
        got = {r.rel: (bytes(r.data), r.note) for r in optimize(files(spark, tmp_path, [("a.up", b"x"), ("a.json", b"{ }"), ("a.mcmeta", b"{ }")])).collect()}
        assert got == {"a.up": (b"X", "loud"), "a.json": (b"{ }", "kept"), "a.mcmeta": (b"{}", "")}
    finally:
        registry._registry.clear()
        registry._registry.update(before)


@pytest.fixture
def tools(tmp_path, monkeypatch):
    """Stand-ins on the path that write down their arguments and answer with a file's bytes."""

    def add(name, out=b"", code=0):
        (tmp_path / f"{name}.out").write_bytes(out)
        exe = tmp_path / "bin" / name
        exe.parent.mkdir(exist_ok=True)
        exe.write_text(f'#!/bin/sh\nprintf "%s\\n" "$@" > {tmp_path}/{name}.args\ncat > /dev/null\ncat {tmp_path}/{name}.out\n[ {code} = 0 ] || echo broken >&2\nexit {code}\n')
        exe.chmod(0o755)
        monkeypatch.setenv("PATH", f"{exe.parent}:/usr/bin:/bin")
        media.tool.cache_clear()
        return lambda: (tmp_path / f"{name}.args").read_text().split("\n")[:-1]

    yield add
    media.tool.cache_clear()


def test_ogg_tool_arguments(tools):
    args = tools("optivorbis", b"OggSx")
    src = b"OggS" + bytes(100)
    assert media.ogg(src, Options()) == (b"OggSx", 0, True, "")
    said = args()
    assert said[:7] == ["--quiet", "--remuxer", "ogg2ogg", "--remuxer_option", "randomize_stream_serials=false", "--vendor_string_action", "empty"]
    assert said[7:9] == ["--comment_fields_action", "delete"] and said[9].endswith("in.ogg") and said[10] == "-"
    media.ogg(src, Options(ogg_strip_comments=False))
    assert "copy" in args()
    tools("optivorbis", b"no Ogg")
    assert media.ogg(src, Options()) == (src, 0, False, "")


def test_missing_ogg_tool_is_noted():
    comment = b"\x03vorbis" + struct.pack("<I", 0) + struct.pack("<I", 0) + b"\x01"
    src = media.ogg_stream([(2, 0, b"\x01vorbis" + bytes(23)), (0, 0, comment), (0, 0, b"\x05vorbis" + bytes(60)), (4, 8, b"b")])
    if media.tool("optivorbis") is None:
        assert media.ogg(src, Options()) [3].startswith("optivorbis:") and media.ogg(b"OggS", Options())[3] == ""


def test_png_tools_and_notes(tools):
    src = make_png(RAMP, 6, chunk(b"pHYs", bytes(9)) + chunk(b"cICP", bytes(4)) + chunk(b"gAMA", bytes(4)) + chunk(b"tEXt", b"k\0" + b"v" * 400))
    keep = media.png(src, Options(png_keep_color_profile=True, png_lossy=False))[0]
    assert [t for t, _ in media.chunks(keep)] == [b"IHDR", b"pHYs", b"cICP", b"IDAT", b"IEND"]
    quant = tools("pngquant", b"", 2)
    o = Options(png_protect_alpha=False, media_notes=True)
    assert media.png(src, o)[3] == "palette pass failed: broken" and media.png(src, Options(png_protect_alpha=False))[3] == ""
    assert quant() == ["--quality=65-90", "--skip-if-larger", "--strip", "-"]
    assert "transparent" in media.png(src, Options(media_notes=True))[3] and media.png(src, Options())[3] == ""
    args = tools("oxipng", b"\x89PNG small")
    assert media.png(src, Options(png_lossy=False, png_level=9))[0] == b"\x89PNG small"
    assert args() == ["-o", "max", "--strip", "all", "--stdout", "-"]
    media.png(src, Options(png_lossy=False, png_keep_color_profile=True))
    assert args() == ["-o", "4", "--strip", "safe", "--stdout", "-"]


def test_progress(spark):
    class Terminal(io.StringIO):
        def isatty(self):
            return True

    out = Terminal()
    assert progress.wanted(Options(), out) and not progress.wanted(Options(), io.StringIO())
    assert not any(progress.wanted(Options(**{k: True}), out) for k in ("quiet", "verbose", "dry_run", "no_progress"))
    with progress.shown(spark, out=out, every=0.02):
        spark.range(4, numPartitions=4).foreach(lambda _: time.sleep(0.3))
    assert "Optimizing pack: " in out.getvalue() and out.getvalue().endswith("\n")


def test_staged_tables_go(spark):
    from bundleloom import staging

    with scope():
        df = stage(spark.range(5), "t")
        assert df.count() == 5 and df._staged_at in staging._live
    assert df._staged_at not in staging._live
    kept = stage(spark.range(2), "t")
    staging.release()
    assert kept._staged_at not in staging._live


def test_pack_without_media_is_read_by_one_plan(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.json").write_text(json.dumps({"a": [1, 2]}, indent=4))
    engine = PackEngine(spark, str(tmp_path / "p"))
    assert "MapInArrow" not in plan_of(engine.optimized()) and engine.summary().first().optimized == 1
    with pytest.raises(ValueError):
        (tmp_path / "q" / ".git").mkdir(parents=True)
        (tmp_path / "q" / ".git" / "x").write_text("x")
        pack.read_index(spark, str(tmp_path / "q"))


def test_text_helpers(spark):
    rows = [('{"tag_name": "v1.2", "x": 1234567}', "v1.2"), ('"tag_name"' + " " * 33 + '"v1" 123456789', ""), ('"tag_name":"v"', ""), ("none", ""), ('"tag_name" : "open 1234567', ""), ('"tag_name" "a" "tag_name" "b"', "a")]
    df = spark.createDataFrame(rows, "b string, w string")
    assert [r.g for r in df.select(report.tag_name(df.b).alias("g")).collect()] == [w for _, w in rows]
    df = spark.createDataFrame([("a\n b \r\n\n", "b", None), ("\n", "", None), ("12", "12", 12), ("", "", None), ("x\n ", "", None)], "t string, l string, d long")
    for r in df.select("l", "d", report.last_line(df.t).alias("g"), report.digits(df.t).alias("n")).collect():
        assert r.g == r.l and r.n == r.d
