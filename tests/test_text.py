import random

import pytest

from bundleloom.functions import minify, paths, report
from bundleloom.operators.optimize import optimize
from bundleloom.options import Options

JSON_CASES = [
    (b'  {"a": 1}  ', b'{"a":1}', False), (b'{\n\t"a" : [ 1 , 2 ]\r\n}', b'{"a":[1,2]}', False), (b'{"a":1 // x\n}', b'{"a":1}', True),
    (b'{/* x */"a":1}', b'{"a":1}', True), (b'{"u":"http://x"}', b'{"u":"http://x"}', False), (b'{"a":"\\"//"}', b'{"a":"\\"//"}', False),
    (b'{"a":"# /* no */"}', b'{"a":"# /* no */"}', False), (b"[]", b"[]", False), (b"1 2", b"12", False), (b'"open // ', b'"open // ', False),
    (b"a/b", b"a/b", False), (b"/* open", b"", True), (b"\xef\xbb\xbf{ }", b"\xef\xbb\xbf{}", False), (b'"\xff \\', b'"\xff \\', False), (b"", b"", False), (b"\x0c", b"\x0c", False),
]
KV_CASES = [
    (b"a=1\nb=2", b"a=1\nb=2\n"), (b"a=1\n\n\nb=2\n", b"a=1\nb=2\n"), (b"#x=1\na=1\n", b"a=1\n"), (b"plain\na=1\n", b"a=1\n"), (b"a=1\r\nb=2\r\n", b"a=1\nb=2\n"),
    (b"", b""), (b"# only\n", b""), (b"a=", b"a=\n"), (b" a = b ", b" a = b \n"), (b" # a=b", b" # a=b\n"), (b"a=1\r\r\n", b"a=1\r\n"),
]
GLSL_CASES = [
    (b"int a; // x\nint b;", b"int a; \nint b;"), (b"/* a\n b */int a;", b"int a;"), (b'"//" x', b'"//" x'), (b"'/' // y", b"'/'"),
    (b"a   \t b", b"a b"), (b"#version 150\n\n  void main(){}\n", b"#version 150\nvoid main(){}"), (b"a/**/b", b"ab"), (b"a /* x\ny */ b", b"a \n b".replace(b"\n ", b"\n")), (b"", b""),
]


def files(spark, rows):
    return spark.createDataFrame([(r, i, bytearray(d), None) for i, (r, d) in enumerate(rows)], "rel string, ordinal long, data binary, error string")


def run(spark, rows, o=Options()):
    got = {r.ordinal: r for r in optimize(files(spark, rows), o).collect()}
    return [got[i] for i in range(len(rows))]


def test_json(spark):
    got = run(spark, [(f"{i}.json", c[0]) for i, c in enumerate(JSON_CASES)])
    for (data, want, comment), r in zip(JSON_CASES, got):
        assert bytes(r.data) == want, data
        assert bool(r.note) == comment
        assert r.changed == (len(want) != len(data))


def test_json_note_depends_on_the_path(spark):
    got = run(spark, [("a.json", b"{}//x"), ("a.jsonc", b"{}//x"), ("X.JSONC", b"{}//x"), ("p.mcmeta", b"{}//x")])
    assert [bool(r.note) for r in got] == [True, False, True, True]


def test_key_values(spark):
    got = run(spark, [(f"{i}.lang", c[0]) for i, c in enumerate(KV_CASES)])
    assert [bytes(r.data) for r in got] == [c[1] for c in KV_CASES]
    both = run(spark, [("a.properties", b"!x=1\n#y=1\nz=1"), ("a.lang", b"!x=1\n#y=1\nz=1")])
    assert [bytes(r.data) for r in both] == [b"z=1\n", b"!x=1\nz=1\n"]


def test_glsl(spark):
    got = run(spark, [(f"{i}.fsh", c[0]) for i, c in enumerate(GLSL_CASES)])
    for (data, want), r in zip(GLSL_CASES, got):
        assert bytes(r.data) == want == minify.glsl_text(data), data


def test_glsl_routes_agree(spark):
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ab/* \n\t\r") for _ in range(rng.randrange(40))) for _ in range(3000)] + [b"/*" + b"\n*" * 5000, b"// x\n" * 20000]
    got = run(spark, [(f"{i}.glsl", t) for i, t in enumerate(texts)])
    for t, r in zip(texts, got):
        assert bytes(r.data) == minify.glsl_text(t), t[:80]


def test_switched_off(spark):
    o = Options(json_minify=False, text_minify=False, png_recompress=False, png_strip_meta=False, png_lossy=False, ogg_optimize=False)
    rows = [("a.json", b" { } // x"), ("a.lang", b"# x"), ("a.vsh", b"  'a'  b "), ("a.png", b"\x89PNG\r\n\x1a\nxx"), ("a.ogg", b"OggSxx"), ("a.bin", b"\x00")]
    assert [(bytes(r.data), r.changed) for r in run(spark, rows, o)] == [(d, False) for _, d in rows]


def test_paths(spark):
    names = ["A.PNG", "noext", "d.png/f", ".", "a.apng", "x/.lang", "b.tar.MCMETA", "a.b/c"]
    df = spark.createDataFrame([(n,) for n in names], "rel string")
    got = [(r.e, r.k) for r in df.select(paths.extension(df.rel).alias("e"), paths.kind(df.rel).alias("k")).collect()]
    assert got == [(".png", "PNG"), ("", "PASS"), (".png/f", "PASS"), (".", "PASS"), (".apng", "PNG"), (".lang", "LANG"), (".mcmeta", "JSON"), (".b/c", "PASS")]


@pytest.mark.parametrize("n,want", [(0, "0 B"), (1023, "1023 B"), (1024, "1.00 KB"), (1152, "1.12 KB"), (1 << 20, "1.00 MB"), (3 << 30, "3.00 GB")])
def test_human_bytes(spark, n, want):
    df = spark.createDataFrame([(n,)], "n long")
    assert df.select(report.human_bytes(df.n)).first()[0] == want


def test_trim_path_counts_bytes(spark):
    df = spark.createDataFrame([("é" * 30,), ("a" * 48,), ("a" * 49,)], "p string")
    got = [bytes(r[0]) for r in df.select(report.trim_path(df.p)).collect()]
    raw = ("é" * 30).encode()
    assert got == [b"..." + raw[-45:], b"a" * 48, b"..." + b"a" * 45]


def test_versions(spark):
    df = spark.createDataFrame([("v1.2.4", True), ("1.2.3", False), ("1.10", True), ("1.x", False), ("2", True), ("1.2.3.1", True), ("", False)], "t string, w boolean")
    from pyspark.sql import functions as F

    for r in df.select("t", "w", report.is_newer(df.t, F.lit("1.2.3")).alias("g")).collect():
        assert r.g == r.w, r
