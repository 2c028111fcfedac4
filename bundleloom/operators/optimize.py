"""Per-file transforms: one pass of column expressions chosen by extension; Python only ever sees media files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bundleloom.functions import media, minify, paths
from bundleloom.operators import registry
from bundleloom.operators.registry import Optimizer
from bundleloom.options import Options
from bundleloom.schema import DEFLATE


def _json(rel: Column, data: Column, o: Options):
    if not o.json_minify:
        return data, F.lit("")
    told = minify.json_has_comment(data) & ~F.endswith(rel, F.lit("c"))
    return minify.json_minify(data), F.when(told, F.concat(rel, F.lit(": comments were removed from strict JSON"))).otherwise("")


def _lang(rel, data, o):
    return (minify.lang_lines(data) if o.text_minify else data), F.lit("")


def _properties(rel, data, o):
    return (minify.properties_lines(data) if o.text_minify else data), F.lit("")


def _shader(rel, data, o):
    return (minify.glsl_minify(data) if o.text_minify else data), F.lit("")


JSON, SHADER = Optimizer("json", columns=_json), Optimizer("shader", columns=_shader)
LANG, PROPERTIES = Optimizer("lang", columns=_lang), Optimizer("properties", columns=_properties)
PNG, OGG = Optimizer("png", media=media.png), Optimizer("ogg", media=media.ogg)
registry.register(JSON, "json", "jsonc", "mcmeta", "mcmetac")
registry.register(PNG, "png")
registry.register(OGG, "ogg", "oga")
registry.register(SHADER, "vsh", "fsh", "glsl")
registry.register(LANG, "lang")
registry.register(PROPERTIES, "properties")

_OUT = ["rel", "ordinal", "ext", "kind", "orig", "new", "method", "changed", "skipped", "note", "data", "error"]


def _finish(df: DataFrame, data: Column, note: Column) -> DataFrame:
    """Result columns of a native transform; a file counts as changed when its length differs."""
    df = df.withColumn("_new", data).withColumn("note", note)
    new = F.octet_length("_new").cast("long")
    df = df.withColumns({"new": new, "changed": new != F.col("orig"), "method": F.lit(DEFLATE), "skipped": F.lit(False)})
    return df.drop("data").withColumnRenamed("_new", "data").select(*_OUT)


def _media(df: DataFrame, which: dict, o: Options) -> DataFrame:
    """Media files through the function of their extension; unreadable ones pass."""
    schema = "rel string, ordinal bigint, ext string, kind string, orig bigint, new bigint, method int, changed boolean, skipped boolean, note string, data binary, error string"

    def run(batches):
        for b in batches:
            read = zip(b.column("ext").to_pylist(), (d.as_py() for d in b.column("data")), b.column("error").to_pylist())
            made = [which[e](d, o) if d is not None and error is None else (d, DEFLATE, None if d is None else False, "") for e, d, error in read]
            cols = {c: b.column(c) for c in ("rel", "ordinal", "ext", "kind", "orig", "error")}
            cols |= {
                "new": pa.array([None if m[0] is None else len(m[0]) for m in made], pa.int64()), "method": pa.array([m[1] for m in made], pa.int32()),
                "changed": pa.array([m[2] for m in made], pa.bool_()), "skipped": pa.array([False] * len(made), pa.bool_()),
                "note": pa.array([m[3] for m in made], pa.string()), "data": pa.array([m[0] for m in made], pa.binary()),
            }
            yield pa.RecordBatch.from_arrays([cols[c] for c in _OUT], _OUT)

    return df.select("rel", "ordinal", "ext", "kind", "orig", "data", "error").mapInArrow(run, schema)


def has_media(files: DataFrame) -> bool:
    """True if a file's extension has an optimizer that is a Python function: a scan of the paths alone."""
    exts = [e for own, exts in registry.by_optimizer().items() if own.media is not None for e in exts]
    return files.isStreaming or not files.select(paths.extension(F.col("rel")).alias("ext")).filter(F.col("ext").isin(exts)).isEmpty()


def optimize(files: DataFrame, o: Options = Options(), media_files: bool | None = None) -> DataFrame:
    """``files(rel, ordinal, data, error)`` -> the optimized table; unreadable files pass with their error.

    One scan; a second, with a Python stage, only where there are media files (``media_files``: whether there
    are, looked up if not said).
    """
    rel, data, ext = F.col("rel"), F.col("data"), F.col("ext")
    base = files.select("rel", "ordinal", "data", "error", paths.extension(rel).alias("ext"), paths.kind(rel).alias("kind"), F.octet_length("data").cast("long").alias("orig"))
    readable = F.col("error").isNull() & data.isNotNull()
    new, note = F.when(~readable, data), F.when(~readable, F.lit(""))
    by_media: dict = {}
    for own, exts in registry.by_optimizer().items():
        if own.media is not None:
            by_media[own.media] = exts
        else:
            made, told = own.columns(rel, data, o)
            new, note = new.when(ext.isin(exts), made), note.when(ext.isin(exts), told)
    if media_files is None:
        media_files = has_media(files)
    if not media_files or not by_media:
        return _finish(base, new.otherwise(data), note.otherwise(F.lit("")))
    mine = ext.isin([e for exts in by_media.values() for e in exts])  # by path alone: content that is made isn't made for both branches
    plain = _finish(base.filter(~mine), new.otherwise(data), note.otherwise(F.lit("")))
    which = {e: fn for fn, exts in by_media.items() for e in exts}
    return plain.unionByName(_media(base.filter(mine), which, o))


def settle_method(optimized: DataFrame, o: Options = Options()) -> DataFrame:
    """The archive method of each file: by default everything is deflated, whatever the hint."""
    return optimized if o.store_policy == "hint" else optimized.withColumn("method", F.lit(DEFLATE))
