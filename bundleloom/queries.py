"""Registered queries of the pack operators, over virtual packs made from the given tables, with their SQL.

A virtual pack is ``(rel, ordinal, data, error)``: rows of a table given a path whose extension depends on
their id and, where comments or quotes are wanted, text around them; the SQL builds the same strings.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundleloom.functions import media, minify, paths, report
from bundleloom.operators import layout, registry, summary
from bundleloom.operators.optimize import optimize, settle_method
from bundleloom.options import Options
from bundleloom.sinks import archive
from bundleloom.sources import pack
from bundleloom.staging import scope, shared_dir, track

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql.strip()
        return fn

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- virtual packs; each with its SQL twin

_EXT = ("json", "LANG", "properties", "txt", "jsonc", "PNG", "d/f", "ogg")
_EXT_SQL = "[" + ", ".join(f"'{e}'" for e in _EXT) + "]"
DOCS_SQL = f"SELECT 'a.b/' || source || '/' || doc_id || '.' || {_EXT_SQL}[doc_id % 8 + 1] AS rel, doc_id AS ordinal, coalesce(text, '') AS data FROM documents"


def docs_pack(spark, sf_dir) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, _EXT)), (F.col("doc_id") % 8 + 1).cast("int"))
    rel = F.concat(F.lit("a.b/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext)
    data = F.coalesce("text", F.lit("")).cast("binary")
    return _t(spark, sf_dir, "documents").select(rel.alias("rel"), F.col("doc_id").alias("ordinal"), data.alias("data"), F.lit(None).cast("string").alias("error"))


JSON_SQL = """SELECT 'e/' || event_id || CASE event_id % 3 WHEN 0 THEN '.json' WHEN 1 THEN '.jsonc' ELSE '.MCMETA' END AS rel, event_id AS ordinal,
 CASE WHEN event_id % 2 = 0 THEN '// of ' || event_type || chr(10) ELSE '' END || ' { "p" : ' || props || ' , "s" : "a // b /* c */ \\" d" }' || CASE WHEN event_id % 5 = 0 THEN '/* end' ELSE '' END AS data FROM events"""


def json_pack(spark, sf_dir) -> DataFrame:
    i = F.col("event_id")
    ext = F.when(i % 3 == 0, ".json").when(i % 3 == 1, ".jsonc").otherwise(".MCMETA")
    head = F.when(i % 2 == 0, F.concat(F.lit("// of "), "event_type", F.lit("\n"))).otherwise("")
    tail = F.when(i % 5 == 0, "/* end").otherwise("")
    data = F.concat(head, F.lit(' { "p" : '), "props", F.lit(' , "s" : "a // b /* c */ \\" d" }'), tail)
    return _t(spark, sf_dir, "events").select(F.concat(F.lit("e/"), i.cast("string"), ext).alias("rel"), i.alias("ordinal"), data.cast("binary").alias("data"), F.lit(None).cast("string").alias("error"))


GLSL_SQL = """SELECT 'g/' || conv_id || '-' || turn || '.fsh' AS rel, turn AS ordinal,
 '#version 150 // ' || role || chr(10) || chr(9) || 'void  main() { /* a' || chr(10) || ' b */ ' || coalesce(text, '') || ' }  ' || chr(13) || chr(10) AS data FROM conversations"""


def glsl_pack(spark, sf_dir) -> DataFrame:
    data = F.concat(F.lit("#version 150 // "), "role", F.lit("\n\tvoid  main() { /* a\n b */ "), F.coalesce("text", F.lit("")), F.lit(" }  \r\n"))
    rel = F.concat(F.lit("g/"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit(".fsh"))
    return _t(spark, sf_dir, "conversations").select(rel.alias("rel"), F.col("turn").alias("ordinal"), data.cast("binary").alias("data"), F.lit(None).cast("string").alias("error"))


def _text(c: str = "data"):
    return F.decode(F.col(c), "UTF-8")


# ---- classification

_EXT_OF = "CASE WHEN instr({0}, '.') = 0 THEN '' ELSE lower('.' || string_split({0}, '.')[-1]) END"
_KINDS = {"PNG": ".png .apng", "OGG": ".ogg .oga", "JSON": ".json .jsonc .mcmeta .mcmetac", "GLSL": ".fsh .vsh .glsl", "LANG": ".lang", "PROP": ".properties"}
_KIND_OF = "CASE " + " ".join(f"WHEN {_EXT_OF.format('base')} = '{e}' THEN '{k}'" for k, es in _KINDS.items() for e in es.split()) + " ELSE 'PASS' END"
_REGISTERED = {"json": ".json .jsonc .mcmeta .mcmetac", "png": ".png", "ogg": ".ogg .oga", "shader": ".vsh .fsh .glsl", "lang": ".lang", "properties": ".properties"}
_ROWS = ", ".join(f"('{e}', '{o}')" for o, es in _REGISTERED.items() for e in es.split())


@query(f"""
WITH p AS (SELECT page_id AS id, url AS rel FROM pages UNION ALL SELECT ordinal, rel FROM ({DOCS_SQL})),
b AS (SELECT id, rel, string_split(rel, '/')[-1] AS base FROM p)
SELECT id, rel, {_EXT_OF.format("rel")} AS ext, {_KIND_OF} AS kind FROM b""")
def ext_kind(spark, sf_dir):
    """Extension of the whole path and display kind of the base name."""
    p = _t(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("rel"))
    p = p.unionByName(docs_pack(spark, sf_dir).select(F.col("ordinal").alias("id"), "rel"))
    return p.select("id", "rel", paths.extension(F.col("rel")).alias("ext"), paths.kind(F.col("rel")).alias("kind"))


@query(f"""
WITH r(ext, optimizer) AS (VALUES {_ROWS}),
d AS (SELECT rel, {_EXT_OF.format("rel")} AS ext FROM ({DOCS_SQL}))
SELECT d.rel, d.ext, coalesce(r.optimizer, 'pass') AS optimizer FROM d LEFT JOIN r ON d.ext = r.ext""")
def registry_dispatch(spark, sf_dir):
    """File to optimizer by extension: a left join with the registry, a few rows."""
    files = docs_pack(spark, sf_dir).select("rel", paths.extension(F.col("rel")).alias("ext"))
    return files.join(F.broadcast(registry.table(spark)), "ext", "left").select("rel", "ext", F.coalesce("optimizer", F.lit("pass")).alias("optimizer"))


@query(f"SELECT ext FROM (VALUES {_ROWS}) AS r(ext, optimizer)")
def registered_extensions(spark, sf_dir):
    return registry.table(spark).select("ext")


@query(f"""
SELECT rel, CASE WHEN strlen(rel) > length(rel) THEN 2048 ELSE 0 END AS flag, regexp_replace(replace(rel, chr(92), '/'), '^\\./', '') AS plain
FROM (SELECT './' || rel || CASE WHEN ordinal % 2 = 0 THEN 'é' ELSE chr(92) || 'x' END AS rel FROM ({DOCS_SQL}))""")
def name_flag(spark, sf_dir):
    """UTF-8 name flag and path normalisation."""
    tail = F.when(F.col("ordinal") % 2 == 0, "é").otherwise("\\x")
    rel = docs_pack(spark, sf_dir).select(F.concat(F.lit("./"), "rel", tail).alias("rel"))
    return rel.select("rel", paths.utf8_flag(F.col("rel")).alias("flag"), paths.normalise(F.col("rel")).alias("plain"))


_SNIFF = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '89504E470D0A1A0A' WHEN 1 THEN '4F676753' WHEN 2 THEN '89504E47' ELSE '' END
 || CASE WHEN p_partkey % 8 = 0 THEN '0000000D4948445200000008000000080806000000FFFFFFFF00' ELSE '' END AS h FROM part"""


@query(f"""
SELECT p_partkey, h LIKE '89504E470D0A1A0A%' AS png, h LIKE '4F676753%' AS ogg,
  CASE WHEN h LIKE '89504E470D0A1A0A%' AND length(h) >= 66 THEN CAST(substr(h, 51, 2) AS INT) END AS color FROM ({_SNIFF})""")
def magic_sniff(spark, sf_dir):
    """Signatures and PNG colour type from leading bytes."""
    k = F.col("p_partkey")
    head = F.when(k % 4 == 0, "89504E470D0A1A0A").when(k % 4 == 1, "4F676753").when(k % 4 == 2, "89504E47").otherwise("")
    more = F.when(k % 8 == 0, "0000000D4948445200000008000000080806000000FFFFFFFF00").otherwise("")
    data = F.unhex(F.concat(head, more))
    return _t(spark, sf_dir, "part").select(k, paths.is_png(data).alias("png"), paths.is_ogg(data).alias("ogg"), paths.png_color_type(data).alias("color"))


# ---- text transforms

_STR = r'("(?:[^"\\]|\\.)*(?:"|\\?\z))'
_COM = r"//[^\r\n]*|/\*.*?(?:\*/|\z)"
_JSON_ALL = f"regexp_replace(data, '(?s){_STR}|{_COM}|[ \\t\\r\\n]+', '\\1', 'g')"
_JSON_COM = f"regexp_replace(data, '(?s){_STR}|{_COM}', '\\1', 'g')"


@query(f"SELECT rel, {_JSON_ALL} AS data, strlen({_JSON_ALL}) <> strlen(data) AS changed FROM ({JSON_SQL})")
def json_minify(spark, sf_dir):
    return optimize(json_pack(spark, sf_dir)).select("rel", _text().alias("data"), "changed")


@query(f"""
SELECT rel, strlen({_JSON_COM}) <> strlen(data) AS has_comment,
  CASE WHEN strlen({_JSON_COM}) <> strlen(data) AND NOT rel LIKE '%c' THEN rel || ': comments were removed from strict JSON' ELSE '' END AS note FROM ({JSON_SQL})""")
def json_comment_note(spark, sf_dir):
    files = json_pack(spark, sf_dir)
    seen = files.select("rel", minify.json_has_comment(F.col("data")).alias("has_comment"))
    return seen.join(optimize(files).select("rel", "note"), "rel")


def _lines_sql(markers: str) -> str:
    lines = "[regexp_replace(y, '\\r\\z', '') FOR y IN string_split(data, chr(10))]"
    return f"array_to_string([x || chr(10) FOR x IN {lines} IF x <> '' AND contains(x, '=') AND NOT contains('{markers}', x[1])], '')"


_PAIRS_SQL = "SELECT 'l/' || page_id || '{}' AS rel, page_id AS ordinal, '# top=' || url || chr(10) || '!b=1' || chr(13) || chr(10) || chr(10) || ' #c=2' || chr(13) || chr(13) || chr(10) || 'none' || chr(10) || html AS data FROM pages"


def _pairs_pack(spark, sf_dir, ext: str) -> DataFrame:
    data = F.concat(F.lit("# top="), "url", F.lit("\n!b=1\r\n\n #c=2\r\r\nnone\n"), "html").cast("binary")
    rel = F.concat(F.lit("l/"), F.col("page_id").cast("string"), F.lit(ext))
    return _t(spark, sf_dir, "pages").select(rel.alias("rel"), F.col("page_id").alias("ordinal"), data.alias("data"), F.lit(None).cast("string").alias("error"))


@query(f"SELECT rel, {_lines_sql('#')} AS data FROM ({_PAIRS_SQL.format('.lang')})")
def lang_lines(spark, sf_dir):
    return optimize(_pairs_pack(spark, sf_dir, ".lang")).select("rel", _text().alias("data"))


@query(f"SELECT rel, {_lines_sql('#!')} AS data FROM ({_PAIRS_SQL.format('.properties')})")
def properties_lines(spark, sf_dir):
    return optimize(_pairs_pack(spark, sf_dir, ".properties")).select("rel", _text().alias("data"))


# strings, line comments, block comments, the rest: the white space of strings is set aside, comments go, lines are tidied
_GLSL_PARTS = r"""(?s)"(?:[^"\\]|\\.)*(?:"|\\?\z)|''(?:[^''\\]|\\.)*(?:''|\\?\z)|//[^\n]*|/\*.*?(?:\*/|\z)|[^"''/]+|/"""
_BLANKS, _ASIDE = "' ' || chr(9) || chr(13) || chr(10)", "chr(57344) || chr(57345) || chr(57346) || chr(57347)"
_GLSL = f"""array_to_string([CASE WHEN x[1] IN ('"', '''') THEN translate(x, {_BLANKS}, {_ASIDE}) WHEN x[1:2] = '//' THEN ''
 WHEN x[1:2] = '/*' THEN CASE WHEN contains(CASE WHEN x LIKE '%*/' AND length(x) >= 4 THEN x ELSE left(x, greatest(length(x) - 1, 2)) END, chr(10)) THEN chr(10) ELSE '' END ELSE x END
 FOR x IN regexp_extract_all(data, '{_GLSL_PARTS}')], '')"""


def _glsl_sql() -> str:
    out = _GLSL
    for pattern, to in ((r"[ \t\r]+", "' '"), (r"\n[ \n]*", "chr(10)"), (r"\A[ \n]+", "''")):
        out = f"regexp_replace({out}, '{pattern}', {to}, 'g')"
    out = f"translate({out}, {_ASIDE}, {_BLANKS})"
    return f"regexp_replace(regexp_replace({out}, ' ?\\z', ''), '\\n?\\z', '')"


@query(f"SELECT rel, {_glsl_sql()} AS data FROM ({GLSL_SQL})")
def glsl_minify(spark, sf_dir):
    return optimize(glsl_pack(spark, sf_dir)).select("rel", _text().alias("data"))


_QUOTED = """'"a // b" /* c */ ''q /* " ' || chr(10) || ' ''' || data || CASE WHEN ordinal % 2 = 0 THEN '"open  ' ELSE '/* open' || chr(10) END"""


@query(f"SELECT rel, {_glsl_sql()} AS data FROM (SELECT rel, {_QUOTED} AS data FROM ({GLSL_SQL}))")
def glsl_quoted(spark, sf_dir):
    """Shaders with strings in both quotes, comment marks inside them, and ends that are left open."""
    head, tail = F.lit("\"a // b\" /* c */ 'q /* \" \n '"), F.when(F.col("ordinal") % 2 == 0, '"open  ').otherwise("/* open\n")
    files = glsl_pack(spark, sf_dir).withColumn("data", F.concat(head, _text(), tail).cast("binary"))
    return optimize(files).select("rel", _text().alias("data"))


# ---- dedup and layout


@query(f"""
WITH d AS (SELECT rel, ordinal, sha256(data) AS hash FROM ({DOCS_SQL}))
SELECT rel, hash, first_value(rel) OVER w AS owner_rel, row_number() OVER w = 1 AS is_owner FROM d WINDOW w AS (PARTITION BY hash ORDER BY rel, ordinal)""")
def content_dedup(spark, sf_dir):
    files = docs_pack(spark, sf_dir).select("rel", "ordinal", F.lit(8).alias("method"), layout.content_key(F.col("data")).alias("hash"))
    return layout.entries(files).select("rel", "hash", "owner_rel", "is_owner")


_STORED = f"""WITH d AS (SELECT rel, ordinal, sha256(data) AS hash, strlen(data) AS comp_size FROM ({DOCS_SQL})),
m AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY rel, ordinal) = 1 AS is_owner FROM d),
o AS (SELECT rel, ordinal, hash, comp_size, 30 + strlen(rel) + comp_size AS rec_len FROM m WHERE is_owner),
p AS (SELECT *, CAST(coalesce(sum(rec_len) OVER (ORDER BY rel, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS local_offset FROM o)"""


def _stored(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(entries, laid out bodies) of the documents' pack if it were stored uncompressed."""
    files = docs_pack(spark, sf_dir).select("rel", "ordinal", F.lit(0).alias("method"), layout.content_key(F.col("data")).alias("hash"), F.octet_length("data").cast("long").alias("comp_size"))
    rows = layout.entries(files)
    length = layout.local_length(F.col("rel"), F.col("comp_size"), F.col("comp_size"))
    return rows, layout.running_offsets(rows.filter("is_owner").withColumn("rec_len", length), ["rel", "ordinal"], "rec_len")


@query(_STORED + " SELECT CAST(coalesce(sum(CASE WHEN NOT is_owner THEN 30 + strlen(rel) + comp_size END), 0) AS BIGINT) AS dedup_saved FROM m")
def dedup_savings(spark, sf_dir):
    return layout.dedup_savings(_stored(spark, sf_dir)[0])


@query(_STORED + " SELECT rel, rec_len, local_offset FROM p")
def archive_offsets(spark, sf_dir):
    return _stored(spark, sf_dir)[1].select("rel", "rec_len", "local_offset")


@query(_STORED + """ SELECT m.rel, m.is_owner, p.local_offset FROM m JOIN p ON m.hash = p.hash""")
def directory_entries(spark, sf_dir):
    """Logical entries joined with their physical body."""
    rows, placed = _stored(spark, sf_dir)
    return rows.join(placed.select("hash", "local_offset"), "hash").select("rel", "is_owner", "local_offset")


@query(_STORED + " SELECT (SELECT CAST(sum(rec_len) AS BIGINT) FROM p) AS cd_start, (SELECT CAST(sum(46 + strlen(rel)) AS BIGINT) FROM m) AS cd_size, (SELECT count(*) FROM m) AS entries")
def central_directory(spark, sf_dir):
    rows, placed = _stored(spark, sf_dir)
    start = placed.agg(F.sum("rec_len").alias("cd_start"))
    full = rows.join(placed.select("hash", "local_offset"), "hash")
    size = full.agg(F.sum(layout.central_length(F.col("rel"), F.col("comp_size"), F.col("comp_size"), F.col("local_offset"))).alias("cd_size"), F.count("*").alias("entries"))
    return start.crossJoin(size).select("cd_start", "cd_size", "entries")  # one row each


@query(f"SELECT rel, row_number() OVER (ORDER BY rel, ordinal) AS place FROM ({DOCS_SQL})")
def sorted_paths(spark, sf_dir):
    """Bytewise path order, as places (a running sum of ones)."""
    files = docs_pack(spark, sf_dir).select("rel", "ordinal", F.lit(1).alias("one"))
    return layout.running_offsets(files, ["rel", "ordinal"], "one", "before").select("rel", (F.col("before") + 1).alias("place"))


# ---- reports

_OPT = f"""j AS (SELECT rel, ordinal, strlen(data) AS orig, strlen({_JSON_ALL}) AS new FROM ({JSON_SQL})), o AS (SELECT *, orig <> new AS changed FROM j)"""
_HUMAN = """CASE WHEN {0} >= 1073741824 THEN printf('%.2f GB', round_even({0} / 1073741824.0::DOUBLE, 2)) WHEN {0} >= 1048576 THEN printf('%.2f MB', round_even({0} / 1048576.0::DOUBLE, 2))
 WHEN {0} >= 1024 THEN printf('%.2f KB', round_even({0} / 1024.0::DOUBLE, 2)) ELSE {0} || ' B' END"""


@query(f"""WITH {_OPT} SELECT count(*) AS files, count(*) FILTER (changed) AS optimized, CAST(sum(orig) AS BIGINT) AS orig_bytes, CAST(sum(new) AS BIGINT) AS new_bytes,
  round((sum(orig) - sum(new))::DOUBLE / sum(orig)::DOUBLE * 100.0::DOUBLE, 6) AS pct_smaller FROM o""")
def pack_summary(spark, sf_dir):
    return summary.pack_summary(optimize(json_pack(spark, sf_dir))).withColumn("pct_smaller", F.round("pct_smaller", 6))


@query(f"""WITH {_OPT} SELECT rel, rpad(rel, greatest(60, length(rel))::INT, ' ') || ' -' || {_HUMAN.format("(orig - new)")} || '  (' || orig || ' -> ' || new || ')' AS line FROM o WHERE new < orig""")
def log_rows(spark, sf_dir):
    return summary.log_rows(optimize(json_pack(spark, sf_dir)))


@query(f"""SELECT rel, rel || ': comments were removed from strict JSON' AS note FROM ({JSON_SQL}) WHERE strlen({_JSON_COM}) <> strlen(data) AND NOT rel LIKE '%c'""")
def notes(spark, sf_dir):
    return summary.notes(optimize(json_pack(spark, sf_dir)))


@query(f"SELECT orderkey, {_HUMAN.format('n')} AS label FROM (SELECT o_orderkey AS orderkey, CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 4000) + o_orderkey * 128 AS n FROM orders)")
def human_bytes(spark, sf_dir):
    n = F.floor("o_totalprice").cast("long") * (F.col("o_orderkey") % 4000) + F.col("o_orderkey") * 128
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), report.human_bytes(n).alias("label"))


@query("SELECT page_id, CASE WHEN strlen(url) <= 48 THEN url ELSE '...' || right(url, 45) END AS short FROM (SELECT page_id, url || '/x' AS url FROM pages)")
def trim_path(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.decode(report.trim_path(F.concat("url", F.lit("/x"))), "UTF-8").alias("short"))


@query("""SELECT p_partkey, CASE WHEN hi = 0 THEN '' ELSE lo || '-' || hi END AS quality, CASE WHEN l <= 0 THEN '4' WHEN l > 6 THEN 'max' ELSE l || '' END AS level
FROM (SELECT p_partkey, l, lo, greatest(lo, hi) AS hi FROM (SELECT p_partkey, p_partkey % 10 - 1 AS l, greatest(0, least(100, p_size * 5 - 40)) AS lo, greatest(0, least(100, (p_partkey % 120 - 10))) AS hi FROM part))""")
def quality_level(spark, sf_dir):
    k = F.col("p_partkey")
    q = report.quality_range(F.col("p_size") * 5 - 40, (k % 120 - 10).cast("int"))
    return _t(spark, sf_dir, "part").select(k, q.alias("quality"), report.png_level(k % 10 - 1).alias("level"))


_FILES = """(SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 2 = 0 END AS in_file, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 2 = 1 END AS in_flag FROM customer)"""


@query(f"SELECT c_custkey, coalesce(in_flag, in_file, true) AS minify, coalesce(in_file, false) OR coalesce(in_flag, false) AS quiet FROM {_FILES}")
def config_overlay(spark, sf_dir):
    """Precedence of settings as a coalesce: flag, then file, then the built-in value; switches only turn on."""
    k = F.col("c_custkey")
    rows = _t(spark, sf_dir, "customer").select(k, F.when(k % 3 != 0, k % 2 == 0).alias("in_file"), F.when(k % 5 == 0, k % 2 == 1).alias("in_flag"))
    quiet = F.coalesce("in_file", F.lit(False)) | F.coalesce("in_flag", F.lit(False))
    return rows.select("c_custkey", F.coalesce("in_flag", "in_file", F.lit(Options().json_minify)).alias("minify"), quiet.alias("quiet"))


@query("""WITH v AS (SELECT p_partkey, (p_partkey % 3)::BIGINT AS a, (p_size % 4)::BIGINT AS b, (p_partkey % 7)::BIGINT AS c FROM part)
SELECT p_partkey, 'v' || a || '.' || b || '.' || c AS tag, (a, b, c) > (1, 2, 3) AS newer FROM v""")
def version_compare(spark, sf_dir):
    k = F.col("p_partkey")
    tag = F.concat(F.lit("v"), (k % 3).cast("string"), F.lit("."), (F.col("p_size") % 4).cast("string"), F.lit("."), (k % 7).cast("string"))
    rows = _t(spark, sf_dir, "part").select(k, tag.alias("tag"))
    return rows.withColumn("newer", report.is_newer(F.col("tag"), F.lit("1.2.3")))


@query("""SELECT o_orderkey, CASE WHEN n >= 1048576 THEN (n // 1048576) || ' MB' WHEN n >= 1024 THEN (n // 1024) || ' KB' ELSE n || ' B' END AS label,
 'out/' || o_orderkey || '-optimized.zip' AS out FROM (SELECT o_orderkey, o_orderkey * o_orderkey AS n FROM orders)""")
def size_label(spark, sf_dir):
    n = F.col("o_orderkey") * F.col("o_orderkey")
    path = F.concat(F.lit("/packs/"), F.col("o_orderkey").cast("string"), F.lit(".ZIP/"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", report.size_label(n).alias("label"), report.output_name(path, F.lit("out/")).alias("out"))


@query(f"""WITH {_OPT} SELECT min_by(rel || ' failed', rel) AS error FROM o WHERE ordinal % 7 = 3""")
def first_error(spark, sf_dir):
    """The error of the first path, whatever the order of arrival."""
    files = json_pack(spark, sf_dir).withColumn("error", F.when(F.col("ordinal") % 7 == 3, F.concat("rel", F.lit(" failed"))))
    return summary.first_error(optimize(files))


@query("""WITH t AS (SELECT o_orderkey, ' x' || chr(10) || '{"tag_name": "v' || o_orderkey || '.' || o_orderkey % 7 || '" , "n": 1}' || chr(13) || chr(10) || chr(10) AS body FROM orders)
SELECT o_orderkey, 'v' || o_orderkey || '.' || o_orderkey % 7 AS tag, '{"tag_name": "v' || o_orderkey || '.' || o_orderkey % 7 || '" , "n": 1}' AS last, strlen(trim(body, ' ' || chr(13) || chr(10))) AS trimmed,
 CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS number FROM t""")
def text_helpers(spark, sf_dir):
    """Tag of a release feed, last line, trimmed text, number in digits."""
    k = F.col("o_orderkey").cast("string")
    body = F.concat(F.lit(' x\n{"tag_name": "v'), k, F.lit("."), (F.col("o_orderkey") % 7).cast("string"), F.lit('" , "n": 1}\r\n\n'))
    number = report.digits(F.when(F.col("o_orderkey") % 3 == 0, k).otherwise(F.concat(k, F.lit(" "))))
    trimmed = F.octet_length(report.trim_ends(body))
    return _t(spark, sf_dir, "orders").select("o_orderkey", report.tag_name(body).alias("tag"), report.last_line(body).alias("last"), trimmed.cast("long").alias("trimmed"), number.cast("long").alias("number"))


# ---- packs on disk: written from a table, read by the pack sources


def _folder(spark, name: str) -> str:
    """A fresh folder of the shared one, which the driver and all tasks must see as a local path."""
    root = shared_dir(spark)
    if "://" in root and not root.startswith("file://"):
        raise ValueError("packs are read from a file system that all machines mount")
    return track(spark, f"file://{root.removeprefix('file://')}/{name}-{uuid.uuid4().hex}").removeprefix("file://")


_OPT_DOCS = f"""SELECT rel, CASE {_EXT_OF.format("rel")} WHEN '.json' THEN {_JSON_ALL} WHEN '.jsonc' THEN {_JSON_ALL}
 WHEN '.lang' THEN {_lines_sql("#")} WHEN '.properties' THEN {_lines_sql("#!")} ELSE data END AS data FROM ({DOCS_SQL})"""


@query(f"SELECT rel, row_number() OVER (ORDER BY rel) - 1 AS place, data, strlen(data) AS size FROM ({_OPT_DOCS})")
def archive_roundtrip(spark, sf_dir):
    """A pack is optimized and written as an archive; the archive is read back by the pack source."""
    folder = _folder(spark, "roundtrip")
    os.makedirs(folder)
    path = os.path.join(folder, "pack.zip")
    with scope():
        archive.write(settle_method(optimize(docs_pack(spark, sf_dir))), path, Options(dedup="off"))
    return pack.read_pack(spark, path).select("rel", F.col("ordinal").alias("place"), _text().alias("data"), "size")


_TREE = (("a/%s.json", True), ("_u/%s.bin", True), (".dot%s", True), ("b/c/.h/%s.json", False), (".git/%s", False), ("b/.x/y/%s", False), ("é/%s.TXT", True))
_TREE_SQL = " UNION ALL ".join(f"SELECT replace('{p}', '%s', CAST(n_nationkey AS VARCHAR)) AS rel, n_name AS data FROM nation" for p, seen in _TREE if seen)


@query(f"SELECT rel, strlen(data) AS size, row_number() OVER (ORDER BY rel) - 1 AS ordinal, data FROM ({_TREE_SQL})")
def directory_scan(spark, sf_dir):
    """A directory read by both sources, index and files: hidden directories and links left out, dot files kept."""
    root = _folder(spark, "tree")
    for r in _t(spark, sf_dir, "nation").collect():  # a few files, so that there is a directory to read
        for p, _ in _TREE:
            at = os.path.join(root, p % r.n_nationkey)
            os.makedirs(os.path.dirname(at), exist_ok=True)
            with open(at, "w", encoding="utf-8") as f:
                f.write(r.n_name)
    os.symlink(os.path.join(root, "a"), os.path.join(root, "link"))
    os.symlink(os.path.join(root, "a/0.json"), os.path.join(root, "a/link.json"))
    files = pack.read_pack(spark, root).select("rel", _text().alias("data"))
    return pack.read_index(spark, root).join(files, "rel").select("rel", "size", "ordinal", "data")


# ---- media: made from table values by Arrow functions, then optimized like any pack


def _made(df: DataFrame, ext: str, fn) -> DataFrame:
    """A pack of files that ``fn(key)`` makes for each key.  Keys lie close together, in few tasks, so they are dealt out first."""

    def make(keys: pa.Array) -> pa.Array:
        return pa.array([fn(k) for k in keys.to_pylist()], pa.binary())

    key, spark = F.col(df.columns[0]), df.sparkSession
    dealt = df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    rel = F.concat(F.lit("m/"), key.cast("string"), F.lit(ext))
    return dealt.select(rel.alias("rel"), key.alias("ordinal"), F.arrow_udf(make, "binary")(key).alias("data"), F.lit(None).cast("string").alias("error"))


def _png_of(k: int) -> bytes:
    """Two by two RGBA pixels from k; a text chunk, a chunk of the safe set, and for every fifth a control chunk of animation."""
    chunk = lambda t, b: struct.pack(">I", len(b)) + t + b + struct.pack(">I", zlib.crc32(t + b))
    pixels = [(k % 251, i, 7, (255, 0, k % 256, 255)[i]) for i in range(4)]
    lines = b"".join(b"\0" + bytes(v for p in pixels[y : y + 2] for v in p) for y in (0, 2))
    extra = chunk(b"pHYs", bytes(9)) + chunk(b"tEXt", b"k\0" + b"v" * 300) + (chunk(b"acTL", bytes(8)) if k % 5 == 0 else b"")
    return paths.PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 6, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(lines, 0)) + chunk(b"IEND", b"")


@query("""SELECT p_partkey, p_partkey % 5 <> 0 AS changed, p_partkey % 256 NOT IN (0, 255) AS uses_alpha,
 CASE WHEN p_partkey % 5 = 0 THEN 'IHDR,pHYs,tEXt,acTL,IDAT,IEND' ELSE 'IHDR,pHYs,IDAT,IEND' END AS chunks,
 lower(string_agg(printf('%02X%02X07%02X', p_partkey % 251, i, CASE i WHEN 1 THEN 0 WHEN 2 THEN p_partkey % 256 ELSE 255 END), '' ORDER BY i)) AS pixels
FROM part, (SELECT unnest([0, 1, 2, 3]) AS i) GROUP BY p_partkey""")
def png_optimize(spark, sf_dir):
    """Lossless pass: pixels stay, chunks outside the safe set go, animations pass; the alpha test beside it."""
    files = _made(_t(spark, sf_dir, "part").select("p_partkey"), ".png", _png_of)
    done = optimize(files, Options(png_lossy=False, png_keep_color_profile=True), media_files=True)

    def look(batches):
        for b in batches:
            found = [(media.uses_alpha(d), ",".join(t.decode() for t, _ in media.chunks(d)), media.samples(d)[2].tobytes().hex()) for d in b.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("ordinal"), b.column("changed"), *map(pa.array, zip(*found))], ["p_partkey", "changed", "uses_alpha", "chunks", "pixels"])

    return done.select("ordinal", "changed", "data").mapInArrow(look, "p_partkey bigint, changed boolean, uses_alpha boolean, chunks string, pixels string")


def _ogg_of(k: int) -> bytes:
    """Headers with a vendor and a comment, and audio packets from k; every fourth isn't Ogg."""
    comment = b"\x03vorbis" + struct.pack("<I", 9) + b"encoder x" + struct.pack("<I", 1) + struct.pack("<I", 8) + b"title=%02d" % (k % 100) + b"\x01"
    packets = [(2, 0, b"\x01vorbis" + bytes(23)), (0, 0, comment), (0, 0, b"\x05vorbis" + bytes(600)), (0, 64, bytes([k % 256]) * 300), (4, 128, b"%d" % k)]
    return media.ogg_stream(packets, 77) if k % 4 else b"Riff%d" % k


@query("""SELECT p_partkey, p_partkey % 4 <> 0 AS changed, CASE WHEN p_partkey % 4 <> 0 THEN '03766f72626973000000000000000001' END AS comment,
 CASE WHEN p_partkey % 4 <> 0 THEN repeat(lower(printf('%02X', p_partkey % 256)), 300) || lower(hex(CAST(p_partkey AS VARCHAR))) END AS audio FROM part""")
def ogg_optimize(spark, sf_dir):
    """Container pass: vendor and comments emptied, packets of audio as they were; other files pass."""
    done = optimize(_made(_t(spark, sf_dir, "part").select("p_partkey"), ".ogg", _ogg_of), media_files=True)

    def look(batches):
        for b in batches:
            found = [[p for _, _, p in media.ogg_packets(d)] if d[:4] == b"OggS" else None for d in b.column("data").to_pylist()]
            comment, audio = [f and f[1].hex() for f in found], [f and b"".join(f[3:]).hex() for f in found]
            yield pa.RecordBatch.from_arrays([b.column("ordinal"), b.column("changed"), pa.array(comment, pa.string()), pa.array(audio, pa.string())], ["p_partkey", "changed", "comment", "audio"])

    return done.select("ordinal", "changed", "data").mapInArrow(look, "p_partkey bigint, changed boolean, comment string, audio string")


# ---- bytes that SQL can't make


@query()
def crc32_rows(spark, sf_dir):
    return docs_pack(spark, sf_dir).select("rel", F.crc32("data").alias("crc"))


@query()
def deflate_sizes(spark, sf_dir):
    files = docs_pack(spark, sf_dir).select("rel", "ordinal", F.lit(8).alias("method"), layout.content_key(F.col("data")).alias("hash"), "data")
    return archive.bodies(files).select("rel", "crc", "uncomp_size", "comp_size")


@query()
def archive_plan(spark, sf_dir):
    """The whole chain: optimize, dedup, deflate, offsets, directory."""
    done = settle_method(optimize(docs_pack(spark, sf_dir)))
    return archive.plan(done)[1].select("rel", "is_owner", "method", "crc", "uncomp_size", "comp_size", "local_offset", "flags")
