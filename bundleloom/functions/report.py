"""Columns for reports: sizes, deltas, padded rows, shortened paths, and small parameter maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def human_bytes(n: Column) -> Column:
    """Bytes as an integer below 1024, else KB, MB or GB with two decimals, ties to even."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        size = F.bround(n.cast("double") / float(1024**power), 2)
        out = F.when(n >= 1024**power, F.format_string(f"%.2f {unit}", size)).otherwise(out)
    return out


def percent_smaller(orig: Column, new: Column) -> Column:
    return F.when(orig > 0, (orig - new).cast("double") / orig.cast("double") * 100.0).otherwise(F.lit(0.0))


def delta(orig: Column, new: Column) -> Column:
    """``-`` and the bytes saved, ``+`` and the bytes added, or ``=``, with the size in words."""
    sign = F.when(new < orig, "-").when(new > orig, "+").otherwise("=")
    return F.concat(sign, human_bytes(F.abs(orig - new)))


def log_row(rel: Column, orig: Column, new: Column) -> Column:
    """Path padded to 60 but never cut, the change, and the sizes before and after."""
    return F.format_string("%-60s %s  (%d -> %d)", rel, delta(orig, new), orig, new)


def trim_path(rel: Column, most: int = 48) -> Column:
    """Paths over ``most`` bytes keep their last bytes after an ellipsis."""
    raw = F.encode(rel, "UTF-8")
    cut = F.encode(F.right(F.decode(raw, "ISO-8859-1"), F.lit(most - 3)), "ISO-8859-1")
    return F.when(F.octet_length(rel) <= most, raw).otherwise(F.concat(F.lit(b"..."), cut))


def png_level(level: Column) -> Column:
    """0 and below is preset 4; above 6 is "max"."""
    return F.when(level <= 0, "4").when(level > 6, "max").otherwise(level.cast("string"))


def quality_range(low: Column, high: Column) -> Column:
    """Both clamped to 0..100, the upper at least the lower; empty if both are 0."""
    lo, hi = (F.greatest(F.lit(0), F.least(F.lit(100), x)) for x in (low, high))
    hi = F.greatest(lo, hi)
    return F.when(hi == 0, "").otherwise(F.concat(lo.cast("string"), F.lit("-"), hi.cast("string")))


# ---- helpers of the front end


def version_parts(tag: Column) -> Column:
    """Numbers of a version after one leading v: three, later ones run on into the last; null if not digits."""
    bare = F.regexp_replace(tag, "^v", "")
    part = F.split(bare, "\\.", -1)
    number = lambda c: F.coalesce(F.nullif(c, F.lit("")).cast("long"), F.lit(0).cast("long"))
    cell = lambda i: number(F.coalesce(F.get(part, F.lit(i)), F.lit("")))
    last = number(F.array_join(F.slice(part, 3, F.greatest(F.size(part), F.lit(3))), ""))
    return F.when(bare.rlike("^[0-9.]+$"), F.struct(cell(0).alias("major"), cell(1).alias("minor"), last.alias("patch")))


def is_newer(tag: Column, than: Column) -> Column:
    """True if both are versions and the first is the greater."""
    return F.coalesce(version_parts(tag) > version_parts(than), F.lit(False))


def size_label(n: Column) -> Column:
    """Whole B, KB or MB, rounded down."""
    kb, mb = F.shiftright(n, 10), F.shiftright(n, 20)
    return F.when(mb > 0, F.concat(mb.cast("string"), F.lit(" MB"))).when(kb > 0, F.concat(kb.cast("string"), F.lit(" KB"))).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def output_name(path: Column, folder: Column, suffix: str = "-optimized.zip") -> Column:
    """Folder, the input's base name without .zip, and a suffix; an empty base is "pack", an empty folder none."""
    name = F.regexp_extract(F.regexp_replace(path, "[/\\\\]+$", ""), "[^/\\\\]*$", 0)
    base = F.regexp_replace(name, "(?i)(?<=.)\\.zip$", "")
    at = F.regexp_replace(F.trim(folder), "[/\\\\]+$", "")
    return F.concat(F.when(F.trim(folder) == "", "").otherwise(F.concat(at, F.lit("/"))), F.when(base == "", "pack").otherwise(base), F.lit(suffix))


def tag_name(body: Column) -> Column:
    """The value of the first ``"tag_name"`` in a release feed's text, its opening quote at most 32 characters on; else empty."""
    at = F.instr(body, '"tag_name"')
    rest = F.substring(body, at + 10, F.length(body))
    value = F.regexp_extract(rest, '(?s)^[^"]{0,32}"([^"]*)"', 1)
    return F.when((at > 0) & (F.octet_length(rest) >= 10), value).otherwise("")


def trim_ends(text: Column) -> Column:
    """Without blanks and line ends on either side."""
    return F.trim(text, F.lit(" \t\r\n"))


def last_line(text: Column) -> Column:
    """The last line that isn't empty, without blanks around it."""
    body = F.rtrim(text, F.lit("\r\n"))
    return F.trim(F.substring_index(body, "\n", -1), F.lit(" \t\r"))


def digits(text: Column) -> Column:
    """The number that a text of ASCII digits alone stands for; null for any other."""
    return F.when(text.rlike("^[0-9]+\\z"), text.cast("decimal(38,0)"))


# ---- plain forms of the parameter maps, for tool arguments


def png_level_text(level: int) -> str:
    return "4" if level <= 0 else "max" if level > 6 else str(level)


def quality_text(low: int, high: int) -> str:
    lo, hi = (min(100, max(0, x)) for x in (low, high))
    hi = max(lo, hi)
    return f"{lo}-{hi}" if hi else ""
