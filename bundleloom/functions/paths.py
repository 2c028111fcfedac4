"""Columns over pack paths and content: extension, kind, magic, flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display kind by extension of the base name.
KINDS = {".png": "PNG", ".apng": "PNG", ".ogg": "OGG", ".oga": "OGG", ".json": "JSON", ".jsonc": "JSON", ".mcmeta": "JSON", ".mcmetac": "JSON",
         ".fsh": "GLSL", ".vsh": "GLSL", ".glsl": "GLSL", ".lang": "LANG", ".properties": "PROP"}
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def extension(rel: Column) -> Column:
    """From the last dot of the whole path, lower-cased; empty without a dot."""
    return F.when(F.instr(rel, ".") == 0, "").otherwise(F.lower(F.concat(F.lit("."), F.substring_index(rel, ".", -1))))


def kind(rel: Column, kinds: dict[str, str] = KINDS) -> Column:
    """Display kind by the extension of the base name; PASS for the rest."""
    ext = extension(F.substring_index(rel, "/", -1))
    out = F.lit("PASS")
    for e, k in reversed(kinds.items()):
        out = F.when(ext == e, k).otherwise(out)
    return out


def normalise(path: Column) -> Column:
    """Forward slashes, and one leading ``./`` off."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^\\./", "")


def utf8_flag(rel: Column) -> Column:
    """2048 for names with bytes over 0x7F, else 0."""
    return F.when(F.octet_length(rel) > F.char_length(rel), 2048).otherwise(0)


def is_png(data: Column) -> Column:
    return F.coalesce(F.substring(data, 1, 8) == F.lit(PNG_SIGNATURE), F.lit(False))


def is_ogg(data: Column) -> Column:
    return F.coalesce(F.substring(data, 1, 4) == F.lit(b"OggS"), F.lit(False))


def png_color_type(data: Column) -> Column:
    """Colour type of a PNG of at least 33 bytes; null for anything else."""
    return F.when(is_png(data) & (F.octet_length(data) >= 33), F.conv(F.hex(F.substring(data, 26, 1)), 16, 10).cast("int"))
