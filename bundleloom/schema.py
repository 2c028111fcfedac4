"""Schemas of the pack tables."""

PACK_INDEX = "rel string, size bigint, ordinal bigint, container string, is_zip boolean"
PACK_FILES = PACK_INDEX + ", data binary, error string"
OPTIMIZED = "rel string, ordinal bigint, ext string, kind string, orig bigint, new bigint, method int, changed boolean, skipped boolean, note string, data binary, error string"
#: ZIP methods.
STORE, DEFLATE = 0, 8
