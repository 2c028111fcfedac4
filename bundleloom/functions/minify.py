"""Text transforms as Column expressions over bytes.

All work on the ISO-8859-1 view of the bytes, which keeps every byte.  Shaders are cut into strings, comments and
the rest; white space inside strings is moved to code points that no byte has while lines are tidied.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LATIN1 = "ISO-8859-1"
# A string from its quote to the closing quote, or to the end; a line comment; a block comment; white space.
_STRING = r'("[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\z))'
_COMMENTS = r"//[^\r\n]*|/\*.*?(?:\*/|\z)"
JSON_ALL = f"(?s){_STRING}|{_COMMENTS}|[ \\t\\r\\n]+"
JSON_COMMENTS = f"(?s){_STRING}|{_COMMENTS}"

#: A shader's parts: strings in either quote, line comments, block comments, anything else.
GLSL_PARTS = r"""(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\z)|'[^'\\]*+(?:\\.[^'\\]*+)*+(?:'|\\?\z)|//[^\n]*+|/\*.*?(?:\*/|\z)|[^"'/]++|/"""
#: Tidying between strings, in order, and at the very end: pattern, replacement.
GLSL_SPACE = ((r"[ \t\r]+", " "), (r"\n[ \n]*", "\n"), (r"\A[ \n]+", ""))
GLSL_END = ((r" ?\z", ""), (r"\n?\z", ""))
SPACE, HIDDEN = " \t\r\n", "\ue000\ue001\ue002\ue003"


def view(data: Column) -> Column:
    return F.decode(data, LATIN1)


def unview(text: Column) -> Column:
    return F.encode(text, LATIN1)


def json_minify(data: Column) -> Column:
    """Comments and white space outside strings go; no validation, strings stay as they are."""
    return unview(F.regexp_replace(view(data), JSON_ALL, "$1"))


def json_has_comment(data: Column) -> Column:
    """True if a comment stands outside strings."""
    return F.octet_length(unview(F.regexp_replace(view(data), JSON_COMMENTS, "$1"))) != F.octet_length(data)


def key_value_lines(data: Column, *markers: str) -> Column:
    """Lines with ``=`` that don't begin with a marker; each kept line ends in one line feed."""
    lines = F.transform(F.split(view(data), "\n", -1), lambda x: F.regexp_replace(x, "\\r\\z", ""))
    kept = F.filter(lines, lambda x: (x != "") & F.contains(x, F.lit("=")) & ~F.substring(x, 1, 1).isin(*markers))
    return unview(F.array_join(F.transform(kept, lambda x: F.concat(x, F.lit("\n"))), ""))


def lang_lines(data: Column) -> Column:
    return key_value_lines(data, "#")


def properties_lines(data: Column) -> Column:
    return key_value_lines(data, "#", "!")


def _glsl_part(x: Column) -> Column:
    """A string with its white space hidden; a line feed for a comment that spans lines, else nothing; or the part itself."""
    head, n = F.substring(x, 1, 2), F.char_length(x)
    closed = F.endswith(x, F.lit("*/")) & (n >= 4)
    # the last byte of a comment without an end isn't looked at
    body = F.when(closed, x).otherwise(F.left(x, F.greatest(n - 1, F.lit(2))))
    out = F.when(F.substring(x, 1, 1).isin('"', "'"), F.translate(x, SPACE, HIDDEN)).when(head == "//", "")
    return out.when(head == "/*", F.when(F.contains(body, F.lit("\n")), "\n").otherwise("")).otherwise(x)


def glsl_minify(data: Column) -> Column:
    """Comments out, runs of blanks to one, none at the start of a line, no blank lines; strings stay as they are."""
    out = F.array_join(F.transform(F.regexp_extract_all(view(data), F.lit(GLSL_PARTS), F.lit(0)), _glsl_part), "")
    for pattern, to in GLSL_SPACE:
        out = F.regexp_replace(out, pattern, to)
    out = F.translate(out, HIDDEN, SPACE)
    for pattern, to in GLSL_END:
        out = F.regexp_replace(out, pattern, to)
    return unview(out)


def glsl_text(data: bytes) -> bytes:
    """The same as a walk over the bytes with a quote state: the plain form."""
    s, out, i, n = data, bytearray(), 0, len(data)
    while i < n:
        c = s[i : i + 1]
        if c in (b'"', b"'"):
            j = i + 1
            while j < n and s[j : j + 1] != c:
                j += 2 if s[j : j + 1] == b"\\" else 1
            j = min(n, j + 1)
            out += s[i:j]
            i = j
        elif s[i : i + 2] == b"//":
            j = s.find(b"\n", i)
            i = n if j < 0 else j
        elif s[i : i + 2] == b"/*":
            j = s.find(b"*/", i + 2)
            # an unterminated comment's last byte isn't looked at
            body = s[i + 2 : max(i + 2, n - 1)] if j < 0 else s[i + 2 : j]
            if b"\n" in body and out and out[-1:] != b"\n":
                out += b"\n"
            i = n if j < 0 else j + 2
        elif c == b"\n":
            if out and out[-1:] != b"\n":
                out += c
            i += 1
        elif c in b" \t\r":
            while i < n and s[i : i + 1] in (b" ", b"\t", b"\r"):
                i += 1
            if out and out[-1:] not in (b" ", b"\n"):
                out += b" "
        else:
            out += c
            i += 1
    if out[-1:] == b" ":
        del out[-1:]
    if out[-1:] == b"\n":
        del out[-1:]
    return bytes(out)
