"""PNG and Ogg work on bytes, for Arrow functions: chunk walks, alpha test, lossless re-packing.

Where the optional native tools are installed they are tried first; without them PNGs are re-deflated
losslessly with unneeded chunks dropped, and Ogg streams are left as they are at the codec level, with
their comment header emptied and pages rebuilt.  A failure of any kind gives the input back.
"""

from __future__ import annotations

import functools
import shutil
import struct
import subprocess
import tempfile
import zlib
from pathlib import Path

import numpy as np

from bundleloom.functions.paths import PNG_SIGNATURE
from bundleloom.functions.report import png_level_text, quality_text
from bundleloom.options import Options
from bundleloom.schema import DEFLATE, STORE

# Chunks that hold the picture, and those that the safe set keeps beside them.
SHOWN = {b"IHDR", b"PLTE", b"IDAT", b"IEND", b"tRNS"}
PROFILE = {b"cICP", b"iCCP", b"sRGB", b"pHYs"}
# Arguments that make the Vorbis tool's output the same at every run.
OGG_ARGS = ("--quiet", "--remuxer", "ogg2ogg", "--remuxer_option", "randomize_stream_serials=false", "--vendor_string_action", "empty")


#: What the palette tool's exits for a result that would be larger or worse look like; not failures.
TOO_LARGE = ("exit 98", "exit 99")


@functools.lru_cache(8)
def tool(name: str) -> str | None:
    """Path of an optional native tool, looked up once per Python worker."""
    return shutil.which(name)


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """(type, body) of each chunk; a chunk that runs past the end raises ValueError."""
    out, at = [], 8
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("short chunk")
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 12 + n > len(data):
            raise ValueError("chunk past the end")
        out.append((data[at + 4 : at + 8], data[at + 8 : at + 8 + n]))
        at += 12 + n
        if out[-1][0] == b"IEND":
            break
    return out


def is_apng(data: bytes) -> bool:
    """True if a chunk of animation control comes up in a walk over the chunks."""
    if data[:8] != PNG_SIGNATURE:
        return False
    at = 8
    while at + 8 <= len(data):
        if data[at + 4 : at + 8] == b"acTL":
            return True
        at += 12 + int.from_bytes(data[at : at + 4], "big")
    return False


def _unfilter(raw: bytes, rows: int, stride: int, step: int) -> np.ndarray:
    """Scan lines of one pass with their filters undone."""
    out = np.zeros((rows, stride), dtype=np.uint8)
    prior = np.zeros(stride, dtype=np.uint8)
    at = 0
    for y in range(rows):
        kind, line = raw[at], np.frombuffer(raw, np.uint8, stride, at + 1)
        at += stride + 1
        if kind == 0:
            cur = line.copy()
        elif kind == 2:
            cur = line + prior
        elif kind == 1:
            cur = np.zeros(stride, np.uint8)
            for k in range(step):
                cur[k::step] = np.cumsum(line[k::step], dtype=np.uint8)
        elif kind in (3, 4):
            cur, up = [0] * stride, prior.tolist()
            for i, v in enumerate(line.tolist()):
                left, diag = (cur[i - step], up[i - step]) if i >= step else (0, 0)
                if kind == 3:
                    guess = (left + up[i]) >> 1
                else:
                    p = left + up[i] - diag
                    d = abs(p - left), abs(p - up[i]), abs(p - diag)
                    guess = left if d[0] <= d[1] and d[0] <= d[2] else up[i] if d[1] <= d[2] else diag
                cur[i] = (v + guess) & 255
            cur = np.array(cur, dtype=np.uint8)
        else:
            raise ValueError("unknown filter")
        out[y] = prior = cur
    return out


def samples(data: bytes) -> tuple[int, int, np.ndarray]:
    """(colour type, bit depth, scan lines of all passes one after another as rows of bytes, ragged passes joined flat)."""
    parts = chunks(data)
    if not parts or parts[0][0] != b"IHDR":
        raise ValueError("no header")
    w, h, depth, color, _, _, lace = struct.unpack(">IIBBBBB", parts[0][1])
    per = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color] * depth
    raw, at, flat = zlib.decompress(b"".join(b for t, b in parts if t == b"IDAT")), 0, []
    steps = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)) if lace else ((0, 0, 1, 1),)
    for x0, y0, dx, dy in steps:
        pw, ph = -(-(w - x0) // dx) if w > x0 else 0, -(-(h - y0) // dy) if h > y0 else 0
        if pw and ph:
            stride = -(-pw * per // 8)
            flat.append(_unfilter(raw[at : at + ph * (stride + 1)], ph, stride, max(1, per // 8)).ravel())
            at += ph * (stride + 1)
    return color, depth, np.concatenate(flat) if flat else np.zeros(0, np.uint8)


def uses_alpha(data: bytes) -> bool:
    """True if some pixel is neither fully transparent nor fully opaque; False for what can't be read."""
    try:
        color, depth, flat = samples(data)
        if color == 3:
            alpha = np.frombuffer(next((b for t, b in chunks(data) if t == b"tRNS"), b""), np.uint8)
            if not len(alpha):
                return False
            if depth < 8:
                flat = np.unpackbits(flat.reshape(-1, 1), axis=1).reshape(-1, depth) @ (1 << np.arange(depth)[::-1])
            full = np.full(256, 255, np.uint8)
            full[: len(alpha)] = alpha
            return bool(((full[flat] != 0) & (full[flat] != 255)).any())
        if color not in (4, 6):
            return False
        n = 2 if color == 4 else 4
        if depth == 16:
            wide = flat.view(">u2").reshape(-1, n)[:, -1]
            return bool(((wide != 0) & (wide != 65535)).any())
        alpha = flat.reshape(-1, n)[:, -1]
        return bool(((alpha != 0) & (alpha != 255)).any())
    except (ValueError, KeyError, zlib.error, struct.error, IndexError):
        return False


def repack_png(data: bytes, o: Options) -> bytes:
    """Lossless: unneeded chunks out (by the settings), image data in one chunk deflated again."""
    parts = chunks(data)
    keep = None if not o.png_strip_meta else SHOWN | PROFILE if o.png_keep_color_profile else SHOWN
    body = b"".join(b for t, b in parts if t == b"IDAT")
    raw = zlib.decompress(body)
    best = min((body, *(zlib.compress(raw, 9) if s is None else _deflated(raw, s) for s in (None, 1, 3))), key=len)
    out, done = [PNG_SIGNATURE], False
    for t, b in parts:
        if t == b"IDAT":
            if done:
                continue
            b, done = best, True
        elif keep is not None and t not in keep:
            continue
        out.append(struct.pack(">I", len(b)) + t + b + struct.pack(">I", zlib.crc32(t + b)))
    return b"".join(out)


def _deflated(raw: bytes, strategy: int) -> bytes:
    c = zlib.compressobj(9, zlib.DEFLATED, 15, 9, strategy)
    return c.compress(raw) + c.flush()


def _piped(args: list[str], data: bytes) -> tuple[bytes | None, str]:
    """(what a tool makes of data, what it says where it fails)."""
    try:
        done = subprocess.run(args, input=data, capture_output=True, timeout=600)
    except (OSError, subprocess.SubprocessError) as e:
        return None, str(e)
    if done.returncode == 0:
        return done.stdout, ""
    return None, done.stderr.decode("utf-8", "replace").strip() or f"exit {done.returncode}"


def png(data: bytes, o: Options) -> tuple[bytes, int, bool, str]:
    """(data, method, changed, note) of a PNG: palette pass if its tool is there, then the lossless pass."""
    passed = (data, DEFLATE, False, "")
    if not (o.png_recompress or o.png_strip_meta or o.png_lossy) or data[:8] != PNG_SIGNATURE or is_apng(data):
        return passed
    try:
        color = data[25] if len(data) >= 33 else None
        first, note = data, ""
        if o.png_lossy and color not in (0, 3, 4, None):
            if color == 6 and o.png_protect_alpha and uses_alpha(data):
                note = "palette pass left out: partly transparent pixels"
            elif exe := tool("pngquant"):
                got, said = _piped([exe, f"--quality={quality_text(o.png_quant_min, o.png_quant_max)}", "--skip-if-larger", "--strip", "-"], data)
                first = got if got and len(got) < len(data) else data
                if said and said not in TOO_LARGE:
                    note = f"palette pass failed: {said}"
            note = note if o.media_notes else ""
        best = first
        if o.png_recompress or o.png_strip_meta:
            if exe := tool("oxipng"):
                strip = ["--strip", "safe" if o.png_keep_color_profile else "all"] if o.png_strip_meta else []
                second, _ = _piped([exe, "-o", png_level_text(o.png_level), *strip, "--stdout", "-"], first)
            else:
                second = repack_png(first, o)
            best = second if second and len(second) < len(data) else first
        return (best, STORE, len(best) != len(data), note) if len(best) < len(data) else (*passed[:3], note)
    except (ValueError, KeyError, zlib.error, struct.error, IndexError):
        return passed


# ---- Ogg


#: Each byte with its bits turned round.
_TURNED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def ogg_crc(page: bytes) -> int:
    """Checksum of a page whose checksum field is zero.

    It has zlib's polynomial, but takes bits from the other end and begins and ends plainly; zlib does the work.
    """
    r = zlib.crc32(page.translate(_TURNED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(r.to_bytes(4, "little").translate(_TURNED), "big")


def ogg_packets(data: bytes) -> list[tuple[int, int, bytes]]:
    """(flags, granule position of the page it ends on, packet) of a stream with one serial."""
    out, held, at, serial = [], b"", 0, None
    while at < len(data):
        if data[at : at + 4] != b"OggS" or at + 27 > len(data):
            raise ValueError("not a page")
        flags, granule, own = data[at + 5], struct.unpack_from("<q", data, at + 6)[0], data[at + 14 : at + 18]
        if serial not in (None, own):
            raise ValueError("several streams")
        serial = own
        laces = data[at + 27 : at + 27 + data[at + 26]]
        at += 27 + len(laces)
        if at + sum(laces) > len(data):
            raise ValueError("short page")
        for n in laces:
            held += data[at : at + n]
            at += n
            if n < 255:
                out.append((flags, granule, held))
                held = b""
    if held:
        raise ValueError("unended packet")
    return out


def ogg_stream(packets: list[tuple[int, int, bytes]], serial: int = 1) -> bytes:
    """Pages of the packets: headers by themselves, each run of packets of one granule position together."""
    pages: list[tuple[int, list[bytes]]] = []
    for i, (_, granule, p) in enumerate(packets):
        if i in (0, 1, 3) or pages[-1][0] != granule:
            pages.append((granule, []))
        pages[-1][1].append(p)
    out, number, first = bytearray(), 0, True
    for k, (granule, group) in enumerate(pages):
        laces, body = [], b"".join(group)
        for p in group:
            laces += [255] * (len(p) // 255) + [len(p) % 255]
        at, going = 0, False
        while laces:
            part, laces = laces[:255], laces[255:]
            ends = any(n < 255 for n in part)
            flags = going * 1 | first * 2 | (k == len(pages) - 1 and not laces) * 4
            head = struct.pack("<4sBBqIII", b"OggS", 0, flags, granule if ends else -1, serial, number, 0) + bytes([len(part)]) + bytes(part)
            page = head + body[at : at + sum(part)]
            out += page[:22] + struct.pack("<I", ogg_crc(page)) + page[26:]
            at += sum(part)
            going, first, number = part[-1] == 255, False, number + 1
    return bytes(out)


def ogg(data: bytes, o: Options) -> tuple[bytes, int, bool, str]:
    """(data, method, changed, note) of an Ogg file; always the store hint."""
    passed = (data, STORE, False, "")
    if not o.ogg_optimize or len(data) < 4 or data[:4] != b"OggS":
        return passed
    if exe := tool("optivorbis"):
        with tempfile.TemporaryDirectory() as d:  # the tool goes by the file's extension
            src = Path(d, "in.ogg")
            src.write_bytes(data)
            comments = "delete" if o.ogg_strip_comments else "copy"
            out = _piped([exe, *OGG_ARGS, "--comment_fields_action", comments, str(src), "-"], b"")[0] or b""
        return (out, STORE, True, "") if out[:4] == b"OggS" and len(out) < len(data) else passed
    try:
        packets = ogg_packets(data)
        if len(packets) < 3 or packets[1][2][:7] != b"\x03vorbis":
            return passed
        flags, granule, old = packets[1]
        vendor = 11 + struct.unpack_from("<I", old, 7)[0]
        rest = struct.pack("<I", 0) + b"\x01" if o.ogg_strip_comments else old[vendor:]
        packets[1] = (flags, granule, old[:7] + struct.pack("<I", 0) + rest)
        out = ogg_stream(packets)
    except (ValueError, struct.error, IndexError):
        return passed
    note = "optivorbis: not on this machine's path; only headers and pages are made smaller"
    return (out, STORE, True, note) if len(out) < len(data) else (*passed[:3], note)
