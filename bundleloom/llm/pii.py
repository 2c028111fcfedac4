"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score.

Base kinds (email, ip, card, phone) are always kept once their own check passes.  The further kinds
(iban, ssn, aba) are kept when pattern, checksum and context words together reach ``ACCEPT``.

Defined cases: a null text counts as empty and has no spans; a null id is passed through; repeated rows
give repeated results; texts of any length are read whole, in time linear in their length.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundleloom.llm.common import map_rows, per_batch

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "aba")
BASE = KINDS[:4]
ACCEPT = 0.6
#: Code points on either side of a span that count as near.
NEAR = 48

# Total length of an IBAN by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20,
    "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24,
    "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}

#: kind -> score of a confirmed span, words that raise it, words that lower it.
CONTEXT = {
    "email": (0.9, {"email", "mail", "contact", "write"}, {"example"}),
    "ip": (0.6, {"ip", "address", "host", "server", "client", "login"}, {"version", "release", "section", "chapter"}),
    "card": (0.8, {"card", "visa", "mastercard", "amex", "credit", "debit", "payment"}, {"order", "isbn", "tracking", "serial"}),
    "phone": (0.7, {"phone", "tel", "call", "mobile", "fax", "contact", "whatsapp"}, {"order", "serial", "score"}),
    "iban": (0.8, {"iban", "bank", "account", "konto", "compte", "cuenta", "transfer"}, {"serial", "model"}),
    "ssn": (0.4, {"ssn", "social", "security", "taxpayer", "itin"}, {"part", "order", "serial", "model"}),
    "aba": (0.3, {"routing", "aba", "rtn", "bank"}, {"order", "serial", "isbn"}),
}
STEP = 0.3

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
#: What follows an IBAN's first four characters, exactly as long as its country has it.
IBAN_REST = {c: re.compile(rf"(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for c, n in IBAN_LENGTH.items()}
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
ABA = re.compile(r"(?<![0-9-])[0-9]{9}(?![0-9-])")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = str.maketrans("", "", " -().+")
NEARBY = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    """The mod-10 check of payment cards."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(code: str) -> bool:
    """ISO 13616: the moved and spelled-out number leaves 1 when divided by 97."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def aba_sum(digits: str) -> bool:
    """Weights 3, 7, 1 of bank routing numbers."""
    return any(c != "0" for c in digits) and sum(int(c) * w for c, w in zip(digits, (3, 7, 1) * 3)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each ``@`` outwards, which keeps long runs linear."""
    out, done, at = [], 0, text.find("@")
    floor = 0
    while at >= 0:
        left = text[floor:at]
        start = floor + len(left.rstrip(LOCAL))
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        floor = max(done, at + 1)
        at = text.find("@", floor)
    return out


def _part_ok(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def find_base(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four base kinds, by kind as listed, then start."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    first = DIGIT.search(text)
    if first is None:
        return out
    at = first.start()
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text, at) if all(map(_part_ok, m[0].split(".")))]
    for m in CARD.finditer(text, at):
        if m.end() - m.start() >= 13:
            digits = m[0].translate(NOT_DIGIT)
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(m[0].translate(NOT_DIGIT)) <= 15]
    return out


def ibans(text: str, at: int = 0) -> list[tuple[int, int]]:
    """Leftmost non-overlapping IBANs of their country's length that pass the check, whatever follows them."""
    out, done = [], at
    for m in IBAN.finditer(text, at):
        rest = IBAN_REST.get(m[0][:2])
        if m.start() >= done and rest and (r := rest.match(text, m.end())) and mod97(m[0] + r[0].replace(" ", "")):
            out.append((m.start(), r.end()))
            done = r.end()
    return out


def find_further(text: str) -> list[tuple[str, int, int]]:
    """Confirmed proposals of the further kinds; their score decides later."""
    first = DIGIT.search(text)
    if first is None:
        return []
    at = max(0, first.start() - 2)
    out = [("iban", s, e) for s, e in ibans(text, at)]
    for m in SSN.finditer(text, at):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            out.append(("ssn", m.start(), m.end()))
    out += [("aba", m.start(), m.end()) for m in ABA.finditer(text, at) if aba_sum(m[0])]
    return out


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's own score, a step up or down for words of its context near the span."""
    base, up, down = CONTEXT[kind]
    near = set(NEARBY.findall(text[max(0, start - NEAR) : start].lower() + " " + text[end : end + NEAR].lower()))
    return round(min(1.0, max(0.0, base + STEP * bool(near & up) - STEP * bool(near & down))), 2)


def scan(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans of one text with their scores: kinds as listed, then start."""
    if not text:
        return []
    base = [(k, s, e, score(text, k, s, e)) for k, s, e in find_base(text)]
    further = [(k, s, e, p) for k, s, e in find_further(text) if (p := score(text, k, s, e)) >= ACCEPT]
    return base + further


def joined(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in spans)


def redacted(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    spans = sorted((s, -e, k) for k, s, e, _ in scan(text))
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        start, stop, kind = spans[i][0], -spans[i][1], spans[i][2]
        i += 1
        while i < len(spans) and spans[i][0] < stop:
            stop = max(stop, -spans[i][1])
            i += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = stop
    return "".join(out) + text[at:]


FOUND = "id long, spans array<struct<kind:string,start:int,stop:int,score:double>>"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id and its spans with scores."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))

    def batch(ids, texts):
        rows = [[dict(zip(("kind", "start", "stop", "score"), s)) for s in scan(t)] for t in texts]
        return pa.RecordBatch.from_arrays([ids, pa.array(rows, kind)], ["id", "spans"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(per_batch(batch), FOUND)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced; all other columns and rows stay as they are."""

    at = docs.columns.index(text_col)

    def run(part, texts):
        return part.set_column(at, part.schema.field(at), pa.array([redacted(t) for t in texts], part.schema.field(at).type))

    return map_rows(docs, text_col, run).toDF(*docs.columns)


DIGEST = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string"


def digest(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans of each document, as the query returns them."""

    def batch(ids, texts):
        cols: list[list] = [[] for _ in range(7)]
        for t in texts:
            found = scan(t)
            kinds = [s[0] for s in found]
            base = joined([s for s in found if s[0] in BASE])
            row = (*(kinds.count(k) for k in BASE), hashlib.sha256(base.encode()).hexdigest(), joined(found), ",".join(f"{s[3]:g}" for s in found))
            for c, v in zip(cols, row):
                c.append(v)
        kinds = [pa.int64()] * 4 + [pa.string()] * 3
        names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "scores"]
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(per_batch(batch), DIGEST)
