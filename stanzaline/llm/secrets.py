"""Secret scans with structural confirmation.

Three plain patterns find assignments, access keys and hex runs. Runs of base64, also wrapped over
lines, and of hex, also with colons between the bytes, are then decoded and reported only when their
structure holds: DER private keys whose nested lengths add up, OpenSSH private keys whose
length-prefixed fields do, PEM blocks whose body is such a key, and signed tokens whose header is JSON
with an algorithm. Public keys and certificates are no secrets and are not reported.

Defined cases: a null or empty text has no spans; repeated rows are scanned alike; an empty table gives
no rows; very long texts are scanned whole; other columns are left out. Offsets are code points, ends
exclusive.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16

TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]{8,})(?![A-Za-z0-9_-])")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----([A-Za-z0-9+/=\s\\]*?)-----END \1-----")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2}")
#: Lines of at least 40 characters, and a last one of any length; blanks or quote marks may stand before each.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}(?:(?:\r?\n|\\n)[ \t>]*[A-Za-z0-9+/]{40,})*(?:(?:\r?\n|\\n)[ \t>]*[A-Za-z0-9+/]{1,}={0,2})")
LONG_CODE = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9a-f]{64,}|[0-9A-F]{64,})(?![0-9A-Fa-f])")
#: Bytes in hex with colons between, also over several lines.
COLON_CODE = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:(?:\r?\n[ \t]*)?){31,}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])")
#: Order of kinds among spans that start together.
KINDS = ("assign", "access", "hex", "token", "pem", "der", "ssh", "der_hex")
_RANK = {k: i for i, k in enumerate(KINDS)}
_FIRST = ("MI", "MC", "MD", "ME", "MF", "MG", "MH", "b3")
_BLANKS, _COLONS, _BREAK = re.compile(r"\\n|[\s>]+"), re.compile(r"[:\s]+"), re.compile(r"(?:\r?\n|\\n)[ \t>]*")
_ENDING = re.compile(r"(?:\r?\n|\\n)[ \t>]*\Z")


def _der_length(data: bytes, at: int, end: int) -> tuple[int, int] | None:
    """Start and end of the content of the element whose length begins at ``at``."""
    if at >= end:
        return None
    first = data[at]
    if first < 0x80:
        start, size = at + 1, first
    else:
        n = first & 0x7F
        if not 1 <= n <= 4 or at + 1 + n > end:
            return None
        size, start = int.from_bytes(data[at + 1 : at + 1 + n], "big"), at + 1 + n
        if size < 0x80 or data[at + 1] == 0:  # DER writes lengths in the fewest bytes
            return None
    return (start, start + size) if start + size <= end else None


def _der_children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    found, at = [], start
    while at < end:
        if (span := _der_length(data, at + 1, end)) is None:
            return None
        found.append((data[at], *span))
        at = span[1]
    return found


#: Fixed: first bytes of the object identifiers of password-based encryption.
_PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c"))


def _whole(data: bytes, tag: int) -> list[tuple[int, int, int]] | None:
    """The children of the one element, with this tag, that fills the data."""
    if not data or data[0] != tag:
        return None
    outer = _der_length(data, 1, len(data))
    return _der_children(data, *outer) if outer and outer[1] == len(data) else None


def is_der_key(data: bytes) -> bool:
    """A PKCS#1, SEC1, PKCS#8 or encrypted PKCS#8 private key: nested lengths that fill the outer ones."""
    if len(data) < 24 or not (inner := _whole(data, 0x30)) or len(inner) < 2:
        return False
    tags = [t for t, _, _ in inner]
    small = inner[0][2] - inner[0][1] == 1
    if tags[0] == 0x02 and len(tags) >= 9 and set(tags[:9]) == {0x02}:  # version and eight numbers
        return small
    if tags[:2] == [0x02, 0x04]:  # version and the private number, of a curve's size
        return small and 16 <= inner[1][2] - inner[1][1] <= 80
    plain = tags[:3] == [0x02, 0x30, 0x04] and small
    if not plain and tags != [0x30, 0x04]:
        return False
    (_, low, high), (_, start, end) = inner[1:3] if plain else inner[:2]
    algorithm = _der_children(data, low, high)  # an object identifier first
    if not algorithm or algorithm[0][0] != 0x06:
        return False
    body = data[start:end]
    if plain:  # a key of the algorithm's own kind, itself nested
        return is_der_key(body) or _whole(body, 0x30) is not None or (body[:1] == b"\x04" and len(body) > 2 and body[1] == len(body) - 2)
    return len(body) >= 32 and data[algorithm[0][1] : algorithm[0][2]].startswith(_PASSWORD_BASED)


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key container: length-prefixed fields in their order."""
    if not data.startswith(b"openssh-key-v1\0"):
        return False
    at, fields = 15, 0
    while fields < 3 and at + 4 <= len(data):
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        fields += 1
    return fields == 3 and at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4], "big") <= 64


def _base64(text: str, url: bool = False) -> bytes | None:
    text = text.rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(head: str, body: str, signature: str) -> bool:
    """Header and body are base64url of JSON objects, the header names an algorithm, the signature decodes."""
    try:
        header, claims = (json.loads(_base64(x, True) or b"-") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(claims, dict) and _base64(signature, True) is not None


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    # a run of 16 or more begins where its leftmost maximal run does
    found += [("hex", m.start(), m.end()) for m in LONG_HEX.finditer(text)]
    return found


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates whose decoded structure holds."""
    found = []
    if "eyJ" in text:
        found += [("token", m.start(), m.end()) for m in TOKEN.finditer(text) if is_signed_token(*m.groups())]
    if "PRIVATE KEY-----" in text:
        for m in PEM.finditer(text):
            data = _base64(re.sub(r"\\n|\s|\\", "", m[2]))
            if data and (is_der_key(data) or is_ssh_key(data)):
                found.append(("pem", m.start(), m.end()))
    # lines first: a run of one line may be a part of them
    taken: list[tuple[int, int]] = []
    for pattern in (WRAPPED, BASE64) if "\n" in text or "\\n" in text else (BASE64,):
        for m in pattern.finditer(text):
            # every such structure begins with 0x30 and a length, or with "openssh"
            if m[0][:2] not in _FIRST or any(s <= m.start() and m.end() <= e for s, e in taken):
                continue
            # the last line may be the words that follow
            for end in (m.end(), m.end() - len(_BREAK.split(m[0])[-1])) if pattern is WRAPPED else (m.end(),):
                code = _ENDING.sub("", text[m.start() : end])
                data = _base64(_BLANKS.sub("", code))
                if kind := data and ("der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None):
                    found.append((kind, m.start(), m.start() + len(code)))
                    taken.append((m.start(), m.start() + len(code)))
                    break
    for m in LONG_CODE.finditer(text):
        if m[0].startswith("30") and len(m[0]) % 2 == 0 and is_der_key(bytes.fromhex(m[0])):
            found.append(("der_hex", m.start(), m.end()))
    if ":" in text:
        for m in COLON_CODE.finditer(text):
            if m[0].startswith("30") and is_der_key(bytes.fromhex(_COLONS.sub("", m[0]))):
                found.append(("der_hex", m.start(), m.end()))
    return found


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], _RANK[s[0]], s[2]))


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("confirmed", pa.bool_())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            text = text or ""
            base, more = base_spans(text), confirmed_spans(text)
            held = {(s, e) for _, s, e in more}
            rows.append([{"kind": k, "start": s, "end": e, "confirmed": k not in ("assign", "access", "hex") or (s, e) in held} for k, s, e in ordered(base + more)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _SPAN)], names=["doc_id", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and its spans (kind, start, end, confirmed) by start, then kind. One pass, no shuffle."""
    slim = docs.select(F.col("doc_id").cast("long"), "text")
    return slim.mapInArrow(_scan, "doc_id long, spans array<struct<kind:string,start:long,end:long,confirmed:boolean>>")
