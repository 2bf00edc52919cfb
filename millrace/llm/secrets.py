"""Secret scans with structural confirmation.

Plain patterns find assignments, access keys and hex runs. Candidates in base64 or hex are then
decoded and reported only if what comes out has the form of a secret:

* `signed`: three base64url parts of which the first is a JSON object with an `alg`;
* `openssh`: an OpenSSH private key, whose lengths must nest up to the last byte;
* `der`: a PKCS#1, PKCS#8, SEC1 or DSA private key, whose ASN.1 lengths must nest exactly.

A span is (kind, start, end) in code points, end exclusive. One pass over each text, one text at a
time, no shuffle. A null text is empty and has no spans; repeated rows give repeated rows; columns
other than key and text are left out of `scan`, kept by `redact`.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns, their least lengths, and the order of kinds.
ASSIGN = re.compile(
    r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs of fewer digits fail, and no match starts inside a run
KINDS = ("assign", "access", "hex", "signed", "openssh", "der")
BASE_KINDS = KINDS[:3]

_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_SIGNED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{40,}(?:\r?\n(?!-----)[A-Za-z0-9+/_-]+)*)={0,2}")
_HEX_BYTES = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{60,}(?![0-9A-Fa-f])")
_LINE = re.compile(r"[^\r\n]+")
_OPENSSH = b"openssh-key-v1\x00"

Span = tuple[str, int, int]


def _decode64(text: str) -> bytes | None:
    text = re.sub(r"\s", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, first and last+1 byte of the content of the DER element at `at`, if it fits."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        more = size & 0x7F
        if not 1 <= more <= 4 or at + more > end:
            return None
        size, at = int.from_bytes(data[at : at + more], "big"), at + more
    return (tag, at, at + size) if at + size <= end else None


def _elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """All elements of a content, if their lengths fill it exactly."""
    found = []
    while at < end:
        one = _element(data, at, end)
        if one is None:
            return None
        found.append(one)
        at = one[2]
    return found


def is_der_key(data: bytes) -> bool:
    outer = _element(data, 0, len(data))
    if outer is None or outer[0] != 0x30 or outer[2] != len(data):
        return False
    parts = _elements(data, outer[1], outer[2])
    if not parts or parts[0][0] != 0x02 or parts[0][2] - parts[0][1] != 1:
        return False
    version, tags = data[parts[0][1]], [p[0] for p in parts]
    if version in (0, 1) and len(tags) in (9, 10) and set(tags[:9]) == {0x02}:
        return True  # PKCS#1: nine numbers
    if version == 0 and tags == [0x02] * 6:
        return True  # DSA: version, p, q, g and both keys
    if version in (0, 1) and tags[1:3] == [0x30, 0x04]:
        algorithm = _elements(data, parts[1][1], parts[1][2])
        return bool(algorithm) and algorithm[0][0] == 0x06  # PKCS#8: algorithm id, then the key
    return version == 1 and tags[1:2] == [0x04] and all(t in (0xA0, 0xA1) for t in tags[2:]) and len(tags) > 2


def is_openssh_key(data: bytes) -> bool:
    if not data.startswith(_OPENSSH):
        return False
    at, parts = len(_OPENSSH), 0
    while at < len(data):
        if parts == 3:  # the number of keys is not length-prefixed
            at += 4
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        parts += 1
    return at == len(data) and parts >= 5


def _der_size(data: bytes) -> int | None:
    """The bytes that the outer length of a DER element asks for."""
    outer = _element(data[:6] + bytes(1 << 16), 0, 1 << 62) if data[:1] == b"\x30" else None
    return None if outer is None else outer[2]


def _openssh_size(data: bytes) -> int | None:
    """The bytes up to the end of the private part: three texts, the number of keys, the keys, the private part."""
    at, left, keys = len(_OPENSSH), 3, None
    while left:
        if at + 4 > len(data):
            return None
        at, left = at + 4 + int.from_bytes(data[at : at + 4], "big"), left - 1
        if not left and keys is None:
            keys = left = int.from_bytes(data[at : at + 4], "big") + 1
            at += 4
    return at


def key_in(run: str) -> tuple[str, int] | None:
    """Kind and end of the private key at the start of a base64 run, which may go on with other lines.

    The key says how many bytes it has, and must end where a line or the run ends.
    """
    body = run.rstrip("=")
    head = _decode64(body[:20])
    if not head or not (head[0] == 0x30 or head == _OPENSSH):
        return None
    lines = list(_LINE.finditer(body))
    text = "".join(m[0] for m in lines)
    data = _decode64(text[: len(text) - (len(text) % 4 == 1)]) or b""
    size = _der_size(data) if head[0] == 0x30 else _openssh_size(data)
    if size is None or size > len(data):
        return None
    left = -(-size * 4 // 3)
    for m in lines:
        left -= len(m[0])
        if left <= 0:
            break
    if left:
        return None
    kind = "der" if is_der_key(data[:size]) else "openssh" if is_openssh_key(data[:size]) else None
    return (kind, len(run) if m.end() == len(body) else m.end()) if kind else None


def is_signed_token(text: str) -> bool:
    head = _decode64(text.split(".", 1)[0])
    try:
        header = json.loads(head) if head and head[:1] == b"{" else None
    except ValueError:
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    lower = text.lower()
    if any(name in lower for name in _NAMES):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[Span]:
    found: list[Span] = []
    if "eyJ" in text or "ey" in text:
        found += [("signed", m.start(), m.end()) for m in _SIGNED.finditer(text) if is_signed_token(m[0])]
    for m in _BASE64.finditer(text):
        key = key_in(m[0])
        if key:
            found.append((key[0], m.start(), m.start() + key[1]))
    for m in _HEX_BYTES.finditer(text):
        if len(m[0]) % 2 == 0 and is_der_key(bytes.fromhex(m[0])):
            found.append(("der", m.start(), m.end()))
    return found


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def all_spans(text: str | None) -> list[Span]:
    return ordered(base_spans(text) + confirmed_spans(text)) if text else []


def redacted(text: str | None) -> str | None:
    """The text with each secret replaced by its kind; overlapping spans become one."""
    spans = all_spans(text)
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, spans: array of (kind, start, end), by start and then by the order of KINDS."""
    kind = docs.select(key).schema[0].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [{"kind": k, "start": a, "end": b} for k, a, b in all_spans(x.as_py())] for x in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, span)], ["key", "spans"])

    return (
        docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text")
        .mapInArrow(run, f"key {kind}, spans array<struct<kind string, start long, end long>>")
        .withColumnRenamed("key", key)
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with the secrets in their text replaced; all columns stay."""

    @F.pandas_udf("string")
    def clean(values: pd.Series) -> pd.Series:
        return values.map(redacted, na_action="ignore")

    return docs.withColumn(text, clean(F.col(text)))
