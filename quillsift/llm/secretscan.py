"""Secrets in texts: patterns find candidates, structure confirms them.

Base patterns report by their looks. The method's own kinds are reported only when the candidate, decoded,
parses as what it claims to be:

    pem       a PEM private-key block whose body is a DER or OpenSSH key, or by its headers whole cipher blocks;
              line ends may be escaped as in JSON
    jwt       a signed token: two base64url parts with JSON objects, the first naming an ``alg``, and a signature
    der       base64 or hex of a DER private key (PKCS#1, PKCS#8 plain or encrypted, SEC1, DSA), nested lengths adding up exactly
    openssh   base64 of an ``openssh-key-v1`` container, nested lengths adding up exactly
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillsift.llm.encoding import texts_of

# The base patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "jwt", "der", "openssh")

# No assignment without one of these, in any case; access keys, hex and encodings lie in long runs.
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{20,}")
# Label, headers, body. A header's value ends with its line, a backslash or dashes.
PEM = re.compile(
    r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----"
    r"((?:(?:\s|\\+[nrt])*[A-Za-z][A-Za-z0-9-]*:(?:(?!-----)[^\r\n\\])*(?:[\r\n]|\\+[rn]))*)"
    r"((?:[A-Za-z0-9+/=\s]|\\+(?:[nrt/]|u003[dD]))+)-----END \1-----")
PEM_BLANKS = re.compile(r"\s+|\\+(?:[nrt]|u003[dD]|(?=/))")
PEM_CIPHER = re.compile(r"Proc-Type:[\x20\t]*4,[\x20\t]*ENCRYPTED.*DEK-Info:[\x20\t]*[A-Za-z0-9-]+,[\x20\t]*((?:[0-9A-Fa-f]{16}){1,2})(?![0-9A-Fa-f])", re.S)
ENCODED = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
HEX_ENCODED = re.compile(r"(?:[0-9a-f]{2}){24,}|(?:[0-9A-F]{2}){24,}")
JWT = re.compile(r"[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]{16,}")
OPENSSH = b"openssh-key-v1\x00"


def decode_base64(text: str) -> bytes | None:
    """Plain or URL-safe base64, with or without padding; nothing if it is neither."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """The (tag, content) items that fill ``data`` exactly, lengths in DER's shortest form."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if length > 0x80:
            size = length - 0x80
            if size > 4 or at + size > len(data):
                return None
            length = int.from_bytes(data[at:at + size], "big")
            if length < 0x80 or data[at] == 0:
                return None
            at += size
        elif length == 0x80:
            return None
        if at + length > len(data):
            return None
        items.append((tag, data[at:at + length]))
        at += length
    return items


def is_der_key(data: bytes) -> bool:
    """A private key: SEQUENCE of a version and what PKCS#1, PKCS#8, SEC1 or DSA put after it, or an encrypted PKCS#8."""
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    parts = der_items(outer[0][1])
    if not parts:
        return False
    tags = [tag for tag, _ in parts]
    if tags == [0x30, 0x04]:  # encrypted PKCS#8: algorithm with parameters (a digest has none), cipher text
        algorithm = der_items(parts[0][1])
        return bool(algorithm) and [tag for tag, _ in algorithm] == [0x06, 0x30] and bool(parts[1][1])
    if len(parts) < 2 or parts[0][0] != 0x02 or parts[0][1] not in (b"\x00", b"\x01"):
        return False
    if tags == [0x02, 0x04]:  # SEC1 without curve and public key
        return parts[0][1] == b"\x01"
    if tags == [0x02] * 6:  # DSA: version and five integers
        return parts[0][1] == b"\x00"
    if len(parts) < 3:
        return False
    if len(parts) >= 9 and tags[:9] == [0x02] * 9:  # PKCS#1: nine integers
        return True
    if tags[1] == 0x30 and tags[2] == 0x04:  # PKCS#8: algorithm, key
        algorithm = der_items(parts[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06
    return tags[1] == 0x04 and tags[2] in (0xA0, 0xA1) and parts[0][1] == b"\x01"  # SEC1


def is_openssh_key(data: bytes) -> bool:
    """Cipher, key derivation and its options, the number of keys, then as many public keys and one private part."""
    if not data.startswith(OPENSSH):
        return False
    at = len(OPENSSH)

    def field() -> bool:
        nonlocal at
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at:at + 4], "big")
        return at <= len(data)

    if not (field() and field() and field()) or at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at:at + 4], "big")
    at += 4
    if not 1 <= keys <= 64 or not all(field() for _ in range(keys + 1)):
        return False
    return at == len(data)


def key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "der" if is_der_key(data) else "openssh" if is_openssh_key(data) else None


def is_pem_key(headers: str, body: str) -> bool:
    data = decode_base64(PEM_BLANKS.sub("", body))
    if cipher := PEM_CIPHER.search(headers):  # the initial vector is as long as a block
        return bool(data) and len(data) % (len(cipher[1]) // 2) == 0
    return key_kind(data) is not None


def is_signed_token(text: str) -> bool:
    header, payload, _ = text.split(".")
    found = []
    for part in (header, payload):
        data = decode_base64(part)
        try:
            found.append(json.loads(data) if data else None)
        except (ValueError, RecursionError):
            return False
    return all(isinstance(x, dict) for x in found) and isinstance(found[0].get("alg"), str)


def signed_tokens(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Where signed tokens lie; a candidate that fails is tried again from its second part, since words may stand before a token."""
    spans, at = [], start
    while match := JWT.search(text, at, end):
        if is_signed_token(match[0]):
            spans.append(match.span())
            at = match.end()
        else:
            at = text.index(".", match.start()) + 1
    return spans


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns: leftmost matches that do not overlap, too short ones dropped."""
    spans = []
    folded = text.lower()
    if any(hint in folded for hint in ASSIGN_HINTS):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    for run in RUN.finditer(text):
        for kind, pattern, least in (("access", ACCESS, MIN_ACCESS), ("hex", HEX, MIN_HEX)):
            spans += [(m.start(), m.end(), kind) for m in pattern.finditer(text, *run.span())
                      if m.end() - m.start() >= least]
    return spans


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of candidates whose structure holds."""
    spans = []
    if "-----BEGIN" in text:
        spans += [(m.start(), m.end(), "pem") for m in PEM.finditer(text)
                  if is_pem_key(m[2], m[3])]
    for run in RUN.finditer(text):
        if run.end() - run.start() < 28:
            continue
        spans += [(*span, "jwt") for span in signed_tokens(text, *run.span())]
        for m in HEX_ENCODED.finditer(text, *run.span()):
            if kind := key_kind(bytes.fromhex(m[0])):
                spans.append((m.start(), m.end(), kind))
        for m in ENCODED.finditer(text, *run.span()):
            if kind := key_kind(decode_base64(m[0])):
                spans.append((m.start(), m.end(), kind))
    return spans


SPAN_SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def find_secrets(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: ``doc_id`` and ``spans`` (kind, start, end, base), by start and then kind.

    Positions count code points, the end is exclusive. Every text is read whole, each row for itself: repeated
    rows are reported each, a null or empty text has no span, an empty table no row. Other columns are
    not read.
    """
    order = {kind: i for i, kind in enumerate(KINDS)}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in texts_of(batch, "text"):
                text = text or ""
                spans = sorted({*base_spans(text), *confirmed_spans(text)}, key=lambda s: (s[0], order[s[2]], s[1]))
                rows.append([{"kind": k, "start": a, "end": b, "base": k in BASE_KINDS} for a, b, k in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, SPAN_TYPE)], names=["doc_id", "spans"])

    chosen = df.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    return chosen.mapInArrow(scan, SPAN_SCHEMA)
