"""Secret scans with structural confirmation of what candidates decode to."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

# The base patterns. Group 2 of assign is the value.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are taken whole, so a shorter run holds no longer one
#: Order in which kinds are listed where spans start alike.
KINDS = ("assign", "access", "hex", "signed_token", "pem_key", "der_key", "hex_der_key", "ssh_key")

_DOTTED = re.compile(r"[A-Za-z0-9_.-]+")
_PEM_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----")
_PEM_BODY = re.compile(r"(?:[A-Za-z0-9+/=\s]|\\+[nr])+")  # line ends as such or escaped, as JSON has them
_PEM_HEADER = re.compile(r"(?:\s|\\+[nr])*([A-Za-z][A-Za-z0-9-]*): ?([^\n\\]*)(?:\n|\\+[nr])")
# A key name and '=' may stand straight before a value. Standard and URL-safe runs are looked for apart: dashes also rule lines off.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2}")
_URL_SAFE = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{40,}={0,2}")
_HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])(?:30[0-9a-f]{46,}|30[0-9A-F]{46,})(?![0-9A-Fa-f])")
_SSH = re.compile(r"(?<![A-Za-z0-9+/])(?:AAAA|b3BlbnNzaC1rZXktdjEA)[A-Za-z0-9+/]{36,}={0,2}")
_SSH_URL_SAFE = re.compile(r"(?<![A-Za-z0-9_-])(?:AAAA|b3BlbnNzaC1rZXktdjEA)[A-Za-z0-9_-]{36,}={0,2}")
_SSH_MAGIC = b"openssh-key-v1\0"
_SSH_SEALED = (b"aes128-gcm@openssh.com", b"aes256-gcm@openssh.com", b"chacha20-poly1305@openssh.com")  # 16 bytes of tag after the last field


def decode_base64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, padded or not, over lines or not; None if it is neither."""
    text = re.sub(r"\s|\\+[nr]", "", text).rstrip("=")
    try:
        return base64.b64decode(text.replace("-", "+").replace("_", "/") + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def tlv_exact(data: bytes, depth: int = 0) -> int:
    """Number of elements if ``data`` is a whole run of tag-length-value elements with fitting nested lengths, else 0."""
    at = n = 0
    while at < len(data):
        if at + 2 > len(data):
            return 0
        tag, size = data[at], data[at + 1]
        at += 2
        if size == 0x80 or size > 0x84:
            return 0
        if size > 0x80:
            width = size & 0x7F
            if at + width > len(data):
                return 0
            size = int.from_bytes(data[at : at + width], "big")
            at += width
        if at + size > len(data):
            return 0
        if tag & 0x20 and size:
            inner = tlv_exact(data[at : at + size], depth + 1) if depth < 16 else 0
            if not inner:
                return 0
            n += inner
        elif tag not in (1, 2, 3, 4, 5, 6, 10, 12, 19, 22, 23, 24) and tag < 0x80:
            return 0
        n += 1
        at += size
    return n


def is_der_key(data: bytes | None) -> bool:
    """One outer sequence that fills the data exactly, with an integer or identifier inside and three elements at least."""
    return bool(data) and len(data) >= 24 and data[0] == 0x30 and tlv_exact(data) >= 3 and (b"\x02" in data[2:8] or b"\x06" in data[2:12] or b"\x30" in data[2:6])


def ssh_fields(data: bytes) -> list[bytes] | None:
    """The length-prefixed fields of ``data``; None if they don't fill it exactly."""
    at, fields = 0, []
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return fields


def is_openssh_key(data: bytes) -> bool:
    """The magic, then cipher, derivation and its options, the number of keys, so many public keys, and the private part, to the last byte."""
    at, fields = len(_SSH_MAGIC), []
    count = 1
    while len(fields) < 3 + count + 1:
        if len(fields) == 3 and at + 4 <= len(data):
            count, at = int.from_bytes(data[at : at + 4], "big"), at + 4
            if not 1 <= count <= len(data):
                return False
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return False
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    tag = 16 if fields[0] in _SSH_SEALED else 0
    return bool(fields[0] and fields[1] and fields[-1]) and all(ssh_fields(f) for f in fields[3:-1]) and at + tag == len(data)


def is_ssh_blob(data: bytes | None) -> bool:
    """Length-prefixed fields that fill the data exactly, the first of which names a key type; or a whole private key file."""
    if not data:
        return False
    if data.startswith(_SSH_MAGIC):
        return is_openssh_key(data)
    fields = ssh_fields(data) or []
    return len(fields) >= 2 and re.fullmatch(rb"(ssh-(rsa|dss|ed25519)|ecdsa-sha2-[a-z0-9]+)(@[a-z.]+)?", fields[0]) is not None


def is_signed_token(head: str, claims: str) -> bool:
    """Header is a JSON object that names an algorithm, claims are a JSON object."""
    try:
        first, second = (json.loads(decode_base64(x) or b"") for x in (head, claims))
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    return isinstance(first, dict) and isinstance(first.get("alg"), str) and isinstance(second, dict)


def last_object(data: bytes) -> int:
    """Where the object that ends ``data`` begins, read backwards: braces outside of strings are counted; -1 if it is not closed so."""
    at = len(data.rstrip()) - 1
    if at < 0 or data[at] != 0x7D:
        return -1
    depth, quoted = 0, False
    while at >= 0:
        c = data[at]
        if c == 0x22:
            slashes = at
            while slashes and data[slashes - 1] == 0x5C:
                slashes -= 1
            if (at - slashes) % 2 == 0:
                quoted = not quoted
            at = slashes
        elif not quoted and c in b"{}":
            depth += 1 if c == 0x7D else -1
            if depth == 0:
                return at
        at -= 1
    return -1


def header_starts(part: str) -> list[int]:
    """Places of ``eyJ`` from which on a part can be a whole JSON object: one a remainder of four at most, as an object's end tells its begin."""
    found, seen, at = [], set(), part.find("eyJ")
    while at >= 0 and len(seen) < 4:
        if at % 4 not in seen:
            seen.add(at % 4)
            data = decode_base64(part[at:])
            begin = last_object(data) if data else -1
            if begin >= 0 and begin % 3 == 0:
                found.append(at + begin // 3 * 4)
        at = part.find("eyJ", at + 1)
    return sorted(found)


def signed_tokens(text: str):
    """(start, end) of the signed tokens: runs of the token alphabet are cut at dots, so the text is read once; claims and, if it has one, signature follow a header."""
    for run in _DOTTED.finditer(text) if "eyJ" in text else ():
        if "eyJ" not in run[0]:
            continue
        parts, at = run[0].split("."), run.start()
        starts = [at]
        for p in parts:
            starts.append(starts[-1] + len(p) + 1)
        i = 0
        while i + 2 < len(parts):
            found = next((k for k in header_starts(parts[i]) if parts[i + 1] and is_signed_token(parts[i][k:], parts[i + 1])), None) if "eyJ" in parts[i] else None
            if found is not None:
                yield starts[i] + found, starts[i + 3] - 1
                i += 2
            i += 1


class _Headers:
    """Header lines of PEM blocks, each read once: where the lines from a place on end, and the last Proc-Type and DEK-Info among them."""

    def __init__(self, text: str):
        self.text, self.known = text, {}

    def after(self, at: int) -> tuple[int, str, str]:
        walked = []
        while at not in self.known:
            h = _PEM_HEADER.match(self.text, at)
            if not h:
                self.known[at] = (at, None, None)
                break
            walked.append((at, h))
            at = h.end()
        for start, h in reversed(walked):
            end, proc, sealed = self.known[h.end()]
            value = h[2].strip()
            self.known[start] = (end, value if proc is None and h[1] == "Proc-Type" else proc, value if sealed is None and h[1] == "DEK-Info" else sealed)
        return self.known[walked[0][0] if walked else at]


def _pem_body(text: str, at: int) -> tuple[int, bytes | None, bool]:
    """(end of the body at a place, its bytes, whether these are a key)."""
    body = _PEM_BODY.match(text, at)
    data = decode_base64(body[0]) if body else None
    return body.end() if body else at, data, is_der_key(data) or is_ssh_blob(data)


def pem_keys(text: str):
    """(start, end) of the PEM blocks whose body decodes to a key, or, where headers tell how it is sealed, to whole cipher blocks. Headers and bodies are read once."""
    if "-----BEGIN " not in text:
        return
    headers, bodies = _Headers(text), {}
    for m in _PEM_BEGIN.finditer(text):
        at, proc, sealed = headers.after(m.end())
        if at not in bodies:
            bodies[at] = _pem_body(text, at)
        end, data, key = bodies[at]
        close = f"-----END {m[1]}-----"
        if end == at or not text.startswith(close, end):
            continue
        if (proc or "").endswith("ENCRYPTED"):
            vector = (sealed or "").partition(",")[2]
            key = bool(data) and re.fullmatch(r"[0-9A-Fa-f]{16}|[0-9A-Fa-f]{32}", vector) is not None and len(data) % (len(vector) // 2) == 0
        if key:
            yield m.start(), end + len(close)


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, confirmed spans) of a text as (start, order of kind, span), sorted."""
    base = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    more = [(a, b, 3) for a, b in signed_tokens(text)] + [(a, b, 4) for a, b in pem_keys(text)]
    inside = [(a, b) for a, b, k in more if k == 4]
    first = [a for a, _ in inside]
    covered = lambda at: bool(first) and (k := bisect_right(first, at)) > 0 and at < inside[k - 1][1]
    hex_bytes = lambda x: bytes.fromhex(x) if len(x) % 2 == 0 else None
    for kind, pattern, decode, fits in ((5, _BASE64, decode_base64, is_der_key), (5, _URL_SAFE, decode_base64, is_der_key), (6, _HEX_ANY, hex_bytes, is_der_key), (7, _SSH, decode_base64, is_ssh_blob), (7, _SSH_URL_SAFE, decode_base64, is_ssh_blob)):
        more += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if not covered(m.start()) and fits(decode(m[0]))]
    order = lambda spans: sorted((a, k, f"{KINDS[k]}:{a}:{b}") for a, b, k in spans)
    return order(base), order(base + list(dict.fromkeys(more)))  # a run of letters and digits alone is of both alphabets


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: counts by base kind, digest of the base spans, all spans.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then in the order of KINDS. A base
    span is one that its pattern matches; a confirmed span also decodes to what its kind says: a signed token
    with a JSON header, a PEM block with headers or not, base64 (standard or URL-safe) or hex run that is one exactly nested key encoding, a key blob of
    length-prefixed fields. Texts of any length are read in linear time. Null text counts as empty and has no span; repeated rows give repeated rows.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                base, every = scan(text or "")
                kinds = [k for _, k, _ in base]
                digest = hashlib.sha256(",".join(s for *_, s in base).encode()).hexdigest()
                rows.append((doc, kinds.count(0), kinds.count(1), kinds.count(2), digest, ",".join(s for *_, s in every), len(every) - len(base)))
            names, types = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"], [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
