"""Secret scan with structural confirmation.

Textual candidates (assignments, access keys, hex runs) are found by pattern. On top of
them, base64 and hex that may begin a private key is decoded from wherever it begins, after
a name and an equals sign or another separator as well, over line ends if it is wrapped. A
span is reported only if the bytes hold together: a key in DER needs nested lengths that fill
their parent exactly, down to the key inside a PKCS#8 wrapping, and the members of a known
layout; an OpenSSH key its length-prefixed fields, public and private part included; a signed
token a JSON header that names its algorithm, a JSON body and a signature that decodes; a PEM
block a body that decodes to one of these, or to whole cipher blocks under the header that names the cipher.

Null and empty texts have no spans. Offsets are code points, ends exclusive; one kind's
spans do not overlap, spans of different kinds may. Keys of more than MOST_KEY bytes, which
no key type has, are not looked for.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds in the order in which they are listed; the first three are found by pattern alone.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
PEM_BEGIN = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
#: Headers of a PEM block that say how its body is encrypted.
PEM_CIPHER = re.compile(r"\s*Proc-Type: *4, *ENCRYPTED(?:\s|\\[rn])+DEK-Info: *([A-Z0-9-]+), *([0-9A-Fa-f]+)(?:\s|\\[rn])+")
DOTTED = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*)+")
#: How base64 of a JSON object begins: a brace, then a quote, white space or a closing brace.
JSON_STARTS = ("eyJ", "eyAi", "eyAg", "ewog", "ewoi", "ewoJ", "ew0K", "ewki")
LEAST_ASSIGNED, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
LEAST_KEY, MOST_KEY = 24, 1 << 16
#: Bytes by which a key is recognised before the rest of it is read.
HEAD = 96
#: Where an encoded key may begin: a DER sequence of up to four length bytes, or the magic of an OpenSSH key.
BEGIN64 = re.compile(r"(?<![A-Za-z0-9])(?:M[A-I]|b3BlbnNzaC1rZXktdjE)")
BEGIN16 = re.compile(r"(?i)(?<![0-9a-f])(?:30[0-8]|6f70656e7373682d6b65792d7631)")
DIGITS64, DIGITS16 = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"[0-9A-Fa-f]+")
#: How an encoded key goes on in its next line; line ends may be written out.
WRAP = re.compile(r"(?:\\r|\r)?(?:\\n|\n)[ \t]*(?=[A-Za-z0-9+/_-])")

_HEX = np.zeros(129, bool)
_HEX[[ord(c) for c in "0123456789abcdef"]] = True


def _runs(points: np.ndarray, members: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of a character class, of ``least`` code points or more."""
    inside = np.empty(len(points) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = members[np.minimum(points, 128)]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    keep = ends - starts >= least
    return list(zip(starts[keep].tolist(), ends[keep].tolist(), strict=True))


def unbase64(run: str) -> bytes | None:
    """Standard or URL-safe base64, with or without padding."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if "=" in body or len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, depth: int = 0) -> list | None:
    """(tag, content or children) of DER values that fill ``data`` exactly; None if a length does not fit."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            wide = n & 0x7F
            if not 1 <= wide <= 4 or at + wide > len(data) or data[at] == 0:
                return None
            n, at = int.from_bytes(data[at : at + wide], "big"), at + wide
            if n < 0x80:
                return None
        if at + n > len(data):
            return None
        body, at = data[at : at + n], at + n
        if tag & 0x20:
            if depth > 16 or (children := der_items(body, depth + 1)) is None:
                return None
            items.append((tag, children))
        else:
            items.append((tag, body))
    return items


INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30
#: Algorithm identifiers in DER, and what the key octets under them hold (a layout, a number, or octets of a length).
INNER = {
    "2a864886f70d010101": "pkcs1", "2a864886f70d01010a": "pkcs1", "2a8648ce3d0201": "sec1", "2a8648ce380401": "number", "2a864886f70d010301": "number",
    "2b656e": 32, "2b6570": 32, "2b656f": 56, "2b6571": 57,
}
#: How the identifiers of password-based encryption begin.
ENCRYPTIONS = tuple(bytes.fromhex(x) for x in ("2a864886f70d0105", "2a864886f70d010c01"))


def _wrapped(algorithm: bytes, octets: bytes) -> bool:
    """Whether the octets of a PKCS#8 key hold what their algorithm says, or for an unknown one DER values."""
    want, items = INNER.get(algorithm.hex(), "values"), der_items(octets)
    if not items:
        return False
    if want == "values":
        return True
    if want == "number":
        return [t for t, _ in items] == [INTEGER]
    if isinstance(want, int):
        return items[0][0] == OCTETS and len(items) == 1 and len(items[0][1]) == want
    return key_layout(octets) == want


def key_layout(data: bytes) -> str | None:
    """The layout of a private key in DER: PKCS#1, DSA, SEC1, PKCS#8 or its encrypted form."""
    items = der_items(data)
    if not items or len(items) != 1 or items[0][0] != SEQUENCE:
        return None
    parts = items[0][1]
    tags = [t for t, _ in parts]
    named = lambda k: len(tags) > k and tags[k] == SEQUENCE and bool(parts[k][1]) and parts[k][1][0][0] == OID
    if tags[:1] == [INTEGER]:
        version = int.from_bytes(parts[0][1], "big")
        if version in (0, 1) and len(tags) >= 9 and set(tags[:9]) == {INTEGER}:
            return "pkcs1"
        if version == 0 and tags == [INTEGER] * 6:
            return "dsa"
        if version == 1 and tags[1:2] == [OCTETS] and len(parts[1][1]) >= 16:
            return "sec1"
        if version in (0, 1) and tags[2:3] == [OCTETS] and named(1) and _wrapped(parts[1][1][0][1], parts[2][1]):
            return "pkcs8"
    if tags == [SEQUENCE, OCTETS] and named(0) and parts[0][1][0][1].startswith(ENCRYPTIONS) and len(parts[1][1]) >= 16 and len(parts[1][1]) % 8 == 0:
        return "pkcs8-encrypted"
    return None


MAGIC = b"openssh-key-v1\0"


def _fields(data: bytes, at: int, n: int) -> tuple[list[bytes], int] | None:
    """n length-prefixed fields from ``at`` on and where they end; None if one does not fit."""
    out = []
    for _ in range(n):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return out, at


def ssh_length(data: bytes) -> int | None:
    """How many bytes an OpenSSH private key takes at the start of ``data``: magic, cipher, derivation, its options, a count, public keys, private part."""
    if not data.startswith(MAGIC) or (head := _fields(data, len(MAGIC), 3)) is None:
        return None
    (cipher, derivation, options), at = head
    count = int.from_bytes(data[at : at + 4], "big")
    if not 1 <= count <= 64 or (rest := _fields(data, at + 4, count + 1)) is None:
        return None
    (*public, private), at = rest
    for blob in public:
        kind = _fields(blob, 0, 1)
        if kind is None or not kind[0][0].isascii() or not kind[0][0] or len(blob) <= kind[1]:
            return None
    if (cipher == b"none") != (derivation == b"none") or len(private) < 16 or len(private) % 8:
        return None
    if cipher == b"none":
        return at if not options and private[:4] == private[4:8] else None
    return at + 16 if b"gcm" in cipher or b"poly1305" in cipher else at  # the tag stands behind the part


def ssh_layout(data: bytes) -> str | None:
    return "openssh" if ssh_length(data) == len(data) else None


def signed_token(head: str, body: str, signature: str) -> bool:
    """Header and body are base64url JSON objects, the header names an algorithm, and there is a signature that decodes."""
    if not unbase64(signature):
        return False
    try:
        h, b = (json.loads(raw) if (raw := unbase64(x)) is not None else None for x in (head, body))
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    return isinstance(h, dict) and isinstance(h.get("alg"), str) and isinstance(b, dict)


def _signed(chain: str, at: int) -> Iterator[tuple[int, int]]:
    """The signed tokens among consecutive dotted parts of a chain that starts at ``at``."""
    parts = chain.split(".")
    for k, head in enumerate(parts[:-2]):
        if head.startswith(JSON_STARTS) and signed_token(head, *parts[k + 1 : k + 3]):
            yield at, at + sum(map(len, parts[k : k + 3])) + 2
        at += len(head) + 1


def _layout(data: bytes | None) -> str | None:
    if not data:
        return None
    if data[0] == SEQUENCE and key_layout(data):
        return "der"
    return "ssh" if ssh_layout(data) else None


def _needed(head: bytes) -> int | None:
    """Bytes that the DER value at the start takes by its length; None if it is no sequence, or none of a key's size."""
    if len(head) < 6 or head[0] != SEQUENCE:
        return None
    n, wide = head[1], 0
    if n & 0x80:
        wide = n & 0x7F
        if not 1 <= wide <= 4:
            return None
        n = int.from_bytes(head[2 : 2 + wide], "big")
    return 2 + wide + n if LEAST_KEY <= n <= MOST_KEY else None


def _even(run: str, bits: int) -> str:
    """Without a last digit that completes no byte."""
    return run[:-1] if len(run) * bits % 8 == bits else run


def _encoded(text: str, begins: re.Pattern, digits: re.Pattern, bits: int) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the keys in base64 (6 bits a digit) or hex (4) of a text."""
    digit = lambda n: (n * 8 + bits - 1) // bits

    def gathered(at: int, n: int) -> tuple[list[tuple[int, int]], bytes]:
        """Up to n digits from ``at`` on, over line ends: where they stand, and what they encode."""
        pieces, left = [], n
        line = digits.match(text, at, at + left)
        while line is not None:
            pieces.append(line.span())
            left -= line.end() - line.start()
            more = WRAP.match(text, line.end()) if left else None
            line = digits.match(text, more.end(), more.end() + left) if more else None
        run = _even("".join(text[a:b] for a, b in pieces), bits)
        return pieces, (unbase64(run) if bits == 6 else bytes.fromhex(run)) or b""

    at = 0
    while (begun := begins.search(text, at)) is not None:
        start = begun.start()
        at = start + 1
        head = gathered(start, digit(HEAD))[1]
        n = _needed(head) if head[:1] == b"0" else None
        if head.startswith(MAGIC) and _fields(head, len(MAGIC), 2) is not None:
            n = ssh_length(gathered(start, digit(MOST_KEY))[1])
        if n is None:
            continue
        need = digit(n)
        pieces, data = gathered(start, need)
        if len(data) < n or (kind := _layout(data[:n])) is None:
            continue
        end, left = start, need
        for a, b in pieces:
            end = a + min(left, b - a)
            left -= min(left, b - a)
            if not left:
                break
        if text[end : end + 1].isalnum() and text[end].isascii():
            continue
        if bits == 6:
            padding = 0
            while padding < -need % 4 and text[end + padding : end + padding + 1] == "=":
                padding += 1
            end += padding
        yield kind, start, end
        at = end


def _cipher_blocks(cipher: str, iv: str, body: bytes | None) -> bool:
    """Whether a legacy PEM body is whole blocks of the cipher that its header names, with a vector of a block."""
    block = 16 if cipher.startswith("AES") else 8
    return body is not None and len(iv) == 2 * block and len(body) >= 2 * block and len(body) % block == 0


def _pem_blocks(text: str) -> Iterator[tuple[str, int, int]]:
    marks = list(PEM_BEGIN.finditer(text))
    for m, after in zip(marks, [*(x.start() for x in marks[1:]), len(text)], strict=True):
        close = f"-----END {m[1]}-----"
        end = text.find(close, m.end(), after)
        if end < 0:
            continue
        body = text[m.end() : end]
        cipher = PEM_CIPHER.match(body) or PEM_CIPHER.match(re.sub(r"^(?:\\r|\\n)+", "", body))
        if cipher:
            body = cipher.string[cipher.end() :]
        data = unbase64("".join(x for x in re.split(r"\\r|\\n|\s+", body) if x))
        if _cipher_blocks(cipher[1], cipher[2], data) if cipher else _layout(data):
            yield "pem", m.start(), end + len(close)


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All (kind, start, end) of a text, by start, then by kind as listed."""
    if not text:
        return []
    spans: list[tuple[str, int, int]] = []
    if "=" in text or ":" in text:
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    spans += [("hex", a, b) for a, b in _runs(points, _HEX, LEAST_HEX)]
    spans += _encoded(text, BEGIN64, DIGITS64, 6)
    spans += _encoded(text, BEGIN16, DIGITS16, 4)
    if any(x in text for x in JSON_STARTS):
        spans += [("jwt", a, b) for m in DOTTED.finditer(text) for a, b in _signed(m[0], m.start())]
    if "-----BEGIN " in text:
        spans += _pem_blocks(text)
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(set(spans), key=lambda s: (s[1], order[s[0]], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(text: Column) -> Column:
    """array<struct(kind, start, end)> of one text column."""

    @F.pandas_udf("array<struct<kind: string, start: long, end: long>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in find(t)] for t in texts], dtype=object)

    return found(text)


def secret_spans(df: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """Adds the confirmed and textual secret spans of each text."""
    return df.withColumn(out, scan(F.col(text)))


def redacted(df: DataFrame, text: str = "text", out: str = "redacted", mark: str = "[secret]") -> DataFrame:
    """Adds the text with every span, merged where they overlap, replaced by ``mark``."""

    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            done = []
            for t in texts:
                parts, at = [], 0
                for _, a, b in find(t):
                    if b > at:
                        if a >= at:
                            parts += [t[at:a], mark]
                        at = b
                done.append(None if t is None else "".join(parts) + t[at:])
            yield pd.Series(done, dtype=object)

    return df.withColumn(out, cut(F.col(text)))


def digest(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts per textual kind, the digest of those spans, and all spans."""
    spans = F.col("secrets")
    base = F.filter(spans, lambda s: s["kind"].isin(*KINDS[:3]))
    told = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return secret_spans(df.select(id_column, text), text).select(
        id_column, *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(told(base), 256).alias("base_sha256"), told(spans).alias("spans"),
        F.size(F.filter(spans, lambda s: ~s["kind"].isin(*KINDS[:3]))).cast("long").alias("n_confirmed"),
    )
