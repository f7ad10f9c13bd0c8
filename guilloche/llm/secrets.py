"""Secret scan with structural confirmation.

Plain patterns report assignments, access keys and long hex runs. Beside them, candidates in
base64 or hex are decoded and reported only if what comes out has the structure of a secret:
a private key whose nested lengths add up to the last byte, or a token with a signed header.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import text_runs

#: Kinds in the order in which they are listed at one place of a text.
KINDS = ("assign", "access", "hex", "pem", "key", "token")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Boundaries of a private key's armour, with its label.
_ARMOUR = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ ){0,4}PRIVATE KEY)-----")
#: Header lines that an armour may have before its body.
_HEADERS = re.compile(r"\s*(?:[A-Za-z][A-Za-z0-9-]*:[^\n]*\n)+\r?\n")
#: Runs of base64, of either alphabet, and of hex that are long enough for a key; lower-case hex is among the base kinds as well.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
_KEY_HEX = re.compile(r"(?<![0-9A-Fa-f])30(?:[0-9A-Fa-f]{2}){30,}(?![0-9A-Fa-f])")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])(ey[A-Za-z0-9_-]{8,}+)\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]*+)(?:\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++))?+(?!\.?[A-Za-z0-9_-])")
#: Bytes of a signature by the algorithm that the header names; of those of RSA, at least.
_SIGNED = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "ES256K": 64, "EdDSA": 64, "Ed25519": 64, "Ed448": 114}
_RSA_SIGNED, _RSA_LEAST = ("RS256", "RS384", "RS512", "PS256", "PS384", "PS512"), 128
_OPENSSH = b"openssh-key-v1\0"
_INTEGER, _OCTETS, _OID, _SEQUENCE = 0x02, 0x04, 0x06, 0x30
#: Algorithms of private keys: RSA, RSA-PSS, DSA, EC, X25519, X448, Ed25519, Ed448; and of passwords that encrypt one.
_KEY_OIDS = tuple(bytes.fromhex(x) for x in ("2a864886f70d010101", "2a864886f70d01010a", "2a8648ce380401", "2a8648ce3d0201", "2b656e", "2b656f", "2b6570", "2b6571"))
_CIPHER_OID = bytes.fromhex("2a864886f70d0105")
_CIPHER_OID_12 = bytes.fromhex("2a864886f70d010c01")


def _items(data: bytes, most: int = 64) -> list[tuple[int, bytes]] | None:
    """The (tag, content) elements that fill ``data`` to its last byte; None if their lengths do not add up."""
    out, at = [], 0
    while at < len(data):
        if len(out) == most or at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(data) or data[at] == 0:
                return None
            n = int.from_bytes(data[at : at + k], "big")
            at += k
            if n < 0x80:
                return None  # a shorter form is due
        if at + n > len(data):
            return None
        out.append((tag, data[at : at + n]))
        at += n
    return out


def _sequence(data: bytes) -> list[tuple[int, bytes]] | None:
    """The elements of the one sequence that ``data`` is, to its last byte."""
    outer = _items(data, 1)
    return _items(outer[0][1]) if outer and outer[0][0] == _SEQUENCE else None


def is_private_key(data: bytes, depth: int = 0) -> bool:
    """Whether bytes are a private key: RSA, DSA, elliptic curve, PKCS 8 (plain or encrypted) or OpenSSH's own form."""
    if data.startswith(_OPENSSH):
        return _is_openssh(data[len(_OPENSSH) :])
    top = _sequence(data) if data[:1] == b"\x30" else None
    if not top or len(top) < 2:
        return False
    tags = [t for t, _ in top]
    if tags[0] == _INTEGER and top[0][1] in (b"\0", b"\1"):
        if tags[1] == _SEQUENCE and len(top) >= 3 and tags[2] == _OCTETS:  # PKCS 8
            named = _items(top[1][1])
            if not named or named[0][0] != _OID or named[0][1] not in _KEY_OIDS or depth:
                return False
            inner = top[2][1]
            if named[0][1] in _KEY_OIDS[4:]:
                raw = _items(inner, 1)
                return bool(raw) and raw[0][0] == _OCTETS and len(raw[0][1]) in (32, 56, 57)
            if named[0][1] == _KEY_OIDS[2]:
                number = _items(inner, 1)
                return bool(number) and number[0][0] == _INTEGER and len(number[0][1]) >= 16
            return is_private_key(inner, depth + 1)
        if tags[1] == _OCTETS and top[0][1] == b"\1":  # elliptic curve
            return 20 <= len(top[1][1]) <= 66 and all(t in (0xA0, 0xA1) and _items(v, 1) is not None for t, v in top[2:])
        # RSA has nine numbers, DSA six; the modulus and the private number are long ones.
        if all(t == _INTEGER and v for t, v in top[:9]):
            return len(top) >= 9 and len(top[1][1]) >= 48 and 2 * len(top[3][1]) >= len(top[1][1]) or len(top) == 6 and len(top[1][1]) >= 64 and len(top[5][1]) >= 16
        return False
    if tags == [_SEQUENCE, _OCTETS]:  # encrypted PKCS 8
        named = _items(top[0][1])
        return bool(named) and named[0][0] == _OID and named[0][1].startswith((_CIPHER_OID, _CIPHER_OID_12)) and len(top[1][1]) >= 32 and len(top[1][1]) % 8 == 0
    return False


def _is_openssh(data: bytes) -> bool:
    """Cipher, derivation and its options, number of keys, then public keys and the private part, each with its length."""

    def field(at: int) -> tuple[bytes, int] | None:
        n = int.from_bytes(data[at : at + 4], "big")
        return (data[at + 4 : at + 4 + n], at + 4 + n) if at + 4 + n <= len(data) and at + 4 <= len(data) else None

    at, first = 0, None
    for _ in range(3):
        if (got := field(at)) is None:
            return False
        first, at = (got[0] if first is None else first), got[1]
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 16 or not first:
        return False
    for _ in range(keys + 1):
        if (got := field(at)) is None:
            return False
        private, at = got
    return at == len(data) and len(private) >= 16 and len(private) % 8 == 0 and (first != b"none" or private[:4] == private[4:8])


def _decoded(text: str) -> bytes | None:
    """Base64 of either alphabet, with or without the padding at its end."""
    plain = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(plain) % 4 == 1:
        return None
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except binascii.Error:
        return None


def _is_armoured(body: str) -> bool:
    """Whether what stands between the boundaries decodes to a private key; one that its headers call encrypted, to whole cipher blocks."""
    head = _HEADERS.match(body)
    data = _decoded("".join(body[head.end() if head else 0 :].split()))
    if not data:
        return False
    if head and "ENCRYPTED" in head.group():
        return len(data) >= 32 and len(data) % 8 == 0
    return is_private_key(data)


def _armoured(text: str) -> list[tuple[int, int]]:
    """Confirmed private keys in armour; a boundary belongs to the next one, if that ends the same label."""
    out, begun = [], None
    for m in _ARMOUR.finditer(text):
        if m[1] == "BEGIN":
            begun = m
        elif begun is not None:
            if begun[2] == m[2] and _is_armoured(text[begun.end() : m.start()].replace("\\r", "").replace("\\n", "\n")):
                out.append((begun.start(), m.end()))
            begun = None
    return out


def _object(part: str) -> dict | None:
    try:
        found = json.loads(_decoded(part) or b"")
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _is_token(m: re.Match) -> bool:
    """A signed token: a header that names its algorithm, a payload that is an object, a signature of that algorithm's length. An encrypted one has five parts and names a cipher."""
    header = _object(m[1])
    kind = header.get("alg") if header else None
    if not isinstance(kind, str):
        return False
    if m[4]:
        return isinstance(header.get("enc"), str) and all(_decoded(p) is not None for p in m.groups()[1:] if p)
    signature = _decoded(m[3]) or b""
    right = len(signature) >= _RSA_LEAST if kind in _RSA_SIGNED else kind in _SIGNED and len(signature) == _SIGNED[kind]
    return right and (header.get("b64") is False or _object(m[2]) is not None)


def _is_encoded_key(run: str) -> bool:
    """Whether a base64 run decodes to a private key, or to the armour of one."""
    if run[0] not in "MbL":  # a sequence, OpenSSH's mark or a dash comes first
        return False
    data = _decoded(run)
    if not data:
        return False
    if data.startswith(b"-----BEGIN"):
        return bool(_armoured(data.decode("ascii", "replace")))
    return is_private_key(data)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of assignments, access keys and hex runs; a match that is too short is used up and dropped."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] if ":" in text or "=" in text else []
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of keys in armour, of encoded keys outside it and of signed tokens."""
    out = [(a, 3, b) for a, b in (_armoured(text) if "-----BEGIN" in text else ())]
    begins, ends = [a for a, _, _ in out], [b for _, _, b in out]

    def free(m: re.Match) -> bool:
        k = bisect_right(begins, m.start())
        return k == 0 or ends[k - 1] <= m.start()

    out += [(m.start(), 4, m.end()) for m in _BASE64.finditer(text) if _is_encoded_key(m[0]) and free(m)]
    out += [(m.start(), 4, m.end()) for m in _KEY_HEX.finditer(text) if is_private_key(bytes.fromhex(m[0])) and free(m)]
    return out + [(m.start(), 5, m.end()) for m in _TOKEN.finditer(text) if _is_token(m)] if "ey" in text else out


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    A span is kind:start:end in code points, the end not included; spans are in order of their
    start, then of ``KINDS``. Null and empty texts have none. Each row is read by itself, so
    rows without id, rows that repeat one and equal rows do not matter, nor do other columns;
    an empty table gives no rows. Every pattern and decoder is linear in the text; a task holds
    one text and what its runs decode to.
    """
    schema = pa.schema([("doc_id", pa.int64())] + [(f"n_{k}", pa.int64()) for k in KINDS[:3]] + [("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches):
        for part in text_runs(batches, 1):
            counts, hashes, listed = ([], [], []), [], []
            for text in part.column(1).to_pylist():
                base, more = (base_spans(text), confirmed_spans(text)) if text else ([], [])
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in base))
                hashes.append(hashlib.sha256(_listed(base).encode()).hexdigest())
                listed.append(_listed(base + more))
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, counts), pa.array(hashes), pa.array(listed)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
