"""Secret scan: fixed patterns, and encoded keys and signed tokens that are confirmed by their structure."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from trackloom.llm.common import batches, records

#: Kinds of the base patterns, then those that decoding adds.
BASE, ADDED = ("assign", "access", "hex"), ("key", "signed")
_RANK = {kind: i for i, kind in enumerate(BASE + ADDED)}
#: Fewer characters than this hold no key.
LEAST_CHARS = 40
#: Encodings inside encodings are followed to this depth.
DEPTH = 3

# ASCII only, as letters are to be taken in either case; other letters have no case here
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# the look-behind only saves time: a run of hex digits is one match
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

_RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % LEAST_CHARS)
_HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){%d,}(?![0-9A-Fa-f])" % (LEAST_CHARS // 2))
# a sequence of up to 127 bytes, or with its length in one to three bytes
_SEQUENCE = re.compile(r"M[C-I]")
_OPENSSH = b"openssh-key-v1\x00"
_OPENSSH_64 = base64.b64encode(_OPENSSH).decode()[:19]
_JSON_64 = "eyJ"
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*){2,4}")
_ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40})-----")
_UNURL = str.maketrans("-_", "+/")
#: Bytes of a signature by its algorithm, and the least of an RSA one; fixed values.
SIGNATURE_BYTES = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "ES256K": 64, "EdDSA": 64}
RSA_ALGORITHMS, LEAST_RSA = ("RS256", "RS384", "RS512", "PS256", "PS384", "PS512"), 128

Span = tuple[int, int, str, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind, nothing) of all base matches by start, then kind; ends are exclusive."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign", "") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", "") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex", "") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], _RANK[s[2]]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k, _ in spans)


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, begin, end) of the contents of the element at `at`, which lies before end; lengths must be minimal."""
    if at + 2 > end:
        return None
    tag, size = data[at], data[at + 1]
    at += 2
    if size >= 128:
        n = size - 128
        if not 1 <= n <= 3 or at + n > end or data[at] == 0:
            return None
        size = int.from_bytes(data[at : at + n], "big")
        at += n
        if size < 128:
            return None
    return (tag, at, at + size) if at + size <= end else None


def _elements(data: bytes, begin: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill begin..end exactly."""
    out = []
    while begin < end:
        found = _element(data, begin, end)
        if found is None:
            return None
        out.append(found)
        begin = found[2]
    return out


INTEGER, BITS, OCTETS, OBJECT, SEQUENCE = 2, 3, 4, 6, 48


def key_structure(data: bytes) -> str | None:
    """What private key these bytes are, if they are the encoding of one from end to end: nested lengths must agree."""
    if data.startswith(_OPENSSH):
        return _openssh(data)
    outer = _element(data, 0, len(data))
    if outer is None or outer[0] != SEQUENCE or outer[2] != len(data):
        return None
    inner = _elements(data, outer[1], outer[2])
    if not inner:
        return None
    tags = [e[0] for e in inner]
    number = lambda e: int.from_bytes(data[e[1] : e[2]], "big")
    size = lambda e: number(e).bit_length()
    if tags[0] == INTEGER and inner[0][2] - inner[0][1] == 1:
        version = number(inner[0])
        if version in (0, 1) and len(inner) in (9, 10) and tags[1:9] == [INTEGER] * 8:
            # modulus, exponents, two primes of which the modulus is the product, and what follows from them
            bits = size(inner[1])
            good = bits >= 512 and number(inner[2]) % 2 == 1 and number(inner[4]) * number(inner[5]) == number(inner[1])
            return f"rsa {bits}" if good else None
        if version == 0 and tags[1:] == [INTEGER] * 5:
            return f"dsa {size(inner[1])}" if size(inner[1]) >= 512 and size(inner[5]) <= size(inner[2]) else None
        if version == 1 and len(inner) >= 2 and tags[1] == OCTETS and 16 <= inner[1][2] - inner[1][1] <= 66 and all(t in (0xA0, 0xA1) for t in tags[2:]):
            return f"ec {8 * (inner[1][2] - inner[1][1])}"
        if version in (0, 1) and len(inner) >= 3 and tags[1:3] == [SEQUENCE, OCTETS]:
            algorithm = _elements(data, *inner[1][1:])
            return "pkcs8" if algorithm and algorithm[0][0] == OBJECT and inner[2][2] - inner[2][1] >= 16 and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:]) else None
        return None
    if tags == [SEQUENCE, OCTETS]:
        algorithm = _elements(data, *inner[0][1:])
        # password-based encryption: its object identifiers begin with 1.2.840.113549.1.5 or .12
        if algorithm and algorithm[0][0] == OBJECT and data[algorithm[0][1] :].startswith((bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c"))):
            return "pkcs8 encrypted"
    return None


def _openssh(data: bytes) -> str | None:
    at = len(_OPENSSH)

    def field() -> bytes | None:
        nonlocal at
        if at + 4 > len(data) or at + 4 + (n := int.from_bytes(data[at : at + 4], "big")) > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    head = [field() for _ in range(3)]
    if None in head or at + 4 > len(data):
        return None
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 16:
        return None
    public = [field() for _ in range(keys)]
    private = field()
    return "openssh" if None not in public and private and at == len(data) else None


def _decoded(run: str) -> bytes | None:
    run = run.translate(_UNURL).rstrip("=")
    if len(run) % 4 == 1:
        run = run[:-1]
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4))
    except (binascii.Error, ValueError):
        return None


def _of_run(run: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, what) of the private keys in a run of base64 characters."""
    at = 0
    while (m := _SEQUENCE.search(run, at)) is not None:
        start = m.start()
        at = start + 1
        head = _decoded(run[start : start + 24])
        # only its header is read, of which all bytes are there
        first = _element(head, 0, 1 << 30) if head and len(head) > 8 and head[:1] == b"0" else None
        # the first element within is a version number or a sequence, and all of it must be there
        if first is None or head[first[1] : first[1] + 2] != b"\x02\x01" and head[first[1] : first[1] + 1] != b"0":
            continue
        end = start + -(-4 * first[2] // 3)
        if end - start < LEAST_CHARS or end > len(run):
            continue
        what = key_structure((_decoded(run[start:end]) or b"")[: first[2]])
        if what:
            yield start, end, what
            at = end
    if (at := run.find(_OPENSSH_64)) >= 0:
        what = key_structure(_decoded(run[at:]) or b"")
        if what:
            yield at, len(run), what


def signed_token(token: str) -> str | None:
    """The algorithm of a signed token: a header and claims that are JSON objects, and a signature as long as the algorithm's."""
    parts = token.split(".")
    if len(parts) != 3:
        return None
    objects = []
    for part in parts[:2]:
        try:
            objects.append(json.loads((_decoded(part) or b"").decode()))
        except (ValueError, RecursionError):
            return None
    if not all(isinstance(x, dict) for x in objects) or not isinstance(objects[0].get("alg"), str):
        return None
    algorithm, size = objects[0]["alg"], len(_decoded(parts[2]) or b"")
    fits = size == SIGNATURE_BYTES.get(algorithm) or algorithm in RSA_ALGORITHMS and size >= LEAST_RSA
    return algorithm if fits else None


def _armoured(text: str) -> Iterator[Span]:
    """Keys between a line that begins and one that ends them, with the lines in between joined, also where their breaks are written out."""
    at = 0
    while (m := _ARMOUR.search(text, at)) is not None:
        at = m.end()
        end = text.find(closing := f"-----END {m[1]}-----", at)
        if end < 0 or "PRIVATE KEY" not in m[1]:
            continue
        body = re.sub(r"\\[nr]|[\x20\x09-\x0D]", "", text[at:end])
        # headers of an encrypted key end before its encoding
        body = body[m2.start() :] if (m2 := re.search(r"[A-Za-z0-9+/]+={0,2}\Z", body)) else ""
        what = key_structure(_decoded(body) or b"")
        if what is None and "ENCRYPTED" in text[at : min(end, at + 200)] and len(_decoded(body) or b"") >= 64:
            what = "encrypted"
        if what:
            yield m.start(), end + len(closing), "key", what
            at = end + len(closing)


def confirmed(text: str, depth: int = DEPTH) -> list[Span]:
    """Spans of encoded keys and signed tokens whose decoded structure is right; those inside an earlier one are left out."""
    found = list(_armoured(text)) if "-----BEGIN" in text else []
    if _JSON_64 in text:
        found += [(m.start(), m.end(), "signed", what) for m in _TOKEN.finditer(text) if (what := signed_token(m[0]))]
    for m in _RUN.finditer(text):
        run = m[0]
        own = [(m.start() + s, m.start() + e, "key", f"{what} base64") for s, e, what in _of_run(run)]
        if not own and depth > 1 and (raw := _decoded(run)):
            own = _nested(m.start(), m.end(), raw, "base64", depth)
        found += own
    for m in _HEX_RUN.finditer(text):
        raw = bytes.fromhex(m[0])
        if what := key_structure(raw):
            found.append((m.start(), m.end(), "key", f"{what} hex"))
        elif depth > 1:
            found += _nested(m.start(), m.end(), raw, "hex", depth)
    found.sort(key=lambda s: (s[0], -s[1], _RANK[s[2]]))
    out, done = [], 0
    for span in found:
        if span[0] >= done:
            # padding belongs to the encoding before it
            end = span[1]
            while end < len(text) and text[end] == "=" and end < span[1] + 2:
                end += 1
            out.append((span[0], end, *span[2:]))
            done = end
    return out


def _nested(start: int, end: int, raw: bytes, how: str, depth: int) -> list[Span]:
    """The whole of an encoding, if what it encodes is text in which there is a key or a signed token."""
    if not raw.isascii():
        return []
    within = confirmed(raw.decode("ascii"), depth - 1)
    return [(start, end, within[0][2], f"{within[0][3]} in {how}")] if within else []


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("detail", pa.string())])
_FOUND = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_key", pa.int64()), ("n_signed", pa.int64()), ("found", pa.list_(_SPAN))])


def _scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        for row in records(stream):
            text = row["text"] or ""
            base, added = base_spans(text), confirmed(text)
            every = sorted(base + added, key=lambda s: (s[0], _RANK[s[2]], s[1]))
            yield {
                "doc_id": row["doc_id"], "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(), "spans": joined(every),
                "found": [dict(zip(("start", "end", "kind", "detail"), s, strict=True)) for s in every],
            } | {f"n_{k}": sum(s[2] == k for s in every) for k in _RANK}

    yield from batches(rows(), _FOUND, 1000)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_key, n_signed, found; a row for each row of docs.

    The base kinds are plain patterns; base_sha256 describes them alone. spans has all spans as
    kind:start:end in code points by start, then kind; found has them as an array of (start, end, kind,
    detail). Added are encodings in base64 (either alphabet) or hex, or between the lines of an armour,
    that decode to a private key - nested lengths agree to the last byte, the numbers are as many and as
    long as such a key has - and tokens whose header and claims decode to JSON objects with a signature of
    the length that the named algorithm gives. Encodings within encodings are followed. An encoding
    without that structure isn't reported.

    A null text is empty: no spans and the digest of the empty string. Null doc_ids and repeated rows come
    out once for each row; spans of one start are in the order of their kinds. Very long texts are scanned
    whole. Other columns are ignored. An empty table gives an empty result. Each text is judged alone, so
    that no row moves between tasks.
    """
    schema = f"doc_id long, {', '.join(f'n_{k} long' for k in BASE)}, base_sha256 string, spans string, n_key long, n_signed long, found array<struct<start:long,`end`:long,kind:string,detail:string>>"
    return docs.selectExpr("cast(doc_id as long) AS doc_id", "cast(text as string) AS text").mapInArrow(_scan, schema)
