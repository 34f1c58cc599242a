import base64
import hashlib
import json
import random
import re

from pyspark.sql import functions as F

from trackloom.llm.secret_scan import base_spans, confirmed, joined, key_structure, scan_secrets, signed_token

SCHEMA = "doc_id long, text string, found int, spans string"
#: Two primes of 256 bits, of which nothing is protected.
P = (1 << 256) - 189
Q = (1 << 256) - 357


def brute(text):
    """The patterns as they are stated."""
    letters = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join([*map(letters, ("password", "passwd", "secret", "token")), "[aA][pP][iI]_?[kK][eE][yY]"])
    patterns = {"assign": rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
    out = []
    for rank, (kind, pattern) in enumerate(patterns.items()):
        for m in re.finditer(pattern, text):
            if {"assign": kind == "assign" and len(m[2]) >= 6, "access": len(m[0]) >= 20, "hex": len(m[0]) >= 24}[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return [(s, e, k, "") for s, _, e, k in sorted(out)]


def element(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([128 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def number(n):
    return element(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


def rsa(p=P, q=Q, n=None):
    e, d = 65537, 123456789
    return element(48, b"".join(map(number, (0, n or p * q, e, d, p, q, d % (p - 1), d % (q - 1), 5))))


def pkcs8(inner):
    return element(48, number(0) + element(48, element(6, bytes.fromhex("2a864886f70d010101")) + element(5, b"")) + element(4, inner))


def ec():
    return element(48, number(1) + element(4, bytes(range(32))) + element(0xA0, element(6, bytes.fromhex("2a8648ce3d030107"))))


def openssh():
    field = lambda b: len(b).to_bytes(4, "big") + b
    return b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"ssh-ed25519" + bytes(40)) + field(bytes(136))


def url(b):
    return base64.urlsafe_b64encode(b).decode().rstrip("=")


def jwt(alg="HS256", size=32):
    return ".".join([url(json.dumps({"alg": alg, "typ": "JWT"}).encode()), url(b'{"sub":"me"}'), url(bytes(range(size)))])


def test_base_spans():
    r = random.Random(3)
    parts = ["password", "PassWD", "secret", "TOKEN", "api_key", "ApiKey", "toKen", "ſecret", '"', "'", " ", "  ", ":", "=", "abc", "abcdef", "A1+/_.=-", "AKIA", "ABCDEFGH01234567", "0123456789abcdef", "deadbeef", "ü", "\n", "."]
    for _ in range(6000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(14)))
        assert base_spans(text) == brute(text), text


def test_structures():
    assert key_structure(rsa()) == "rsa 512" and key_structure(pkcs8(rsa())) == "pkcs8" and key_structure(ec()) == "ec 256" and key_structure(openssh()) == "openssh"
    assert key_structure(rsa(n=P * Q + 2)) is None and key_structure(rsa() + b"\0") is None and key_structure(rsa()[:-1]) is None and key_structure(openssh()[:-1]) is None
    public = element(48, element(48, element(6, bytes.fromhex("2a864886f70d010101")) + element(5, b"")) + element(3, b"\0" + element(48, number(P * Q) + number(3))))
    assert key_structure(public) is None and key_structure(b"") is None and key_structure(b"0") is None
    # any one byte of a length changed, and the parts no longer fill the whole
    for at in (1, 2, 3, 4):
        bad = bytearray(rsa())
        bad[at] ^= 1
        assert key_structure(bytes(bad)) is None
    assert signed_token(jwt()) == "HS256" and signed_token(jwt("RS256", 256)) == "RS256" and signed_token(jwt("HS256", 31)) is None and signed_token(jwt("none", 0)) is None and signed_token("eyJ.eyJ.eyJ") is None


def test_planted_among_noise():
    """Each encoded key and token is found at its place; as many strings of the same look and none of the structure aren't."""
    r = random.Random(5)
    noise = lambda n, chars="ABCDEFabcdef0123456789+/": "".join(r.choice(chars) for _ in range(n))
    b64 = lambda b: base64.b64encode(b).decode()
    armour = "-----BEGIN RSA PRIVATE KEY-----\n" + re.sub("(.{64})", r"\1\n", b64(rsa())) + "\n-----END RSA PRIVATE KEY-----"
    good = [(b64(rsa()), "key"), (b64(pkcs8(rsa())), "key"), (url(ec()), "key"), (b64(openssh()), "key"), (rsa().hex(), "key"), (rsa().hex().upper(), "key"), (jwt(), "signed"), (jwt("ES256", 64), "signed"), (armour, "key"), (b64(armour.encode()), "key"), (armour.encode().hex(), "key"), (b64(jwt().encode()), "signed"), (armour.replace("\n", "\\n"), "key")]
    bad = [b64(rsa(n=P * Q + 2)), b64(rsa()[:-3]), b64(b"\0" * 90), jwt("none", 0), jwt("HS512", 32), noise(300), "MIIB" + noise(200), rsa().hex()[:-2] + "zz", "eyJ" + noise(60) + "." + noise(60) + "." + noise(43), b64(b"plain text that says nothing at all, in ascii letters")]
    for secret, kind in good:
        for before, after in (("", ""), ("ü key: ", " end"), ('"', '"'), ("x\n", "\n" + noise(100))):
            found = confirmed(before + secret + after)
            assert [(s[0], s[1], s[2]) for s in found] == [(len(before), len(before) + len(secret), kind)], (secret[:40], found)
    for text in bad:
        assert confirmed(f"a {text} b") == [], text[:40]
    assert confirmed("x" * 300_000 + "eyJ" * 20_000 + "MI" * 20_000 + "-----BEGIN PRIVATE KEY-----" * 50) == []


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("text", F.expr("if(doc_id % 3 = 0, text, concat(substr(text, 1, 100), ' Token=', sha1(text), substr(text, 101)))"))
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    got = scan_secrets(docs).collect()
    assert len(got) == len(want) and sum(map(len, want.values())) > 0
    for r in got:
        base = want[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest() and (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[2] == k for s in base) for k in ("assign", "access", "hex"))
        assert set(joined(base).split(",")) <= set(r.spans.split(","))


def test_odd_rows(spark):
    key = base64.b64encode(ec()).decode()
    rows = [(1, None, 0, "x"), (2, "", 0, "x"), (None, f"ü token={key}", 0, "x"), (None, f"ü token={key}", 0, "x"), (3, "word " * 400_000 + "secret: hunter22", 0, "x")]
    got = sorted(((r.doc_id or 0, r.n_assign, r.n_key, r.spans, r.base_sha256[:4]) for r in scan_secrets(spark.createDataFrame(rows, SCHEMA)).collect()))
    empty = hashlib.sha256(b"").hexdigest()[:4]
    end = 8 + len(key)
    # padding is part of an assignment's value and of the encoding
    both = (0, 1, 1, f"assign:2:{end},key:8:{end}", hashlib.sha256(f"assign:2:{end}".encode()).hexdigest()[:4])
    last = (3, 1, 0, "assign:2000000:2000016", hashlib.sha256(b"assign:2000000:2000016").hexdigest()[:4])
    assert got == [both, both, (1, 0, 0, "", empty), (2, 0, 0, "", empty), last]
    assert scan_secrets(spark.createDataFrame([], SCHEMA)).collect() == []
