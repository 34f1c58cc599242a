import hashlib
import random
import re

from trackloom.llm.pii import base_spans, joined, luhn, personal_data, redact

SCHEMA = "doc_id long, text string"


def brute(text):
    """The patterns as they are stated."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for rank, (kind, pattern) in enumerate(patterns.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return [(s, e, k) for s, _, e, k in sorted(out)]


def test_base_spans():
    r = random.Random(2)
    assert luhn("4539578763621486") and not luhn("4539578763621487")
    parts = ["a.b+c@x-1.co.uk", "@", "x@y", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "4539 5787 6362 1486", "4539-5787-6362-1486", "+1 (555) 555-1234", "+49", "ü", " ", ".", "-", "12", "a@b.c@d.e", "\n", "+", "007.8.9.010", "4539578763621486"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(12)))
        assert base_spans(text) == brute(text), text


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    got = personal_data(docs).collect()
    assert len(got) == len(want)
    for r in got:
        base = want[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, _, k in base) for x in ("email", "ip", "card", "phone")]
        assert set(joined(base).split(",")) <= set(r.spans.split(","))


def test_discovery_and_odd_rows(spark):
    rows = [(i, f"Please ring me under +1 555 000 {1000 + i} before noon. Word {i} is fine.") for i in range(20)]
    rows += [(50, "Please ring me under +1-555-77-88 before noon."), (51, "There were 77777 people under 555-9988 trees."), (52, None), (53, ""), (None, "x a@b.cc y"), (54, "a@b.cc " * 20_000), (55, "1" * 300_000), (54, "a@b.cc " * 20_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", spans int")
    got = personal_data(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[50].spans == "phone:21:33" and by[50].n_phone == 0
    assert by[51].spans == by[52].spans == by[53].spans == "" and by[52].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[3].spans == "phone:21:36" and by[None].spans == "email:2:8" and by[54].n_email == 20_000
    assert personal_data(docs.limit(0)).collect() == []


def test_bootstrapping_precision_and_recall(spark):
    """Planted contexts: seeds vouch for one, what is found there for another; numbers elsewhere stay."""
    r = random.Random(7)
    local = lambda: f"0{r.randrange(100, 999)}-{r.randrange(10**6, 10**7)}"
    word = lambda: r.choice("alpha beta gamma delta eps zeta eta theta".split())
    rows, planted = [], set()

    def add(text, identifier=None):
        rows.append((len(rows), text))
        if identifier:
            planted.add((len(rows) - 1, text.index(identifier), text.index(identifier) + len(identifier)))

    both = [local() for _ in range(30)]
    for i in range(200):
        add(f"{word()} call me on +49 30 {1000 + i} {100 + i} tonight please {word()}")
    for x in both + [local() for _ in range(150)]:
        add(f"{word()} call me on {x} tonight please {word()}", x)  # next to seeds
    for x in both + [local() for _ in range(60)]:
        add(f"{word()} reach our desk {x} during hours {word()}", x)  # next to what the first round finds only
    for i in range(200):
        add(f"{word()} article number {10**9 + i} was sold {word()}")  # the shape of a phone, in no such context
        add(f"{word()} call me on day{i:05d} tonight please {word()}" if i < 3 else f"{word()} room A{i:05d} is free {word()}")
    long = " ".join(word() for _ in range(50_000))
    add(f"{long} call me on 0999-1234567 tonight please {long}", "0999-1234567")
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = personal_data(docs)
    base = got.where("n_phone = 1").count()
    found = {(d.doc_id, f.start, f.end) for d in got.where("n_phone = 0").collect() for f in d.found}
    assert base == 200
    assert len(found & planted) >= 0.95 * len(planted) and len(found - planted) <= 0.02 * len(found)


def test_redact_with_clashing_names(spark):
    schema = "doc_id long, text string, found string, spans int, text_hash string, _0 int, hash int, of int"
    rows = [(1, "write to a.b@c.org now", "f", 1, "h", 2, 3, 4), (None, None, "g", None, None, None, None, None), (1, "write to a.b@c.org now", "k", 1, "h", 2, 3, 4)]
    got = redact(spark.createDataFrame(rows, schema))
    assert got.columns == [c.split()[0] for c in schema.split(", ")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "write to <EMAIL> now", "f", 1, "h", 2, 3, 4), rows[1], (1, "write to <EMAIL> now", "k", 1, "h", 2, 3, 4)], key=str)
    assert redact(spark.createDataFrame([], schema)).collect() == []
