import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from trackloom.llm import substring_dedup
from trackloom.llm.substring_dedup import Codes, _strip, locate, remove_repeats

SCHEMA = "doc_id long, text string"


def brute(rows, window=35):
    split = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, split, strict=True):
        gone = {i + j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(window)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, remove_repeats(docs, False).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("size", [1, 400_000])
def test_small_alphabet(spark, monkeypatch, size):
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", size)
    r = random.Random(5)
    passage = [r.choice("abcdefgh") + r.choice("xyzw") for _ in range(90)]
    rows = []
    for i in range(60):
        a = r.randrange(60)
        part = passage[a : a + r.randrange(30, 60)]
        rows.append((i, " ".join(r.choice("ab") for _ in range(r.randrange(60))) + " \n" + " ".join(part) + "\t" + " ".join(r.choice("pqrs") for _ in range(20))))
    rows.append((99, "z " * 300))
    assert sorted(map(tuple, remove_repeats(spark.createDataFrame(rows, SCHEMA), False).collect()), key=str) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, " \x0b "), (None, "a b"), (4, long), (5, "x " + long[:400]), (6, "same text"), (6, "same text"), (7, "q" * 50_000)]
    rows += [(8, long[1000:1400])] * 2
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", key int")
    got = remove_repeats(docs)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == brute(rows)
    assert remove_repeats(docs.limit(0)).collect() == []


def shared_phrase(i):
    """21 own words, a phrase of 14 words whose hash is the smallest, 21 own words: one segment."""
    return " ".join([f"{i}a{j}" for j in range(21)] + [f"line7428w{j}" for j in range(14)] + [f"{i}b{j}" for j in range(21)])


def test_segments_alike_in_32_bits(spark):
    # found by trial: these pairs share their print, and the upper 32 bits of their segments' hashes
    rows = [(i, shared_phrase(i)) for i in (8583, 44493, 101041, 112429, 2738, 170773)]
    assert sorted(map(tuple, remove_repeats(spark.createDataFrame(rows, SCHEMA), False).collect()), key=str) == brute(rows)


def test_crowded_print(spark):
    """A phrase in many documents with different neighbours, of which some recur in part."""
    rows = [(i, shared_phrase(i)) for i in range(200)]
    # of some, also a part of the neighbourhood recurs, in equal and in different segments
    rows += [(300 + i, "x " * i + " ".join(shared_phrase(i).split()[i : 45 + i // 2])) for i in range(15)] + [(400, shared_phrase(3)), (401, shared_phrase(4)), (401, shared_phrase(4))]
    assert sorted(map(tuple, remove_repeats(spark.createDataFrame(rows, SCHEMA), False).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("words", [1, 4, 1000])
def test_locate_against_plain_search(monkeypatch, words):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", words)
    r = random.Random(words)
    for _ in range(200):
        code = Codes()
        code([bytes([i]) for i in range(r.choice([0, 254]))])
        texts = [[r.choice([b"a", b"b", b"ab", b"c"]) for _ in range(r.randrange(30))] for _ in range(4)]
        passages = [[r.choice([b"a", b"b", b"ab", b"c"]) for _ in range(r.randrange(1, 6))] for _ in range(5)]
        got = locate([code(t) for t in texts], {code(p) for p in passages})
        for text, found in zip(texts, got, strict=True):
            want = {i + j for p in passages for i in range(len(text)) if text[i : i + len(p)] == p for j in range(len(p))}
            assert set(np.flatnonzero(found)) == want


def test_the_automata_decide(monkeypatch):
    """What goes is what the automata find of passages that come without any place, in all documents of the bucket; nothing without them."""
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(words), None, "x " + " ".join(words[3:45])]
    docs = pa.table({"doc_id": pa.array([1, 2, 3]), "key": pa.array([7, 8, 9]), "text": pa.array([t and zstandard.compress(t.encode()) for t in texts], pa.binary())})
    region = zstandard.compress(" ".join(["before", *words[5:48]]).encode())

    def removed(*cuts):
        found = pa.table({"region_text": pa.array([region] * bool(cuts), pa.binary()), "cuts": pa.array([[{"low": a, "high": b} for a, b in cuts]] * bool(cuts), pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])))})
        return _strip(False)(docs, found)["n_removed"].to_pylist()

    assert removed() == [0, 0, 0] and removed((1, 36)) == [35, 0, 35] and removed((1, 36), (6, 44)) == [43, 0, 35] and removed((0, 40)) == [0, 0, 0]

    class Blind:
        def __init__(self, *_): ...
        add_word = make_automaton = lambda *_: None
        iter = lambda *_: iter(())

    monkeypatch.setattr(substring_dedup.ahocorasick, "Automaton", Blind)
    assert removed((1, 36), (6, 44)) == [0, 0, 0]


def test_passages_have_no_places(spark, monkeypatch, sf_dir):
    """With many buckets, and so with passages whose text comes from another bucket's document, the result is the same; without automata nothing goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole = sorted(tuple(r) for r in remove_repeats(docs, False).collect())
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 2000)
    assert sorted(tuple(r) for r in remove_repeats(docs, False).collect()) == whole and sum(r[2] for r in whole) > 0
