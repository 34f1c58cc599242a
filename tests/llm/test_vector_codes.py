import hashlib

import numpy as np
import pytest

from trackloom.llm import vector_codes
from trackloom.llm.vector_codes import Books, Piece, encode_vectors, scan

SCHEMA = "vec_id long, embedding array<float>, label int, code int"


def brute(ids, x, labels, parts=16, entries=64, rounds=2):
    """The rounds as they are stated, all parts against all entries."""
    values = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    split = values.reshape(len(x), parts, -1)
    books = split[np.argsort(ids, kind="stable")[:entries]].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        away = ((split[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        codes = away.argmin(axis=2)
        if turn == rounds:
            break
        for p in range(parts):
            for e in range(books.shape[1]):
                own = split[codes[:, p] == e, p]
                if len(own):
                    books[p, e] = own.sum(axis=0) // len(own)
    error = np.take_along_axis(away, codes[:, :, None], 2).sum(axis=(1, 2))
    of_label = {}
    for label, e in zip(labels, error.tolist(), strict=True):
        of_label[label] = of_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return {(i, "".join(f"{c:02x}" for c in code), e, of_label[label], digest) for i, code, e, label in zip(ids, codes.tolist(), error.tolist(), labels, strict=True)}


@pytest.mark.parametrize("rows", [50, 64])
def test_against_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(vector_codes, "ROWS", rows)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 32)).astype(np.float32) * 0.2
    # equal rows, and components on a coarse grid, so that distances tie
    x[500:700] = x[3]
    x[700:1000] = np.round(x[700:1000] * 16) / 16
    ids = rng.permutation(len(x)).tolist()
    labels = [None if i % 9 == 0 else i % 4 for i in ids]
    frame = spark.createDataFrame([(i, v, label, 7) for i, v, label in zip(ids, x.tolist(), labels, strict=True)], SCHEMA).repartition(5)
    assert {tuple(r) for r in encode_vectors(frame).collect()} == brute(ids, x, labels)
    assert {tuple(r) for r in encode_vectors(frame, parts=8, entries=20, rounds=4).collect()} == brute(ids, x, labels, 8, 20, 4)


def test_few_are_looked_at_again(monkeypatch):
    """After a small move of the entries, only parts near a border are compared, and the codes are those of a full scan."""
    rng = np.random.default_rng(2)
    values = rng.integers(-2000, 2000, (1000, 8))
    books = Books(rng.integers(-2000, 2000, (2, 16, 4)))
    piece, sums = Piece.first(values, books)
    moved = Books(books.entries + rng.integers(-3, 4, books.entries.shape), books.drift + 24)
    seen = []
    monkeypatch.setattr(vector_codes, "scan", lambda x, book: seen.append(len(x)) or scan(x, book))
    change = piece.again(moved)
    assert 0 < sum(seen) < 300
    for p in range(2):
        assert (piece.codes[:, p] == scan(piece.part(p), moved.entries[p])[0]).all()
    fresh, whole = Piece.first(values, moved)
    assert (sums + change == whole).all()
    # every heap is one, and they hold each row once
    for p in range(2):
        counts = np.bincount(piece.codes[:, p], minlength=16)
        begin = 0
        for e, n in enumerate(counts.tolist()):
            keys, rows = piece.keys[p, begin : begin + n], piece.order[p, begin : begin + n]
            assert set(rows.tolist()) == set(np.flatnonzero(piece.codes[:, p] == e).tolist())
            assert all(keys[(i - 1) // 2] <= keys[i] for i in range(1, n))
            begin += n


def test_large_numbers_are_exact():
    big = (1 << 24) - 1
    x = np.array([[big] * 4, [-big] * 4])
    near, _ = scan(x, np.array([[big, big, big, big - 1], [-big] * 4, [big] * 4]))
    assert near.tolist() == [2, 1]


def test_odd_rows(spark):
    good = [0.5, -0.25, 0.125, -1.0]
    rows = [(1, None, 1), (2, [None, 1.0, 1.0, 1.0], 1), (3, [float("nan")] * 4, 1), (4, [float("inf")] * 4, 1), (5, good, None), (6, good, None), (6, [0.0, 0.0, 0.0, 1.0], 2), (7, [1.0, 2.0], 2), (8, [1.0, 2.0, 3.0], 2), (9, [], 2), (10, [70000.0, 0.0, 0.0, 0.0], 2), (None, good, 3)]
    got = {(r.vec_id, r.code, r.error, r.label_error) for r in encode_vectors(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA), parts=2, entries=3).collect()}
    # of the three seeds the first and the last are equal, so that the last is unused
    nothing = {(i, None, None, 0) for i in (7, 8, 9, 10)}
    assert got == {(5, "0000", 0, 0), (6, "0000", 0, 0), (6, "0101", 0, 0), (None, "0000", 0, 0)} | nothing
    assert encode_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    only = encode_vectors(spark.createDataFrame([(None, good, 1, 0), (3, None, 1, 0)], SCHEMA), parts=2).collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in only] == [(None, None, None, None)]
    double = encode_vectors(spark.createDataFrame([(1, good, "x")], "vec_id long, embedding array<double>, label string"), parts=2).collect()
    assert [(r.vec_id, r.code, r.error) for r in double] == [(1, "0000", 0)]
