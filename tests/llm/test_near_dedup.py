import re

import pytest

from trackloom.llm import near_dedup
from trackloom.llm.near_dedup import near_duplicates

SCHEMA = "doc_id long, text string"


def brute(rows, percent=85):
    def of(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [of(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        near = {}
        for x in s:
            for j in holders.setdefault(x, []):
                near[j] = near.get(j, 0) + 1
            holders[x].append(i)
        for j, both in near.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {(d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows)}


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert {tuple(r) for r in near_duplicates(docs).collect()} == brute(rows)


@pytest.mark.parametrize("block", [2, 3, 512])
def test_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(30):
        words = list(base)
        for j in range(i % 5):
            words[(7 * i + 31 * j) % 120] = f"x{i}.{j}"
        rows.append((i, " ".join(words)))
    found = near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert {tuple(r) for r in found.collect()} == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(300_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, "one two three"), (None, "one two"), (7, long), (8, long), (8, long)]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA + ", component_id int, node string")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()))
    assert got == [(0, 1, None, False), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 299996, 7, True), (8, 299996, 7, False), (8, 299996, 7, False)]


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rows_that_share_a_doc_id(spark):
    """Each row links by its own text, whatever other text has its doc_id."""
    base = [" ".join(f"{c}{i}" for i in range(100)) for c in "abc"]
    rows = [(1, base[0]), (1, base[1]), (2, base[0] + " x"), (3, base[1] + " y"), (3, base[2]), (4, base[2] + " z"), (5, "alone here with other words")]
    assert {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)
