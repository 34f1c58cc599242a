import random
import re

from trackloom.llm.common import Words
from trackloom.llm.licenses import LEAST_COVERAGE, SLACK, TEMPLATES, align, full_texts, longest_increasing, normal, scan_licenses

LINES = {"CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.", "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.", "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.", "MIT-line": "Released under the MIT License."}


def test_longest_increasing():
    r = random.Random(4)
    for _ in range(200):
        ys = r.sample(range(12), r.randrange(9))
        best = [1] * len(ys)
        for i, y in enumerate(ys):
            best[i] = max([1, *(best[j] + 1 for j in range(i) if ys[j] < y)])
        got = longest_increasing(list(enumerate(ys)))
        assert len(got) == max(best, default=0) and got == sorted(got) and [y for _, y in got] == sorted(y for _, y in got)


def test_align():
    assert align(list("abcdef"), list("abxdef")) == [(0, 0), (1, 1), (3, 3), (4, 4), (5, 5)]
    assert align([], list("ab")) == [] and align(list("aab"), list("aab")) == [(0, 0), (1, 1), (2, 2)]


def test_lines(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {(r.doc_id, r.license) for r in scan_licenses(docs).collect()}
    want = {(r.doc_id, name) for r in docs.collect() for name, line in LINES.items() if line in r.text}
    assert want and want <= got
    # no other template stands in these texts, but for a line inside a longer notice
    assert all(re.search("licen[sc]ed?", r.text, re.I) for r in docs.join(spark.createDataFrame(list(got), "doc_id long, license string"), "doc_id").collect())


def test_edited_templates_and_odd_rows(spark):
    r = random.Random(7)
    rows, want = [], set()
    names = ["MIT", "BSD-3-Clause", "Zlib", "GPL-3.0-header", "ISC"]
    for i, name in enumerate(names):
        words = TEMPLATES[name].split()
        for _ in range(len(words) // 20):
            words[r.randrange(len(words))] = "edited"
        noise = [" ".join(r.choice(["alpha", "the", "of", "software", "and"]) for _ in range(300)) for _ in range(2)]
        rows.append((i, f"{noise[0]}\n// {' '.join(words)}\n{noise[1]}"))
        want.add((i, name))
    rows += [(10, None), (11, ""), (None, TEMPLATES["MIT"]), (12, "pad " * 200_000 + TEMPLATES["MIT"] + " gap " * 50 + TEMPLATES["MIT"]), (13, "the software is provided")]
    docs = spark.createDataFrame([(*x, "MIT") for x in rows], "doc_id long, text string, license string")
    got = scan_licenses(docs).collect()
    full = [(x.doc_id, x.license) for x in got if x.license in TEMPLATES]
    assert want <= set(full) and full.count((12, "MIT")) == 2 and (None, "MIT") in full
    assert not {d for d, _ in full} & {10, 11, 13}
    assert scan_licenses(docs.limit(0)).collect() == []


def test_align_by_its_definition():
    """Pairs are equal and increase in both; no gap between pairs holds an item that occurs once on either side of it."""
    r = random.Random(9)
    for _ in range(400):
        a, b = ([r.randrange(r.choice([3, 8, 40])) for _ in range(r.randrange(25))] for _ in range(2))
        pairs = align(a, b)
        assert all(a[x] == b[y] for x, y in pairs)
        for (x, y), (p, q) in zip([(-1, -1), *pairs], [*pairs, (len(a), len(b))], strict=True):
            assert x < p and y < q
            one, two = a[x + 1 : p], b[y + 1 : q]
            assert not [i for i in one if one.count(i) == 1 and two.count(i) == 1]


def test_places_against_every_start(spark):
    """The same documents and templates as aligning each template with every stretch of a text."""
    r = random.Random(11)
    templates = {n: " ".join(TEMPLATES[n].split()[:40]) for n in ("MIT", "ISC", "Zlib", "MPL-2.0-header", "CC0-1.0-notice")}
    rows = []
    for i in range(40):
        name = r.choice(list(templates))
        words = templates[name].split()
        for _ in range(r.randrange(14)):
            words[r.randrange(len(words))] = r.choice(["changed", "the", "of", "software"])
        noise = [[r.choice(["alpha", "the", "of", "software", "and", "any"]) for _ in range(r.randrange(30))] for _ in range(2)]
        rows.append((i, " ".join(noise[0] + words[: r.choice([25, 34, 40])] + noise[1])))
    hashes = lambda t: Words([normal(t)]).hash.tolist()
    want = set()
    for i, text in rows:
        words = hashes(text)
        for name, template in templates.items():
            own = hashes(template)
            if any(len(align(words[low : low + int(len(own) * SLACK)], own)) >= LEAST_COVERAGE * len(own) for low in range(len(words))):
                want.add((i, name))
    got = {(x.doc_id, x.license) for x in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()}
    assert want and got <= want and len(want - got) <= 0.05 * len(want)


def test_whole_texts_from_a_folder(spark, tmp_path):
    r = random.Random(12)
    words = [r.choice("aa bb cc dd ee ff gg hh".split()) + str(r.randrange(300)) for _ in range(4000)]
    (tmp_path / "LONG").write_text(" ".join(words))
    for _ in range(300):
        words[r.randrange(len(words))] = "edited"
    docs = spark.createDataFrame([(1, "x " * 500 + " ".join(words) + " y" * 500), (2, "aa1 bb2")], "doc_id long, text string")
    (got,) = scan_licenses(docs, full_texts(spark, str(tmp_path))).collect()
    assert (got.doc_id, got.license) == (1, "LONG") and got.coverage > 0.9
