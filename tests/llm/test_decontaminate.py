import itertools
import random

from trackloom.llm.decontaminate import LITERAL, NAME, NUMBER, UNIT, Template, find_leaks

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def test_template():
    t = Template(['Then Anna bought 12 kg, "apples" for 5km. Bob said: Émile | ran 1,000.50 times', None, "KG LOUD!! words%%%"])
    assert t.first.tolist() == [0, 14, 14, 17]
    # a capital after a stop or at the start of a line is no name, a unit needs a number before it
    kinds = {1: NAME, 3: NUMBER, 4: UNIT, 7: NUMBER, 12: NUMBER}
    assert t.kind.tolist() == [kinds.get(i, LITERAL) for i in range(17)]


def brute(docs, items):
    """Documents with half of an item's windows verbatim, by sets of token strings."""
    norm = lambda t: [w for w in (x.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").lower() for x in (t or "").split()) if w]
    out = set()
    for d, text in docs:
        words = norm(text)
        have = {tuple(words[i : i + 8]) for i in range(len(words) - 7)}
        for i, item in items:
            w = norm(item)
            covered = {j + k for j in range(len(w) - 7) if tuple(w[j : j + 8]) in have for k in range(8)}
            if w and len(covered) >= len(w) / 2:
                out.add((d, i))
    return out


def test_against_brute_force(spark, sf_dir):
    docs, items = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in find_leaks(docs, items).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_parameters(spark):
    item = "A train with 120 seats leaves the old station at 9 and meets Anna who has 120 seats reserved for the whole long journey"
    other = item.replace("120", "75").replace("9", "11").replace("Anna", "Boris")
    broken = "A train with 1 seats leaves the old station at 9 and meets Anna who has 2 seats reserved for the whole long journey"
    r = random.Random(1)
    clean = " ".join(r.choice(item.split()) for _ in range(400))
    docs = [(1, f"intro words. {item} and more"), (2, f"intro words. {other} and more"), (3, broken), (4, clean), (5, None), (6, ""), (None, other), (7, "pad " * 200_000 + other), (2, f"intro words. {other} and more")]
    docs = spark.createDataFrame([(*d, 1) for d in docs], DOCS + ", item_id int")
    items = spark.createDataFrame([(10, item), (11, None), (12, "")], ITEMS)
    got = find_leaks(docs, items).collect()
    assert sorted(((r.doc_id or 0, r.item_id, r.n_changed) for r in got)) == [(0, 10, 3), (1, 10, 0), (2, 10, 3), (2, 10, 3), (7, 10, 3)]
    assert find_leaks(docs.limit(0), items).collect() == [] and find_leaks(docs, items.limit(0)).collect() == []


def test_short_and_numeric_items(spark):
    items = [(1, "What is the capital of France?"), (2, "12 * 7 + 3 = 87"), (3, "Anna Boris Carla Dora Emil Frida Georg Hans Ida 4 5 6"), (4, "Who wrote it?"), (5, "What is the capital city of that country"), (6, "!? --")]
    pad = "some other words that stand before"
    docs = [
        (1, f"{pad} the question. What is the capital of France? And more after it."),
        (2, f"{pad} the question: what is the capital of Spain? And more after it."),
        (3, f"{pad} 12 * 7 + 3 = 87 and more"),
        (4, f"{pad} 12 * 7 + 4 = 88 and more"),
        (5, f"{pad} Anna Boris Carla Dora Emil Frida Georg Hans Ida 4 5 6 and more"),
        (6, f"{pad} Anna Boris Carla Dora Emma Frida Georg Hans Ivo 4 5 7 and more"),
        (7, f"{pad} who wrote it, and more"),
        (8, "Who wrote it?"),
        (9, "who wrote"),
        (10, f"{pad} what is the capital city of that country"),
        (12, f"{pad} What is the capital of France? A capital letter within a sentence."),
        (11, "Is the capital of France big?"),
    ]
    got = find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (2, 1), (3, 2), (5, 3), (7, 4), (8, 4), (10, 5), (12, 1)]
    assert all(r.coverage == 1 and r.consistency == 1 for r in got)


def test_names_that_begin_sentences(spark):
    item = "Alice has 12 red apples in a basket. Alice gives Bob 5 of them. How many apples does Alice have left in the basket now?"
    docs = [
        (1, "Before it. " + item.replace("Alice", "Maria").replace("Bob", "Tom").replace("12", "31") + " After it."),
        (2, "Before it. So " + item),
        (3, item.replace("Alice has", "Maria has").replace("Alice gives", "Peter gives").replace("Alice have", "Laura have")),
        (5, "x " + item.replace("Alice gives", "Zelda gives")),
        (4, "Alice has a garden. Alice likes apples, and how many apples does she have? Nobody can say now."),
    ]
    got = find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, item)], ITEMS)).collect()
    assert sorted((r.doc_id, r.n_changed) for r in got) == [(1, 3), (2, 0), (3, 1), (5, 0)]  # of 3, more than half is the same word for word


def test_templates_against_brute_force(spark):
    """Re-parameterised items with numbers, names and units replaced, by windows of token strings compared one by one."""
    r = random.Random(3)
    words = [f"word{chr(97 + i)}" for i in range(12)]
    names = ["Anna", "Boris", "Carla", "Dmitri"]

    def make(slots):
        return [slots[int(w[1:])] if w[0] == "#" else w for w in shape]

    def kinds(tokens):
        out = []
        for i, w in enumerate(tokens):
            number = w.isdigit()
            out.append("<n>" if number else "<u>" if w in ("kg", "km") and i and tokens[i - 1].isdigit() else "<a>" if w.istitle() else w)
        return out

    items, docs, want = [], [], set()
    for item in range(12):
        shape = ["it", "is"] + [r.choice(words) if r.random() < 0.7 else f"#{r.randrange(6)}" for _ in range(22)]
        base = [str(r.randrange(100)) for _ in range(3)] + r.sample(names, 2) + ["km"]
        items.append((item, " ".join(make(base))))
        for variant in range(4):
            slots = [str(r.randrange(100, 999)) for _ in range(3)] + r.sample(names, 2) + ["kg"]
            text = make(slots)
            if variant == 1:  # each place its own value: not consistent
                text = [str(1000 + i) if w.isdigit() else w for i, w in enumerate(text)]
            if variant == 2:  # the first part only
                text = text[: r.randrange(8, 24)]
            docs.append((len(docs), "so " + " ".join(["other"] * 9 + text + ["other"] * 9)))
    for d, text in docs:
        t = text.split()
        k = kinds(t)
        for i, item in items:
            x = item.split()
            y = kinds(x)
            best = False
            for shift in range(-len(x), len(t)):
                covered, seen = set(), {}
                for j in range(len(y) - 7):
                    a = j + shift
                    if 0 <= a and k[a : a + 8] == y[j : j + 8] and sum(w[0] != "<" for w in y[j : j + 8]) >= 4:
                        covered |= set(range(j, j + 8))
                        for o in range(8):
                            if y[j + o][0] == "<":
                                seen[j + o] = (x[j + o].lower(), t[a + o].lower())
                run = max((sum(1 for _ in g) for c, g in itertools.groupby(range(len(x)), lambda n: n in covered) if c), default=0)
                bound = {}
                for v, w in seen.values():
                    bound.setdefault(v, []).append(w)
                consistent = not seen or sum(max(b.count(w) for w in b) for b in bound.values()) / len(seen) >= 0.8
                best |= (len(covered) >= len(x) / 2 or run >= 20) and consistent and bool(covered)
            if best:
                want.add((d, i))
    got = {(q.doc_id, q.item_id) for q in find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert want and got == want
