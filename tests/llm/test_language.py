import numpy as np
import pytest

from trackloom.llm import language
from trackloom.llm.language import mixtures, predict_languages, trigrams


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixture_and_odd_rows(spark):
    a, b = "the and with that this thing " * 30, "der und nicht ein mit über " * 30
    rows = [(i, a if i % 2 else b, "en" if i % 2 else "de") for i in range(40)]
    rows += [(100, None, "en"), (101, "", None), (102, "123 !?", "de"), (None, a, None), (103, a + b, None), (103, a + b, None), (104, (a + b + b) * 300, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    got = predict_languages(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (100, 101, 102, None)] == ["und", "und", "und", "en"] and by[101].score == 0
    assert set(by[103].languages) == {"en", "de"} and 0.4 < by[103].score < 0.6
    assert set(by[104].languages) == {"en", "de"} and 0.6 < by[104].score < 0.72
    assert predict_languages(docs.limit(0)).collect() == []
    assert {r.lang_pred for r in predict_languages(docs.where("lang is null")).collect()} == {"und"}


def test_mixtures_against_a_grid(spark):
    """Sets and shares of two languages as an exhaustive search over shares finds them."""
    r = np.random.default_rng(1)
    alphabets = ["abcdef", "defghi", "jklmno"]
    texts = [" ".join("".join(r.choice(list(alphabets[k]), 4)) for _ in range(400)) for k in range(3)]
    model = np.stack([np.bincount(trigrams(t)[0], minlength=language.BUCKETS) for t in texts], axis=1) + language.SMOOTH
    model = (model / model.sum(axis=0)).astype(np.float32)
    words = [t.split() for t in texts]
    mixed = [" ".join(list(r.choice(words[a], m)) + list(r.choice(words[b], n))) for a, b, m, n in [(0, 1, 50, 0), (0, 1, 50, 50), (0, 2, 20, 180), (2, 1, 3, 1), (1, 2, 300, 2), (0, 1, 90, 30)]]
    grid = np.linspace(0, 1, 401)
    for text, found in zip(mixed, mixtures(mixed, model), strict=True):
        p = model[trigrams(text)[0]].astype(np.float64)
        price = language.PENALTY * np.log(len(p))
        alone = np.log(p).sum(axis=0)
        best = {(int(alone.argmax()),): (2 * alone.max(), 1.0)}
        for a in range(3):
            for b in range(a + 1, 3):
                like = np.array([np.log(p[:, [a, b]] @ [s, 1 - s]).sum() for s in grid[12:-12]])
                best[a, b] = (2 * like.max() - price, grid[12:-12][like.argmax()])
        want = max(best, key=lambda k: best[k][0])
        assert set(want) == {x for x, _ in found}
        if len(want) == 2:
            assert abs(dict(found)[want[0]] - best[want][1]) < 0.01


def test_a_rare_language_is_learned(spark, sf_dir):
    """Ten documents among thousands are enough to be told from the rest."""
    r = np.random.default_rng(1)
    syllables = ["qua", "xil", "zho", "wum", "yrk"]
    rare = lambda: " ".join("".join(r.choice(syllables, 3)) for _ in range(40))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select("doc_id", "text", "lang").collect()
    rows = [(x.doc_id + 100_000 * n, x.text, x.lang) for n in range(10) for x in docs] + [(5_000_000 + i, rare(), "rare") for i in range(14)]
    got = {x.doc_id: x for x in predict_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[5_000_000 + i].lang_pred == "rare" for i in range(14)) and any(got[5_000_000 + i].held_out for i in range(14))
    assert sum(x.lang_pred == "rare" for i, x in got.items() if i < 5_000_000) == 0


def test_many_languages_share_the_model(spark, monkeypatch):
    """More languages than the model has room for at full size: buckets are folded, none is left out; too many are an error."""
    monkeypatch.setattr(language, "CELLS", 100 * 4096)
    monkeypatch.setattr(language, "HELD", 3)
    words = lambda k: " ".join("".join(w) for w in np.random.default_rng(k).choice(list("abcdefghijklmnopqrstuvwxyz"), (60, 4)))
    rows = [(k * 3 + n, words(k), f"l{k:02}") for k in range(90) for n in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, model = language.train(df)
    assert len(langs) == 90 and model.shape == (4096, 90)
    found = mixtures([words(k) for k in range(0, 90, 9)], model.astype(np.float32))
    assert [langs[m[0][0]] for m in found] == [f"l{k:02}" for k in range(0, 90, 9)]
    monkeypatch.setattr(language, "LEAST_BUCKETS", 4096 * 2)
    with pytest.raises(ValueError, match="different values"):
        language.train(df)
