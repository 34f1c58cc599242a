import numpy as np

from trackloom.llm import quality
from trackloom.llm.quality import Ftrl, accept, features, logistic, quality_scores


def test_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_scores(docs, labels)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").where("held_out").toPandas()
    good, bad = rows[rows.quality == 1].score, rows[rows.quality == 0].score
    assert np.mean([(good > b).mean() for b in bad]) > 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "a b", 1), (3, "good words here", 1), (3, "good words here", 1), (4, "bad " * 200_000, 1)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(1, 1), (3, 1), (3, 1), (4, 0), (None, 1), (2, None), (9, 1), (4, 7)], "doc_id long, quality int")
    got = quality_scores(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert quality_scores(docs.limit(0), labels).collect() == []
    assert {r.score for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_same_model_at_any_number_of_partitions(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    few = np.array([r.score for r in quality_scores(docs, labels).orderBy("doc_id").collect()])
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        many = np.array([r.score for r in quality_scores(docs.repartition(13), labels.repartition(5)).orderBy("doc_id").collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert np.abs(few - many).max() < 1e-9


def test_updates_against_the_closed_form():
    """Each weight minimises the regularised sum of linearised losses, as a plain search finds it."""
    r = np.random.default_rng(1)
    learner, seen = Ftrl(), []
    for _ in range(30):
        at = np.unique(r.integers(0, 5, 3))
        count, label = r.integers(1, 4, len(at)), int(r.integers(2))
        value, w = count / np.sqrt(count.sum()), learner.weights(at)
        g = (logistic(w @ value) - label) * value
        for i, gi, wi in zip(at, g, w, strict=True):
            before = sum(x[1] ** 2 for x in seen if x[0] == i)
            seen.append((i, gi, wi, (np.sqrt(before + gi * gi) - np.sqrt(before)) / quality.ALPHA))
        learner.learn(at, count, label)
    for i in range(5):
        own = [(g, w, s) for j, g, w, s in seen if j == i]
        grid = np.linspace(-3, 3, 60001)
        # the first learning rate also has the constant BETA, which pulls towards 0
        cost = sum(g * grid + s / 2 * (grid - w) ** 2 for g, w, s in own) + (quality.BETA / quality.ALPHA + quality.L2) / 2 * grid**2 + quality.L1 * np.abs(grid)
        assert abs(grid[cost.argmin()] - learner.weights(np.array([i]))[0]) < 2e-4


def test_scores_against_a_plain_dot_product(spark):
    weights = np.random.default_rng(2).standard_normal(quality.BUCKETS)
    texts = ["one two three", None, "", "a b a b " * 50, "Ünï code\x0bx"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.quality_score for r in quality.score(docs, weights, "doc_id").collect()}
    for i, text in enumerate(texts):
        every, _ = features([text])
        assert abs(got[i] - logistic(sum(weights[x] for x in every) / len(every) ** 0.5)) < 1e-9


def test_packing():
    r = np.random.default_rng(4)
    for n in (1, 2, 700):
        at, count = np.sort(r.choice(quality.BUCKETS, n, replace=False)), r.integers(1, 1 << 20, n)
        got = quality.unpack(quality.pack(at, count))
        assert (got[0] == at).all() and (got[1] == count).all()


def test_accept_with_a_column_like_the_score(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "text", "doc_id * 2 AS quality_score", "1 AS _0")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = accept(docs, labels)
    assert got.columns == docs.columns and all(r.quality_score == 2 * r.doc_id for r in got.collect()) and 0 < got.count() < docs.count()
