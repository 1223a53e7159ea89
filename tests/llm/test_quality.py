import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlake.llm import queries, quality


def test_fit_orders_grades():
    rng = random.Random(1)
    rows, grades = [], []
    for _ in range(900):
        g = rng.randrange(3)
        words = [f"common{rng.randrange(30)}" for _ in range(20)] + [f"grade{g}x{rng.randrange(6)}"] * (rng.random() < 0.9) + [f"rare{rng.randrange(10**6)}"]
        rows.append(" ".join(words))
        grades.append(g)
    model = quality.fit([quality.features(t) for t in rows[:600]], grades[:600])
    assert list(model.thresholds) == sorted(model.thresholds)
    expected, tail = quality._judge(model, rows[600:], 2)
    y = np.array(grades[600:])
    assert expected[y == 0].mean() < expected[y == 1].mean() < expected[y == 2].mean()
    assert ((tail >= 0.5) == (y == 2)).mean() > 0.85
    p = model.probabilities(np.array([-100.0, 0.0, 100.0]))
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all() and np.allclose(p @ [0, 1, 2], [0, p[1] @ [0, 1, 2], 2], atol=1e-6)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    grades = queries.table(spark, folder, "labels").select("doc_id", F.expr("CASE WHEN quality = 0 THEN 0 WHEN toxic = 1 THEN 1 ELSE 2 END").alias("grade"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    documents = queries.table(spark, folder, "documents")
    model = quality.train(documents, "doc_id", "text", grades.where(part > 0), "grade")
    scored = quality.score_documents(documents, "doc_id", "text", model, 2).join(grades.where(part == 0), "doc_id").collect()
    share = lambda g: np.mean([r.kept for r in scored if r.grade == g])
    assert len(scored) > 800 and share(2) > 0.97 and share(0) < 0.05 and share(1) < 0.5


def test_rows(spark):
    good, bad = "a fine day for a walk", "BUY!! NOW!! CHEAP!! PILLS!!"
    rows = [(i, good if i % 2 else bad) for i in range(40)] + [(100, None), (101, ""), (None, good), (1, good), (102, "word " * 60000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 1), (999, 0), (None, 0), (3, None)], "doc_id long, grade int")
    model = quality.train(df, "doc_id", "text", labels, "grade")
    got = quality.score_documents(df, "doc_id", "text", model, 1).collect()
    assert len(got) == len(rows) and all(r.kept == (r.doc_id % 2 == 1) for r in got if r.doc_id is not None and r.doc_id < 40)
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 1 for r in got)
    kept = quality.keep_good(df, "text", model, 1)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 40} == set(range(1, 40, 2))
    for some in (labels.limit(0), labels.where("grade = 1")):
        only = quality.train(df, "doc_id", "text", some, "grade")
        assert quality.score_documents(df, "doc_id", "text", only, 1).where("kept").count() == len(rows)
    assert quality.score_documents(df.limit(0), "doc_id", "text", model, 1).count() == 0
    assert quality.keep_good(df.limit(0), "text", model, 1).count() == 0


def test_repeated_and_missing_documents(spark):
    """A document that is repeated, and labels without a document, leave the bound to the other documents."""
    good, bad = "a fine day for a walk", "BUY!! NOW!! CHEAP!! PILLS!!"
    rows = [(i, good if i % 2 else bad) for i in range(20)]
    grades = [(i, i % 2) for i in range(20)]
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    labels = lambda r: spark.createDataFrame(r, "doc_id long, grade int")
    want = quality.train(frame(rows), "doc_id", "text", labels(grades), "grade", 20)
    assert want.grades == [0, 1] and want.weights
    for docs, some in (([(0, bad)] * 400 + rows, grades), (rows, grades + [(i, 0) for i in range(1000, 3000)])):
        got = quality.train(frame(docs), "doc_id", "text", labels(some), "grade", 20)
        assert got.grades == want.grades and got.weights == want.weights and list(got.thresholds) == list(want.thresholds)


def test_fit_meets_the_optimality_conditions():
    """Independent of the solver: slopes of the penalized likelihood by differences are 0 at thresholds and weights, and within the penalty where a weight is 0."""
    rng = np.random.default_rng(6)
    n, d, l1 = 400, 20, 0.01
    x = rng.random((n, d)) < 0.3
    true = np.where(np.arange(d) < 6, rng.normal(size=d) * 2, 0)
    y = np.searchsorted([-0.5, 1.0], x @ true + rng.logistic(size=n))
    model = quality.fit([np.flatnonzero(r) for r in x], y.tolist(), steps=6000, l1=l1)
    w = np.array([model.weights.get(j, 0.0) for j in range(d)])

    def loss(w, theta):
        below = np.hstack([np.zeros((n, 1)), 1 / (1 + np.exp(-(theta[None, :] - (x @ w)[:, None]))), np.ones((n, 1))])
        return -np.log(below[np.arange(n), y + 1] - below[np.arange(n), y]).mean()

    theta, e = model.thresholds, 1e-5
    assert list(theta) == sorted(theta) and model.grades == [0, 1, 2]
    for j in range(len(theta)):
        step = np.eye(len(theta))[j] * e
        assert abs(loss(w, theta + step) - loss(w, theta - step)) / (2 * e) < 1e-3
    slopes = np.array([(loss(w + np.eye(d)[j] * e, theta) - loss(w - np.eye(d)[j] * e, theta)) / (2 * e) for j in range(d)])
    assert np.all(np.abs(slopes[w != 0] + l1 * np.sign(w[w != 0])) < 1e-3) and np.all(np.abs(slopes[w == 0]) <= l1 + 1e-3)
    assert 0 < np.count_nonzero(w) < d


def test_query_against_plain_scores(spark, sf_dir):
    """Every document's expected grade and tail probability from its features and the model's weights, one by one."""
    docs = queries.table(spark, sf_dir, "documents")
    model = queries.quality_model(docs, queries.table(spark, sf_dir, "labels"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = queries.op5_quality(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        score = math.fsum(model.weights.get(int(f), 0.0) for f in quality.features(texts[r.doc_id]))
        above = [1.0] + [1 / (1 + math.exp(t - score)) for t in model.thresholds] + [0.0]
        p = [a - b for a, b in zip(above, above[1:])]
        assert r.expected_grade == pytest.approx(sum(g * x for g, x in zip(model.grades, p)), abs=1e-9)
        tail = sum(x for g, x in zip(model.grades, p) if g >= queries.GOOD_GRADE)
        assert r.tail_probability == pytest.approx(tail, abs=1e-9) and r.kept == (r.tail_probability >= queries.GOOD_PROBABILITY)
