import zlib

import numpy as np

from siftline.llm import quality

SYLLABLES = ["an", "er", "th", "on", "re", "st", "ing", "ea", "ou", "le"]


def good(rng):
    return ". ".join(" ".join("".join(rng.choice(SYLLABLES, int(rng.integers(1, 4)))) for _ in range(int(rng.integers(5, 12)))) for _ in range(int(rng.integers(2, 12))))


def bad(rng):
    words = good(rng).split()
    if rng.random() < 0.5:
        return " ".join(w.upper() + "!!" for w in words)
    return " ".join(words[:5] * 20)


def tables(spark, n=1500):
    rng = np.random.default_rng(6)
    rows, marks = [], []
    for i in range(n):
        q = int(rng.random() < 0.8)
        rows.append((i, good(rng) if q else bad(rng), "clash", 1.0))
        if i % 2 == 0:
            marks.append((i, q, 0))
    rows += [(None, None, None, None), (n, "", "x", 0.0), (n + 1, "w " * 200_000, "x", 0.0), (3, rows[3][1], "x", 0.0)]
    marks += [(None, 1, 0), (5, None, 0), (0, 0, 0), (0, 1, 0), (10**9, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, row double")
    return docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), dict((m[0], m[1]) for m in marks[:-5])


def test_held_out_accuracy(spark):
    docs, labels, truth = tables(spark)
    model = quality.train(docs, labels)
    got = quality.classify(docs, model).select("row.doc_id", quality.held_out("row.doc_id").alias("h"), "score").collect()
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 5 == 0) for r in got)
    judged = [(r.score >= quality.THRESHOLD, truth[r.doc_id]) for r in got if r.h and r.doc_id in truth]
    assert len(judged) > 100 and np.mean([a == b for a, b in judged]) > 0.95
    assert np.mean([a == b for a, b in judged if b == 0]) > 0.85
    again = quality.train(docs.repartition(7), labels)
    assert np.allclose(model.weights, again.weights)


def test_nothing_to_learn_from(spark):
    docs, labels, _ = tables(spark, 20)
    assert quality.train(docs, labels.filter("false")) is None
    assert quality.train(docs.filter("false"), labels) is None
    assert {r.score for r in quality.classify(docs, None).collect()} == {0.5}
    assert quality.classify(docs.filter("false"), None).collect() == []


def test_negative_risk_is_not_overfitted():
    rng = np.random.default_rng(8)
    k = quality.N_FEATURES
    positive, negative = rng.normal(1, 1, (300, k)), rng.normal(-1, 1, (300, k))
    unlabelled = np.concatenate([rng.normal(1, 1, (300, k)), negative])
    model = quality.fit(positive, unlabelled, 0.5)
    assert model.score(rng.normal(1, 1, (500, k))).mean() > 0.9
    assert model.score(rng.normal(-1, 1, (500, k))).mean() < 0.1


def test_prior_is_estimated_without_negatives():
    rng = np.random.default_rng(9)
    k = quality.N_FEATURES
    for share in (0.2, 0.5, 0.8):
        n = 3000
        u = np.where(rng.random((n, 1)) < share, rng.normal(0.7, 1, (n, k)), rng.normal(-0.7, 1, (n, k)))
        assert abs(quality.class_prior(rng.normal(0.7, 1, (n, k)), u) - share) < 0.07


def test_risk_is_near_the_least_there_is():
    """Against a plain minimiser of the written-out risk, with numeric gradients and many small steps."""
    rng = np.random.default_rng(10)
    k = quality.N_FEATURES
    p, n = rng.normal(0.3, 1, (80, k)), rng.normal(-0.3, 1, (80, k))
    u = np.concatenate([rng.normal(0.3, 1, (80, k)), n])
    model = quality.fit(p, u, 0.5, decay=0.3)
    dp, du = model.design(p), model.design(u)

    def loss(w):
        gp, gu = dp @ w, du @ w
        own = 0.5 * np.mean(np.log1p(np.exp(-gp)))
        return own + max(0.0, np.mean(np.log1p(np.exp(gu))) - 0.5 * np.mean(np.log1p(np.exp(gp)))) + 0.15 * w @ w

    w = np.zeros(dp.shape[1])
    eye = np.eye(len(w)) * 1e-5
    for _ in range(400):
        grad = np.array([(loss(w + e) - loss(w - e)) / 2e-5 for e in eye])
        w -= 0.2 * grad
    assert abs(loss(model.weights) - loss(w)) < 0.01 and loss(w) < 0.95 * loss(np.zeros(len(w)))
    own, rest = quality.risk(model.weights, dp, du, 0.5)
    assert abs(own + max(0.0, rest) + 0.15 * (model.weights @ model.weights) - loss(model.weights)) < 1e-9


def test_repeated_rows_of_a_sampled_document_count_once(spark):
    docs, labels, _ = tables(spark, 300)
    once = quality.train(docs, labels, 50, 60)
    many = quality.train(docs.unionByName(docs.filter("doc_id < 20")).unionByName(docs), labels, 50, 60)
    assert np.allclose(once.weights, many.weights)
