import math

import numpy as np

from millrace.llm import quality

LABELS = "doc_id bigint, quality int, toxic int"


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.train(docs, labels.filter("doc_id % 2 = 0"))
    assert (np.diff(model.thresholds) > 0).all()
    got = quality.grade(docs, model, keep_text=False).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    good = [r["keep"] for r in got if r["quality"] == 1 and r["toxic"] == 0]
    bad = [r["keep"] for r in got if r["quality"] == 0 or r["toxic"] == 1]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.15
    grade = lambda rows: np.mean([r["expected_grade"] for r in rows])
    assert grade([r for r in got if r["toxic"] == 1]) < grade([r for r in got if r["quality"] == 0 and r["toxic"] == 0]) < grade([r for r in got if r["quality"] == 1 and r["toxic"] == 0])


def plain_loss(weights, thresholds, rows, grades):
    """Mean negative log-likelihood of the cumulative-link model, row by row."""
    out = 0.0
    for found, g in zip(rows, grades, strict=True):
        score = sum(weights[j] for j in found)
        below = [0.0, *(1 / (1 + math.exp(score - t)) for t in thresholds), 1.0]
        out -= math.log(below[g + 1] - below[g])
    return out / len(rows)


def test_fit_is_the_optimum_of_the_plain_loss(monkeypatch):
    """By numerical slopes of the plain loss: none along thresholds, the penalty's along weights, less than that where a weight is 0."""
    monkeypatch.setattr(quality, "BUCKETS", 16)
    monkeypatch.setattr(quality, "STEPS", 8000)
    monkeypatch.setattr(quality, "PENALTY", 0.02)
    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(16) < 0.3) for _ in range(150)]
    true = rng.normal(0, 1.5, 16)
    grades = np.array([int(np.searchsorted([-1.0, 1.0], true[r].sum() + rng.logistic())) for r in rows])
    model = quality.fit([r.astype(np.int32) for r in rows], grades)
    w, t = model.weights.tolist(), model.thresholds.tolist()

    def slope(values, k):
        up, down = list(values), list(values)
        up[k] += 1e-5
        down[k] -= 1e-5
        loss = (lambda v: plain_loss(v, t, rows, grades)) if values is w else (lambda v: plain_loss(w, v, rows, grades))
        return (loss(up) - loss(down)) / 2e-5

    assert all(abs(slope(t, k)) < 2e-3 for k in range(2)) and len(set(grades.tolist())) == 3
    for k in range(16):
        want = -quality.PENALTY * np.sign(w[k])
        assert abs(slope(w, k) - want) < 2e-3 if w[k] else abs(slope(w, k)) <= quality.PENALTY + 2e-3, k
    p = model.probabilities(model.score(rows))
    assert math.isclose(-np.log(p[np.arange(150), grades]).mean(), plain_loss(w, t, rows, grades))


def test_a_text_has_the_features_of_its_half():
    line = "It is SO that the WORDS of a text are here AND there. "
    for n in (18, 36, 72, 400):
        assert np.array_equal(quality.features(line * n), quality.features(line * 2 * n))


def test_edges(spark, documents):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 1), (9999, 0, 1), (60, 1, 0)], LABELS)
    assert sorted(map(tuple, quality.rated(labels).collect())) == [(1, 1), (60, 2), (9999, 0)]
    model = quality.train(documents, labels)
    got = quality.grade(documents.withColumn("keep", documents["lang"]), model).collect()
    assert len(got) == documents.count() and all(0 <= r["tail_prob"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in got)
    again = quality.train(documents.repartition(3), labels)
    assert np.array_equal(model.weights, again.weights)


def test_no_ratings(spark, documents):
    model = quality.train(documents, spark.createDataFrame([], LABELS))
    assert all(r["keep"] and r["expected_grade"] > 1.99 for r in quality.grade(documents, model).collect())
    assert quality.grade(documents.limit(0), model).count() == 0


def test_upper_case_over_the_whole_text():
    for n in (100, 1900, 2000, 2500, 3900, 4000, 5900, 60_001):
        assert np.array_equal(quality.features("AB cd " * (n // 6)), quality.features("AB cd " * 40)) and quality.upper_count("Aé" * n + "É") == n + 1
    late = "ab cd " * 500 + "AB CD " * 500
    assert np.array_equal(quality.features(late), quality.features("ab cd AB CD " * 500)) and quality.upper_count(late) == 2000
    assert quality.upper_count("aA\ud800ÀßⅠǅ\U0001d400") == sum(map(str.isupper, "aA\ud800ÀßⅠǅ\U0001d400"))
