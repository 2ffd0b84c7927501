"""Models: held-out accuracy, the reference definition of the distance, and odd rows."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import language, quality

SYLLABLES = {"aa": "ka li mo ran tu ve", "bb": "schu ter nik olg ba ert", "cc": "ción la esa ro qui ñar"}


def _sentence(name, draw, words):
    parts = SYLLABLES[name].split()
    return " ".join("".join(draw.choice(parts) for _ in range(draw.randrange(1, 4))) for _ in range(words)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(3)
    rows = [(i, _sentence(name, draw, draw.randrange(3, 60)), name) for i, name in enumerate(["aa", "bb", "cc"] * 100)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows


def _top_by_definition(text, size):
    counts = Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        padded = f" {word} "
        for n in (1, 2, 3):
            counts.update(padded[i : i + n] for i in range(len(padded) - n + 1) if padded[i : i + n] != " ")
    code = lambda gram: sum(ord(c) << 21 * (len(gram) - 1 - i) for i, c in enumerate(gram))
    return [code(gram) for gram, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))][:size]


@pytest.mark.parametrize("text", ["The cat sat on the Mat.", "a", "Éa--é \U0001d49c1b", "  x  ", "ab " * 500])
def test_ranked_grams_by_definition(text):
    assert language.top_grams(text, language._letters(), 30).tolist() == _top_by_definition(text, 30)


def test_the_nearest_profile_by_definition(corpus):
    frame, rows = corpus
    profiles = language.learn(frame, size=50, sample=10**6)
    letters = language._letters()
    by_lang = {name: Counter() for name in SYLLABLES}
    for _, text, name in rows:
        for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            padded = f" {word} "
            for n in (1, 2, 3):
                by_lang[name].update(padded[i : i + n] for i in range(len(padded) - n + 1) if padded[i : i + n] != " ")
    code = lambda gram: sum(ord(c) << 21 * (len(gram) - 1 - i) for i, c in enumerate(gram))
    ranked = {
        name: [code(g) for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:50]]
        for name, counts in by_lang.items()
    }
    for _, text, _ in rows[:40]:
        top = _top_by_definition(text, 50)
        far = {n: sum(abs(r.index(g) - i) if g in r else 50 for i, g in enumerate(top)) for n, r in ranked.items()}
        name, score = profiles.predict(text, letters)
        assert (far[name], name) == min((d, n) for n, d in far.items())
        assert score == pytest.approx(1 - far[name] / (50 * len(top)))


def test_held_out_accuracy_and_odd_texts(spark, corpus):
    frame, _ = corpus
    profiles = language.learn(frame.filter("doc_id % 4 <> 2"))
    found = frame.filter("doc_id % 4 = 2").withColumn("found", language.identify(F.col("text"), profiles))
    assert found.filter("found.lang = lang").count() >= 0.95 * found.count()
    odd = spark.createDataFrame([(None,), ("",), ("123 !? \U0001f600",), ("x" * 300_000,)], "text string")
    rows = odd.select("text", language.identify(F.col("text"), profiles).alias("found")).collect()
    assert all(r["found"]["lang"] == "und" and r["found"]["score"] == 0 for r in rows if not r["text"] or r["text"][0] == "1")
    assert all(0 <= r["found"]["score"] <= 1 for r in rows)


def test_no_training_rows(spark):
    none = spark.createDataFrame([(1, None, "en"), (2, "text", None)], "doc_id long, text string, lang string")
    assert language.learn(none).predict("text", language._letters()) == ("und", 0.0)
    assert language.learn(none.limit(0)).languages == []


@pytest.mark.parametrize("points", [1, 7, 50])
def test_long_texts_are_counted_in_pieces(monkeypatch, points):
    letter = language._letters()
    text = "Ein langer Text, mit W\u00f6rtern; und\u00a0\u4e1c\u4eac!! \u039f\u0394\u039f\u03a3 \u039f\u0394\u039f\u03a3x " * 9 + "z" * 200
    whole = language.gram_counts([text, "kurz", "", "12"], letter)
    monkeypatch.setattr(language, "_POINTS", points)
    pieces = language.gram_counts([text, "kurz", "", "12"], letter)
    assert [part.tolist() for part in pieces] == [part.tolist() for part in whole]


def test_languages_beyond_the_bound_are_told(spark, caplog):
    rows = [(i, "some text", name) for i, name in enumerate(["a"] * 3 + ["b"] * 2 + ["d", "c"])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language.learn(frame, languages=3)
    assert (profiles.languages, profiles.left_out) == (["a", "b", "c"], 1)
    assert "1 languages" in caplog.text
    assert language.learn(frame).left_out == 0


def _graded(seed, count=400):
    draw = random.Random(seed)
    rows = []
    for i in range(count):
        good = draw.random() < 0.7
        words = [f"w{draw.randrange(300)}" for _ in range(draw.randrange(5, 60))]
        rows.append((i, " ".join(words) + "." if good else " | ".join(words) + "!!", int(good)))
    return rows


def test_quality_on_held_out_documents(spark):
    rows = _graded(1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 3], "doc_id long, label int")
    model = quality.learn(docs, labels)
    scored = docs.select("doc_id", quality.score(F.col("text"), model).alias("score")).collect()
    right = [(row["score"] >= 0.5) == bool(rows[row["doc_id"]][2]) for row in scored if row["doc_id"] % 3 == 0]
    assert sum(right) >= 0.97 * len(right)


def test_the_drivers_share_is_bounded(spark, monkeypatch):
    """Documents with very many features do not take the place of others, and none reaches the driver beyond the bound."""
    assert quality.within([(1, 5), (2, 9), (3, 4), (4, 1), (5, 1)], 10) == [1, 3, 4]
    rows = _graded(2)
    rows = [(i, text + " ".join(f" u{i}x{j}" for j in range(3000 if i % 20 == 0 else 0)), label) for i, text, label in rows]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    fitted = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda rows, positive: fitted.append(rows) or fit(rows, positive))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, label int")
    quality.learn(docs, labels, most_features=20_000)
    assert sum(map(len, fitted[0])) <= 20_000 and len(fitted[0]) > 100
    quality.learn(docs, labels, sample=50)
    assert len(fitted[1]) == 50


def test_dual_coordinate_descent_reaches_the_optimum():
    """At the optimum of the squared hinge loss the gradient of the primal is zero."""
    draw = np.random.default_rng(4)
    rows = [np.unique(draw.integers(0, 40, 8)) for _ in range(80)]
    signs = np.where(draw.random(80) < 0.5, 1.0, -1.0)
    scaled = [draw.standard_normal(len(r)) for r in rows]
    weights = quality.fit_svm(rows, scaled, signs, cost=0.5, epochs=2000)
    gradient = weights.copy()
    for row, value, sign in zip(rows, scaled, signs, strict=True):
        slack = max(0.0, 1 - sign * (float(weights[row] @ value) + weights[-1]))
        gradient[row] -= 2 * 0.5 * slack * sign * value
        gradient[-1] -= 2 * 0.5 * slack * sign
    assert np.abs(gradient).max() < 1e-2


def test_log_count_ratios_by_definition():
    rows = [np.array([1, 2]), np.array([2, 3]), np.array([3])]
    ratios = quality.log_count_ratios(rows, np.array([True, True, False]))
    n = quality.DIMENSIONS
    assert ratios[2] == pytest.approx(np.log((3 / (4 + n)) / (1 / (1 + n))))
    assert ratios[3] == pytest.approx(np.log((2 / (4 + n)) / (2 / (1 + n))))


@pytest.mark.parametrize("labelled", [[], [(1, 1)], [(1, 1), (1, 0)], [(None, 1), (1, None)]])
def test_quality_with_few_or_contradicting_labels(spark, labelled):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (None, ""), (3, "x " * 100_000)], "doc_id long, text string")
    model = quality.learn(docs, spark.createDataFrame(labelled, "doc_id long, label int"))
    scores = [r[0] for r in docs.select(quality.score(F.col("text"), model)).collect()]
    usable = labelled == [(1, 1)]
    assert scores == pytest.approx([2 / 3 if usable else 0.5] * 5)
