"""Toxicity: held-out accuracy, gapped insults, and the kernel against all subsequences."""

import random
from itertools import combinations

import numpy as np
import pytest

from lectern.llm import toxicity as X

INSULTS = ["blockhead", "numbskull", "dimwit", "scoundrel"]


def sentence(chance):
    return " ".join("".join(chance.choices(["ka", "ro", "mi", "te", "sol", "na", "be", "lu"], k=chance.randint(1, 4))) for _ in range(chance.randint(4, 14)))


def document(chance, toxic, disguise=lambda w: w):
    parts = [sentence(chance) for _ in range(chance.randint(2, 12))]
    if toxic:
        for _ in range(2):
            n = chance.randrange(len(parts))
            parts[n] += " " + disguise(chance.choice(INSULTS)) + " " + sentence(chance)
    return ". ".join(parts) + "."


@pytest.fixture(scope="module")
def data():
    chance = random.Random(1)
    return [(i, document(chance, i % 4 == 0), int(i % 4 == 0)) for i in range(400)]


@pytest.fixture(scope="module")
def model(data):
    return X.train([t for _, t, _ in data[:260]], [y for _, _, y in data[:260]])


def test_held_out_accuracy(data, model):
    scores = model.probabilities([t for _, t, _ in data[260:]])
    labels = np.array([y for _, _, y in data[260:]])
    assert ((scores >= 0.7) == (labels == 1)).mean() >= 0.98


@pytest.mark.parametrize("disguise", [".".join, " ".join, lambda w: w[:3] + "*" + w[3:], lambda w: w[:4] + "q" + w[4:], str.upper, lambda w: w + "s"])
def test_disguised_insults_score_higher_than_clean_words(model, disguise):
    chance = random.Random(2)
    worst = max(float(model.sentences([sentence(chance)])[0, 0]) for _ in range(200))
    hits = [float(model.sentences([disguise(w)])[0, 0]) > worst for w in INSULTS]
    assert sum(hits) >= 3


def test_kernel_is_that_of_all_subsequences():
    def brute(word):
        out = {}
        for i, j, k in combinations(range(len(word)), 3):
            if k - i < X.SPAN and all(word[n].isalpha() for n in (i, j, k)):
                out.setdefault(word[i] + word[j] + word[k], []).append(X.DECAY ** (k - i - 2))
        norm = sum(w * w for ws in out.values() for w in ws) ** 0.5
        return {u: sum(ws) / norm for u, ws in out.items()}

    words = ["stupid", "st.upid", "banana", "a-b-c", "letters", "stupidity"]
    table = np.zeros((X._CODES, len(words)))
    found = X.features(words)
    for n, (code, weight) in enumerate(found):
        np.add.at(table[:, n], code, weight)
    got = X.kernel(found, table)
    want = [[sum(v * brute(b).get(u, 0) for u, v in brute(a).items()) for b in words] for a in words]
    assert np.allclose(got, want)
    weights = np.random.default_rng(1).random(X._CODES).astype(np.float32) * X._LETTER_CODE
    one_by_one = [float(sum(weights[c] * w for c, w in zip(*f))) for f in found]
    assert np.allclose(X.Letters(["\n".join(words)]).scores(weights), one_by_one, atol=1e-4)


def test_rows_and_edges(spark, data, model):
    rows = [(i, t, "x") for i, t, _ in data[:40]] + [(None, "null id", ""), (900, None, ""), (901, "", ""), (902, " . ", ""), (903, "ka " * 50_000 + "blockhead", "")]
    rows += [(904, "a b c d e f", "")] * 3
    got = X.toxicity(spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3), model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[900] == by[901] and np.allclose([by[i] for i in range(40)], model.probabilities([t for _, t, _ in data[:40]]))
    assert X.toxicity(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_fit_uses_labels_only_and_bounds_its_sample(spark, data):
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(5000, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    scores = X.toxicity(docs, X.fit(docs, labels, most=60)).toPandas().set_index("doc_id").score
    assert np.mean([(scores[i] >= 0.7) == bool(y) for i, _, y in data]) >= 0.95
    for some in (labels.where("toxic = 0"), labels.where("toxic = 2")):
        assert X.toxicity(docs, X.fit(docs, some)).agg({"score": "max"}).first()[0] <= 0.5


def test_held_out_rows(spark):
    import zlib

    df = spark.range(50).withColumnRenamed("id", "doc_id")
    assert {r[0] for r in df.where(X.held_out()).collect()} == {i for i in range(50) if zlib.crc32(str(i).encode()) % 3 == 1}
