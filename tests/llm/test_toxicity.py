import random
import zlib

import numpy as np
import pytest

from tidebook.llm import toxicity as tox

INSULTS = ["blockhead", "dunce", "nitwit", "vermin"]


def corpus(n=1200, seed=1):
    rnd = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice("bcdfgklm") + rnd.choice("aeiou") + rnd.choice("nrst") + str(rnd.randrange(40)) for _ in range(rnd.randint(5, 80))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(rnd.randint(1, 3)):
                words.insert(rnd.randint(0, len(words)), rnd.choice(INSULTS).upper() + rnd.choice(["", "!", ","]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark, make_docs):
    rows, labels = corpus()
    frame = spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    return rows, labels, frame, tox.fit(make_docs(rows), frame)


def test_held_out_accuracy(fitted, make_docs, spark):
    rows, labels, frame, model = fitted
    found = {r.doc_id: r for r in tox.scored(make_docs(rows), model).collect()}
    truth = {i: t for i, _, t in labels}
    out = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in found if found[i].held_out} == set(out)
    assert np.mean([found[i].predicted == truth[i] for i in out]) > 0.97
    assert all((found[i].score >= 0.5) == (found[i].predicted == 1) for i in truth)
    assert len(model.keys) < 2000


def test_unseen_long_clean_and_toxic_texts(fitted, make_docs):
    *_, model = fitted
    clean = " ".join(f"bar{i % 997}x" for i in range(40_000))
    assert model.score(clean) < 0.5 < model.score("hello you blockhead and nitwit")
    assert model.score(clean + " dunce vermin") > model.score(clean)


def test_scores_do_not_depend_on_labels_of_held_out_documents(fitted, make_docs, spark):
    rows, labels, _, model = fitted
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    other = tox.fit(make_docs(rows), spark.createDataFrame(flipped, "doc_id long, quality int, toxic int"))
    assert other.bias == model.bias and (other.weights == model.weights).all()


def test_edges(fitted, make_docs, spark):
    *_, frame, model = fitted
    rows = [(1, None), (2, ""), (2, ""), (3, "!!! ..."), (None, "dunce"), (4, "one"), (5, "dunce " * 50_000)]
    found = tox.scored(make_docs(rows), model).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    scores = {r.score for r in found if r.doc_id in (1, 2, 3)}
    assert len(scores) == 1 and scores.pop() < 0.5
    assert tox.scored(make_docs([]), model).count() == 0
    for few in ([], [(1, 1, 1)], [(1, 1, 0), (4, 0, 0)]):
        labels = spark.createDataFrame(few, "doc_id long, quality int, toxic int")
        assert tox.toxicity(make_docs(rows), labels).count() == len(rows)
        assert tox.toxicity(make_docs([]), labels).count() == 0


def test_ftrl_is_sparse_and_matches_a_plain_loop():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 60, 8)).astype(np.uint64) for _ in range(80)]
    labels = np.array([int(7 in r) for r in rows])
    keys, w, bias = tox.ftrl(rows, labels, epochs=2)
    z, n = {}, {}

    def weight(i):
        bound = 0 if i == "bias" else tox.L1
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        if abs(zi) <= bound:
            return 0.0
        return -(zi - np.sign(zi) * bound) / ((tox.BETA + ni**0.5) / tox.ALPHA + tox.L2)

    for _ in range(2):
        for r, y in zip(rows, labels):
            at = [*r.tolist(), "bias"]
            ws = [weight(i) for i in at]
            g = 1 / (1 + np.exp(-sum(ws))) - y
            for i, wi in zip(at, ws):
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / tox.ALPHA * wi
                n[i] = old + g * g
    expected = {i: weight(i) for i in z if i != "bias" and weight(i)}
    assert dict(zip(keys.tolist(), w)) == pytest.approx(expected) and bias == pytest.approx(weight("bias"))
