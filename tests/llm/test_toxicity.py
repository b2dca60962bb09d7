import math
import random
import zlib

import numpy as np

from wattframe.llm.toxicity import Ftrl, drop_toxic, score_toxicity, slots_of, training_rows

WORDS = [f"w{i}" for i in range(400)]


def corpus(n=600):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = [rng.choice(WORDS) for _ in range(40)]
        if bad:
            for w in rng.sample(["grobw", "fiesw", "miesw"], 2):
                words.insert(rng.randrange(40), w)
        rows.append((i, " ".join(words), "a"))
        labels.append((i, 1 if i % 2 else 0, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark, make_docs):
    rows, labels = corpus()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in score_toxicity(make_docs(rows), table).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r.held_out} == set(held)
    right = np.mean([got[i].predicted == (i % 5 == 0) for i in held])
    assert right > 0.97 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    flipped = spark.createDataFrame([(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels], table.schema)
    assert {(r.doc_id, r.score) for r in score_toxicity(make_docs(rows), flipped).collect()} == {(i, r.score) for i, r in got.items()}
    kept = drop_toxic(make_docs(rows), table)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted == 0} and kept.columns == make_docs(rows).columns


def test_hard_rows(spark, hard_docs):
    none = spark.createDataFrame([(None, 0, 1), (6, 1, None), (2, 1, 7)], "doc_id long, quality int, toxic int")
    got = score_toxicity(hard_docs, none).collect()
    assert len(got) == hard_docs.count() and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {1}
    some = spark.createDataFrame([(6, 1, 0), (6, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert score_toxicity(hard_docs, some).count() == hard_docs.count() and score_toxicity(hard_docs.limit(0), some).count() == 0


def test_ftrl_step_by_hand():
    model = Ftrl(4, alpha=0.5, beta=1.0, l1=0.1, l2=1.0)
    model.learn(np.array([1, 2]), 1)
    assert np.allclose(model.z, [0, -0.5, -0.5, 0, -0.5]) and np.allclose(model.n, [0, 0.25, 0.25, 0, 0.25])
    w = model.weights(np.array([1]))
    assert np.allclose(w, 0.4 / ((1 + 0.5) / 0.5 + 1))
    assert len(slots_of(b"")) == 0 and len(slots_of(b"a b c d")) == 4 + 3 + 2 + 2 + 1


def test_a_repeated_id_is_learnt_once(spark, make_docs):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5][:6]
    docs = make_docs([(i, f"text {i}", "a") for i in ids] + [(ids[0], f"other {k}", "b") for k in range(30)] + [(ids[1], None, "b")])
    table = spark.createDataFrame([(i, 1, 0) for i in ids], "doc_id long, quality int, toxic int")
    assert training_rows(docs, table).count() == 6 and training_rows(docs, table, 3).count() == 3
    again = docs.unionByName(docs).repartition(5)
    assert sorted(map(str, training_rows(docs, table).collect())) == sorted(map(str, training_rows(again, table).collect()))


def plain_features(text):
    """Words, neighbours, triples, and pairs that skip one or two words, unhashed."""
    w = text.lower().split()
    grams = [(0, x) for x in w] + [(1, *p) for p in zip(w, w[1:])] + [(2, *p) for p in zip(w, w[2:])] + [(3, *p) for p in zip(w, w[1:], w[2:])] + [(4, *p) for p in zip(w, w[3:])]
    return sorted(set(grams))


def plain_ftrl(rows, epochs=3, alpha=1.0, beta=1.0, l1=6.0, l2=1.0):
    """(text, label) in order; weights by feature, the bias under None."""
    z, n = {}, {}

    def weight(f):
        held = abs(z.get(f, 0.0)) - l1
        return 0.0 if held <= 0 else -math.copysign(held, z[f]) / ((beta + math.sqrt(n[f])) / alpha + l2)

    for _ in range(epochs):
        for text, label in rows:
            found = [*plain_features(text), None]
            w = {f: weight(f) for f in found}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for f in found:
                old = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[f]
                n[f] = old + g * g
    return {f: weight(f) for f in z}


def test_scores_equal_plain_dictionaries(spark, make_docs):
    """The fitted scores against FTRL over unhashed features, in the order of the fit."""
    rows, labels = corpus(300)
    docs, table = make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    ordered = sorted(training_rows(docs, table).collect(), key=lambda r: r.place)
    weights = plain_ftrl([(r.text, r.label) for r in ordered])
    got = {r.doc_id: r.score for r in score_toxicity(docs, table).collect()}
    assert sum(w != 0 for w in weights.values()) > 3
    for i, text, _ in rows:
        total = weights[None] + sum(weights.get(f, 0.0) for f in plain_features(text))
        assert abs(got[i] - 1 / (1 + math.exp(-total))) < 1e-4
