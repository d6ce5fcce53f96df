import random

import numpy as np

from heapspan.llm.toxicity import CHOICES, Scorer, choose, fit, learn, toxicity

BAD = ["grotz", "blarfing", "snivelka", "snivelmo"]


def text(r, bad, term=None):
    words = ["".join(r.choice(["ta", "ko", "ri", "ven", "lus"]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(10, 40))]
    for _ in range(r.randint(1, 3) if bad else 0):
        words.insert(r.randrange(len(words)), r.choice(BAD))
    if term:
        words.insert(r.randrange(len(words)), term)
    return " ".join(words)


def rows(n, lean=0.0):
    r = random.Random(7)
    out = []
    for i in range(n):
        bad = r.random() < 0.25
        out.append((i, text(r, bad, "women" if r.random() < (0.1 + lean * bad) else None), int(bad)))
    return out


def frames(spark, data):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in data], "doc_id long, text string, score double")
    return docs, spark.createDataFrame([(i, y, None) for i, _, y in data], "doc_id long, toxic int, quality int")


def test_held_out_and_cases(spark):
    data = rows(900)
    odd = [(2000, None), (2001, ""), (None, "ta grotz"), (None, "ta grotz"), (2002, "12 !!")]
    docs, labels = frames(spark, data)
    model = learn(docs, labels.where("doc_id % 4 <> 2").unionByName(spark.createDataFrame([(2, None, 1), (None, 1, 1)], labels.schema)))
    seen = docs.unionByName(spark.createDataFrame([(i, t, 0.1) for i, t in odd], docs.schema))
    got = toxicity(seen, model).collect()
    assert len(got) == len(data) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    found = {r.doc_id: r.predicted for r in got if r.doc_id is not None}
    held = [(found[i], y) for i, _, y in data if i % 4 == 2]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert found[2000] == found[2001] == 0
    assert toxicity(docs.limit(0), model).collect() == []
    assert {r.score for r in toxicity(docs, learn(docs, labels.limit(0))).collect()} == {0.0}


def test_identity_terms_do_not_move_scores(spark):
    """With the balance that the query has."""
    data = rows(900, lean=0.6)
    docs, labels = frames(spark, data)
    neutral, plain = "ta ko women ri", "ta ko men ri"
    gaps = {}
    for balance in (0.0, 1.0):
        score = Scorer(learn(docs, labels, balance=balance))
        gaps[balance] = abs(score(neutral) - score(plain))
    assert gaps[1.0] < 0.5 * gaps[0.0] or gaps[1.0] < 0.02


def test_fit_is_the_optimum():
    """Against plain proximal gradient with a small step."""
    r = random.Random(3)
    width, l1, balance, lift = 6, 0.01, 0.7, 2.0
    has = [sorted(r.sample(range(width), 3)) for _ in range(60)]
    toxic = [int(0 in h and r.random() < 0.9 or r.random() < 0.1) for h in has]
    changes = [[(1, -1), (2, 1)], [(4, 1)]]
    x, y = np.zeros((60, width)), np.array(toxic, dtype=float)
    for i, h in enumerate(has):
        x[i, h] = 1
    d = np.array([[0, -1, 1, 0, 0, 0], [0, 0, 0, 0, 1, 0]], dtype=float)
    cost = 1 + (lift - 1) * y

    def loss(b, w):
        z = b + x @ w
        return (cost * (np.logaddexp(0, z) - y * z)).mean() + balance * ((d @ w) ** 2).mean() + l1 * np.abs(w).sum()

    b, w = 0.0, np.zeros(width)
    for _ in range(30_000):
        g = cost * (1 / (1 + np.exp(-(b + x @ w))) - y) / 60
        step = w - 0.05 * (x.T @ g + balance * d.T @ (d @ w))
        b, w = b - 0.05 * g.sum(), np.sign(step) * np.maximum(np.abs(step) - 0.05 * l1, 0)
    base, got = fit(has, toxic, changes, width, l1, balance, lift, rounds=3000)
    assert abs(loss(base, got) - loss(b, w)) < 1e-6 and np.abs(got - w).max() < 1e-2


def test_parameters_are_chosen_among_the_rows_given():
    r = random.Random(5)
    has = [[r.randrange(1, 30)] for _ in range(300)]
    toxic = [int(h[0] < 4) for h in has]
    assert choose(has, toxic, [], 30, choices=((0.5, 1.0), (1e-4, 1.0), (1e-4, 1.0))) == (1e-4, 1.0)
    assert choose([[]], [1], [], 1) in CHOICES


def test_long_text(spark):
    docs, labels = frames(spark, rows(300))
    score = Scorer(learn(docs, labels))
    assert score("ta ko ri " * 200_000 + "grotz snivelka") == score("ta ko ri grotz snivelka")
