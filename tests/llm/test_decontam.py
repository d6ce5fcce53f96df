import itertools
import random
import re

import duckdb

from heapspan.llm.decontam import LEAST, MASKS, ORACLE, WINDOW, clean, contamination


def test_masks_meet_every_overlap():
    for w in range(LEAST, WINDOW + 1):
        places = [frozenset(s + k for k in m) for m in MASKS for s in range(w - max(m))]
        for gone in itertools.combinations(range(w), w // 10):
            assert any(p.isdisjoint(gone) for p in places)


def brute(text, items):
    t = re.findall(r"[^\W_]+", (text or "").lower())
    found = {}
    for i, x in items:
        b = re.findall(r"[^\W_]+", (x or "").lower())
        w = min(WINDOW, len(b))
        if len(b) < LEAST:
            continue
        most = max((sum(a == c for a, c in zip(t[p : p + w], b[q : q + w])) for p in range(len(t) - w + 1) for q in range(len(b) - w + 1)), default=0)
        if most >= w - w // 10:
            found[i] = max(found.get(i, 0), most)
    return bool(found), len(found), min(found, default=None), max(found.values(), default=0)


def data(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    prose = lambda n: [r.choice(words) for _ in range(n)]
    items = [(i, prose(n)) for i, n in enumerate([3, 7, 8, 9, 10, 15, 19, 20, 21, 35, 50])]
    docs = [None, "", "w1", "w2 w3"]
    for _ in range(60):
        i, b = r.choice(items)
        a = r.randint(0, max(0, len(b) - 20))
        b = b[a : a + r.randint(8, 30)]
        b = [r.choice(words) if r.random() < r.choice([0, 0.05, 0.15]) else x for x in b]
        docs.append(" ".join(prose(r.randint(0, 25)) + b + prose(r.randint(0, 25))).replace("w1 ", "W1,\n"))
    items = [(i, " ".join(b)) for i, b in items] + [(98, None), (99, ""), (7, " ".join(items[8][1])), (7, " ".join(items[8][1]))]
    return items, [(i // 2 if i > 10 else i, t) for i, t in enumerate(docs)] + [(None, docs[9]), (None, docs[9]), (3, docs[10])]


def test_brute_force_and_sql(spark):
    for seed in (1, 2):
        items, docs = data(seed)
        d, b = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, item string"), spark.createDataFrame(items, "item_id long, text string")
        want = sorted(str((i, *brute(t, items))) for i, t in docs)
        assert sorted(str(tuple(r)) for r in contamination(d, b).collect()) == want
        assert sorted(str(tuple(r)) for r in contamination(d, b, small=1, words=64).collect()) == want
        documents, benchmark = d.toPandas(), b.toPandas()  # noqa: F841
        got = duckdb.sql(ORACLE).fetchall()
        assert sorted(str((None if i is None or i != i else int(i), *x)) for i, *x in got) == want
        kept = clean(d, b)
        assert kept.columns == d.columns and sorted(str(tuple(r)[:2]) for r in kept.collect()) == sorted(str((i, t)) for i, t in docs if not brute(t, items)[0])
    assert contamination(d.limit(0), b).collect() == []
    assert not any(r.contaminated for r in contamination(d, b.limit(0)).collect())
