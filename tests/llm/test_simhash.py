import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heapspan.llm.simhash import close_pairs, fingerprint, fingerprints, near_duplicates, one_of_each, one_of_each_linked, similar_documents


def test_fingerprint_by_definition(spark):
    text = "The CAT sat\ton  the\x0bmat É the cat sat on the mat"
    words = "the cat sat on the mat É the cat sat on the mat".split()
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [r[0] & (2**64 - 1) for r in spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s")).collect()]
    bits = [sum(h >> i & 1 for h in hashes) * 2 > len(hashes) for i in range(64)]
    assert fingerprint(text.encode()) & (2**64 - 1) == sum(1 << i for i in range(64) if bits[i])
    assert fingerprint(b"") == 0 and fingerprint(b" \n") == 0 and fingerprint(b"A b") == fingerprint(b"a\tb")


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_by_brute_force(spark, seed):
    r = np.random.default_rng(seed)
    base = r.integers(-(2**63), 2**63, 60)
    flips = [int(b) ^ sum(1 << int(i) for i in r.choice(64, n, replace=False)) for b in base[:20] for n in (1, 2, 3, 3, 4, 5)]
    values = sorted({int(np.uint64(x % 2**64).astype(np.int64)) for x in [*map(int, base), *flips, 0, -1, 7]})
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) % 2**64).bit_count() <= 3}
    got = [tuple(x) for x in close_pairs(spark.createDataFrame([(v,) for v in values], "fp long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_components(spark):
    r = random.Random(5)
    words = ["w%d" % i for i in range(400)]
    texts = []
    for _ in range(25):
        t = [r.choice(words) for _ in range(400)]
        texts.append(" ".join(t))
        for _ in range(r.randint(0, 4)):
            t = list(t)
            t[r.randrange(400)] = r.choice(words)
            texts.append(" ".join(t))
    texts += [None, "", texts[0], texts[0]]
    rows = [(i * 7 % 1000, t) for i, t in enumerate(texts)] + [(None, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    fps = [fingerprint((t or "").encode()) % 2**64 for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d) if least.get(find(i)) is not None else d, d) if d is not None else least.get(find(i))
    got = sorted((str(x.doc_id), x.fingerprint, x.component_id) for x in near_duplicates(df).collect())
    assert got == sorted((str(d), f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows))


def test_cases(spark):
    df = spark.createDataFrame([(None, None), (None, "")], "doc_id long, text string")
    assert [x.component_id for x in near_duplicates(df).collect()] == [None, None]
    assert near_duplicates(df.limit(0)).collect() == [] and one_of_each(df.limit(0)).collect() == []
    assert fingerprints(df).columns == ["doc_id", "fp"]


def test_one_of_each(spark):
    r = random.Random(9)
    words = ["v%d" % i for i in range(3000)]
    rows = []
    for _ in range(40):
        base = [r.choice(words) for _ in range(r.randint(80, 400))]
        for k in range(r.choice([1, 1, 2, 3, 30])):
            t = list(base)
            for _ in range(len(t) * k // 2000):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((len(rows), " ".join(t), "c"))
    rows += [(1000, None, "c"), (1001, "", "c"), (3, rows[3][1], "c"), (None, rows[3][1], "c"), (None, "only without an id", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sig string")
    kept = one_of_each(df)
    assert kept.columns == df.columns
    own = [t for _, t, _ in rows[: len(rows) - 5]]
    want = [*(i for i, g in enumerate(groups(own)) if i == g), 1000, None]
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted(map(str, want))
    assert one_of_each(df.limit(0)).collect() == []


def sets(text, shingle=5):
    words = text.lower().split()
    return {tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}


def groups(texts):
    """Smallest position of each text's component, by brute-force Jaccard similarities."""
    found, root = [sets(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(found[i] & found[j])
            if both and 5 * both >= 4 * (len(found[i]) + len(found[j]) - both) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    return root


def test_similar_by_brute_force(spark):
    r = random.Random(21)
    words = ["u%d" % i for i in range(2000)]
    texts = []
    for n in [5, 6, 7, 9, 12, 15, 20, 30, 45, 60, 90, 150, 300] * 12:
        t = [r.choice(words) for _ in range(n)]
        texts.append(" ".join(t))
        extra = [r.choice(words) for _ in range(r.randint(0, max(1, n // 5)))]
        t[r.randrange(n)] = r.choice(words) if n > 40 else t[0]
        texts.append(" ".join(t + extra))
        texts.append(" ".join(t + t[: n // 3]))  # repeats
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in similar_documents(df).collect()}
    assert [got[i] for i in range(len(texts))] == groups(texts)


def test_similar_beside_others(spark):
    r = random.Random(22)
    words, texts = ["u%d" % i for i in range(3000)], []
    for others in (0, 1, 5, 20, 40):  # other texts of the same words
        for _ in range(6):
            t = [r.choice(words) for _ in range(80)]
            texts += [" ".join(t), " ".join([*t[:-2], "x", "y"])] + [" ".join(r.sample(t, 80)) for _ in range(others)]
    # chains in large cells: each text is similar to the next, few to the centre
    for _ in range(3):
        t = [r.choice(words) for _ in range(120)]
        for k in range(30):
            t = [*t[:k], f"v{r.random()}", *t[k + 1 :]]
            texts.append(" ".join(t))
    for _ in range(40):  # a long passage of many texts, by which they are not similar, with a near copy each
        t = ["passage%d" % i for i in range(60)] + [r.choice(words) for _ in range(40)]
        texts += [" ".join(t), " ".join([*t, r.choice(words), r.choice(words)])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in similar_documents(df).collect()}
    assert [got[i] for i in range(len(texts))] == groups(texts)


def linked_groups(texts):
    """Smallest position of each text's component, by brute force over the fingerprints."""
    fps, root = [fingerprint((t or "").encode()) % 2**64 for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    return root


def near_copies(r, n):
    words, texts = ["v%d" % i for i in range(3000)], []
    for _ in range(n):
        base = [r.choice(words) for _ in range(r.randint(80, 400))]
        for k in range(r.choice([1, 2, 5, 12])):
            t = list(base)
            for _ in range(k):
                t[r.randrange(len(t))] = r.choice(words)
            texts.append(" ".join(t))
    return texts


def test_one_of_each_linked(spark):
    texts = [*near_copies(random.Random(31), 40), None, "", " \n"]
    want = linked_groups(texts)
    assert want[:-3] != groups(texts[:-3])  # what the stage gave before: one document of each group by Jaccard similarity
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, th string")
    kept = one_of_each_linked(df)
    assert kept.columns == df.columns
    assert sorted(x.doc_id for x in kept.collect()) == [i for i, g in enumerate(want) if i == g]
    assert one_of_each_linked(df.limit(0)).collect() == []


def test_one_of_each_linked_odd_ids(spark):
    a, b, c, d = ("%s " % x * 3 + "one two three four five %s" % x for x in ("alpha", "beta", "gamma", "delta"))
    # 3 has a copy of 1's text, a text of its own and two equal rows of another; no row of d has an id
    rows = [(1, a), (3, a), (3, b), (3, c), (3, c), (7, c), (None, a), (None, d), (None, d)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(x.doc_id), x.text) for x in one_of_each_linked(df).collect())
    assert got == sorted([("1", a), ("3", b), ("3", c), ("None", d)])
    named = df.selectExpr("concat('n', doc_id) as name", "text as body")
    assert sorted((str(x.name), x.body) for x in one_of_each_linked(named, "name", "body").collect()) == sorted([("n1", a), ("n3", b), ("n3", c), ("None", d)])
