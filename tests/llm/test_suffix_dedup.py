import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from heapspan.llm.suffix_dedup import ranks, repeated_spans


def brute(texts, width):
    """(n_removed, n_spans, sha256 of the rest) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        runs = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


def texts(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 9))) for _ in range(60)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, base = prose(90), prose(200)
    out = [None, "", "short", "a" * 700, "a" * 199, "ab" * 200, base, base, base[:300] + "X" + base[301:], base[50:], passage]
    out += [prose(r.randint(0, 120)) + passage[r.randint(0, 40) : r.randint(150, 500)] + prose(r.randint(0, 120)) for _ in range(25)]
    return out + [prose(r.randint(1, 300)) for _ in range(10)]


@pytest.mark.parametrize(("seed", "width", "options"), [(1, 200, {}), (2, 200, {"hot": 2, "part_bytes": 2000}), (3, 40, {"chunk": 500}), (4, 40, {"hot": 3})])
def test_brute_force(spark, seed, width, options):
    rows = texts(seed)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(rows)], "doc_id long, text string, n_removed int").repartition(3)
    got = {r.doc_id: r for r in repeated_spans(df, width=width, block_bytes=3000, **options).collect()}
    for i, (t, (removed, runs, digest)) in enumerate(zip(rows, brute(rows, width))):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len((t or "").encode()), removed, runs, digest), i
        assert sum(s.end - s.begin for s in got[i].spans) == removed


def test_long_text_in_segments(spark, monkeypatch):
    monkeypatch.setattr("heapspan.llm.suffix_dedup.SEGMENT", 150)
    from heapspan.llm.suffix_dedup import Parse

    data = ("abc " * 100 + "xyz" * 50 + "hello world " * 60).encode()
    parse = Parse(data, 200, 64)
    assert [x for a, b in zip(parse.first, parse.last) for x in range(a, b + 1)] == list(range(len(data) - 199))


def test_documents_and_empty(spark):
    rows = [(None, "é" * 300, "en"), (2, "é" * 300, "en"), (3, None, None), (4, "kept", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, begin string")
    out = {r.doc_id: r for r in repeated_spans(df, emit="documents").collect()}
    assert out[2].text == "" and out[None].text == "" and out[3].text is None and out[4] == (4, "kept", "en")
    assert repeated_spans(df.limit(0)).collect() == []


def test_structured_strings_are_told_apart(spark):
    """Thue-Morse strings and their complements, which collide under polynomial hashes modulo a power of two."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    one, two = word[:2048], word[:2048].translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(0, one), (1, two)], "doc_id long, text string")
    for width in (200, 1500):
        got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_spans(df, width=width).collect()}
        assert [got[0], got[1]] == brute([one, two], width)


def test_ranks_are_a_suffix_array():
    r = random.Random(6)
    text = bytes(r.choice(b"ab") for _ in range(400)) * 2 + b"abc" * 60
    for width in (5, 8, 40, 200):
        got = ranks(np.frombuffer(text, dtype=np.uint8), width)
        cut = [text[i : i + width].ljust(width, b"\0") for i in range(len(text))]
        order = {x: n for n, x in enumerate(sorted(set(cut)))}
        whole = [i for i in range(len(text) - width + 1)]
        assert all((got[i] < got[j]) == (order[cut[i]] < order[cut[j]]) and (got[i] == got[j]) == (cut[i] == cut[j]) for i in whole[::7] for j in whole[::11])
