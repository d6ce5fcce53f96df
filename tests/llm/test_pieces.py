import random

import numpy as np
import pytest
import xxhash

from heapspan.llm.merge_dropout import Codec, Encoder, decode, encode
from heapspan.llm.pieces import default_model, exact_pre_tokens, load, model_bytes
from heapspan.llm.token_counts import token_counts

MODEL = model_bytes(default_model())
TEXTS = [None, "", " ", "  ", "a", " a", "a ", "a  b   c", "a\nb\n\n c\t d", "  \n  x", "▁x ▁▁ y", "<s> hi </s> <unk> <0x0A>", "ﬁ①\u0000b", "Éauou Straße ¿qué? 漢字かな 😀", "x" * 900, "=" * 70 + " end", "the quick brown fox " * 50]


def more(seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghinorstuéßñ  \n\t.,|▁😀") for _ in range(r.randint(1, 300))) for _ in range(60)] + [" ".join("".join(r.choice(["th", "er", "on", "an", "re", "tion", "ing"]) for _ in range(r.randint(1, 5))) for _ in range(80)) for _ in range(20)]


def frame(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS + more(3))] + [(None, "x y", 2), (None, "x y", 2)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")


def test_counts(spark):
    rows, df = frame(spark)
    sp = load(MODEL)
    got = token_counts(df, limit=20).collect()
    want = [(i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 20) for i, t, _ in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_counts(df.limit(0)).collect() == []


def test_counts_over_many_blocks_and_parts(spark):
    sp, long = load(MODEL), " ".join(f"w{i % 700}" for i in range(60_000))
    rows = [(i, t, 1) for i, t in enumerate([*more(5), None, long, "", *more(5)])]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, x int").repartition(3), block_bytes=2000, part_bytes=50_000).collect()
    assert {r.doc_id: (r.n_tokens, r.over_limit) for r in got} == {i: (n := len(sp.encode(t or "")), n > 4096) for i, t, _ in rows} and len(got) == len(rows)


def test_without_dropout_as_the_library():
    sp = load(MODEL)
    texts = [t for t in TEXTS + more(4) if t and "▁" not in t]
    for t, ids in zip(texts, Encoder(Codec(MODEL, dropout=0.0))(texts)):
        assert ids.tolist() == sp.encode(t), t


@pytest.mark.parametrize("dropout", [0.1, 0.5, 1.0])
def test_short_as_long(dropout):
    codec = Codec(MODEL, 7, dropout)
    tokens = sorted({t for x in more(6) for t in x.replace("\n", " ").split(" ") if t})
    for v in (0, 1):
        flat, sizes = codec.encode_short([v] * len(tokens), tokens)
        ends = np.cumsum(sizes)
        assert [flat[e - n : e].tolist() for e, n in zip(ends, sizes)] == [codec.encode_long(v, t) for t in tokens]


def test_varied_and_lossless(spark):
    texts = [t for t in TEXTS + more(8) if t]
    runs = [Encoder(Codec(MODEL, seed, 0.3))(texts) for seed in (1, 1, 2)]
    assert all(np.array_equal(a, b) for a, b in zip(runs[0], runs[1])) and any(not np.array_equal(a, b) for a, b in zip(runs[0], runs[2]))
    rows, df = frame(spark)
    digest = encode(df, dropout=0.2, emit="digest").collect()
    assert len(digest) == len(rows) and all(r.lossless for r in digest)
    back = decode(encode(df, dropout=0.2)).collect()
    assert sorted((str(i), t or "") for i, t, _ in rows) == sorted((str(r.doc_id), r.text) for r in back)
    assert encode(df.limit(0)).collect() == []


def naive(codec, sp, text):
    """All neighbours are looked at again for every merge; scores are the library's."""
    own, out = xxhash.xxh64_intdigest(text, int(codec.key)), []
    for token in exact_pre_tokens(text):
        unit, parts = codec.unit(own, token), [(c if c != " " else "\u2581", i, c == "\u2581") for i, c in enumerate(token)]
        while True:
            best = None
            for k, ((a, i, odd), (b, _, other)) in enumerate(zip(parts, parts[1:])):
                piece = codec.ids.get(a + b)
                if piece is not None and not odd and not other and not codec.skipped(np.array([unit], dtype=np.uint64), np.array([i]), np.array([piece]))[0]:
                    found = (-sp.get_score(piece), k)
                    best = min(best, found) if best else found
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [(parts[k][0] + parts[k + 1][0], parts[k][1], False)]
        for x, _, odd in parts:
            out += [codec.ids[x]] if x in codec.ids and not odd else [codec.byte_ids[b] for b in x.encode()]
    return out


@pytest.mark.parametrize("dropout", [0.1, 0.4])
def test_dropout_by_brute_force(dropout):
    codec, sp = Codec(MODEL, 11, dropout), load(MODEL)
    texts = [t for t in TEXTS + more(9)[:40] if t]
    for t, ids in zip(texts, Encoder(codec)(texts)):
        assert ids.tolist() == naive(codec, sp, t), t


def test_each_document_has_cuts_of_its_own():
    texts = [f"internationalisation {i}" for i in range(200)]
    got = {tuple(x[:-5].tolist()) for x in Encoder(Codec(MODEL, 1, 0.2))(texts)}
    assert len(got) > 8


def test_long_text_and_copies():
    text = " ".join(f"w{i % 500}" for i in range(120_000)) + "y" * 5000
    one, two = Encoder(Codec(MODEL, 1, 0.1))([text, text])
    assert np.array_equal(one, two) and Codec(MODEL).decode(one).decode() == text
