import os
import random

import pytest

from heapspan.llm.common import Store
from heapspan.llm.simhash import fingerprint

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def prose(r, words, n):
    return " ".join(r.choice(words) for _ in range(n))


def test_stages(spark, tmp_path):
    r = random.Random(11)
    words = ["".join(r.choice(["th", "er", "on", "an", "re", "ing", "ou"]) for _ in range(r.randint(1, 5))) for _ in range(1500)]
    leak, passage = prose(r, words, 40), prose(r, words, 70)
    docs = [(i, prose(r, words, 150)) for i in range(40)]
    docs += [(100, docs[0][1]), (101, docs[1][1] + " and one more"), (102, prose(r, words, 60) + " " + leak + " " + prose(r, words, 60))]
    docs += [(103 + k, prose(r, words, 60) + " " + passage + " " + prose(r, words, 60)) for k in range(3)]
    docs += [(110, None), (111, ""), (112, "12 ?? 34")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == now.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = now.collect()
    ids = {n: {x.doc_id for x in rows} for n, rows in kept.items()}
    assert ids["language_id"] == {i for i, _ in docs} - {110, 111, 112}
    assert ids["near_duplicates"] == ids["language_id"] - {100, 101}
    assert ids["repeated_text"] == ids["near_duplicates"]
    text = {x.doc_id: x.text for x in kept["repeated_text"]}
    assert all(passage not in text[103 + k] and len(text[103 + k]) < len(dict(docs)[103 + k]) - 200 for k in range(3)) and text[5] == dict(docs)[5]
    assert ids["benchmark_leaks"] == ids["repeated_text"] - {102}
    assert all(x.lossless and x.n_bytes == len(text[x.doc_id].encode()) for x in kept["encoding"])
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids["encoding"]


def edited(r, n):
    """Texts of 200 words and copies of them with up to 15 words replaced."""
    words, texts = ["w%d" % i for i in range(2000)], []
    for _ in range(n):
        t = [r.choice(words) for _ in range(200)]
        for k in (0, 1, 2, 15):
            copy = list(t)
            for _ in range(k):
                copy[r.randrange(200)] = r.choice(words)
            texts.append(" ".join(copy))
    return texts


def test_near_duplicates_by_fingerprints(spark):
    """The stage's groups are those of the method: fingerprints that link at 3 or fewer differing bits."""
    texts = edited(random.Random(41), 40)
    fps, root = [fingerprint(t.encode()) % 2**64 for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [i for i, g in enumerate(root) if i == g]


def test_near_duplicates_disk(spark, tmp_path, monkeypatch):
    """All tables that the stage writes, deleted or not, are far smaller than the texts."""
    spark.createDataFrame(list(enumerate(edited(random.Random(42), 300))), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents")
    df, written, put = spark.read.parquet(f"{tmp_path}/documents"), {}, Store.put

    def size(path):
        return sum(os.path.getsize(f"{d}/{x}") for d, _, names in os.walk(path) for x in names if x.endswith(".parquet"))

    def measured(self, frame, name):
        out = put(self, frame, name)
        written[f"{self.base}/{name}"] = size(f"{self.base}/{name}".removeprefix("file://"))
        return out

    monkeypatch.setattr(Store, "put", measured)
    assert corpus_pipeline.near_duplicates(spark, df, "").count() > 300
    assert 0 < sum(written.values()) < size(f"{tmp_path}/documents") / 4, written
