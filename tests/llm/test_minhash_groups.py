"""Large groups of near copies around the threshold: components equal those of brute force over all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonagrid.llm import minhash


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        at, what = rng.randrange(len(out)), rng.random()
        if what < 0.5:
            out[at] += rng.choice("xyz")
        elif what < 0.75:
            out.insert(at, f"n{rng.randrange(40)}")
        elif len(out) > 60:
            del out[at]
    return out


def family(rng, n, most, words=110):
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    second = edited(rng, base, 7)
    return [" ".join(edited(rng, second if k % 3 == 0 else base, rng.randrange(most))) for k in range(n)] + [" ".join(second), " ".join(base)]


def brute(texts, banded):
    """Components over linked pairs that share a band."""
    look = minhash.Words()
    sets = [minhash.shingle_set(minhash.words_of(t.encode()), look) for t in texts]
    every = np.unique(np.concatenate(sets))
    m = np.zeros((len(sets), len(every)), np.float32)
    for i, s in enumerate(sets):
        m[i, np.searchsorted(every, s)] = 1
    common = m @ m.T
    size = m.sum(axis=1)
    link = 100 * common >= minhash.PERCENT * (size[:, None] + size[None] - common)
    if banded:
        keys = np.stack([minhash.band_keys(minhash.signature(s, minhash.BANDS * minhash.ROWS), minhash.BANDS) for s in sets])
        link &= np.stack([(keys == k).any(axis=1) for k in keys])
    root = np.arange(len(sets))
    while True:
        new = np.array([root[row].min() for row in link])
        if (new == root).all():
            return root, int(np.triu(link, 1).sum())
        root = new


@pytest.mark.parametrize("direct", [12, 64])
def test_groups_at_the_threshold(spark, monkeypatch, direct):
    monkeypatch.setattr(minhash, "DIRECT", direct)
    rng = random.Random(11)
    texts = family(rng, 110, 9) + family(rng, 50, 6) + [" ".join(f"u{i}-{k}" for k in range(30)) for i in range(20)]
    want, links = brute(texts, banded=False)
    assert links > 500 and len(set(want.tolist())) > 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = minhash.near_duplicates(docs).orderBy("doc_id").collect()
    assert [r["component_id"] for r in got] == want.tolist()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_clashing_columns_and_repeated_ids(spark):
    a = " ".join(f"a{i}" for i in range(40))
    rows = [(1, 9, a, "p", 0, 0), (2, 9, a, "q", 0, 0), (3, 9, "z " + a, "r", 0, 0), (4, 8, "b", "s", 0, 0), (4, 7, "c d", "t", 0, 0), (4, 7, None, "t", 0, 0), (None, 1, a, "n", 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, DOC_ID long, text string, gone string, again long, Text long")
    out = minhash.deduplicated(docs)
    assert out.columns == docs.columns
    first = [r[0] for r in out.collect()]
    assert sorted(x for x in first if x is not None) == [1, 4] and first.count(None) == 1
    assert sorted(map(str, out.collect())) == sorted(map(str, minhash.deduplicated(docs.repartition(5)).collect()))
    assert minhash.deduplicated(docs.where(F.lit(False))).count() == 0
