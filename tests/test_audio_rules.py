"""Resampling against direct convolution, loading and chunks, and word rules against a loop."""

import random
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonagrid import audio_queries
from sonagrid.functions import signal
from sonagrid.operators import wordmap
from sonagrid.sources import text_tables


def direct(x, rate, to, zeros=6, rolloff=0.99):
    n = -(-len(x) * to // rate)
    band = min(rate, to) * rolloff
    t = (np.arange(len(x)) / rate - np.arange(n)[:, None] / to) * band
    kernel = np.where(np.abs(t) < zeros, np.sinc(t) * np.cos(np.pi * t / (2 * zeros)) ** 2, 0) * band / rate
    return kernel @ x


@pytest.mark.parametrize(("rate", "to"), [(24000, 16000), (16000, 44100), (8000, 16000), (48000, 16000), (11025, 16000)])
@pytest.mark.parametrize("block", [1, 7, 4096])
def test_resampling_is_the_direct_convolution(rate, to, block):
    x = np.random.default_rng(0).normal(size=1500)
    common = np.gcd(rate, to)
    assert np.allclose(signal.resample(x, rate, to, block), direct(x, rate // common, to // common), atol=1e-9)


def test_resampling_keeps_a_tone_and_odd_inputs():
    t = np.arange(8000) / 8000
    got = signal.resample(np.sin(2 * np.pi * 300 * t), 8000, 16000)
    assert np.abs(got - np.sin(2 * np.pi * 300 * np.arange(16000) / 16000))[200:-200].max() < 1e-3
    assert len(signal.resample(np.zeros(0), 8000, 16000)) == 0 and signal.resample([1.0, 2.0], 8000, 8000).tolist() == [1, 2]
    assert len(signal.resample(np.ones(1), 44100, 8000)) == 1


def test_mono_takes_the_shorter_axis():
    x = np.arange(6.0).reshape(2, 3)
    assert signal.mono(x).tolist() == signal.mono(x.T).tolist() == [1.5, 2.5, 3.5]
    assert signal.mono(np.array([16384, -32768], np.int16)).tolist() == [0.5, -1.0]
    with pytest.raises(ValueError, match="3 axes"):
        signal.mono(np.zeros((1, 1, 1)))


def wav(rate, samples):
    body = np.asarray(samples, "<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(body)) + body


def test_files_are_resampled_capped_or_refused(spark):
    df = spark.createDataFrame([(bytearray(wav(8000, range(800))),)], "content binary")
    got = df.select(signal.decode_wav(F.col("content"), rate=16000, cap=0.05).alias("w")).first()["w"]
    assert got["rate"] == 16000 and np.allclose(got["samples"], signal.resample(np.arange(800) / 32768, 8000, 16000)[:800])
    assert df.select(signal.decode_wav(F.col("content"), rate=8000, strict=True).alias("w")).first()["w"]["rate"] == 8000
    with pytest.raises(Exception, match="sample rate is 8000"):
        df.select(signal.decode_wav(F.col("content"), rate=16000, strict=True)).collect()


def test_chunks_of_nothing_and_of_little(spark):
    df = spark.createDataFrame([([],), (None,), ([1.0, 2.0, 3.0],), ([float(i) for i in range(100)],)], "x array<double>")
    got = [r[0] for r in df.select(signal.batch_chunks(F.col("x"), 1, cap=6, chunk=4)).collect()]
    assert got[:2] == [None, None] and got[2] == [[1, 2, 3, 1]] and got[3] == [[0, 1, 2, 3], [4, 5, 0, 1]]


def loop(words, rules):
    out, i = [], 0
    table = {tuple(r[0]): r for r in rules}
    while i < len(words):
        n = next((n for n in range(5, 0, -1) if tuple(w[2] for w in words[i : i + n]) in table and i + n <= len(words)), 0)
        if n:
            _, parts, alternatives = table[tuple(w[2] for w in words[i : i + n])]
            said, many = parts or alternatives[0], alternatives if len(alternatives) > 1 else None
        else:
            w = words[i][2]
            k = next((k for k in range(len(w) - 2, 0, -1) if w[k] == "-"), 0)
            said, many = ([w] if w in wordmap.WHOLE or not k else [w[:k], w[k + 1 :]]), None
        st, ed = words[i][3], max(w[4] for w in words[i : i + max(n, 1)])
        each = (ed - st) / len(said)
        out += [(words[i][0], words[i][1], k, x, st + k * each, st + k * each + each, many) for k, x in enumerate(said)]
        i += max(n, 1)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_rules_apply_as_in_a_loop(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "c", "mm-hmm", "x-y", "x-y-z", "-q", "q-", "-"]
    rules = {tuple(rng.choice(names[:4]) for _ in range(rng.randrange(1, 5))): None for _ in range(25)}
    rows = []
    for source in rules:
        parts = [rng.choice("pqr") for _ in range(rng.randrange(0, 4))]
        rows.append((list(source), parts, [parts] if parts else [["u", "v"], ["w"]]))
    words = [(rec, i, rng.choice(names if rng.random() < 0.3 else names[:3]), i * 1.0, i + 0.5) for rec in range(8) for i in range(40)]
    got = wordmap.standardised(spark.createDataFrame(words, "rec int, idx int, word string, st double, ed double"), spark.createDataFrame(rows, "source array<string>, parts array<string>, alternatives array<array<string>>"), ["rec"])
    want = [x for rec in range(8) for x in loop([w for w in words if w[0] == rec], rows)]
    have = sorted(map(tuple, got.collect()))
    assert [x[:4] for x in have] == [x[:4] for x in want] and [x[6] for x in have] == [x[6] for x in want]
    assert np.allclose([x[4:6] for x in have], [x[4:6] for x in want])


def test_rules_that_begin_alike_cost_no_more(spark):
    """Every word begins all of 6,000 rules: compared one by one that is 360 million slices, by whole sources 60,000 lookups."""
    words = spark.range(60_000).select(F.lit(1).alias("rec"), F.col("id").cast("int").alias("idx"), F.when(F.col("id") % 2 == 0, "a").otherwise(F.concat(F.lit("b"), F.col("id") % 14_000)).alias("word"), (F.col("id") * 1.0).alias("st"), (F.col("id") + 1.0).alias("ed"))
    many = spark.range(6000).select(F.array(F.lit("a"), F.concat(F.lit("b"), F.col("id"))).alias("source"), F.array(F.concat(F.lit("ab"), F.col("id"))).alias("parts"))
    rules = many.withColumn("alternatives", F.array("parts"))
    began = time.monotonic()
    hits = wordmap.rule_hits(words, rules, ["rec"]).select("idx", "length", "parts").collect()
    assert time.monotonic() - began < 30
    want = {(i, 2, f"ab{(i + 1) % 14_000}") for i in range(0, 60_000, 2) if (i + 1) % 14_000 < 6000}
    assert len(hits) == len(want) and {(r["idx"], r["length"], r["parts"][0]) for r in hits} == want


def test_words_are_not_broadcast(spark, monkeypatch):
    """Spark takes exploded words for as small as their file."""
    monkeypatch.setattr(wordmap, "RULES", 0, raising=False)
    got = audio_queries.words_standardised(spark, "/root/testdata/sf0.001")
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().sparkPlan().toString()
    few = spark.createDataFrame([(["can"], ["could"], [["could"]])], "source array<string>, parts array<string>, alternatives array<array<string>>")
    words = spark.createDataFrame([("so can can",)], "t string").select(F.lit(1).alias("rec"), F.posexplode(F.split("t", " ")).alias("idx", "word"))
    for limit in (0, 10):
        monkeypatch.setattr(wordmap, "RULES", limit)
        assert [r["idx"] for r in wordmap.rule_hits(words, few, ["rec"]).orderBy("idx").collect()] == [1, 2]


def test_no_shuffle_by_hit_follows_the_join(spark):
    """A hit ends with the latest of its words' ends, of which some may be null."""
    words = spark.createDataFrame([(1, 0, "a", 0.0, 1.0), (1, 1, "b", 1.0, None), (1, 2, "c", 2.0, 2.5), (1, 3, "a", 3.0, 4.0)], "rec int, idx int, word string, st double, ed double")
    rules = spark.createDataFrame([(["a", "b", "c"], ["x", "y"], [["x", "y"]])], "source array<string>, parts array<string>, alternatives array<array<string>>")
    got = wordmap.standardised(words, rules, ["rec"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("SortMergeJoin")[0]
    assert [tuple(r)[1:6] for r in got.orderBy("idx", "part").collect()] == [(0, 0, "x", 0.0, 1.25), (0, 1, "y", 1.25, 2.5), (3, 0, "a", 3.0, 4.0)]


def test_without_rules_only_hyphens_split(spark):
    words = spark.createDataFrame([(1, 0, "can-do", 0.0, 1.0), (1, 1, "uh-huh", 1.0, 2.0)], "rec int, idx int, word string, st double, ed double")
    rules = spark.createDataFrame([], "source array<string>, parts array<string>, alternatives array<array<string>>")
    assert [r["word"] for r in wordmap.standardised(words, rules, ["rec"]).orderBy("idx", "part").collect()] == ["can", "do", "uh-huh"]
    assert wordmap.standardised(words, rules, ["rec"], hyphens=False).count() == 2


def test_rule_files(spark, tmp_path):
    (tmp_path / "r.glm").write_text("; c\n[X] => y\n* z\n%\n\nGonna  => going to ;; said\n can not =>  cannot\nGONNA => gonna do\nalot => { a lot / allot }\nnothing => 123\nno arrow\n")
    got = {tuple(r["source"]): (r["parts"], r["alternatives"]) for r in text_tables.glm(spark, str(tmp_path / "r.glm")).collect()}
    assert got == {("gonna",): (["gonna", "do"], [["gonna", "do"]]), ("can", "not"): (["cannot"], [["cannot"]]), ("alot",): ([], [["a", "lot"], ["allot"]])}
