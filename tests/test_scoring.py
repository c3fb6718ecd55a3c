"""Scoring reports, unscored time, Python's numbers and realigned words: equal to SQL, restated loops and Python itself."""

import random

import duckdb
import numpy as np
import pytest
import test_library as library
from pyspark.sql import functions as F

import __spark_entry__
from sonagrid import queries, scoring_queries
from sonagrid.functions import draws, scalars, vectors
from sonagrid.operators import labels, scoring, tracks, transcripts, trials

NAMES = sorted(n for n, f in queries.queries().items() if f.__module__ == scoring_queries.__name__)


@pytest.mark.parametrize("name", NAMES)
def test_scoring_queries_equal_sql(spark, name):
    library.test_queries_equal_sql(spark, name)
    assert __spark_entry__.queries()[name](spark, library.SF).count() > 0


def test_python_round(spark):
    rng = random.Random(5)
    xs = [rng.uniform(-1000, 1000) for _ in range(2000)] + [k / 8 for k in range(-99, 99)] + [k / 200 for k in range(-999, 999)]
    xs += [1.005, 2.675, 0.285, 1e17, -0.001, 0.0, None, float("inf")]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = df.select("i", "x", *[scalars.python_round(F.col("x"), n).alias(f"r{n}") for n in (1, 2, 3)], scalars.python_text(scalars.python_round(F.col("x")), 2).alias("text")).collect()
    for r in got:
        for n in (1, 2, 3):
            assert r[f"r{n}"] == (None if r["x"] is None else round(r["x"], n)), (r["x"], n)
        if r["x"] is not None and abs(r["x"]) < 1e13:
            assert r["text"] == str(round(r["x"], 2))


def zones_by_loop(tokens, extend):
    """The state machine over boundaries in order, one at a time."""
    rank = {"SEG": 0, "LEX": 1, "NSZ": 2}
    events = sorted((t, step, rank[kind], kind) for st, ed, kind in tokens if ed > st for t, step in ((st, 1), (ed, -1)))
    open_, word, turn, left, at, out = {"LEX": 0, "NSZ": 0}, 0.0, 0.0, 0.0, None, []
    for t, step, _, kind in events:
        if kind == "SEG":
            turn = t
        else:
            open_[kind] += step
            if not open_[kind] and step < 0:
                word, left = (t, left) if kind == "LEX" else (word, t)
        quiet = not open_["NSZ"]
        if at is None:
            if kind == "NSZ" and not quiet:
                at = t if open_["LEX"] else max(word, turn, t - extend)
        elif quiet and (open_["LEX"] or kind == "SEG"):
            out.append((at, min(left + extend, t)))
            at = None
        elif kind == "NSZ" and step == 1 and open_["NSZ"] == 1 and t > left + 2 * extend:
            out.append((at, left + extend))
            at = t - extend
    return out + ([(at, float("inf"))] if at is not None else [])


def test_noscore_zones(spark):
    rng = random.Random(7)
    cases = {k: [(float(a), float(a + rng.randint(0, 6)), rng.choice(["LEX", "SEG", "NSZ", "NSZ"])) for a in (rng.randint(0, 60) for _ in range(rng.randint(1, 14)))] for k in range(150)}
    df = spark.createDataFrame([(k, *t) for k, ts in cases.items() for t in ts], "rec int, st double, ed double, kind string")
    for extend in (0.5, 2.0):
        got = {}
        for r in scoring.noscore_zones(df, ["rec"], extend).collect():
            got.setdefault(r["rec"], []).append((r["st"], r["ed"]))
        for k, ts in cases.items():
            assert sorted(got.get(k, [])) == zones_by_loop(ts, extend), (k, ts)


def test_uem_without_noscore(spark):
    uem = spark.createDataFrame([(1, 0.0, 20.0), (2, 0.0, 5.0)], "rec int, st double, ed double")
    tokens = spark.createDataFrame([(1, 4.0, 5.0, "NON-LEX", "laugh"), (1, 5.25, 6.0, "LEXEME", "lex"), (1, 12.0, 13.0, "NOSCORE", "x"), (1, None, None, None, None)], "rec int, st double, ed double, type string, sub string")
    kinds = tokens.withColumn("kind", scoring.token_kind(F.col("type"), F.col("sub"), {"NON-LEX": ["laugh"], "NOSCORE": ["x"]}))
    got = sorted((r["rec"], r["st"], r["ed"]) for r in scoring.without_noscore(uem, kinds, ["rec"]).collect())
    assert got == [(1, 0.0, 3.5), (1, 5.25, 11.5), (2, 0.0, 5.0)]


def test_realigned(spark):
    rows = [(1, "Hello, World!你好。We go", "hello world 你好 we go", [1, 2, 3, 4, 5]), (2, "Hello", "other", [1]), (3, None, "a", [1]), (4, "A b", "a b", [1]), (5, "", "", [])]
    df = spark.createDataFrame(rows, "k int, text string, raw string, times array<int>")
    got = [tuple(r) for r in transcripts.realigned(df, "text", "raw", "times").orderBy("k", "idx").collect()]
    assert got == [(1, 0, "Hello, ", 0, 1), (1, 1, "World!", 0, 2), (1, 2, "你好。", 1, 3), (1, 3, "We ", 2, 4), (1, 4, "go", 2, 5)]


def test_speaker_reports(spark):
    ref = spark.createDataFrame([(1, "a", "male", 3.0), (1, "b", "female", 2.0), (1, "c", "male", 0.0)], "rec int, ref string, type string, time double")
    sys = spark.createDataFrame([(1, "x", "female", 1.0), (1, "y", "male", 1.0), (1, "z", "male", 0.0)], "rec int, sys string, type string, time double")
    mapping = spark.createDataFrame([(1, "a", "x"), (1, "c", "y")], "rec int, ref string, sys string")
    got = sorted(map(tuple, scoring.speaker_types(ref, sys, mapping, ["rec"]).collect()))
    assert got == [("FALSE ALARM", "male", 1), ("female", "MISS", 1), ("male", "female", 1)]
    pairs = spark.createDataFrame([(1, "a", "x", 1.25), (1, "b", "x", 2.0)], "rec int, ref string, sys string, ov double")
    lines = sorted(r[0] for r in scoring.map_lines(scoring.mapped_pairs(pairs, mapping, ["rec"]), "rec", F.lit("1")).collect())
    assert lines == ["1,1,a,x,mapped,1.2500", "1,1,b,x,notmapped,2.0000"]


def test_lines_round_next_to_halves_as_sql(spark):
    """Sums of time whose shortest decimals and whose product with 10,000 lie on different sides of a half."""
    times = [3614.6012499999997, 3654.6012499999997, 4272.64705, 4232.64705, 0.00005, 12.34565, 7.0]
    pairs = spark.createDataFrame([(i, "a", "b", t) for i, t in enumerate(times)], "rec int, ref string, sys string, ov double")
    lines = scoring.map_lines(scoring.mapped_pairs(pairs, pairs, ["rec"]), "rec", F.lit("1")).collect()
    want = duckdb.execute("SELECT printf('%.4f', round(unnest(?::DOUBLE[]), 4))", [times]).fetchall()
    assert [r[0].split(",")[-1] for r in sorted(lines, key=lambda r: int(r[0].split(",")[0]))] == [w[0] for w in want]


def test_draws(spark):
    df = spark.createDataFrame([(i, [float(x) for x in range(n)]) for i, n in enumerate([0, 3, 8, 50])] + [(9, None)], "k int, w array<double>")
    got = {r["k"]: r["c"] for r in df.select("k", draws.crop(F.col("w"), 8, draws.draw("s", F.col("k"))).alias("c")).collect()}
    assert got[0] == [0.0] * 8 and got[1] == [0.0, 1.0, 2.0] + [0.0] * 5 and got[2] == [float(x) for x in range(8)] and got[9] is None
    assert len(got[3]) == 8 and all(b - a == 1 for a, b in zip(got[3], got[3][1:], strict=False))
    n = spark.range(4000).groupBy(draws.augmentation("s", F.col("id"), 0.5, ["a", "b"]).alias("x")).count()
    got = {r["x"]: r["count"] for r in n.collect()}
    assert abs(got[None] - 2000) < 200 and abs(got["a"] - 1000) < 150


def test_length_batches(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", None]), i, rng.choice([None, 0, 1, 3, 3, 7, 20])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, n int")
    got = {r["i"]: r["batch"] for r in tracks.length_batches(df, ["k"], "n", ["i"], 12).collect()}
    for key in ("a", None):
        left = sorted((-(n or 0), i) for k, i, n in rows if k == key)
        number = 0
        while left:
            size = max(1, 12 // max(1, -left[0][0]))
            assert {got[i] for _, i in left[:size]} == {number}
            left, number = left[size:], number + 1
    assert len(got) == 300 and tracks.length_batches(df.where("false"), ["k"], "n", ["i"], 12).count() == 0


def test_merge_by_cosine(spark):
    rng = np.random.default_rng(2)
    x, label = rng.normal(size=(60, 3)), rng.integers(0, 9, 60)
    want = label.copy()
    while True:  # centroids of rows, made anew after each merge
        ids = np.unique(want)
        c = np.stack([x[want == i].mean(axis=0) for i in ids])
        c /= np.linalg.norm(c, axis=1, keepdims=True)
        best = max((float(c[i] @ c[j]), i, j) for i in range(len(ids)) for j in range(i + 1, len(ids))) if len(ids) > 1 else (-2.0, 0, 0)
        if best[0] < 0.5:
            break
        want[want == ids[best[2]]] = ids[best[1]]
    assert (labels.cosine_merged(label, x, 0.5) == want).all()
    df = spark.createDataFrame([(1, i, int(label[i]), x[i].tolist()) for i in range(60)] + [(1, 60, None, [1.0, 0.0, 0.0])], "k int, i int, label int, e array<double>")
    got = {r["i"]: r["label"] for r in labels.merge_by_cosine(df, ["k"], "label", "e", 0.5).collect()}
    assert got.pop(60) is None and got == {i: int(v) for i, v in enumerate(want)}


def test_without_subtype(spark):
    ref = spark.createDataFrame([(1, 0.0, 9000.0, "FILLER", "x"), (1, 2.0, 3.0, "FILLER", "y"), (1, 0.0, 1.0, None, None)], "k int, st double, ed double, type string, subtype string")
    sys = spark.createDataFrame([(1, 9000.0, "FILLER", None), (1, 9001.0, "FILLER", None), (1, 1.0, "FILLER", "y"), (1, 9500.0, "FILLER", "x"), (1, 1.0, None, None), (1, None, "FILLER", None)], "k int, mid double, type string, partner string")
    left, right = scoring.without_subtype(ref, sys, "k", "FILLER", "x")
    assert sorted(str(r["subtype"]) for r in left.collect()) == ["None", "y"]
    assert sorted((str(r["mid"]), str(r["type"])) for r in right.collect()) == [("1.0", "FILLER"), ("1.0", "None"), ("9001.0", "FILLER"), ("None", "FILLER")]


def test_word_weight(spark):
    rows = [("well", "lex", 1), ("well-known", "lex", 2), ("-cut-", None, 1), ("mm-hmm", "lex", 1), ("um", "misc", 0), (None, "lex", 0), ("--", "lex", 2), ("", None, 2)]
    got = spark.createDataFrame(rows, "w string, k string, n int").select("n", scoring.word_weight(F.col("w"), F.col("k")).alias("got"))
    assert all(r["n"] == r["got"] for r in got.collect())


def test_word_deltas(spark):
    flags = [True, False, None, True, True]
    words = spark.createDataFrame([(1, i, f) for i, f in enumerate(flags)], "k int, idx int, scored boolean")
    cases = [(1, p, a, b) for p in ("BEG", "END") for a in range(-2, 8) for b in range(-2, 8)]
    extra = [(2, "END", 0, 3), (1, None, 0, 3), (1, "END", None, 3)]
    got = {tuple(r)[:4]: r["delta"] for r in scoring.word_deltas(spark.createDataFrame(cases + extra, "k int, place string, ref int, sys int"), words, "k").collect()}
    for k, p, a, b in cases:
        passed = range(min(a, b) + (p == "END"), max(a, b) + (p == "END"))
        n = sum(bool(flags[i]) for i in passed if 0 <= i < len(flags))
        assert got[k, p, a, b] == (n if b > a else -n)
    assert [got[e] for e in extra] == [0, None, None]


def test_crop_box(spark):
    got = spark.createDataFrame([([10.0, 20.0, 30.0, 60.0],), (None,)], "b array<double>").select(scalars.crop_box(F.col("b"), 0.5).alias("c")).select("c.*").collect()
    assert tuple(got[0]) == (40, 60, 120, 30, 90) and got[1]["pad"] is None


def test_trials_meet_vectors_in_cells(spark):
    rng = np.random.default_rng(4)
    vecs = [(i, [float(x) for x in rng.normal(size=6)], i % 3) for i in range(60)] + [(60, [0.0] * 6, 0), (61, None, 1), (62, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (63, [1.0, 2.0], 2), (64, [], 2), (None, [1.0] * 6, 0), (5, [1.0] * 6, 9)]
    v = spark.createDataFrame(vecs, "utt_id long, embedding array<double>, of int")
    t = spark.createDataFrame([(i, j, f"{i}-{j}") for i in range(66) for j in range(66)] + [(None, 1, "x"), (1, None, "y")], "enrol long, test long, said string")
    got = trials.score_trials(t, v, v, strict=False, carried=("of",), rows=20, least=2)
    x, y = (v.where("utt_id IS NOT NULL").select(F.col("utt_id").alias(n), F.col("embedding").alias(f"x_{n}"), F.col("of").alias(f"of_{n}")) for n in ("enrol", "test"))
    want = t.join(x, "enrol").join(y, "test").withColumn("score", vectors.cosine(F.col("x_enrol"), F.col("x_test")))
    columns = ["enrol", "test", "said", "of_enrol", "of_test", "score"]
    rows = lambda df: sorted([tuple(r) for r in df.select(*columns).collect()], key=str)
    assert rows(got) == rows(want) and got.columns == columns
    # a pair costs its own bytes on the way, and not those of two vectors
    wide = spark.range(300).select(F.col("id").alias("utt_id"), F.array_repeat(F.rand(1), 500).alias("embedding"))
    each = spark.range(90_000).select(F.floor(F.col("id") / 300).alias("enrol"), (F.col("id") % 300).alias("test"))
    plan = trials.score_trials(each, wide, wide, strict=False)
    assert plan.count() == 90_000 and "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()
