"""Operators on clashing columns, shuffled input, array sources, double vectors and near fingerprints."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sonagrid.llm import kneser_ney, mixing, secrets, simhash, vamana


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, -i, f"text number {i} of the table with password = hunter{i}22", "T", "en", ["a", "b"][i % 2], "S", 5, True) for i in range(40)]
    rows += [(None, 1, None, "T", None, None, "S", 0, None), (40, 1, "", "T", "en", "a", "S", 0, False)]
    return spark.createDataFrame(rows, "doc_id long, DOC_ID long, text string, TEXT string, lang string, source string, SOURCE string, n_chars long, gone boolean")


def test_stages_take_clashing_names(spark, odd):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    assert kneser_ney.filtered(odd, labels).columns == odd.columns
    clean = secrets.redact(odd)
    assert clean.columns == odd.columns and clean.count() == 42
    texts = [r[2] for r in clean.collect()]
    assert sum("[SECRET]" in (t or "") for t in texts) == 40 and not any("hunter" in (t or "") for t in texts)
    assert mixing.mixed(odd).columns == odd.columns


def test_classify_takes_shuffled_input(spark, odd):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    other = spark.createDataFrame([(i, i * i) for i in range(40)], "k long, v long")
    joined = odd.toDF(*[f"c{i}" for i in range(9)]).selectExpr("c2 as text", "c4 as lang").where("text is not null")
    joined = joined.withColumn("doc_id", F.xxhash64("text")).repartition(7).join(other, F.pmod("doc_id", F.lit(40)) == F.col("k"))
    assert kneser_ney.classify(joined, labels).count() == joined.count()


def test_mixed_takes_what_mix_says_of_array_sources(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * (1 + k % 3) for k in range(rng.randrange(1, 60))), rng.choice([["a"], ["b", "a"], ["c"], ["b", "c"], [], None])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    want = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect() if r["taken"]}
    got = {r["doc_id"]: r["n"] for r in mixing.mixed(docs).groupBy("doc_id").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    assert got == want and sum(got.values()) > 0


def test_double_vectors_keep_their_scores(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) * 10.0 ** (290 if i % 7 == 0 else -200 if i % 5 == 0 else 0) for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, [x * 2.0**i for x in rows[50][1]]) for i in range(1, 20)]
    got = vamana.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()

    def cosine(a, b):
        a, b = ([x / max(map(abs, v)) for x in v] for v in (a, b))
        return math.fsum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(math.fsum(x * x for x in a) * math.fsum(y * y for y in b))

    vectors = dict(rows)
    for q in (x for x in vectors if x % 50 == 0):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        best = sorted(((round(-cosine(vectors[q], v), 12), i) for i, v in vectors.items() if i != q))[:5]
        assert [m[1] for m in mine] == [i for _, i in best]
        assert all(abs(m[2] + b) < 1e-9 for m, (b, _) in zip(mine, best, strict=True))


def test_neighbours_equal_brute_force(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(12)]
    codes = base + [b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(6))) for b in base for _ in range(25)]
    codes = [c - (1 << 64) if c >> 63 else c for c in codes]
    want = {c: n for c in codes if (n := sum(bin((c ^ d) & (2**64 - 1)).count("1") <= 3 for d in set(codes) if d != c))}
    got = simhash.neighbours(spark.createDataFrame([(c,) for c in [*codes, *codes, None]], "code long")).collect()
    assert {r["code"]: r["n_near"] for r in got} == want and len(got) == len(want)


def test_query_counts_neighbours(spark, odd):
    got = simhash.with_neighbours(odd).collect()
    assert len(got) == 42
    codes = {r["code"] for r in got}
    for r in got:
        assert r["n_near"] == sum(bin((r["code"] ^ c) & (2**64 - 1)).count("1") <= 3 for c in codes if c != r["code"])


def test_bounds_are_searched(spark):
    from pyspark.sql import functions as F

    from sonagrid.llm import simhash

    for bounds in ([5], [1, 2, 3], [-7, 0, 4, 9, 12, 30, 31], list(range(0, 4095, 3))):
        values = [-(1 << 63), *bounds[:50], *[b + 1 for b in bounds[:50]], bounds[-1], 10**12]
        got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(simhash.bounds_upto(bounds, F.col("v"))).collect()]
        assert got == [sum(b <= v for b in bounds) for v in values]


def test_common_texts_are_broadcast(spark, monkeypatch):
    from sonagrid.llm import minhash

    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[:40])) for i in range(100)] + [(i, " ".join(words[i : i + 30])) for i in range(100, 160)] + [(i, " ".join(words[300:340])) for i in range(160, 164)]
    rows += [(200, None), (201, ""), (202, " "), (None, " ".join(words[:40]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    for common in (2, 10**9):
        monkeypatch.setattr(minhash, "COMMON", common)
        got = minhash.near_duplicates(docs).collect()
        assert len(got) == len(rows) and {r["doc_id"]: r["component_id"] for r in got} == want
    assert want[99] == 0 and want[163] == 160 and want[200] == 200 and want[None] is None
