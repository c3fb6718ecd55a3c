"""Configurations with references, and stages composed into one pass."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonagrid import config
from sonagrid.functions import chain, draws, signal

MADE = []


def make(**args):
    MADE.append(args)
    return args | {"id": len(MADE)}


CONFIG = {
    "root": "/data", "name": "x", "wav_len": 3.0, "path": "<root>/sets/<name>/a<b>", "shared": {"obj": "make", "args": {"seconds": "<wav_len>"}},
    "left": {"of": "<shared>", "list": ["<name>", "plain", 5]}, "right": {"obj": "make", "args": {"a": "<shared>", "b": "<left>"}}, "all": ["<left>", "<right>"],
    "one": "<two>", "two": {"x": ["<three>"]}, "three": "a/<one>", "lost": "<nowhere>", "self": "<self>", "bad": {"obj": "make", "args": [1]}, "named": {"obj": "collections.Counter", "args": {"k": 2}},
}


def test_each_key_is_made_once_and_shared():
    MADE.clear()
    left, right, path = config.build(CONFIG, "left", "right", "path", registry={"make": make})
    assert len(MADE) == 2 and left["of"] is right["a"] and right["b"] is left and left["list"] == ["x", "plain", 5]
    assert path == "/data/sets/x/a<b>" and CONFIG["left"]["of"] == "<shared>"
    assert config.order(CONFIG, "all") == ["wav_len", "shared", "name", "left", "right", "all"]
    assert config.build(CONFIG, "named")[0]["k"] == 2


@pytest.mark.parametrize(("name", "error", "said"), [("one", ValueError, "one -> two -> three -> one"), ("self", ValueError, "self -> self"), ("lost", KeyError, "nowhere, which lost"), ("bad", TypeError, "must be a mapping")])
def test_circles_and_gaps_are_errors(name, error, said):
    with pytest.raises(error, match=said):
        config.build(CONFIG, name, registry={"make": make})


def test_deep_references_need_no_recursion():
    many = {f"k{i}": f"<k{i + 1}>" for i in range(20_000)} | {"k20000": 7}
    assert config.build(many, "k0") == [7]


def test_overrides_and_files(spark, tmp_path):
    (tmp_path / "c.yaml").write_text('{"a": 1, "b": "<a>", "c": [1, 2]}')
    c = config.load(spark, str(tmp_path / "c.yaml"))
    assert config.with_overrides(c, ["--a=5", "--d", "[3, 4]", "--e"]) == {"a": 5, "b": "<a>", "c": [1, 2], "d": [3, 4], "e": None}
    with pytest.raises(ValueError, match="before any"):
        config.with_overrides(c, ["5"])
    with pytest.raises(ValueError, match="unknown kind"):
        config.load(spark, "c.toml")


def test_the_chain_equals_its_stages_one_by_one(spark):
    rng = np.random.default_rng(2)
    rows = [(f"u{i}", i % 4, rng.normal(size=200 + 37 * i).tolist(), "more") for i in range(24)]
    df = spark.createDataFrame(rows, "utt string, label int, wave array<double>, other string").repartition(3)
    pool = [rng.normal(size=50), rng.normal(size=900)]
    stages = [chain.speed("s", "utt"), chain.speed_class(4), chain.crop("c", "utt", 400), chain.noise("n", "utt", pool, (0, 15), 0.7), chain.features(8, 8000)]
    got = {r["utt"]: r for r in chain.chained(df, stages, "utt", "label", "speed_index", "wave", "features", "other").collect()}
    for utt, label, x, other in rows:
        i, y = stages[0].run(utt, np.array(x))
        y = stages[3].run(utt, stages[2].run(utt, y)[0])[0]
        assert got[utt]["label"] == label + 4 * i and got[utt]["other"] == other and np.allclose(got[utt]["wave"], y)
        assert np.allclose(got[utt]["features"], signal.fbank_matrix(y, 8, 8000, True)) and len(y) == 400
    assert {r["speed_index"] for r in got.values()} == {0, 1, 2}
    again = {r["utt"]: r["wave"] for r in chain.chained(df.repartition(7), stages, "utt", "wave").collect()}
    assert all(again[u] == got[u]["wave"] for u in again)


def test_draws_agree_with_the_jvm(spark):
    df = spark.createDataFrame([("a", 1), ("é|", -7)], "k string, n int")
    assert [r[0] for r in df.select(draws.draw("seed", F.col("k"), F.col("n"))).collect()] == [chain.draw("seed", "a", 1), chain.draw("seed", "é|", -7)]


def test_noise_has_the_ratio():
    rng = np.random.default_rng(0)
    x, n = rng.normal(size=5000), rng.normal(size=20000)
    added = chain.noise("n", "k", [n], (10, 10)).run("key", x)[0] - x
    assert 10 * np.log10(np.mean(x * x) / np.mean(added * added)) == pytest.approx(10)


def test_missing_columns_show_when_the_plan_is_built(spark):
    df = spark.createDataFrame([("u", [1.0])], "utt string, wave array<double>")
    with pytest.raises(ValueError, match="stage speed_class needs label, speed_index"):
        chain.chained(df, [chain.speed_class(3)], "utt")
    assert chain.chained(df.where("false"), [chain.crop("c", "utt", 3)], "utt", "wave").count() == 0
