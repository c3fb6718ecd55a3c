"""Shots, typed times, crops, noise, quantiles and numbers against Python."""

import random
import time
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonagrid.functions import draws, scalars
from sonagrid.operators import manifests, scoring, selection, tracks, transcripts, trials
from sonagrid.shared import purge, stored
from sonagrid.sources import text_tables


def test_shots_begin_anew_in_each_interval(spark):
    rows = [(1, 0, 0, 640 * 119 + 5), (1, 1, 640 * 200, 640 * 249), (1, 2, 640 * 300 + 639, 640 * 301), (1, 3, 640, 0)]
    got = selection.shots_by_interval(spark.createDataFrame(rows, "rec int, seq int, st long, ed long"), ["rec"]).orderBy("seq", "shot").collect()
    assert [(r["seq"], r["shot"], r["first"], r["frames"]) for r in got] == [(0, 0, 0, 50), (0, 1, 50, 50), (0, 2, 100, 20), (1, 0, 200, 50), (2, 0, 300, 2)]
    assert got[2]["detected"] == [100, 105, 110, 115] and got[3]["detected"] == list(range(200, 250, 5)) and got[4]["detected"] == [300]


def test_types_meet_as_often_as_both_have_them(spark):
    pieces = spark.createDataFrame([(1, 0.0, 2.0, ["a", "b"], ["x"]), (1, 2.0, 3.0, ["c"], []), (1, 3.0, 7.0, [], ["x", "y"]), (1, 7.0, 8.0, ["a"], ["x", "y"])], "rec int, st double, ed double, ref array<string>, sys array<string>")
    pieces = pieces.withColumns({"n_ref": F.size("ref"), "n_sys": F.size("sys")})
    ref = spark.createDataFrame([(1, "a", "adult"), (1, "b", "adult"), (1, "c", "child")], "rec int, speaker string, type string")
    sys = spark.createDataFrame([(1, "x", "adult"), (1, "y", "adult")], "rec int, speaker string, type string")
    got = {tuple(r)[:2]: r["seconds"] for r in scoring.speaker_type_times(pieces, ref, sys, ["rec"]).collect()}
    assert got == {("adult", "adult"): 3.0, ("adult", "MISS"): 2.0, ("child", "MISS"): 1.0, ("FALSE ALARM", "adult"): 9.0}


def test_crops_are_from_different_places(spark):
    waves = [[float(i) for i in range(n)] for n in (0, 3, 16, 17, 19, 40, 400)]
    df = spark.createDataFrame([(k, w) for k, w in enumerate(waves)], "k int, w array<double>")
    got = df.select("k", draws.crop_set(F.col("w"), 16, 3, 4, "s", F.col("k")).alias("c")).orderBy("k").collect()
    for k, c in got:
        w = waves[k] + [0.0] * max(19 - len(waves[k]), 0)
        assert [len(x) for x in c["whole"]] == [16] * 3 and [len(x) for x in c["halves"]] == [8] * 4
        if len(waves[k]) >= 19:
            assert len({x[0] for x in c["whole"]}) == 3 and len({x[0] for x in c["halves"]}) == 4
        assert all(any(w[i : i + len(x)] == x for i in range(len(w))) for x in [*c["whole"], *c["halves"]])


def test_noise_is_standard_normal(spark):
    x = np.array([r[0] for r in spark.range(20_000).select(draws.normal("s", F.col("id"))).collect()])
    assert abs(x.mean()) < 0.03 and abs(x.std() - 1) < 0.03 and abs(np.mean(np.abs(x) < 1) - 0.6827) < 0.01
    assert spark.createDataFrame([([1.0],)], "w array<double>").select(draws.dithered(F.col("w"), 0.0, "s")).first()[0] == [1.0]


def test_probit_is_the_normal_quantile(spark):
    p = [1e-12, 1e-6, 0.01, 0.02425, 0.1, 0.5, 0.7, 0.97575, 0.999, 1 - 1e-12]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in p], "p double").select(trials.probit(F.col("p"))).collect()]
    assert np.allclose(got, [NormalDist().inv_cdf(x) for x in p], rtol=2e-9, atol=1e-9)


def test_numbers_as_python_writes_them(spark):
    rng = random.Random(1)
    v = [0.0, 1.0, 100.0, 99.999, 0.1235, 4605.0, 22450.0, -3.5, 999.5, 9995.0, 1.005, 2.675, 50.125] + [rng.uniform(-1, 1) * 10 ** rng.randrange(-9, 12) for _ in range(500)] + [rng.randrange(1, 10**6) / 8 for _ in range(500)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in v], "x double").select(scalars.log_number(F.col("x"))).collect()]
    assert got == [f"{x:.2f}" if 1 < x < 100 else f"{x:.2e}" for x in v]


def test_boxes_and_gaps(spark):
    one = spark.range(1)
    box = lambda *b: one.select(scalars.frame_box(F.array(*map(F.lit, b)), F.lit(100), F.lit(50))).first()[0]
    assert box(-0.1, 0.5, 0.999, 1.2) == [0, 25, 99, 50]
    gap = lambda *x: one.select(scalars.gap_overlap(*[F.lit(float(v)) for v in x[:4]], x[4])).first()[0]
    assert gap(0, 2, 1, 3, 0.0) == 1 and gap(0, 2, 3, 4, 0.5) == 0 and gap(0, 2, 2, 3, 1.0) == pytest.approx(1 / 1.5)


def test_manifests_must_have_the_same_keys(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(1, "p"), (2, "q")], "k int, w string")
    assert sorted(map(tuple, manifests.joined_strict(a, b, "k").collect())) == [(1, "x", "p"), (2, "y", "q")]
    with pytest.raises(Exception, match="a manifest lacks 2"):
        manifests.joined_strict(a, b.where("k = 1"), "k").collect()


def test_inputs_of_one_or_another_kind(spark, tmp_path):
    (tmp_path / "l.scp").write_text("a.wav\n\n b.wav \n")
    assert [r[0] for r in text_tables.wav_or_list(spark, str(tmp_path / "l.scp")).collect()] == ["a.wav", "b.wav"]
    assert text_tables.wav_or_list(spark, "x/y.wav").collect()[0][0] == "x/y.wav"
    (tmp_path / "t.csv").write_text("a,b\n1,2\n")
    assert text_tables.table_of(spark, str(tmp_path / "t.csv")).collect()[0].asDict() == {"a": "1", "b": "2"}
    with pytest.raises(ValueError, match="one kind"):
        text_tables.table_of(spark, "a.csv", "b.json")


def test_equal_scores_go_by_coordinates(spark):
    rows = [(1, [x, 0.0, x + 10, 10.0], 1.0) for x in (10.0, 0.0, 1.0)]
    for part in (rows, rows[::-1]):
        got = tracks.nms(spark.createDataFrame(part, "k int, box array<double>, s double"), ["k"], "box", "s").orderBy("rank").collect()
        assert [r["box"][0] for r in got] == [0.0, 10.0]


def test_named_conditions():
    assert scoring.condition("scores", "metadata") == {"NOSCORE": ["<na>"], "SU": ["unannotated"], "LEXEME": ["un-lex"]}
    assert scoring.condition("scores", "metadata", "NONE") == {}
    with pytest.raises(ValueError, match="DEFAULT: NON-LEX laugh"):
        scoring.condition("scores", "speakers", "MIN")


def test_lengths_fit_each_other(spark):
    got = [tuple(r[0]) for r in spark.createDataFrame([(103, 25), (103, 30), (7, 9), (400, 99)], "a int, v int").select(scalars.paired_lengths(F.col("a"), F.col("v"))).collect()]
    assert got == [(100, 25), (100, 25), (4, 1), (396, 99)]


def test_what_was_stored_can_be_deleted(spark):
    kept = stored(spark.range(5), "x")
    assert kept.count() == 5 and purge(spark) >= 1 and purge(spark) == 0
    with pytest.raises(Exception, match="(?i)not.*exist|FAILED_READ_FILE|PATH_NOT_FOUND"):
        spark.read.schema(kept.schema).parquet(*kept.inputFiles()[:1] or ["/nowhere/at/all"]).count()


def test_bars_of_a_long_text_cost_its_length(spark):
    text = "aé𝄞 " * 50_000
    df = spark.createDataFrame([(0, text, None), (1, text, [0, 1] * 3), (2, "ab", [1, 1, 1]), (3, "", [1]), (4, None, [1])], "k int, text string, labels array<int>")
    began = time.monotonic()
    got = {r["k"]: r["t"] for r in df.select("k", transcripts.with_bars(F.col("text"), F.col("labels")).alias("t")).collect()}
    assert time.monotonic() - began < 20
    assert got == {0: text, 1: "aé|𝄞 |aé|" + text[6:], 2: "a|b|", 3: "", 4: ""}


def test_times_in_segment_names_are_rounded_as_python_rounds(spark):
    durs = [12.25, 2.25, 0.15, 0.35, 2.85, 29.75, 19.85, 2.95, 0.0, 1.05]
    m = spark.createDataFrame([(k, f"w/{k}", d) for k, d in enumerate(durs)], "utt_id long, path string, dur double")
    s = m.select("utt_id", F.lit(1).alias("spk_id"))
    got = {r["path"]: r["ID"] for r in manifests.segment_table(m, s, random_segment=True).collect()}
    assert got == {f"w/{k}": f"{k}_0.0_{d:.1f}" for k, d in enumerate(durs)}
    got = {r["path"]: r["ID"] for r in manifests.segment_table(m, s, 3.0).where("start = 0").collect()}
    assert got == {f"w/{k}": f"{k}_0.0_{min(d, 3.0):.1f}" for k, d in enumerate(durs)}
