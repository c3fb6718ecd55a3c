"""Golden cases and restated loops for the operators; whole-table queries are compared with SQL by the driver."""

import random
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sonagrid.functions import scalars, signal, vectors
from sonagrid.operators import der, intervals, labels, manifests, tracks, transcripts, trials
from sonagrid.sources import binary, text_tables

SF = "/root/testdata/sf0.001"
SPANS = "rec int, seq int, st double, ed double, label string"


def spans(spark, rows):
    return spark.createDataFrame([(1, i, float(a), float(b), c) for i, (a, b, *r) in enumerate(rows) for c in [r[0] if r else "A"]], SPANS)


def pairs(df):
    return sorted((r["st"], r["ed"]) for r in df.collect())


def test_merges_differ(spark):
    df = spans(spark, [(0, 10), (2, 3), (3.5, 4), (10, 11)])
    assert pairs(intervals.merge_intervals(df, ["rec"])) == [(0, 11)]
    assert pairs(intervals.merge_intervals(df, ["rec"], "last")) == [(0, 3), (3.5, 4), (10, 11)]
    assert pairs(intervals.merge_intervals(df, ["rec"], "last_drop")) == [(0, 3), (3.5, 4)]
    assert pairs(intervals.merge_intervals(spans(spark, [(0, 1)]), ["rec"], "last_drop")) == []
    with pytest.raises(ValueError):
        intervals.merge_intervals(df, ["rec"], "other")


def test_compress(spark):
    df = spans(spark, [(0, 1.5, "A"), (0.75, 2.25, "A"), (1.5, 3, "B")])
    assert pairs(intervals.compress_labels(df, ["rec"])) == [(0, 1.875), (1.875, 3)]


def test_chunks(spark):
    of = lambda a, b: pairs(intervals.sliding_chunks(spans(spark, [(a, b)])))
    assert of(0, 3) == [(0, 1.5), (0.75, 2.25), (1.5, 3)] and of(0, 0.75) == [] and of(0, 1) == [(0, 1)]
    rows = spark.createDataFrame([(7.0,), (2.0,)], "dur double")
    assert sorted((r["dur"], r["start"], r["stop"]) for r in intervals.fixed_chunks(rows, "dur").collect()) == [(2, 0, 2), (7, 0, 3), (7, 3, 6)]


def test_eer_threshold(spark):
    rows = [(0.1, 0), (0.2, 0), (0.3, 1), (0.4, 0), (0.5, 0), (0.6, 1), (0.7, 1), (0.8, 1)]
    curve = trials.det_curve(spark.createDataFrame(rows, "score double, label int"))
    got = trials.eer(curve).first()
    assert (got["eer"], got["threshold"]) == (0.25, 0.4)
    one = trials.eer(trials.det_curve(spark.createDataFrame([(0.1, 1)], "score double, label int"))).first()
    assert one["eer"] is None


def test_average_precision(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1)], "score double, label int")
    assert abs(trials.average_precision(df, "score", "label").first()["ap"] - 5 / 6) < 1e-12


def test_unknown_trial_fails(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0])], "utt_id long, embedding array<double>")
    t = spark.createDataFrame([(1, 2)], "enrol long, test long")
    with pytest.raises(KeyError):
        trials.score_trials(t, v, v)
    assert trials.score_trials(t, v, v, strict=False).count() == 0


def test_der_golden(spark):
    ref = spark.createDataFrame([("f", 0.0, 10.0, "A")], "file string, st double, ed double, speaker string")
    sys = spark.createDataFrame([("f", 0.0, 8.0, "X"), ("f", 8.0, 12.0, "Y"), ("g", 0.0, 1.0, "X")], ref.schema)
    got = der.der(ref, sys, ["file"]).where("file = 'f'").first()
    assert (got["scored"], got["ms"], got["fa"], got["der"]) == (10, 0, 0, 20)


def test_der_atoms_match_event_loop(spark):
    r = random.Random(1)
    ref = [("f", float(a), a + float(r.randrange(1, 9)), r.choice("AB")) for a in r.sample(range(60), 14)]
    sys = [("f", float(a), a + float(r.randrange(1, 9)), r.choice("XYZ")) for a in r.sample(range(60), 14)]
    kind = "file string, st double, ed double, speaker string"
    a, b = spark.createDataFrame(ref, kind), spark.createDataFrame(sys, kind)
    got = intervals.atoms(intervals.extent(a, ["file"]), a, b, ["file"]).collect()
    lo, hi = min(x[1] for x in ref), max(x[2] for x in ref)
    at = lambda rows, t: sorted({s for _, x, y, s in rows if x <= t < y})
    assert abs(sum(g["ed"] - g["st"] for g in got) - (hi - lo)) < 1e-9 or any(not g["ref"] for g in got)
    for g in got:
        middle = (g["st"] + g["ed"]) / 2
        assert (g["ref"], g["sys"]) == (at(ref, middle), at(sys, middle))


def test_collars_and_overlap(spark):
    ref = spark.createDataFrame([(1, 0.0, 10.0), (1, 8.0, 20.0)], "k int, st double, ed double")
    uem = intervals.extent(ref, ["k"])
    assert pairs(intervals.subtract_collars(uem, ref, ["k"], 1.0)) == [(1, 7), (11, 19)]
    assert pairs(intervals.subtract_overlap(uem, ref, ["k"])) == [(0, 8), (10, 20)]


def test_hungarian_is_optimal():
    from itertools import permutations

    r = np.random.default_rng(0)
    for _ in range(60):
        n, m = r.integers(1, 5, 2)
        g = np.where(r.random((n, m)) < 0.3, 0, r.integers(1, 20, (n, m))).astype(float)
        got = sum(g[i, j] for i, j in der.hungarian(g))
        wide = g.T if n > m else g
        best = max(sum(wide[i, p[i]] for i in range(len(wide))) for p in permutations(range(wide.shape[1]), len(wide)))
        assert got == best


def test_minor_cluster_boundary(spark):
    rows = [(0, i, 5, [1.0, 0.0]) for i in range(6)] + [(0, 10 + i, 7, [0.9, 0.1]) for i in range(4)]
    df = spark.createDataFrame(rows, "rec int, seq int, label int, embedding array<double>")
    assert {r["label"] for r in labels.absorb_minor(df, ["rec"], min_size=4).collect()} == {5}
    assert {r["label"] for r in labels.absorb_minor(df, ["rec"], min_size=10).collect()} == {0}


def test_clusters_find_blobs(spark):
    r = np.random.default_rng(2)
    centres = np.eye(8)[:3] * 10
    rows = [(n, i, (centres[i % 3] + r.normal(size=8) * 0.1).tolist()) for n, size in ((0, 30), (1, 90), (2, 1)) for i in range(size)]
    df = spark.createDataFrame(rows, "rec int, seq int, embedding array<double>")
    for method in ("ahc", "spectral"):
        got = labels.cluster_embeddings(df, ["rec"], "seq", "embedding", method).collect()
        for n in (0, 1):
            assert len({(g["seq"] % 3, g["label"]) for g in got if g["rec"] == n}) == 3
    with pytest.raises(ValueError):
        labels.cluster_embeddings(df, ["rec"], "seq", "embedding", "umap")


def test_arrange_first_seen_and_sorted(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate([9, 3, 9, 5])], "rec int, seq int, label int")
    assert [r["label"] for r in labels.arrange_labels(df, ["rec"], "seq", "label").orderBy("seq").collect()] == [0, 1, 0, 2]
    assert [r["label"] for r in labels.sorted_labels(df, ["rec"], "label").orderBy("seq").collect()] == [2, 0, 2, 1]


def test_sentences_and_windows(spark):
    df = spark.createDataFrame([("好。吗？嗯",)], "content string")
    assert [r["content"] for r in transcripts.split_sentences(df).orderBy("k").collect()] == ["好。", "吗？", "嗯"]
    rows = [("a", "x" * 10)] * 4
    assert [w[0] for w in transcripts.windows_of(rows, 96, 32)] == [2]  # a single window keeps only the one from the end


def test_punctuation(spark):
    df = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "a", "y"), (1, 2, "b", "z。")], "u int, t int, s string, c string")
    assert [r["c"] for r in transcripts.repair_punctuation(df, ["u"], "t", "s", "c").orderBy("t").collect()] == ["x，", "y。", "z。"]


def test_tracks_and_suppression(spark):
    rows = [(1, [0.0, 0.0, 10.0, 10.0], 0.9), (1, [1.0, 1.0, 10.0, 10.0], 0.8), (1, [20.0, 20.0, 30.0, 30.0], 0.7)]
    got = tracks.nms(spark.createDataFrame(rows, "f int, box array<double>, score double"), ["f"], "box", "score").collect()
    assert sorted(g["score"] for g in got) == [0.7, 0.9]
    frames = [(1, f, [float(f), 0.0, f + 50.0, 50.0]) for f in range(30) if f % 7]
    out = tracks.track_boxes(spark.createDataFrame(frames, "s int, frame int, box array<double>"), ["s"], "frame", "box").collect()
    assert {g["track"] for g in out} == {0} and len(out) == 29


def test_manifest_checks(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    with pytest.raises(ValueError):
        manifests.assert_unique(df, "k")
    with pytest.raises(ValueError):
        manifests.assert_vocab(df, "k", ["b"])
    with pytest.raises(ValueError):
        manifests.error_budget(df, F.col("v") == 1)
    assert manifests.last_wins(df, ["k"], "v").collect()[0] == ("a", 2)


def test_text_sources(spark, tmp_path):
    (tmp_path / "wav.scp").write_text("a p1\nb  p2\na p3\n")
    assert sorted(map(tuple, text_tables.wav_scp(spark, str(tmp_path / "wav.scp")).collect())) == [("a", "p3"), ("b", "p2")]
    with pytest.raises(ValueError):
        text_tables.strict_pairs(spark, str(tmp_path / "wav.scp"), ("utt_id", "path"))
    (tmp_path / "x.rttm").write_text(";; comment\n\nSPEAKER f 1 0.5 2.0 <NA> <NA> s1 <NA>\nSPEAKER f 1 3 <na> <NA> <NA> s*2 <NA>\n")
    got = text_tables.rttm(spark, str(tmp_path / "x.rttm")).orderBy("pos").collect()
    assert [(r["tbeg"], r["tend"], r["tmid"], r["spkr"]) for r in got] == [(0.5, 2.5, 1.5, "s1"), (3.0, 3.0, 3.0, "s2")]
    (tmp_path / "x.uem").write_text("d/f.wav 1 0 5\nf 1 4 6\n")
    with pytest.raises(ValueError):
        text_tables.uem(spark, str(tmp_path / "x.uem"))
    (tmp_path / "t").write_text("s1 0.5 1 你 好\ns2 1 2\n")
    assert [r["content"] for r in text_tables.trans7time(spark, str(tmp_path / "t")).orderBy("pos").collect()] == ["你好", ""]
    (tmp_path / "s.json").write_text('{"r_0_1": {"file": "f", "start": 0, "stop": 1}}')
    assert tuple(text_tables.json_segments(spark, str(tmp_path / "s.json")).first()) == ("r_0_1", "f", 0.0, 1.0)
    (tmp_path / "c").write_text("<AddShift> 2 2\n<LearnRateCoef> 0 [ 1 2 ]\n<Rescale> 2 2\n<LearnRateCoef> 0 [ 3 4 ]\n")
    assert text_tables.cmvn(spark, str(tmp_path / "c")) == ([1.0, 2.0], [3.0, 4.0])


def test_write_once(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    assert text_tables.write_once(spark.range(3), path, {"a": 1}) and not text_tables.write_once(spark.range(3), path, {"a": 1})
    with pytest.raises(ValueError):
        text_tables.write_once(spark.range(3), path, {"a": 2})


def test_wav_and_ark(spark, tmp_path):
    pcm = np.array([[0, 1000], [2000, -3000]], "<i2")
    body = pcm.tobytes()
    head = b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32000, 4, 16)
    (tmp_path / "x.wav").write_bytes(head + b"LIST" + struct.pack("<I", 4) + b"abcd" + b"data" + struct.pack("<I", len(body)) + body)
    mean = binary.wav_files(spark, str(tmp_path)).first()
    assert (mean["rate"], mean["samples"]) == (8000, [500 / 32768, -500 / 32768])
    assert binary.wav_files(spark, str(tmp_path), channels="first", divisor=32767.0).first()["samples"] == [0.0, 2000 / 32767]
    (tmp_path / "1.ark").write_bytes(binary.ark_bytes([("a", np.array([1.0, 2.0])), ("b", np.array([3.0]))]))
    (tmp_path / "2.ark").write_bytes(binary.ark_bytes([("a", np.array([5.0]))]))
    assert sorted((r["utt_id"], r["embedding"]) for r in binary.ark_files(spark, str(tmp_path)).collect()) == [("a", [5.0]), ("b", [3.0])]


def test_fbank_shape(spark):
    wav = np.sin(np.arange(4000) / 5).tolist()
    df = spark.createDataFrame([(wav,)], "w array<double>")
    got = np.array(df.select(signal.fbank(F.col("w"), 40, 16000)).first()[0])
    assert got.shape == (1 + (4000 - 400) // 160, 40) and np.allclose(got.mean(axis=0), 0, atol=1e-9)
    frames = df.select(F.size(vectors.frames(F.col("w"), 400, 160))).first()[0]
    assert frames == got.shape[0]
    rir = df.select(signal.convolve(F.col("w"), F.array(F.lit(1.0), F.lit(0.5)))).first()[0]
    assert len(rir) == 4000 and abs(max(map(abs, rir)) - 1) < 1e-5


def test_scalar_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(scalars.last_parts(F.lit("a/b/c.wav"), 2)) == "b/c.wav" and one(scalars.stem(F.lit("a/b.c.wav"))) == "b.c"
    assert one(scalars.recording_of(F.lit("r_1_0.5_2.0"))) == "r_1"
    assert one(scalars.iou(F.array(*map(F.lit, (0.0, 0.0, 2.0, 2.0))), F.array(*map(F.lit, (1.0, 0.0, 3.0, 2.0))))) == pytest.approx(1 / 3)
    assert one(scalars.int_list(F.lit("[0, 1, 1]"), F.lit(2))) == [0, 1]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1


CHECKED = ["trial_eer", "avg_precision", "confusion", "intervals_merge_last", "der_atoms", "minor_cluster", "word_attribution", "segment_table", "lfr", "session_merge", "collar_uem"]


@pytest.mark.parametrize("name", CHECKED)
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, SF)
    got = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    flat = lambda v: float(v) if type(v).__name__ == "Decimal" else v
    want = sorted(repr(tuple(flat(v) for v in r)) for r in got.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == want


def test_mapping_of_many_keys_passes_in_batches(spark):
    rng = np.random.default_rng(2)
    rows = [(k, f"r{a}", f"s{b}", float(w)) for k in range(3000) for a in range(1 + k % 3) for b in range(1 + k % 4) for w in rng.integers(0, 4, 1 + (a + b) % 2)] + [(7, None, "s0", 9.0), (3001, "r0", None, 1.0)]
    pairs = spark.createDataFrame(rows, "k int, ref string, sys string, ov double")
    mapped = der.best_mapping(pairs, ["k"])
    plan = mapped._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan  # no Python call with frames for each key
    got = {}
    for r in mapped.collect():
        got.setdefault(r["k"], {})[r["ref"]] = (r["sys"], r["ov"])
    for k in range(3000):
        gain = np.zeros((1 + k % 3, 1 + k % 4))
        for _, a, b, w in (r for r in rows if r[0] == k and r[1]):
            gain[int(a[1:]), int(b[1:])] += w
        assert got.get(k, {}) == {f"r{a}": (f"s{b}", gain[a, b]) for a, b in der.hungarian(gain)}
