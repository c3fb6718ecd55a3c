"""Queries that do the whole job where an older one, whose SQL stays as it is, takes a part."""

import time

import duckdb
import numpy as np
import pytest
import test_library as library
from pyspark.sql import functions as F

import __spark_entry__
from sonagrid import queries, shared
from sonagrid.operators import transcripts, trials

SF = library.SF


@pytest.mark.parametrize("name", ["change_point_labels", "change_point_labels_whole", "frames_to_segments_whole", "trial_scores_whole", "trial_eer_whole", "trial_eer", "soft_nearest_whole", "koleo_entropy_whole"])
def test_whole_queries_equal_sql(spark, name):
    library.test_queries_equal_sql(spark, name)


def test_every_character_has_a_label(spark):
    c = spark.read.parquet(f"{SF}/conversations.parquet").where(F.length("text") > 0)
    want = {(r["conv_id"], r["turn"]): r["n"] for r in c.select("conv_id", "turn", F.length("text").alias("n")).collect()}
    got = {(r["conv_id"], r["turn"]): len(r["labels"]) for r in __spark_entry__.queries()["change_point_labels_whole"](spark, SF).collect()}
    assert got == want and max(got.values()) > 64
    df = spark.createDataFrame([("é.😀" + "x" * 70 + "!",), ("",)], "t string")
    labels = [r[0] for r in df.select(transcripts.change_labels(F.col("t"), F.array(F.lit(1)), ".!")).collect()]
    assert labels == [[1, 0, *[-100] * 71, 0], []]


def test_every_event_takes_part(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    voiced = queries.voiced_segments(spark, SF)
    assert voiced.count() == events.count() == voiced.select("event_id").distinct().count()
    vectors = {r["vec_id"]: [float(x) for x in r["embedding"]] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    place = sorted(vectors)
    assert all(r["embedding"] == vectors[place[r["event_id"] % len(place)]] for r in voiced.collect())
    got = {(r["rec"], r["seq"]) for r in __spark_entry__.queries()["joint_av_labels"](spark, SF).collect()}
    assert got == {(r["rec"], r["seq"]) for r in queries.segments(spark, SF).where("event_id % 2 = 0").collect()}


def test_trials_reach_all_vectors(spark):
    ids = {r["vec_id"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()}
    rows = queries.whole_trial_list(spark, SF).select("enrol", "test").collect()
    assert {r["enrol"] for r in rows} == ids and {r["test"] for r in rows} == ids


def test_nearest_of_all(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(60, 8))
    x[7] = 2 * x[50]  # a copy but for its length
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "utt_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    far = np.linalg.norm(u[:, None] - u[None], axis=2) + np.diag([9.0] * 60)
    got = {r["utt_id"]: r["apart"] for r in trials.nearest_apart(df).collect()}
    assert [got[i] for i in range(60)] == pytest.approx(list(far.min(1)), abs=1e-12)
    assert trials.nearest_apart(df.where("utt_id = 1")).count() == 0


def test_frames_at_the_threshold_stay(spark, tmp_path):
    """A third of all frames exactly at the threshold: the query equals its SQL, the one that leaves them out doesn't."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.withColumn("value", F.when(F.col("event_id") % 3 == 0, 20.0).otherwise(F.col("value"))).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(__spark_entry__.oracle_sql()["frames_to_segments_whole"]).fetchall())
    of = lambda name: sorted(tuple(r) for r in __spark_entry__.queries()[name](spark, str(tmp_path)).select("rec", "st", "ed").collect())
    assert of("frames_to_segments_whole") == want and of("frames_to_segments") != want


def test_large_batches_of_trials_cost_their_rows(spark):
    """A batch of 100,000 trials: sent with null lists, each row made Arrow go over all before it (about half a minute)."""
    vecs = spark.range(400).select(F.col("id").alias("utt_id"), F.array(F.col("id") * 1.0, F.lit(1.0)).alias("embedding"))
    pairs = spark.range(100_000).select((F.col("id") % 400).alias("enrol"), F.floor(F.col("id") / 400).alias("test"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    trials.score_trials(pairs.limit(10), vecs, vecs, strict=False, least=1).collect()  # starts the workers
    spark.conf.set(key, "100000")
    try:
        began = time.perf_counter()
        n, s = trials.score_trials(pairs, vecs, vecs, strict=False, least=1).agg(F.count("score"), F.sum("score")).first()
        took = time.perf_counter() - began
    finally:
        spark.conf.set(key, old)
    x = np.stack([np.arange(400.0), np.ones(400)], axis=1)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert n == 100_000 and s == pytest.approx((u @ u[:250].T).sum(), rel=1e-9) and took < 12


@pytest.mark.parametrize("name", ["sinkhorn_whole", "sinkhorn"])
def test_balanced_trials_equal_sql(spark, name):
    library.test_queries_equal_sql(spark, name)


def test_sums_travel_and_rows_stay(spark, monkeypatch):
    """Balanced by sides as numpy does it, nulls a side of their own; rows pass no shuffle while sums are few, else a join."""
    r = np.random.default_rng(5)
    q = r.random((7, 9)) + 0.1
    want = q.copy()
    for _ in range(3):
        want = want / want.sum(0)
        want = want / want.sum(1, keepdims=True)
    name = lambda i: None if i == 3 else i
    df = spark.createDataFrame([(name(i), name(j), float(q[i, j])) for i in range(7) for j in range(9)], "r int, c int, q double")
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    for most in (1_000_000, 0):
        spark.conf.set(key, old if most else "-1")
        monkeypatch.setattr(trials, "BROADCAST_ROWS", most)
        out = trials.balanced(df, ["c", "r"] * 3, "q")
        assert out.columns == ["r", "c", "q"]
        got = {(x["r"], x["c"]): x["q"] for x in out.collect()}
        assert len(got) == 63 and all(got[name(i), name(j)] == pytest.approx(want[i, j], rel=1e-12) for i in range(7) for j in range(9))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert ("Exchange hashpartitioning" in plan) == (most == 0) and "Window" not in plan
    spark.conf.set(key, old)
    monkeypatch.undo()
    whole = __spark_entry__.queries()["sinkhorn_whole"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in whole and "Window" not in whole


@pytest.mark.parametrize("name", ["score_histogram_whole", "score_topk_whole", "p_prune_whole", "score_lines_five_whole", "score_writer_whole"])
def test_trials_read_once_are_not_stored(spark, name):
    before = set(shared._WRITTEN)
    library.test_queries_equal_sql(spark, name)
    assert not [p for p in shared._WRITTEN - before if "/trials-" in p]


def test_weighed_trials_stay(spark):
    """Counts come to the trials, which pass no shuffle by part on their way to their weights."""
    df = spark.createDataFrame([(1, 1), (1, 0), (1, 0), (2, 1), (None, 1)], "p int, y int")
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        out = trials.equalised_weights(df, "y", ["p"], 10.0, 100.0)
        assert sorted(map(tuple, out.collect())) == [(1, 0, 50.0), (1, 0, 50.0), (1, 1, 10.0), (2, 1, 10.0)]
        assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, old)
    library.test_queries_equal_sql(spark, "equalized_weights_whole")


@pytest.mark.parametrize("name", ["min_dcf_sweep_whole", "avg_precision_whole"])
def test_summed_columns_travel_once(spark, name, monkeypatch):
    """What is dealt by ranges and stored there: score, sides, the summed columns and the range."""
    seen, keep = [], trials.stored
    monkeypatch.setattr(trials, "stored", lambda df, label: seen.append((label, df.columns)) or keep(df, label))
    library.test_queries_equal_sql(spark, name)
    assert [c for label, c in seen if label == "ranges" and "score" in c] == [["score", "enrol", "test", *{"min": ["_t", "_i"], "avg": ["y"]}[name[:3]], "_bin"]]
