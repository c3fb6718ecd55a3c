"""Vector archives: written, read back whole and by offset; nothing stays of failed writes."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonagrid.sources import archives, binary


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    return spark.createDataFrame([(f"spk{i % 5}-utt{i}", rng.normal(size=1 + i % 7).tolist()) for i in range(57)], "id string, v array<double>").repartition(4)


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


def wanted(vectors):
    return {r[0]: np.asarray(r[1], np.float32).tolist() for r in vectors.collect()}


def test_archives_come_back_whole_and_by_offset(spark, vectors, tmp_path):
    path = f"file://{tmp_path}/a"
    archives.write_vectors(vectors, path, "id", "v")
    want = wanted(vectors)
    assert as_dict(binary.ark_files(spark, path)) == want
    index = archives.index_lines(spark, path)
    assert index.count() == 57 and as_dict(archives.vectors_at(index)) == want
    few = archives.vectors_at(index.where(F.col("utt_id").startswith("spk3")))
    assert as_dict(few) == {k: v for k, v in want.items() if k.startswith("spk3")}
    names = os.listdir(tmp_path / "a")
    assert sorted({n.rsplit(".", 1)[1] for n in names if not n.startswith(".")}) == ["ark", "scp"] and archives.STAGING not in names


def test_modes(spark, vectors, tmp_path):
    path = str(tmp_path / "m")
    archives.write_vectors(vectors.limit(3), path, "id", "v", mode="error")
    with pytest.raises(FileExistsError):
        archives.write_vectors(vectors, path, "id", "v")
    archives.write_vectors(vectors, path, "id", "v", mode="append")
    assert archives.index_lines(spark, path).count() == 60
    archives.write_vectors(vectors.limit(2), path, "id", "v", mode="overwrite")
    assert archives.index_lines(spark, path).count() == 2
    with pytest.raises(ValueError, match="no such mode"):
        archives.write_vectors(vectors, path, "id", "v", mode="ignore")


def test_single_files(vectors, tmp_path):
    path = str(tmp_path / "n")
    archives.write_vectors(vectors.withColumn("id", F.replace("id", F.lit("-"), F.lit("/"))), path, "id", "v", form="npy")
    got = {n[:-4]: np.load(f"{path}/{n}").tolist() for n in os.listdir(path) if n.endswith(".npy")}
    assert got == wanted(vectors)


def test_a_failed_write_leaves_nothing_and_keeps_what_was(spark, vectors, tmp_path):
    path = str(tmp_path / "f")
    archives.write_vectors(vectors.limit(5), path, "id", "v")
    before = sorted(os.listdir(path))
    bad = vectors.withColumn("id", F.when(F.col("id").endswith("7"), F.lit("two words")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="no key of an archive"):
        archives.write_vectors(bad, path, "id", "v", mode="overwrite")
    assert sorted(os.listdir(path)) == before and archives.index_lines(spark, path).count() == 5


def test_nulls_and_empty_tables(spark, vectors, tmp_path):
    path = str(tmp_path / "e")
    archives.write_vectors(vectors.where("false"), path, "id", "v")
    archives.write_vectors(spark.createDataFrame([("a", None), ("b", [])], "id string, v array<double>"), path, "id", "v", mode="append")
    assert as_dict(binary.ark_files(spark, path)) == {"b": []}
