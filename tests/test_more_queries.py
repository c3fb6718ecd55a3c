"""Queries over formats, selections and regions equal their SQL, and their operators take odd rows."""

import pytest
import test_library as library
from pyspark.sql import functions as F

import __spark_entry__
from sonagrid import more_queries, queries
from sonagrid.operators import regions, selection
from sonagrid.sources import text_tables

NAMES = sorted(n for n, f in queries.queries().items() if f.__module__ == more_queries.__name__)


@pytest.mark.parametrize("name", NAMES)
def test_more_queries_equal_sql(spark, name):
    library.test_queries_equal_sql(spark, name)
    assert __spark_entry__.queries()[name](spark, library.SF).count() > 0


def test_selection_takes_odd_rows(spark):
    df = spark.createDataFrame([(1, "a", 0.95), (1, "b", 0.95), (1, None, None), (2, "c", 0.1)], "k long, x string, p double")
    assert [tuple(r) for r in selection.confident(df, ["k"], "p", "x", most=1).collect()] == [(1, "a", 0.95, 1)]
    assert [r["reason"] for r in selection.with_reasons(df, {"none": F.col("x").isNull(), "low": F.col("p") < 0.5}).collect()] == [None, None, "none", "low"]
    lines = spark.createDataFrame([("e1  u1 u2",), ("e2",), ("",), (None,)], "value string")
    assert sorted(map(tuple, selection.enrolments(lines).collect())) == [("e1", "u1"), ("e1", "u2")]
    none = selection.token_scores(df.where("false").select(F.col("k").alias("t"), F.col("k").alias("p")), "t", "p").first()
    assert tuple(none) == (0.0, 0.0, 0.0, 0.0)


def test_anchors(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 10.0), (1, 3, None), (1, 4, 20.0), (1, 5, None), (2, 1, None)], "k long, i long, t double")
    got = [r["aligned"] for r in regions.between_anchors(df, ["k"], "i", "t").orderBy("k", "i").collect()]
    assert got == [10.0, 10.0, 15.0, 20.0, 20.0, None]


def test_json_forms_agree(spark, tmp_path):
    rows = spark.createDataFrame([("r", "s1", "f", 0.5, 1.5), ("r", "s2", "f", 2.0, 3.0)], "rec string, segid string, file string, start double, stop double")
    text_tables.segments_json(rows).select("value").write.text(str(tmp_path / "j"))
    read = [sorted(map(tuple, f(spark, str(tmp_path / "j")).collect())) for f in (text_tables.json_segments, text_tables.json_objects)]
    assert read[0] == read[1] == [("s1", "f", 0.5, 1.5), ("s2", "f", 2.0, 3.0)]
