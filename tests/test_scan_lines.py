"""Positions of lines in files that are read in many splits, and in parts of one text."""

from pyspark.sql import functions as F

from sonagrid import scan_queries
from sonagrid.sources import text_tables


def test_lines_are_numbered_split_by_split(spark, tmp_path):
    want = {}
    for name, n in (("a", 5000), ("b", 3), ("c", 2000)):
        want[name] = [f"{name} line {i} {'x' * (i * 7 % 50)}" for i in range(n)]
        (tmp_path / name).write_text("".join(t + "\n" for t in want[name]))
    former = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = text_tables.lines(spark, str(tmp_path))
        parts = rows.where("value LIKE 'a %'").select(F.spark_partition_id()).distinct().count()
        assert parts > 10  # the largest file isn't one task's
        for name in want:
            got = sorted((r["pos"], r["value"]) for r in rows.collect() if r["file"].endswith(f"/{name}"))
            assert got == list(enumerate(want[name]))
        joined = sorted((r["pos"], r["value"]) for r in text_tables.lines(spark, str(tmp_path), joined=True).collect())
        assert joined == list(enumerate(want["a"] + want["b"] + want["c"]))
        assert text_tables.lines(spark, str(tmp_path / "b")).where("value LIKE '%line 1%'").first()["pos"] == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", former)


def test_a_text_is_written_in_ordered_parts(spark):
    former = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else small parts are put together
    try:
        df = spark.range(20_000).select(F.pmod(F.col("id") * 7919, F.lit(20_000)).alias("o")).withColumn("value", F.concat(F.lit("v"), F.col("o")))
        path = scan_queries.in_parts(df, "o", "parts")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", former)
    rows = text_tables.lines(spark, path, joined=True)
    assert rows.select("file").distinct().count() == 4
    assert sorted((r["pos"], r["value"]) for r in rows.collect()) == [(i, f"v{i}") for i in range(20_000)]
