"""Queries over formats (written, then read again), selections and regions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors
from .operators import regions, selection
from .queries import SEG, query, rounded, scored, segments, table
from .queries import SCORED as SCORED_SQL
from .shared import shared_path, written_lines
from .sources import text_tables as tt


@query("SELECT page_id::VARCHAR AS utt_id, url AS path FROM pages")
def wav_scp_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("id", F.col("page_id").cast("string"))
    return tt.wav_scp(spark, written_lines(tt.scp_lines(p, "id", "url"), "scp"))


@query("SELECT s_suppkey || '_x' AS utt_id, s_nationkey || '_x' AS spk_id FROM supplier")
def utt2spk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("u"), F.col("s_nationkey").cast("string").alias("s"))
    return tt.strict_pairs(spark, written_lines(tt.scp_lines(s, "u", "s"), "utt2spk"), ("utt_id", "spk_id"), "x", both=True)


@query(SEG + "SELECT event_id::VARCHAR AS ID, round(ed - st, 6) AS dur, label || ', \"' || rec || '\"' AS path, round(st, 6) AS start, round(ed, 6) AS stop, rec::VARCHAR AS spk FROM seg")
def segment_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields with commas and quotes come back as they were."""
    s = segments(spark, sf_dir)
    rows = s.select(F.col("event_id").alias("ID"), (F.col("ed") - F.col("st")).alias("dur"), F.concat("label", F.lit(', "'), "rec", F.lit('"')).alias("path"), F.col("st").alias("start"), F.col("ed").alias("stop"), F.col("rec").alias("spk"))
    path = shared_path(spark, "csv")
    tt.write_segment_csv(rows, path)
    got = tt.segment_csv(spark, path)
    return rounded(got.withColumns({c: F.col(c).cast("double") for c in ("dur", "start", "stop")}), "dur", "start", "stop")


@query(SEG + "SELECT rec::VARCHAR AS name, round(st::DECIMAL(18, 6), 3)::DOUBLE AS tbeg, round((ed - st)::DECIMAL(18, 6), 3)::DOUBLE AS tdur, label AS spkr FROM seg")
def rttm_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = written_lines(tt.rttm_lines(segments(spark, sf_dir), "rec", "st", "ed", "label"), "rttm")
    return tt.rttm(spark, path).select("name", "tbeg", "tdur", "spkr")


@query(SEG + "SELECT rec::VARCHAR AS name, '1' AS chnl, floor(min(st)) AS st, ceil(max(ed)) + 1 AS ed FROM seg GROUP BY rec")
def uem_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = segments(spark, sf_dir).groupBy("rec").agg(F.floor(F.min("st")).alias("a"), (F.ceil(F.max("ed")) + 1).alias("b"))
    return tt.uem(spark, written_lines(ends.select(F.format_string("rec/%s.wav 1 %d %d", F.col("rec").cast("string"), "a", "b").alias("value")), "uem"))


@query("SELECT conv_id || '-' || turn AS spk_id, turn::DOUBLE AS st, turn + 0.5::DOUBLE AS ed, regexp_replace(text, '[ \\t\\n\\f\\r\\x0b]', '', 'g') AS content FROM conversations")
def trans7time_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("spk"), F.col("turn").cast("double").alias("st"), (F.col("turn") + 0.5).alias("ed"), "text")
    return tt.trans7time(spark, written_lines(tt.trans_lines(c, "spk", "st", "ed", "text"), "trans")).drop("pos")


@query(SEG + "SELECT event_id::VARCHAR AS segid, rec::VARCHAR AS file, round(st, 6) AS start, round(ed, 6) AS stop FROM seg")
def json_segments_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).select("rec", F.col("event_id").cast("string").alias("segid"), F.col("rec").cast("string").alias("file"), F.col("st").alias("start"), F.col("ed").alias("stop"))
    path = shared_path(spark, "json")
    tt.segments_json(s).select("value").write.text(path)
    return rounded(tt.json_objects(spark, path), "start", "stop")


@query(SCORED_SQL + " SELECT printf('%d %d %d %.5f', enrol, test, label, score) AS value FROM sc")
def score_lines_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tt.score_lines(scored(spark, sf_dir, once=True))


@query("SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS place FROM embeddings")
def argmax_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.argmax(F.col("embedding")).alias("place"))


@query("SELECT doc_id, CASE WHEN text IS NULL THEN 'empty' WHEN n_chars > 5000 THEN 'too long' WHEN lang NOT IN ('en', 'de') THEN 'language' END AS reason FROM documents")
def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"empty": F.col("text").isNull(), "too long": F.col("n_chars") > 5000, "language": ~F.col("lang").isin("en", "de")}
    return selection.with_reasons(table(spark, sf_dir, "documents"), rules).select("doc_id", "reason")


@query(SEG + "SELECT rec, seq FROM seg WHERE rec % 3 = 0 OR ed >= (rec % 7) * 100000.0::DOUBLE")
def offset_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    offsets = s.select("rec").distinct().where("rec % 3 <> 0").withColumn("offset", F.col("rec") % 7 * 100000.0)
    return selection.after_offset(s, offsets, "rec", "ed").select("rec", "seq")


@query(SEG + "SELECT rec, seq, row_number() OVER (PARTITION BY rec ORDER BY list_position(['purchase', 'click', 'view'], label), st, event_id) AS pos FROM seg WHERE label IN ('purchase', 'click', 'view')")
def class_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.in_class_order(segments(spark, sf_dir), ["rec"], "label", ["purchase", "click", "view"], "st", "event_id").select("rec", "seq", "pos")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 5 = 0 QUALIFY count(*) FILTER (l_discount > 0.05) OVER (PARTITION BY l_orderkey) = 1 AND l_discount > 0.05 AND l_tax >= 0.03")
def active_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are frames, their lines faces; every fifth frame."""
    faces = table(spark, sf_dir, "lineitem").withColumn("score", F.when(F.col("l_discount") > 0.05, 1.0).otherwise(-1.0))
    return selection.single_active(faces, "l_orderkey", "score", "l_tax", least=0.03, stride=5).select("l_orderkey", "l_linenumber")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity / 50.0 DESC, l_orderkey, l_linenumber) AS rank FROM lineitem WHERE l_quantity / 50.0 >= 0.9 QUALIFY rank <= 10")
def confident_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_quantity") / 50.0)
    return selection.confident(rows, ["l_suppkey"], "p", "l_orderkey", "l_linenumber").select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def sample_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.capped(table(spark, sf_dir, "documents").select("doc_id", "lang"), 100, "doc_id")


@query("SELECT a.n_regionkey, a.n_name, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name")
def all_minus_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.others(table(spark, sf_dir, "nation").select("n_regionkey", "n_name"), ["n_regionkey"], "n_name")


@query("""WITH t AS (SELECT (l_returnflag = 'N')::INT AS p, CASE WHEN l_linenumber = 7 THEN -100 ELSE (l_linestatus = 'O')::INT END AS t FROM lineitem), s AS (SELECT * FROM t WHERE t <> -100)
  SELECT avg((t = p)::INT)::DOUBLE AS accuracy, sum(t * p)::DOUBLE / sum(p) AS precision, sum(t * p)::DOUBLE / sum(t) AS recall, 2.0::DOUBLE * sum(t * p) / (sum(p) + sum(t)) AS f1 FROM s""")
def token_level_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = F.when(F.col("l_linenumber") == 7, -100).otherwise((F.col("l_linestatus") == "O").cast("int"))
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "N").cast("int").alias("p"), truth.alias("t"))
    return selection.token_scores(rows, "t", "p")


@query("SELECT date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS \"offset\", count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def offset_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return selection.histogram(rows, F.date_diff(F.to_date("l_shipdate"), F.to_date("o_orderdate")))


@query(SEG + """, x AS (SELECT rec, seq, value, list_sort(list(value) OVER w) AS l, avg(value) OVER w AS m FROM seg WINDOW w AS (PARTITION BY rec ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
  SELECT rec, seq, round(l[(len(l) + 1) // 2], 6) AS median, round(m, 6) AS mean FROM x""")
def lower_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selection.running_medians(segments(spark, sf_dir), ["rec"], ["seq"], "value").select("rec", "seq", "median", "mean"), "median", "mean")


@query(SEG + "SELECT rec, round(min(st), 6) AS first, round(max(st), 6) AS last, arg_min(label, (st, label)) AS first_label, arg_max(label, (st, label)) AS last_label FROM seg GROUP BY rec")
def entity_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selection.clips(segments(spark, sf_dir), ["rec"], "st", "label"), "first", "last")


@query("SELECT event_id, event_id // 50 AS shot FROM events WHERE event_id % 5 = 0")
def shot_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.shots(table(spark, sf_dir, "events").select("event_id"), "event_id")


@query("SELECT s_nationkey::VARCHAR AS enrol, s_suppkey::VARCHAR AS utt FROM supplier")
def enrol_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_join(F.collect_list(F.col("s_suppkey").cast("string")), " ").alias("utts"))
    path = written_lines(s.select(F.concat_ws(" ", F.col("s_nationkey").cast("string"), "utts").alias("value")), "enrol")
    return selection.enrolments(spark.read.text(path))


@query(SEG + "SELECT rec, seq, row_number() OVER (PARTITION BY rec ORDER BY floor(st / 86400), coalesce(list_position(['purchase', 'view'], label), 3), seq) AS pos FROM seg")
def event_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).withColumn("day", F.floor(F.col("st") / 86400))
    return selection.by_priority(s, ["rec"], ["day"], {"label": ["purchase", "view"]}, ["seq"]).select("rec", "seq", "pos")


REGIONS = SEG + """, span AS (SELECT rec, min(st) AS a, max(ed) AS b FROM seg GROUP BY rec),
  reg AS (SELECT rec, a + (b - a) * 0.1::DOUBLE AS rst, a + (b - a) * 0.4::DOUBLE AS red FROM span UNION ALL SELECT rec, a + (b - a) * 0.5::DOUBLE, a + (b - a) * 0.9::DOUBLE FROM span)"""


def evaluated(s: DataFrame) -> DataFrame:
    span = s.groupBy("rec").agg(F.min("st").alias("a"), F.max("ed").alias("b"))
    at = lambda x: F.col("a") + (F.col("b") - F.col("a")) * x
    return span.select("rec", at(0.1).alias("rst"), at(0.4).alias("red")).union(span.select("rec", at(0.5), at(0.9)))


@query(REGIONS + " SELECT rec, seq FROM seg s WHERE EXISTS (SELECT 1 FROM reg WHERE reg.rec = s.rec AND rst - 1e-8 <= st AND ed <= red + 1e-8)")
def events_in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    return regions.in_region(s, evaluated(s), "rec", "st", "ed").select("rec", "seq")


@query(REGIONS + " SELECT rec, seq FROM seg s WHERE EXISTS (SELECT 1 FROM reg WHERE reg.rec = s.rec AND (st + ed) / 2 BETWEEN rst AND red)")
def words_in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    words = s.withColumn("mid", (F.col("st") + F.col("ed")) / 2)
    return regions.midpoint_in_region(words, evaluated(s), "rec", "mid").select("rec", "seq")


@query(REGIONS + " SELECT reg.rec, rst < a + (b - a) * 0.3::DOUBLE AS early, min(seq) AS first, max(seq) AS last FROM reg JOIN span USING (rec) JOIN seg s ON s.rec = reg.rec AND (st + ed) / 2 BETWEEN rst AND red GROUP BY ALL")
def word_index_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    span = s.groupBy("rec").agg(F.min("st").alias("a"), F.max("ed").alias("b"))
    parts = evaluated(s).join(span, "rec").select("rec", (F.col("rst") < F.col("a") + (F.col("b") - F.col("a")) * 0.3).alias("early"), F.col("rst").alias("st"), F.col("red").alias("ed"))
    words = s.select("rec", F.col("seq").alias("idx"), ((F.col("st") + F.col("ed")) / 2).alias("mid"))
    return regions.word_ranges(parts, words, "rec", "early")


@query(SEG + """, k AS (SELECT rec, seq, CASE WHEN label = 'purchase' THEN st END AS t FROM seg),
  w AS (SELECT *, last_value(t IGNORE NULLS) OVER b AS pt, last_value(CASE WHEN t IS NOT NULL THEN seq END IGNORE NULLS) OVER b AS pi,
    first_value(t IGNORE NULLS) OVER f AS nt, first_value(CASE WHEN t IS NOT NULL THEN seq END IGNORE NULLS) OVER f AS ni FROM k
    WINDOW b AS (PARTITION BY rec ORDER BY seq ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY rec ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT rec, seq, coalesce(t, pt + (nt - pt) * (seq - pi) / (ni - pi), pt, nt) AS aligned FROM w""")
def anchor_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).withColumn("t", F.when(F.col("label") == "purchase", F.col("st")))
    return regions.between_anchors(s, ["rec"], "seq", "t").select("rec", "seq", "aligned")
