"""Queries over further scans, sinks and small operators, and their SQL; what they scan is written from the tables first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import draws, scalars, signal, vectors
from .operators import manifests, scoring, selection
from .queries import ATOMS, SEG, der_pieces, long_form, query, rounded, segments, table
from .scoring_queries import drawn
from .shared import shared_path, written_lines
from .sources import text_tables as tt


def one_file(lines: DataFrame, order: str, label: str) -> str:
    """The path of one text file with ``lines`` (value, order) in order: formats whose order means something are single files."""
    return written_lines(lines.repartitionByRange(1, order).sortWithinPartitions(order), label)


def in_parts(lines: DataFrame, order: str, label: str) -> str:
    """The path of ``lines`` (value, order) in order as parts of one text, by name, so that none is written by one task."""
    return written_lines(lines.repartitionByRange(order).sortWithinPartitions(order), label)


@query("SELECT (row_number() OVER (ORDER BY p_partkey) - 1)::INT AS pos, p_name AS value FROM part")
def line_list_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("value"))
    return tt.lines(spark, in_parts(p, "p_partkey", "list"), joined=True).select("pos", "value")


@query(SEG + "SELECT rec::VARCHAR AS name, round(st::DECIMAL(18, 6), 3)::DOUBLE AS tbeg, label AS spkr FROM seg")
def rttm_list_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files' worth of lines, scanned as a list of paths."""
    s = segments(spark, sf_dir)
    paths = [written_lines(tt.rttm_lines(s.where(F.col("rec") % 2 == k), "rec", "st", "ed", "label"), f"rttm{k}") for k in (0, 1)]
    return tt.rttm(spark, paths).select("name", "tbeg", "spkr")


@query(SEG + """, f AS (SELECT rec, label, row_number() OVER (PARTITION BY rec ORDER BY min(seq)) - 1 AS code FROM seg GROUP BY rec, label)
  SELECT rec::VARCHAR AS rec, round(st::DECIMAL(18, 6), 3)::DOUBLE AS st, code::INT AS speaker FROM seg JOIN f USING (rec, label)""")
def simple_rttm_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    order = s.select((F.col("rec") * 1_000_000 + F.col("seq")).alias("o"), "rec", "st", "ed", "label")
    said = order.select("o", F.format_string("SPEAKER %s 0 %.3f %.3f <NA> <NA> %s <NA> <NA>", F.col("rec").cast("string"), "st", F.col("ed") - F.col("st"), "label").alias("value"))
    return tt.simple_rttm(spark, in_parts(said, "o", "simple"), joined=True).select("rec", "st", F.col("speaker").cast("int").alias("speaker"))


def little(value: Column, size: int) -> Column:
    """Hex digits of a whole number in ``size`` bytes, least first."""
    digits = F.lpad(F.hex(F.pmod(value.cast("long"), F.lit(256**size))), 2 * size, "0")
    return F.concat(*[F.substring(digits, 2 * (size - k) - 1, 2) for k in range(size)])


@query("SELECT vec_id, i::INT AS i, 8000 AS rate, round(trunc(e[i + 1] * 30000) / 32768, 6) + 0.0 AS samples FROM (SELECT vec_id, embedding::DOUBLE[] AS e, unnest(range(len(embedding))) AS i FROM embeddings)")
def wav_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RIFF bytes made of each vector, with a chunk to skip before the data, decoded again."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(vectors.doubles("embedding"), lambda v: (v * 30000).cast("int")).alias("e"))
    size = F.size("e") * 2
    text = lambda t: F.hex(F.lit(t))
    head = [text("RIFF"), little(size + 48, 4), text("WAVEfmt "), *[little(F.lit(v), n) for v, n in ((16, 4), (1, 2), (1, 2), (8000, 4), (16000, 4), (2, 2), (16, 2))], text("LIST"), little(F.lit(4), 4), text("abcd"), text("data"), little(size, 4)]
    body = F.array_join(F.transform("e", lambda v: little(v, 2)), "")
    got = e.select("vec_id", signal.decode_wav(F.unhex(F.concat(*head, body)), rate=8000, strict=True).alias("w")).select("vec_id", "w.*")
    return long_form(got, "samples")


@query("""WITH t AS (SELECT conv_id, turn, role, regexp_replace(text, '["\\n]', '', 'g') AS mark FROM conversations) SELECT role AS tier, turn::DOUBLE AS st, turn + 0.5::DOUBLE AS ed, mark FROM t WHERE mark <> ''""")
def textgrid_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid for each conversation, with a tier for each role."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.regexp_replace("text", '["\n]', "").alias("mark"))
    part = F.format_string('intervals [%d]: xmin = %.1f xmax = %.1f text = "%s"', F.col("turn") + 1, F.col("turn").cast("double"), F.col("turn") + 0.5, "mark")
    tiers = c.groupBy("conv_id", "role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), " ").alias("p"))
    grids = tiers.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('item [1]: class = "IntervalTier" name = "'), "role", F.lit('" '), "p"))), " ").alias("value"))
    path = shared_path(spark, "grids")
    grids.select(F.concat(F.lit('File type = "ooTextFile" item []: '), "value").alias("value")).write.text(path)
    return tt.textgrid(spark, path).select("tier", "st", "ed", "mark")


@query("SELECT DISTINCT n_nationkey::VARCHAR AS folder FROM nation WHERE n_regionkey % 2 = 0")
def folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file in a folder for each nation; those of every other region have the wanted ending."""
    n = table(spark, sf_dir, "nation")
    path = shared_path(spark, "tree")
    for kind, rest in (("txt", 0), ("csv", 1)):
        n.where(F.col("n_regionkey") % 2 == rest).select("n_nationkey", F.col("n_name").alias("value")).write.mode("append").partitionBy("n_nationkey").format("text" if kind == "txt" else "csv").save(path)
    return tt.files(spark, path, "*.txt").select(F.regexp_extract("path", r"n_nationkey=(\d+)/", 1).alias("folder")).distinct()


@query("SELECT i::INT AS i, round(avg(x), 6) AS shift, round(stddev_samp(x), 6) AS scale FROM (SELECT unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY i")
def cmvn_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of each dimension, written as a statistics file and read."""
    x = table(spark, sf_dir, "embeddings").select(F.posexplode(vectors.doubles("embedding")).alias("i", "x"))
    s = x.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("d"))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.col(c).alias("v")))), lambda y: F.format_string("%.9f", y["v"])), " ")
    both = s.agg(listed("m").alias("m"), listed("d").alias("d"))
    mark = lambda k, name, c: F.struct(F.lit(k).alias("o"), F.concat(F.lit(f"<{name}> 0 [ "), c, F.lit(" ]")).alias("value"))
    lines = both.select(F.explode(F.array(mark(0, "AddShift", F.col("m")), mark(1, "Rescale", F.col("d")))).alias("l")).select("l.*")
    shift, scale = tt.cmvn(spark, one_file(lines, "o", "cmvn"))
    return rounded(spark.createDataFrame([(shift, scale)], "shift array<double>, scale array<double>").select(F.posexplode(F.arrays_zip("shift", "scale")).alias("i", "z")).select("i", "z.*"), "shift", "scale")


@query("SELECT replace('spk/' || label || '/' || vec_id, '/', '-') AS name, len(embedding) AS n, round(list_sum(embedding::DOUBLE[]), 4) + 0.0 AS total FROM embeddings")
def vector_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as text, read back."""
    v = table(spark, sf_dir, "embeddings").select(F.concat_ws("/", F.lit("spk"), "label", "vec_id").alias("k"), vectors.doubles("embedding").alias("e"))
    back = F.transform(F.split("value", " "), lambda x: x.cast("double"))
    return tt.vector_lines(v, "k", "e").select("name", F.size(back).cast("long").alias("n"), (F.round(vectors.total(back), 4) + 0.0).alias("total"))


@query(SEG + """, t AS (SELECT rec, seq, round((seq * 7919 + rec * 31) % 100000 / 8.0::DOUBLE, 3) AS st, label FROM seg) SELECT rec || '_' || regexp_replace(printf('%.3f', st), '(\\.\\d+?)0+$', '\\1') || '_' || regexp_replace(printf('%.3f', st + 1.125), '(\\.\\d+?)0+$', '\\1') AS segid, st AS start, st + 1.125 AS stop, label AS speaker FROM t
  QUALIFY row_number() OVER (PARTITION BY rec, st ORDER BY label) = 1""")
def diarization_json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).select("rec", (((F.col("seq") * 7919 + F.col("rec") * 31) % 100000) / 8.0).alias("st"), "label")
    rows = s.groupBy("rec", "st").agg(F.min("label").alias("speaker")).withColumn("ed", F.col("st") + 1.125)
    path = shared_path(spark, "json")
    tt.diarization_json(rows).select("value").write.text(path)
    return tt.diarization_objects(spark, path)


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey % 2 = 0")
def written_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written with its options; the second write of other rows with the same options does nothing."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    path = shared_path(spark, "once")
    first = tt.write_once(p.where("p_partkey % 2 = 0"), path, {"half": 0})
    again = tt.write_once(p, path, {"half": 0})
    if not first or again:
        raise ValueError("the guard did not hold")
    return spark.read.parquet(path)


@query("SELECT conv_id, turn, role FROM conversations WHERE role <> 'system'")
def csv_or_json_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    root = shared_path(spark, "tables")
    for role in ("user", "assistant"):
        c.where(F.col("role") == role).write.json(f"{root}/{role}.json")
    return tt.table_of(spark, f"{root}/user.json", f"{root}/assistant.json").select("conv_id", "turn", "role")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def partners_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order whose number three divides."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 3 == 0).select(F.col("o_custkey").alias("c_custkey"))
    return manifests.without_done(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), o, "c_custkey")


@query("SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def strict_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both manifests have all keys; one without would be an error."""
    s = table(spark, sf_dir, "supplier")
    named = s.select("s_suppkey", "s_nationkey").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    return manifests.joined_strict(s.select("s_suppkey", "s_name"), named, "s_suppkey").select("s_suppkey", "s_name", "n_name")


@query("SELECT doc_id, i::INT AS line, t AS text FROM (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) x, LATERAL (SELECT regexp_replace(l, '[a-z0-9 .,]', '', 'g') AS t) WHERE t <> ''")
def cleaned_non_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of which something stays when small letters, digits and marks are taken off."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "l"))
    return d.select("doc_id", "line", F.regexp_replace("l", "[a-z0-9 .,]", "").alias("text")).where(F.length("text") > 0)


@query("""WITH e AS (SELECT user_id AS entity, event_id, date_trunc('hour', ts) AS h, event_id % 4 AS c FROM events WHERE event_id % 4 < 3), o AS (SELECT entity, h, c, min(event_id) AS event_id FROM e GROUP BY ALL HAVING count(*) = 1)
  SELECT entity, event_id, c::INT AS c, row_number() OVER (PARTITION BY entity ORDER BY h, list_position([1, 0, 2], c))::INT AS pos FROM o""")
def class_rows_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an hour and class; three of four classes."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), "event_id", F.date_trunc("hour", "ts").alias("h"), (F.col("event_id") % 4).cast("int").alias("c"))
    single = e.groupBy("entity", "h", "c").agg(F.min("event_id").alias("event_id"), F.count(F.lit(1)).alias("n")).where("n = 1")
    return selection.classes_in_time(single, "entity", "h", "c").select("entity", "event_id", "c", "pos")


@query(SEG + """, i AS (SELECT rec, seq, (st * 16)::BIGINT AS st, (ed * 16)::BIGINT AS ed FROM seg), n AS (SELECT rec, seq, st // 640 AS b, ed // 640 - st // 640 + 1 AS n FROM i), s AS (SELECT *, unnest(range((n + 49) // 50)) AS shot FROM n)
  SELECT rec, seq, shot::INT AS shot, b + shot * 50 AS first, least(50, n - shot * 50) AS frames, array_to_string([b + k FOR k IN range(shot * 50, shot * 50 + least(50, n - shot * 50)) IF k % 5 = 0], ' ') AS detected FROM s""")
def shots_by_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = lambda c: F.round(F.col(c) * 16).cast("long").alias(c)
    s = segments(spark, sf_dir).select("rec", "seq", samples("st"), samples("ed"))
    return selection.shots_by_interval(s, ["rec"]).select("rec", "seq", "shot", "first", "frames", F.array_join("detected", " ").alias("detected"))


TYPES = "CASE WHEN {s} IN ('click', 'view') THEN 'adult' WHEN {s} = 'error' THEN 'child' ELSE 'unknown' END"


@query(SEG + ATOMS + f""", ty AS (SELECT rec, st, ed, src, {TYPES.format(s="spk")} AS type, count(*) AS n FROM act GROUP BY ALL), tot AS (SELECT rec, st, ed, src, sum(n) AS n FROM ty GROUP BY ALL),
  j AS (SELECT r.type AS ref_type, s.type AS sys_type, (r.ed - r.st) * least(r.n, s.n) AS x FROM ty r JOIN ty s USING (rec, st, ed) WHERE r.src = 'R' AND s.src = 'S'
    UNION ALL SELECT r.type, 'MISS', (r.ed - r.st) * (r.n - coalesce(t.n, 0)) FROM ty r LEFT JOIN tot t ON t.rec = r.rec AND t.st = r.st AND t.ed = r.ed AND t.src = 'S' WHERE r.src = 'R' AND r.n > coalesce(t.n, 0)
    UNION ALL SELECT 'FALSE ALARM', s.type, (s.ed - s.st) * (s.n - coalesce(t.n, 0)) FROM ty s LEFT JOIN tot t ON t.rec = s.rec AND t.st = s.st AND t.ed = s.ed AND t.src = 'R' WHERE s.src = 'S' AND s.n > coalesce(t.n, 0))
  SELECT ref_type, sys_type, round(sum(x), 2) AS seconds FROM j GROUP BY ALL""")
def speaker_type_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    typed = F.when(F.col("speaker").isin("click", "view"), "adult").when(F.col("speaker") == "error", "child").otherwise("unknown")
    kinds = s.select("rec", F.explode(F.array("label", F.lit("other"))).alias("speaker")).distinct().withColumn("type", typed)
    out = scoring.speaker_type_times(der_pieces(spark, sf_dir), kinds, kinds, ["rec"])
    return out.withColumn("seconds", F.round("seconds", 2))


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, 1 + vec_id % 90 AS m FROM embeddings), w AS (SELECT vec_id, e[1:m] AS e FROM v), p AS (SELECT vec_id, CASE WHEN len(e) < 18 THEN list_concat(e, [0.0::DOUBLE FOR x IN range(18 - len(e))]) ELSE e END AS e FROM w),
  s AS (SELECT vec_id, e, list_sort([{drawn("crops-whole", "vec_id || '|' || i")} % greatest(len(e) - 16 - 1, 1) FOR i IN range(2)]) AS a, list_sort([{drawn("crops-halves", "vec_id || '|' || i")} % greatest(len(e) - 8 - 2, 1) FOR i IN range(3)]) AS b FROM p),
  q AS (SELECT vec_id, e, list_sort([{{'o': {drawn("crops-whole-order", "vec_id || '|' || i")}, 'p': a[i + 1] + i}} FOR i IN range(2)]) AS a, list_sort([{{'o': {drawn("crops-halves-order", "vec_id || '|' || i")}, 'p': b[i + 1] + i}} FOR i IN range(3)]) AS b FROM s),
  f AS (SELECT vec_id, list_concat(e[a[1].p + 1:a[1].p + 16], e[a[2].p + 1:a[2].p + 16], e[b[1].p + 1:b[1].p + 8], e[b[2].p + 1:b[2].p + 8], e[b[3].p + 1:b[3].p + 8]) AS x FROM q)
  SELECT vec_id, i::INT AS i, round(x[i + 1], 6) + 0.0 AS wave FROM (SELECT *, unnest(range(len(x))) AS i FROM f)""")
def crop_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two crops of 16 samples and three of 8 from each vector's first 1 to 90 numbers."""
    e = F.slice(vectors.doubles("embedding"), F.lit(1), (1 + F.col("vec_id") % 90).cast("int"))
    v = table(spark, sf_dir, "embeddings").select("vec_id", e.alias("e"))
    c = v.select("vec_id", draws.crop_set(F.col("e"), 16, 2, 3, "crops", F.col("vec_id")).alias("c"))
    return long_form(c.select("vec_id", F.concat(F.flatten("c.whole"), F.flatten("c.halves")).alias("wave")), "wave")


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, unnest(range(len(embedding))) AS i FROM embeddings), u AS (SELECT *, ({drawn("dither-radius", "vec_id || '|' || i")} + 0.5::DOUBLE) / {float(draws.TOP)!r}::DOUBLE AS a, ({drawn("dither-angle", "vec_id || '|' || i")} + 0.5::DOUBLE) / {float(draws.TOP)!r}::DOUBLE AS b FROM v)
  SELECT vec_id, i::INT AS i, round(e[i + 1] + 0.1::DOUBLE * sqrt(-2 * ln(a)) * cos(2 * pi() * b), 6) + 0.0 AS wave FROM u""")
def dithered_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", vectors.doubles("embedding").alias("e"))
    return long_form(v.select("vec_id", draws.dithered(F.col("e"), 0.1, "dither", F.col("vec_id")).alias("wave")), "wave")


NUMBERED = "SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS q, l_extendedprice::DOUBLE AS p, l_discount::DOUBLE AS d FROM lineitem"


@query(f"""WITH n AS ({NUMBERED}) SELECT l_orderkey, l_linenumber, CASE WHEN q > 1 AND q < 100 THEN printf('%.2f', q) ELSE printf('%.2e', q) END AS q, CASE WHEN p > 1 AND p < 100 THEN printf('%.2f', p) ELSE printf('%.2e', p) END AS p,
  CASE WHEN d > 1 AND d < 100 THEN printf('%.2f', d) ELSE printf('%.2e', d) END AS d, round(p / 1000, 6) AS seconds,
  [greatest(0, least(640, floor(d * 640)))::INT, greatest(0, least(360, floor(q / 60 * 360)))::INT, greatest(0, least(640, floor((d + 0.95::DOUBLE) * 640)))::INT, greatest(0, least(360, floor((q / 60 - 0.5) * 360)))::INT] AS box FROM n""")
def small_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as logs show them, milliseconds, and boxes in pixels."""
    q, p, d = (F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount"))
    box = scalars.frame_box(F.array(d, q / 60, d + 0.95, q / 60 - 0.5), F.lit(640), F.lit(360))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[scalars.log_number(c).alias(n) for c, n in ((q, "q"), (p, "p"), (d, "d"))], F.round(scalars.seconds(p), 6).alias("seconds"), box.alias("box"))


@query(SEG + """, n AS (SELECT rec, seq, st, ed, lead(st) OVER (PARTITION BY rec ORDER BY seq) AS st2, lead(ed) OVER (PARTITION BY rec ORDER BY seq) AS ed2 FROM seg)
  SELECT rec, seq, round(CASE WHEN least(ed, ed2) - greatest(st, st2) + 60 > 0 THEN (least(ed, ed2) - greatest(st, st2) + 60) / (1 + 60 / greatest(ed - st, 1e-8)) ELSE 0 END, 5) AS shared FROM n WHERE st2 IS NOT NULL""")
def gap_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event and the next one of its user, with a minute's gap granted."""
    s = segments(spark, sf_dir)
    after = s.select("rec", (F.col("seq") - 1).alias("seq"), F.col("st").alias("st2"), F.col("ed").alias("ed2"))
    return s.join(after, ["rec", "seq"]).select("rec", "seq", F.round(scalars.gap_overlap(F.col("st"), F.col("ed"), F.col("st2"), F.col("ed2"), 60.0), 5).alias("shared"))


@query("SELECT l_suppkey AS frame, round_even(avg(l_linenumber % 4), 0)::INT AS n FROM lineitem GROUP BY 1")
def active_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes active in a frame: the mean of several windows' counts, to the even neighbour."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("frame")).agg(F.rint(F.avg(F.col("l_linenumber") % 4)).cast("int").alias("n"))


@query("""WITH m AS (SELECT o_orderkey AS u, o_custkey AS s, o_totalprice::DOUBLE / 10000 AS d FROM orders), a AS (SELECT *, sum(d) OVER (PARTITION BY s) AS al FROM m)
  SELECT u || '_0.0_' || printf('%.1f', d) AS "ID", round(d, 6) AS dur, 'w/' || u AS path, 0.0::DOUBLE AS start, round(d, 6) AS stop, s AS spk FROM a WHERE al > 60""")
def random_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as utterances, one row each."""
    o = table(spark, sf_dir, "orders")
    m = o.select(F.col("o_orderkey").alias("utt_id"), F.concat(F.lit("w/"), F.col("o_orderkey").cast("string")).alias("path"), (F.col("o_totalprice") / 10000).alias("dur"))
    s = o.select(F.col("o_orderkey").alias("utt_id"), F.col("o_custkey").alias("spk_id"))
    return rounded(manifests.segment_table(m, s, 3.0, 60.0, random_segment=True), "dur", "stop")
