"""Queries over scoring reports, unscored time, Python's numbers, seeded choices and realigned words, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import draws, scalars
from .operators import der, scoring, transcripts
from .queries import ATOMS, SEG, der_pieces, long_form, query, segments, table

NUMBERS = "SELECT l_orderkey, l_linenumber, l_orderkey % 4001 / 8.0::DOUBLE AS half, l_extendedprice::DOUBLE * 1.005::DOUBLE / l_quantity AS ratio FROM lineitem"


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.col("l_extendedprice").cast("double") * 1.005 / F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 4001 / 8.0).alias("half"), ratio.alias("ratio"))


@query(f"WITH n AS ({NUMBERS}) SELECT l_orderkey, l_linenumber, printf('%.2f', half)::DOUBLE AS half, printf('%.2f', ratio)::DOUBLE AS ratio FROM n")
def python_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halves that binary numbers hold go to the even neighbour."""
    n = numbers(spark, sf_dir)
    return n.select("l_orderkey", "l_linenumber", *[scalars.python_round(F.col(c)).alias(c) for c in ("half", "ratio")])


@query(f"WITH n AS ({NUMBERS}), t AS (SELECT *, regexp_replace(printf('%.2f', half), '(\\.\\d+?)0+$', '\\1') AS a, regexp_replace(printf('%.2f', ratio), '(\\.\\d+?)0+$', '\\1') AS b FROM n) SELECT l_linenumber, l_orderkey || '_' || a || '_' || b AS segid FROM t")
def python_segment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbers(spark, sf_dir).select("l_linenumber", scalars.python_segment_id(F.col("l_orderkey"), F.col("half"), F.col("ratio")).alias("segid"))


@query("SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\f\\r\\x0b]+')[5] AS field FROM documents")
def fifth_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scalars.nth_field(F.regexp_replace("text", r"^\s+|\s+$", ""), 5).alias("field"))


def drawn(seed: str, key: str) -> str:
    return f"('0x' || substr(md5('{seed}|' || {key}), 1, 15))::BIGINT"


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, 1 + vec_id % 90 AS n FROM embeddings), w AS (SELECT vec_id, e[1:n] AS e, least(n, len(e)) AS n FROM v),
  c AS (SELECT vec_id, CASE WHEN n >= 16 THEN e[1 + {drawn("crop", "vec_id")} % (n - 15) : 16 + {drawn("crop", "vec_id")} % (n - 15)] ELSE list_concat(e, [0.0::DOUBLE FOR x IN range(16 - n)]) END AS e FROM w)
  SELECT vec_id, unnest(range(16))::INT AS i, round(unnest(e), 6) + 0.0 AS wave FROM c""")
def seeded_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of 1 to 90 numbers at most, cut or filled to 16."""
    e = F.slice(F.col("embedding").cast("array<double>"), F.lit(1), (1 + F.col("vec_id") % 90).cast("int"))
    v = table(spark, sf_dir, "embeddings").select("vec_id", e.alias("e"))
    return long_form(v.select("vec_id", draws.crop(F.col("e"), 16, draws.draw("crop", F.col("vec_id"))).alias("wave")), "wave")


@query(f"SELECT doc_id, CASE WHEN {drawn('aug-whether', 'doc_id')} < {int(0.6 * draws.TOP)} THEN ['noise', 'reverb', 'both'][1 + {drawn('aug-which', 'doc_id')} % 3] END AS augmentation FROM documents")
def augmentation_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", draws.augmentation("aug", F.col("doc_id"), 0.6, ["noise", "reverb", "both"]).alias("augmentation"))


@query(SEG + ATOMS + """, p AS (SELECT r.rec, r.spk AS ref, s.spk AS sys, sum(r.ed - r.st) AS ov FROM act r JOIN act s USING (rec, st, ed) WHERE r.src = 'R' AND s.src = 'S' GROUP BY ALL)
  SELECT rec || ',1,' || ref || ',' || sys || CASE WHEN sys = min(sys) OVER (PARTITION BY rec, ref) THEN ',mapped,' ELSE ',notmapped,' END || printf('%.4f', round(ov, 4)) AS value FROM p""")
def speaker_map_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping is given here: each reference speaker's first partner by name."""
    pairs = der.co_occurrence(der_pieces(spark, sf_dir), ["rec"])
    given = pairs.groupBy("rec", "ref").agg(F.min("sys").alias("sys"))
    return scoring.map_lines(scoring.mapped_pairs(pairs, given, ["rec"]), "rec", F.lit("1"))


@query("""WITH r AS (SELECT c_nationkey AS rec, c_custkey AS ref, c_mktsegment AS t, c_acctbal AS time, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer),
  s AS (SELECT s_nationkey AS rec, s_suppkey AS sys, 'S' || s_suppkey % 3 AS t, s_acctbal AS time, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier),
  j AS (SELECT r.t AS ref_type, coalesce(s.t, 'MISS') AS sys_type FROM r LEFT JOIN s ON r.rec = s.rec AND 3 * r.k = 2 * s.k WHERE r.time > 0
    UNION ALL SELECT 'FALSE ALARM', s.t FROM s WHERE s.time > 0 AND NOT EXISTS (SELECT 1 FROM r WHERE r.rec = s.rec AND 3 * r.k = 2 * s.k AND r.time > 0))
  SELECT ref_type, sys_type, count(*) AS n FROM j GROUP BY ALL""")
def speaker_type_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are reference speakers, suppliers the system's; every third supplier of a nation has a customer."""
    at = lambda n, k: F.row_number().over(Window.partitionBy(n).orderBy(k))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("rec"), F.col("c_custkey").alias("ref"), F.col("c_mktsegment").alias("type"), F.col("c_acctbal").alias("time"), at("c_nationkey", "c_custkey").alias("k"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("rec"), F.col("s_suppkey").alias("sys"), F.concat(F.lit("S"), F.col("s_suppkey") % 3).alias("type"), F.col("s_acctbal").alias("time"), at("s_nationkey", "s_suppkey").alias("k"))
    given = c.select("rec", "ref", (3 * F.col("k")).alias("j")).join(s.select("rec", "sys", (2 * F.col("k")).alias("j")), ["rec", "j"])
    return scoring.speaker_types(c.drop("k"), s.drop("k"), given, ["rec"])


ALIGNED = "SELECT l_suppkey, CASE WHEN l_linenumber <> 2 THEN l_returnflag END AS r, CASE WHEN l_linenumber <> 3 THEN CASE WHEN l_tax > 0.06 THEN 'A' ELSE l_returnflag END END AS s FROM lineitem"


@query(f"WITH a AS ({ALIGNED}) SELECT l_suppkey, count(r) AS ref, count(*) FILTER (s IS NULL) AS del, count(*) FILTER (r IS NULL) AS ins, count(*) FILTER (r <> s) AS sub, count(*) FILTER (r = s) AS correct FROM a GROUP BY l_suppkey")
def alignment_error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, flag = F.col("l_linenumber"), F.col("l_returnflag")
    r, s = F.when(line != 2, flag), F.when(line != 3, F.when(F.col("l_tax") > 0.06, "A").otherwise(flag))
    return scoring.typed_errors(table(spark, sf_dir, "lineitem").select("l_suppkey", r.alias("r"), s.alias("s")), ["l_suppkey"], "r", "s")


EXTEND = 7200.0


@query(SEG + f""", x AS (SELECT rec, st, ed, CASE label WHEN 'purchase' THEN 'NSZ' WHEN 'error' THEN 'NSZ' WHEN 'view' THEN 'LEX' WHEN 'click' THEN 'SEG' END AS kind FROM seg WHERE ed > st),
  e AS (SELECT rec, kind, st AS t, 1 AS step FROM x WHERE kind IS NOT NULL UNION ALL SELECT rec, kind, ed, -1 FROM x WHERE kind IS NOT NULL),
  c AS (SELECT *, sum(CASE WHEN kind = 'LEX' THEN step ELSE 0 END) OVER w AS lex, sum(CASE WHEN kind = 'NSZ' THEN step ELSE 0 END) OVER w AS nsz, row_number() OVER w AS n FROM e
    WINDOW w AS (PARTITION BY rec ORDER BY t, step, list_position(['SEG', 'LEX', 'NSZ'], kind) ROWS UNBOUNDED PRECEDING)),
  d AS (SELECT *, kind = 'NSZ' AND step = 1 AND nsz = 1 AS op, greatest(0, last_value(CASE WHEN kind = 'LEX' AND lex = 0 THEN t END IGNORE NULLS) OVER w, last_value(CASE WHEN kind = 'SEG' THEN t END IGNORE NULLS) OVER w) AS bound FROM c
    WINDOW w AS (PARTITION BY rec ORDER BY n ROWS UNBOUNDED PRECEDING)),
  g AS (SELECT *, sum(op::INT) OVER (PARTITION BY rec ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM d),
  r AS (SELECT rec, run, min(t) FILTER (op) AS b, min(lex) FILTER (op) AS lex, min(bound) FILTER (op) AS bound, max(t) FILTER (kind = 'NSZ') AS z, min(t) FILTER (nsz = 0 AND (lex > 0 OR kind = 'SEG')) AS shut FROM g WHERE run > 0 GROUP BY rec, run),
  q AS (SELECT *, lag(z) OVER o AS pz, lag(shut) OVER o AS ps, lead(b) OVER o AS nb FROM r WINDOW o AS (PARTITION BY rec ORDER BY run)),
  s AS (SELECT rec, run, CASE WHEN pz IS NULL OR ps IS NOT NULL THEN CASE WHEN lex > 0 THEN b ELSE greatest(bound, b - {EXTEND}) END WHEN b > pz + {2 * EXTEND} THEN b - {EXTEND} END AS st,
    CASE WHEN shut IS NOT NULL THEN least(z + {EXTEND}, shut) WHEN nb IS NULL THEN 1e12 WHEN nb > z + {2 * EXTEND} THEN z + {EXTEND} END AS ed FROM q),
  k AS (SELECT *, count(st) OVER (PARTITION BY rec ORDER BY run ROWS UNBOUNDED PRECEDING) AS zone FROM s)
  SELECT rec, min(st)::DOUBLE AS st, least(max(ed), 1e12)::DOUBLE AS ed FROM k GROUP BY rec, zone""")
def noscore_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views are words, clicks turns, purchases and errors what isn't scored."""
    kind = F.when(F.col("label").isin("purchase", "error"), "NSZ").when(F.col("label") == "view", "LEX").when(F.col("label") == "click", "SEG")
    zones = scoring.noscore_zones(segments(spark, sf_dir).withColumn("kind", kind), ["rec"], EXTEND)
    return zones.select("rec", "st", F.least("ed", F.lit(1e12)).alias("ed"))


@query(SEG + """, r AS (SELECT rec, seq, st, st + (ed - st) * 600 AS ed, label, 's' || event_id % 3 AS sub FROM seg WHERE seq % 2 = 1),
  s AS (SELECT rec, seq, (st + ed) / 2 AS mid, label, CASE WHEN event_id % 4 > 0 THEN 's' || event_id % 3 END AS partner FROM seg WHERE seq % 2 = 0)
  SELECT 'ref' AS side, rec, seq FROM r WHERE NOT (label = 'purchase' AND sub = 's1')
  UNION ALL SELECT 'sys', rec, seq FROM s WHERE label <> 'purchase' OR partner <> 's1' OR (partner IS NULL AND NOT EXISTS (SELECT 1 FROM r WHERE r.rec = s.rec AND r.label = 'purchase' AND r.sub = 's1' AND s.mid BETWEEN r.st AND r.ed))""")
def discarded_subtype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd events are the reference's, even ones the system's."""
    s = segments(spark, sf_dir)
    sub = F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string"))
    ref = s.where("seq % 2 = 1").select("rec", "seq", "st", (F.col("st") + (F.col("ed") - F.col("st")) * 600).alias("ed"), F.col("label").alias("type"), sub.alias("subtype"))
    sys = s.where("seq % 2 = 0").select("rec", "seq", ((F.col("st") + F.col("ed")) / 2).alias("mid"), F.col("label").alias("type"), F.when(F.col("event_id") % 4 > 0, sub).alias("partner"))
    left, right = scoring.without_subtype(ref, sys, "rec", "purchase", "s1")
    return left.select(F.lit("ref").alias("side"), "rec", "seq").union(right.select(F.lit("sys"), "rec", "seq"))


#: The marks, blank and the marks' brackets, as a class of a pattern.
MARK = r'\[\]\\,.!?;:"—…、，。！？；：“”‘’-'
SPACED = "regexp_replace(regexp_replace(text, '[ \\t\\n\\f\\r\\x0b\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+', ' ', 'g'), '^[ " + MARK + "]+', '')"


@query(f"""WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all({SPACED}, '[^ {MARK}]+[ {MARK}]*')) AS piece, generate_subscripts(regexp_extract_all({SPACED}, '[^ {MARK}]+[ {MARK}]*'), 1) AS k FROM conversations)
  SELECT conv_id, turn, (k - 1)::INT AS idx, piece, coalesce(sum(regexp_matches(piece, '[{MARK}]$')::INT) OVER (PARTITION BY conv_id, turn ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS sentence FROM t""")
def realigned_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in small letters without marks find their pieces of the text again."""
    spaced = F.regexp_replace("text", r"[ \t\n\f\r\x0b\x1c-\x1f\x85\p{Z}]+", " ")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace(spaced, f"^[ {MARK}]+", "").alias("text"))
    return transcripts.realigned(c.withColumn("raw", F.lower(F.regexp_replace("text", f"[ {MARK}]+", " "))), "text", "raw")


@query("""WITH w AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '-' || o_orderstatus || '-' WHEN o_orderkey % 5 = 1 THEN 'mm-hmm' ELSE o_orderpriority END AS word, o_orderstatus = 'P' AS misc FROM orders)
  SELECT o_orderkey, CASE WHEN misc THEN 0 WHEN word = 'mm-hmm' OR instr(trim(word, '-'), '-') = 0 THEN 1 ELSE 2 END AS weight FROM w""")
def word_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    word = F.when(key % 5 == 0, F.concat(F.lit("-"), status, F.lit("-"))).when(key % 5 == 1, "mm-hmm").otherwise(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", scoring.word_weight(word, F.when(status == "P", "misc").otherwise("lex")).alias("weight"))


@query(SEG + """, e AS (SELECT rec, seq, event_id % 2 = 0 AS after, seq - 1 AS ref, seq + event_id % 9 - 5 AS sys FROM seg)
  SELECT e.rec, e.seq, count(w.seq) * CASE WHEN any_value(sys) > any_value(ref) THEN 1 ELSE -1 END AS delta FROM e LEFT JOIN seg w ON w.rec = e.rec AND w.label <> 'error'
    AND w.seq - 1 BETWEEN least(ref, sys) + after::INT AND greatest(ref, sys) - 1 + after::INT GROUP BY e.rec, e.seq""")
def boundary_word_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a word and has a boundary, which the system puts up to four words away."""
    s = segments(spark, sf_dir)
    words = s.select("rec", (F.col("seq") - 1).alias("idx"), (F.col("label") != "error").alias("scored"))
    place = F.when(F.col("event_id") % 2 == 0, "END").otherwise("BEG")
    events = s.select("rec", "seq", place.alias("place"), (F.col("seq") - 1).alias("ref"), (F.col("seq") + F.col("event_id") % 9 - 5).alias("sys"))
    return scoring.word_deltas(events, words, "rec").select("rec", "seq", "delta")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS x1, l_suppkey::DOUBLE AS y1, l_quantity::DOUBLE + l_linenumber * 10 AS x2, l_suppkey::DOUBLE + l_orderkey % 83 AS y2 FROM lineitem),
  s AS (SELECT *, greatest(y2 - y1, x2 - x1) / 2 AS s FROM b), p AS (SELECT *, trunc(s * 1.8::DOUBLE)::INT AS pad FROM s), c AS (SELECT *, (y1 + y2) / 2 + pad AS y, (x1 + x2) / 2 + pad AS x FROM p)
  SELECT l_orderkey, l_linenumber, pad, trunc(y - s)::INT AS top, trunc(y + s * 1.8::DOUBLE)::INT AS bottom, trunc(x - s * 1.4::DOUBLE)::INT AS "left", trunc(x + s * 1.4::DOUBLE)::INT AS "right" FROM c""")
def face_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("l_quantity").cast("double"), F.col("l_suppkey").cast("double")
    box = F.array(x, y, x + F.col("l_linenumber") * 10, y + F.col("l_orderkey") % 83)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.crop_box(box).alias("c")).select("l_orderkey", "l_linenumber", "c.*")
