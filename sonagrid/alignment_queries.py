"""Queries over word and metadata alignments, who spoke what, tags, reference times and performance reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import alignment, performance
from .queries import SEG, halves, query, table
from .shared import dealt

#: Characters of conversations in a partition: some 500,000 words.
TEXT_A_TASK = 3_000_000
#: Seconds of a cell in which metadata events, of up to 2.25 s, are compared with each other.
METADATA_CELL = 10.0
WORD = "[^\\x20\\x09-\\x0D]+"


def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, role, idx, word, at): the words of each conversation, four a second, with a pause after every eighth."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("rec"), "role", "turn", "text")
    c = dealt(t, ["rec"], F.length("text"), TEXT_A_TASK).select("rec", "role", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("pos", "word"))
    w = alignment.placed(c, ["rec"], ["turn", "pos"], "idx")
    return w.select("rec", "role", "idx", "word", (F.col("idx") * 0.25 + F.floor(F.col("idx") / 8) * 0.5).alias("at"))


def every(n: int, rest: int) -> Column:
    return F.col("idx") % n == rest


def reference_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as a reference has them: with filled pauses, fragments, sounds and hyphenated words."""
    kind = F.when(every(17, 3), "fp").when(every(19, 5), "frag").when(every(23, 7), "non-lex").otherwise("lex")
    word = F.when(kind == "frag", F.concat(F.substring("word", 1, 3), F.lit("-"))).when(every(29, 11), F.concat_ws("-", "word", "word")).otherwise(F.col("word"))
    return recorded(spark, sf_dir).select("rec", F.col("role").alias("speaker"), "idx", (F.col("idx") * 2).alias("seq"), word.alias("word"), kind.alias("kind"), F.col("at").alias("st"), (F.col("at") + 0.25).alias("ed"))


def system_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a recogniser made of them: shifted, some missing, misheard, cut short or put in."""
    w = recorded(spark, sf_dir)
    kind = F.when(every(13, 6), "frag").otherwise("lex")
    word = F.when(kind == "frag", F.concat(F.substring("word", 1, 3), F.lit("-"))).when(every(11, 5), F.concat("word", F.lit("x"))).otherwise(F.col("word"))
    st = F.col("at") + (F.col("idx") % 5 - 2) * 0.0625
    heard = w.where(~every(7, 3)).select("rec", (F.col("idx") * 2).alias("seq"), word.alias("word"), kind.alias("kind"), st.alias("st"), (st + 0.25).alias("ed"))
    added = w.where(every(9, 4)).select("rec", (F.col("idx") * 2 + 1).alias("seq"), F.lit("uh").alias("word"), F.lit("fp").alias("kind"), (F.col("at") + 0.125).alias("st"), (F.col("at") + 0.375).alias("ed"))
    return heard.union(added)


def bare_sql(w: str) -> str:
    return f"regexp_replace({w}, '^-+|-+$', '', 'g')"


def weight_sql(w: str, k: str) -> str:
    return f"CASE WHEN {k} IN ('non-lex', 'misc') THEN 0 WHEN regexp_matches({bare_sql(w)}, '^[^-]+$') OR {bare_sql(w)} IN ('mm-hmm', 'uh-huh', 'um-hmm') THEN 1 ELSE 2 END"


def lone_sql(t: str) -> str:
    w = weight_sql(f"{t}.word", f"{t}.kind")
    return f"CASE WHEN {t}.kind = 'lex' THEN -1000 * ({w}) ELSE -200 * greatest(1, {w}) END"


PAIR_SQL = f"""CASE WHEN (a.word = b.word AND a.kind = b.kind) OR (a.kind = 'lex' AND b.kind = 'frag' AND {bare_sql("b.word")} <> '' AND contains(a.word, {bare_sql("b.word")}))
    OR (a.kind = 'frag' AND b.kind = 'lex' AND {bare_sql("a.word")} <> '' AND contains(b.word, {bare_sql("a.word")})) OR (a.kind = b.kind AND a.kind IN ('fp', 'frag')) THEN 0
  WHEN a.kind = b.kind AND a.kind <> 'lex' THEN -100 * greatest(1, {weight_sql("a.word", "a.kind")}) ELSE -1000 * greatest(1, {weight_sql("a.word", "a.kind")}, {weight_sql("b.word", "b.kind")}) END"""

WORDS = f"""WITH RECURSIVE cw AS (SELECT conv_id AS rec, role, turn, regexp_extract_all(text, '{WORD}') AS ws FROM conversations), cu AS (SELECT rec, role, turn, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM cw),
  ci AS (SELECT rec, role, word, row_number() OVER (PARTITION BY rec ORDER BY turn, pos) - 1 AS idx FROM cu), w AS (SELECT *, idx * 0.25::DOUBLE + (idx // 8) * 0.5::DOUBLE AS b FROM ci),
  rk AS (SELECT *, CASE WHEN idx % 17 = 3 THEN 'fp' WHEN idx % 19 = 5 THEN 'frag' WHEN idx % 23 = 7 THEN 'non-lex' ELSE 'lex' END AS kind FROM w),
  rw AS (SELECT rec, role AS speaker, idx, idx * 2 AS seq, CASE WHEN kind = 'frag' THEN substr(word, 1, 3) || '-' WHEN idx % 29 = 11 THEN word || '-' || word ELSE word END AS word, kind, b AS st, b + 0.25 AS ed FROM rk),
  sw AS (SELECT rec, idx * 2 AS seq, CASE WHEN idx % 13 = 6 THEN substr(word, 1, 3) || '-' WHEN idx % 11 = 5 THEN word || 'x' ELSE word END AS word, CASE WHEN idx % 13 = 6 THEN 'frag' ELSE 'lex' END AS kind,
      b + (idx % 5 - 2) * 0.0625 AS st, b + (idx % 5 - 2) * 0.0625 + 0.25 AS ed FROM w WHERE idx % 7 <> 3
    UNION ALL SELECT rec, idx * 2 + 1, 'uh', 'fp', b + 0.125, b + 0.375 FROM w WHERE idx % 9 = 4)"""
#: Places on both sides and pairs of words with their gain.
WORD_PAIRS = f""", ra AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY (st + ed) / 2, seq) - 1 AS r FROM rw), sa AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY (st + ed) / 2, seq) - 1 AS s FROM sw),
  wp AS (SELECT a.rec, a.r, b.s, a.seq AS ref_seq, b.seq AS sys_seq, {PAIR_SQL} AS pair, {lone_sql("a")} AS lr, {lone_sql("b")} AS ls FROM ra a JOIN sa b ON a.rec = b.rec AND a.ed + 0.1 > b.st AND b.ed + 0.1 > a.st),
  pairs AS (SELECT rec, r, s, (pair - lr - ls)::DOUBLE AS gain FROM wp)"""


def chain_sql(key: str, pairs: str = "pairs", name: str = "best") -> str:
    """The pairs of the heaviest chain by piece: a list of gains grown pair by pair, then traced back."""
    n = name
    return f""", {n}_g AS (SELECT * FROM {pairs} WHERE gain > 0), {n}_m AS (SELECT *, max(s) OVER (PARTITION BY {key} ORDER BY r RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sofar, min(s) OVER (PARTITION BY {key} ORDER BY r RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {n}_g),
  {n}_p AS (SELECT {key}, r, s, gain, max(CASE WHEN sofar IS NULL OR sofar < rest THEN r END) OVER (PARTITION BY {key} ORDER BY r RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS piece FROM {n}_m),
  {n}_l AS (SELECT {key}, piece, list({{'r': r, 's': s, 'gain': gain}} ORDER BY r, s) AS p FROM {n}_p GROUP BY ALL),
  {n}_d AS (SELECT {key}, piece, p, 1 AS k, [p[1].gain] AS b, [0::BIGINT] AS f FROM {n}_l
    UNION ALL SELECT {key}, piece, p, k + 1, list_append(b, p[k + 1].gain + coalesce(b[j], 0)), list_append(f, coalesce(j, 0)) FROM
      (SELECT *, (list_sort([{{'t': b[i], 's': -p[i].s, 'r': -p[i].r, 'i': i}} FOR i IN range(1, k + 1) IF p[i].r < p[k + 1].r AND p[i].s < p[k + 1].s], 'DESC'))[1].i AS j FROM {n}_d WHERE k < len(p))),
  {n}_t AS (SELECT {key}, piece, p, f, (list_sort([{{'t': b[i], 's': -p[i].s, 'r': -p[i].r, 'i': i}} FOR i IN range(1, k + 1)], 'DESC'))[1].i AS i FROM {n}_d WHERE k = len(p)
    UNION ALL SELECT {key}, piece, p, f, f[i] FROM {n}_t WHERE f[i] > 0),
  {n} AS (SELECT {key}, p[i].r AS r, p[i].s AS s, p[i].gain AS gain, piece FROM {n}_t)"""


@query(WORDS + WORD_PAIRS + " SELECT rec, ref_seq, sys_seq, pair, pair - lr - ls AS gain FROM wp")
def word_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = alignment.word_pairs(*[alignment.weighed(w(spark, sf_dir)) for w in (reference_words, system_words)], ["rec"])
    return pairs.select("rec", F.col("ref.seq").alias("ref_seq"), F.col("sys.seq").alias("sys_seq"), "pair", "gain")


ALIGNED = WORDS + WORD_PAIRS + chain_sql("rec") + """, al AS (SELECT coalesce(a.rec, c.rec) AS rec, a.seq AS ref_seq, c.seq AS sys_seq, c.gain, a.word AS rword, a.kind AS rkind, a.speaker, c.word AS sword, c.kind AS skind, a.st AS rst, a.ed AS red, c.st, c.ed
    FROM ra a FULL JOIN (SELECT sa.*, best.r, best.gain FROM sa LEFT JOIN best ON sa.rec = best.rec AND sa.s = best.s) c ON a.rec = c.rec AND a.r = c.r)"""


def word_alignment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_words(reference_words(spark, sf_dir), system_words(spark, sf_dir), ["rec"])


@query(ALIGNED + " SELECT rec, ref_seq, sys_seq, gain FROM al")
def word_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_alignment_rows(spark, sf_dir).select("rec", F.col("ref.seq").alias("ref_seq"), F.col("sys.seq").alias("sys_seq"), "gain")


@query(ALIGNED + f""", e AS (SELECT al.*, a.word IS NOT NULL AS hr, b.word IS NOT NULL AS hs, CASE WHEN a.word IS NOT NULL AND b.word IS NOT NULL THEN {PAIR_SQL} WHEN a.word IS NOT NULL THEN {lone_sql("a")} ELSE {lone_sql("b")} END <= -500 AS wrong,
    CASE WHEN a.word IS NOT NULL THEN {weight_sql("a.word", "a.kind")} ELSE 0 END AS weight FROM al LEFT JOIN rw a ON al.rec = a.rec AND al.ref_seq = a.seq LEFT JOIN sw b ON al.rec = b.rec AND al.sys_seq = b.seq)
  SELECT rec, coalesce(speaker, '(none)') AS speaker, sum(weight)::BIGINT AS n_ref, count(*) FILTER (wrong AND hr AND NOT hs) AS n_del, count(*) FILTER (wrong AND hs AND NOT hr) AS n_ins, count(*) FILTER (wrong AND hr AND hs) AS n_sub FROM e GROUP BY ALL""")
def word_path_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alignment.word_path(word_alignment_rows(spark, sf_dir))
    sums = [F.sum(a).cast("long").alias(b) for a, b in zip(("n_ref", "del", "ins", "sub"), performance.ERRORS, strict=True)]
    return rows.groupBy("rec", F.coalesce("ref.speaker", F.lit("(none)")).alias("speaker")).agg(*sums)


#: Reference words of the speakers, and every third word said by another voice at once, a bit later.
VOICES = ", rv AS (SELECT rec, speaker, seq, word, kind, st, ed FROM rw UNION ALL SELECT rec, 'echo', seq + 1, word, kind, st + 0.0625, ed + 0.0625 FROM rw WHERE idx % 3 = 0)"


@query(WORDS + VOICES + f""", ra AS (SELECT *, row_number() OVER (PARTITION BY rec, speaker ORDER BY (st + ed) / 2, seq) - 1 AS r FROM rv), sa AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY (st + ed) / 2, seq) - 1 AS s FROM sw),
  pairs AS (SELECT a.rec, a.speaker, a.r, b.s, ({PAIR_SQL} - ({lone_sql("a")}) - ({lone_sql("b")}))::DOUBLE AS gain FROM ra a JOIN sa b ON a.rec = b.rec AND a.ed + 0.1 > b.st AND b.ed + 0.1 > a.st)"""
  + chain_sql("rec, speaker") + f""", rc AS (SELECT a.rec, a.speaker, a.r, sum({lone_sql("a")}) OVER (PARTITION BY rec, speaker ORDER BY r) AS cost, r = max(r) OVER (PARTITION BY rec, speaker) AS last FROM ra a),
  sc AS (SELECT b.rec, b.s, sum({lone_sql("b")}) OVER (PARTITION BY rec) - sum({lone_sql("b")}) OVER (PARTITION BY rec ORDER BY s) AS rest FROM sa b),
  tt AS (SELECT *, sum(gain) OVER (PARTITION BY rec, speaker ORDER BY r) AS total FROM best), q AS (SELECT tt.rec, tt.s, tt.speaker, tt.r, total + cost + CASE WHEN last THEN rest ELSE 0 END AS score FROM tt JOIN rc USING (rec, speaker, r) JOIN sc USING (rec, s))
  SELECT rec, s, arg_max(speaker, (score, speaker)) AS speaker, arg_max(r, (score, speaker)) AS r, count(*) AS speakers FROM q GROUP BY rec, s""")  # fmt: skip
def words_spoken_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = reference_words(spark, sf_dir)
    late = [(F.col(c) + 0.0625).alias(c) for c in ("st", "ed")]
    echo = ref.where(every(3, 0)).select("rec", F.lit("echo").alias("speaker"), (F.col("seq") + 1).alias("seq"), "word", "kind", *late)
    return alignment.spoken_by(ref.drop("idx").unionByName(echo), system_words(spark, sf_dir), ["rec"])


#: Metadata of the reference, nested, crossing and touching, and the system's: later by some, fewer, with other subtypes.
METADATA = """, md AS (SELECT rec, speaker, idx * 8 AS seq, 'SU' AS type, CASE WHEN idx // 10 % 2 = 0 THEN 'statement' ELSE 'question' END AS subtype, st, st + 2.25 AS ed FROM rw WHERE idx % 10 = 0
    UNION ALL SELECT rec, speaker, idx * 8 + 1, 'EDIT', CASE WHEN idx % 2 = 0 THEN 'repetition' ELSE 'revision' END, st, st + 1 FROM rw WHERE idx % 15 IN (3, 5)
    UNION ALL SELECT rec, speaker, idx * 8 + 2, 'FILLER', CASE WHEN idx % 2 = 0 THEN 'filled_pause' ELSE 'discourse_marker' END, st, st + 0.5 FROM rw WHERE idx % 15 = 4
    UNION ALL SELECT rec, speaker, idx * 8 + 3, 'IP', 'edit', ed, ed FROM rw WHERE idx % 15 = 7),
  ms AS (SELECT rec, seq, type, CASE WHEN seq % 5 = 0 AND type = 'SU' THEN 'question' WHEN seq % 3 = 0 AND type = 'EDIT' THEN 'revision' ELSE subtype END AS subtype, st + (seq % 3) * 0.125 AS st, ed + (seq % 3) * 0.125 AS ed FROM md WHERE seq % 7 <> 2)"""


def metadata(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    w = reference_words(spark, sf_dir)
    even = lambda c, a, b: F.when(c % 2 == 0, a).otherwise(b)
    idx, st = F.col("idx"), F.col("st")
    kinds = [
        (every(10, 0), 0, "SU", even(F.floor(idx / 10), "statement", "question"), st, st + 2.25),
        (every(15, 3) | every(15, 5), 1, "EDIT", even(idx, "repetition", "revision"), st, st + 1),
        (every(15, 4), 2, "FILLER", even(idx, "filled_pause", "discourse_marker"), st, st + 0.5),
        (every(15, 7), 3, "IP", F.lit("edit"), F.col("ed"), F.col("ed")),
    ]
    of = F.explode(F.array(*[F.when(c, F.struct((idx * 8 + k).alias("seq"), F.lit(t).alias("type"), s.alias("subtype"), a.alias("st"), b.alias("ed"))) for c, k, t, s, a, b in kinds]))
    ref = w.select("rec", "speaker", of.alias("e")).where("e IS NOT NULL").select("rec", "speaker", "e.*")
    seq, late = F.col("seq"), F.col("seq") % 3 * 0.125
    subtype = F.when((seq % 5 == 0) & (F.col("type") == "SU"), "question").when((seq % 3 == 0) & (F.col("type") == "EDIT"), "revision").otherwise(F.col("subtype"))
    return ref, ref.where(seq % 7 != 2).select("rec", "seq", "type", subtype.alias("subtype"), (st + late).alias("st"), (F.col("ed") + late).alias("ed"))


def middles(words: DataFrame) -> DataFrame:
    return words.withColumn("mid", (F.col("st") + F.col("ed")) / 2)


@query(WORDS + METADATA + """, wm AS (SELECT rec, idx, (st + ed) / 2 AS mid FROM rw), en AS (SELECT md.*, (SELECT max(idx) FROM wm WHERE wm.rec = md.rec AND wm.mid <= md.ed) AS last FROM md),
  hit AS (SELECT wm.rec, wm.idx, e.type, e.subtype, ((e.st + e.ed) / 2, e.seq) AS o FROM wm JOIN en e ON wm.rec = e.rec AND ((e.type IN ('EDIT', 'FILLER') AND wm.mid BETWEEN e.st AND e.ed) OR (e.type IN ('SU', 'IP') AND wm.idx = e.last)))
  SELECT wm.rec, wm.idx, arg_max(subtype, o) FILTER (type = 'EDIT') AS edit, arg_max(subtype, o) FILTER (type = 'FILLER') AS filler, arg_max(subtype, o) FILTER (type = 'IP') AS ip, arg_max(subtype, o) FILTER (type = 'SU') AS su
  FROM wm LEFT JOIN hit USING (rec, idx) GROUP BY wm.rec, wm.idx""")
def words_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = alignment.tagged_words(middles(reference_words(spark, sf_dir)), metadata(spark, sf_dir)[0], ["rec"])
    return tagged.select("rec", "idx", "edit", "filler", "ip", "su")


@query(ALIGNED + """, an AS (SELECT * FROM al WHERE ref_seq IS NOT NULL AND sys_seq IS NOT NULL), tm AS (SELECT rec, idx, st + 0.3 AS t FROM rw WHERE idx % 4 = 1),
  rt AS (SELECT rec, idx, t, (SELECT {'st': st, 'ed': ed, 'rst': rst, 'red': red} FROM an WHERE an.rec = tm.rec AND an.ed >= t ORDER BY st, ed, sys_seq LIMIT 1) AS a, (SELECT {'st': st, 'ed': ed, 'rst': rst, 'red': red} FROM an WHERE an.rec = tm.rec AND an.st <= t ORDER BY st DESC, ed DESC, sys_seq DESC LIMIT 1) AS b0 FROM tm),
  bb AS (SELECT *, CASE WHEN a.st <= t THEN a ELSE b0 END AS b FROM rt), pt AS (SELECT *, CASE WHEN a.st < t THEN a.ed ELSE a.st END AS t2, CASE WHEN a.st < t THEN a.red ELSE a.rst END AS r2, CASE WHEN b.ed > t THEN b.st ELSE b.ed END AS t1, CASE WHEN b.ed > t THEN b.rst ELSE b.red END AS r1 FROM bb)
  SELECT rec, idx, round(CASE WHEN a IS NULL AND b IS NULL THEN t WHEN b IS NULL THEN r2 + (t - t2) WHEN a IS NULL THEN r1 + (t - t1) WHEN t = t1 THEN r1 ELSE r1 + (t - t1) * (r2 - r1) / (t2 - t1) END, 5) AS rt FROM pt""")
def times_in_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = word_alignment_rows(spark, sf_dir).where("ref IS NOT NULL AND sys IS NOT NULL")
    anchors = pairs.select("rec", "sys.seq", "sys.st", "sys.ed", F.col("ref.st").alias("rst"), F.col("ref.ed").alias("red"))
    times = reference_words(spark, sf_dir).where(every(4, 1)).select("rec", "idx", (F.col("st") + 0.3).alias("t"))
    return alignment.in_reference_time(times, anchors, ["rec"]).select("rec", "idx", F.round("rt", 5).alias("rt"))


SPANS = """, wm AS (SELECT rec, idx, (st + ed) / 2 AS mid FROM rw), mr AS (SELECT *, (SELECT count(*) FROM wm WHERE wm.rec = md.rec AND mid < st) AS w0, (SELECT count(*) FROM wm WHERE wm.rec = md.rec AND mid <= ed) - 1 AS w1, row_number() OVER (PARTITION BY rec, type ORDER BY st, seq) - 1 AS r FROM md),
  mt AS (SELECT *, (SELECT count(*) FROM wm WHERE wm.rec = ms.rec AND mid < st) AS w0, (SELECT count(*) FROM wm WHERE wm.rec = ms.rec AND mid <= ed) - 1 AS w1, row_number() OVER (PARTITION BY rec, type ORDER BY st, seq) - 1 AS s FROM ms),
  sh AS (SELECT a.rec, a.type, a.r, b.s, least(a.ed, b.ed) - greatest(CASE WHEN a.type = 'SU' THEN greatest(a.st, a.ed - 2) ELSE a.st END, CASE WHEN a.type = 'SU' THEN greatest(b.st, b.ed - 2) ELSE b.st END) + CASE WHEN a.type = 'IP' THEN 1e-8 ELSE 0 END + 0.5 AS shared,
      a.ed - CASE WHEN a.type = 'SU' THEN greatest(a.st, a.ed - 2) ELSE a.st END AS dur, CASE WHEN a.subtype = b.subtype THEN 1.1 ELSE 1 END::DOUBLE AS f1, CASE WHEN a.w1 = b.w1 THEN 1.001 ELSE 1 END::DOUBLE AS f2
    FROM mr a JOIN mt b ON a.rec = b.rec AND a.type = b.type AND a.ed + 0.5 >= b.st AND b.ed + 0.5 >= a.st),
  pairs AS (SELECT rec, type, r, s, CASE WHEN dur + 0.5 < greatest(dur, 1e-8) THEN shared * f1 * f2 ELSE shared * f1 * f2 * greatest(dur, 1e-8) / (dur + 0.5) END AS gain FROM sh WHERE shared >= 0)"""
MAPPED = WORDS + METADATA + SPANS + chain_sql("rec, type") + """, mal AS (SELECT coalesce(a.rec, c.rec) AS rec, coalesce(a.type, c.type) AS type, a.seq AS ref_seq, c.seq AS sys_seq, c.gain, a.subtype AS ref_subtype, c.subtype AS sys_subtype, a.speaker, a.w0 AS rw0, a.w1 AS rw1, c.w0, c.w1
    FROM mr a FULL JOIN (SELECT mt.*, best.r, best.gain FROM mt LEFT JOIN best ON mt.rec = best.rec AND mt.type = best.type AND mt.s = best.s) c ON a.rec = c.rec AND a.type = c.type AND a.r = c.r)"""


def metadata_alignment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides' events as structs (ref, sys), partners in one row."""
    words = middles(reference_words(spark, sf_dir))
    ref, sys = (alignment.word_spans(m, words, ["rec"]) for m in metadata(spark, sf_dir))
    score = lambda r, s: alignment.metadata_pair_score(r, s, gap=0.5, su_extent=2.0)
    return alignment.align(ref, sys, ["rec", "type"], score, gap=0.5, touching=True, cell=METADATA_CELL)


@query(MAPPED + " SELECT rec, type, ref_seq, sys_seq, round(gain, 6) AS score FROM mal")
def metadata_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata_alignment_rows(spark, sf_dir).select("rec", "type", F.col("ref.seq").alias("ref_seq"), F.col("sys.seq").alias("sys_seq"), F.round("gain", 6).alias("score"))


def rates_sql(columns: str, source: str) -> str:
    rate = lambda c: f"round(least(999.99, 100 / greatest(n_ref::DOUBLE, 1e-8) * ({c})), 4)"
    return f"SELECT {columns}, n_ref, n_del, n_ins, n_sub, {rate('n_del')} AS del, {rate('n_ins')} AS ins, {rate('n_sub')} AS sub, {rate('n_del + n_ins')} AS d_plus_i, {rate('n_del + n_ins + n_sub')} AS total FROM {source}"


def four_places(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in ("del", "ins", "sub", "d_plus_i", "total")})


SUMS = "sum(n_ref)::BIGINT AS n_ref, sum(n_del)::BIGINT AS n_del, sum(n_ins)::BIGINT AS n_ins, sum(n_sub)::BIGINT AS n_sub"
FILE = "'f' || rec % 50 AS file, CASE WHEN rec % 2 = 0 THEN '1' ELSE '2' END AS channel"


def files(df: DataFrame) -> DataFrame:
    return df.withColumns({"file": F.concat(F.lit("f"), F.col("rec") % 50), "channel": F.when(F.col("rec") % 2 == 0, "1").otherwise("2")})


@query(MAPPED + f""", ev AS (SELECT type, {FILE}, coalesce(speaker, 'unknown') AS speaker, CASE speaker WHEN 'user' THEN 'female' WHEN 'assistant' THEN 'male' ELSE 'unknown' END AS gender, (ref_subtype IS NOT NULL)::INT AS n_ref, (ref_subtype IS NOT NULL AND sys_subtype IS NULL)::INT AS n_del,
    (sys_subtype IS NOT NULL AND ref_subtype IS NULL)::INT AS n_ins, coalesce(ref_subtype <> sys_subtype, false)::INT AS n_sub FROM mal),
  lv AS (SELECT type, 'ALL' AS category, {SUMS} FROM ev GROUP BY ALL UNION ALL SELECT type, 'f=' || file, {SUMS} FROM ev GROUP BY ALL UNION ALL SELECT type, 'c=' || channel, {SUMS} FROM ev GROUP BY ALL
    UNION ALL SELECT type, 'c=' || channel || ' f=' || file, {SUMS} FROM ev GROUP BY ALL UNION ALL SELECT type, 's=' || speaker, {SUMS} FROM ev GROUP BY ALL UNION ALL SELECT type, 'g=' || gender, {SUMS} FROM ev GROUP BY ALL) """ + rates_sql("type, category", "lv"))
def metadata_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(metadata_alignment_rows(spark, sf_dir)).withColumns({"speaker": F.col("ref.speaker"), "ref_subtype": F.col("ref.subtype"), "sys_subtype": F.col("sys.subtype")})
    rows = rows.withColumn("gender", F.when(F.col("speaker") == "user", "female").when(F.col("speaker") == "assistant", "male"))
    errors = performance.event_errors(rows, ["type", "file", "channel", "speaker", "gender"])
    return four_places(performance.performance(errors, performance.EVENT_LEVELS))


@query(MAPPED + ", c AS (SELECT type, coalesce(ref_subtype, '{FA}') AS ref, coalesce(sys_subtype, '{Miss}') AS sys FROM mal) SELECT type, ref, sys, count(*) AS n FROM c GROUP BY ALL")
def metadata_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metadata_alignment_rows(spark, sf_dir).select("type", F.col("ref.subtype").alias("ref_subtype"), F.col("sys.subtype").alias("sys_subtype"))
    return performance.confusion(performance.event_errors(rows, ["type"]))


@query(MAPPED + f""", lw AS (SELECT rec, max(idx) AS last FROM rw GROUP BY rec), sd AS (SELECT rec, type, 'r' AS side, ref_subtype AS subtype, rw0 AS w0, rw1 AS w1, sys_seq IS NOT NULL AS mapped FROM mal WHERE ref_seq IS NOT NULL UNION ALL SELECT rec, type, 's', sys_subtype, w0, w1, ref_seq IS NOT NULL FROM mal WHERE sys_seq IS NOT NULL),
  sp AS (SELECT rec, type, side, subtype, mapped OR type IN ('EDIT', 'FILLER') AS maps, unnest(CASE WHEN type IN ('EDIT', 'FILLER') THEN range(greatest(0, w0), least(w1, last) + 1) ELSE [greatest(0, least(w1, last))] END) AS idx FROM sd JOIN lw USING (rec)),
  bs AS (SELECT rec, type, idx, subtype, count(*) FILTER (side = 'r' AND maps) AS nr, count(*) FILTER (side = 'r' AND NOT maps) AS nm, count(*) FILTER (side = 's' AND maps) AS ns, count(*) FILTER (side = 's' AND NOT maps) AS ni FROM sp GROUP BY ALL),
  bw AS (SELECT rec, type, idx, sum(nr + nm) AS r, sum(ns) AS s, sum(ni) AS i, sum(least(nr, ns)) AS c FROM bs GROUP BY ALL),
  er AS (SELECT type, {FILE}, r AS n_ref, greatest(r - s, 0) AS n_del, greatest(s - r, 0) + i AS n_ins, least(r, s) - c AS n_sub FROM bw WHERE idx % 21 <> 2 OR type IN ('SU', 'IP')),
  lv AS (SELECT type, 'ALL' AS category, {SUMS} FROM er GROUP BY ALL UNION ALL SELECT type, 'f=' || file, {SUMS} FROM er GROUP BY ALL UNION ALL SELECT type, 'c=' || channel, {SUMS} FROM er GROUP BY ALL UNION ALL SELECT type, 'c=' || channel || ' f=' || file, {SUMS} FROM er GROUP BY ALL) """ + rates_sql("type, category", "lv"))
def metadata_word_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 21st word isn't scored."""
    rows = metadata_alignment_rows(spark, sf_dir)
    side = lambda own, other: rows.where(F.col(own).isNotNull()).select("rec", "type", f"{own}.subtype", f"{own}.w0", f"{own}.w1", F.col(other).isNotNull().alias("mapped"))
    words = reference_words(spark, sf_dir).select("rec", "idx", (~every(21, 2)).alias("scored"))
    errors = performance.word_errors(side("ref", "sys"), side("sys", "ref"), words, ["rec"])
    return four_places(performance.performance(files(errors)))


EVENT_ALIGNED = SEG.replace("WITH ", "WITH RECURSIVE ", 1) + """, ra AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY st, seq) - 1 AS r FROM seg WHERE event_id % 2 = 0), sa AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY st, seq) - 1 AS s FROM seg WHERE event_id % 2 = 1),
  pairs AS (SELECT a.rec, r, s, (least(a.ed, b.ed) - greatest(a.st, b.st)) / greatest(a.ed - a.st, b.ed - b.st) AS gain FROM ra a JOIN sa b ON a.rec = b.rec AND a.ed > b.st AND b.ed > a.st)""" + chain_sql("rec") + """,
  al AS (SELECT coalesce(a.rec, c.rec) AS rec, a.seq AS ref_seq, c.seq AS sys_seq, c.gain AS score FROM ra a FULL JOIN (SELECT sa.*, best.r, best.gain FROM sa LEFT JOIN best ON sa.rec = best.rec AND sa.s = best.s) c ON a.rec = c.rec AND a.r = c.r)"""


@query(EVENT_ALIGNED + " SELECT rec, ref_seq, sys_seq, round(score, 6) AS score FROM al")
def event_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = halves(spark, sf_dir)
    return alignment.align_events(a, b, ["rec"]).withColumn("score", F.round("score", 6))


@query(EVENT_ALIGNED + " SELECT rec, count(ref_seq) AS ref, count(*) FILTER (ref_seq IS NOT NULL AND sys_seq IS NULL) AS del, count(*) FILTER (ref_seq IS NULL) AS ins, count(*) FILTER (ref_seq IS NOT NULL AND sys_seq IS NOT NULL) AS matched FROM al GROUP BY rec")
def alignment_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = halves(spark, sf_dir)
    return alignment.error_counts(alignment.align_events(a, b, ["rec"]), ["rec"])
