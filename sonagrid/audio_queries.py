"""Queries over audio loading, vector archives and word rules, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .alignment_queries import WORDS, reference_words
from .functions import chain, signal, vectors
from .operators import wordmap
from .queries import long_form, query, table
from .shared import shared_path, written_lines
from .sources import archives, binary, text_tables


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.doubles("embedding").alias("e"))


def resampled_sql(rate: int, to: int) -> str:
    """Direct convolution with the windowed sinc, sample by sample."""
    band = min(rate, to) * 0.99
    x = f"((i - 1) / {rate}.0::DOUBLE - n / {to}.0::DOUBLE) * {band}::DOUBLE"
    kernel = f"CASE WHEN abs({x}) >= 6 THEN 0 WHEN abs({x}) < 1e-12 THEN 1 ELSE sin(pi() * {x}) / (pi() * {x}) * pow(cos(pi() * {x} / 12), 2) END * {band / rate}::DOUBLE"
    return f"SELECT vec_id, n::INT AS i, round(list_sum([e[i] * {kernel} FOR i IN range(1, len(e) + 1)]), 6) + 0.0 AS wave FROM (SELECT vec_id, embedding::DOUBLE[] AS e, unnest(range((len(embedding) * {to} + {rate} - 1) // {rate})) AS n FROM embeddings)"


@query(resampled_sql(3, 2))
def resampled_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 to 16 kHz."""
    return long_form(waves(spark, sf_dir).select("vec_id", signal.load_samples(F.col("e"), own=24000, rate=16000).alias("wave")), "wave")


@query(resampled_sql(160, 441))
def resampled_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 to 44.1 kHz."""
    return long_form(waves(spark, sf_dir).select("vec_id", signal.load_samples(F.col("e"), own=16000, rate=44100).alias("wave")), "wave")


@query("SELECT vec_id, i::INT AS i, round((e[i + 1] + e[len(e) - i]) / 2, 6) + 0.0 AS wave FROM (SELECT vec_id, embedding::DOUBLE[] AS e, unnest(range(len(embedding))) AS i FROM embeddings)")
def channels_by_longer_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels, for every other vector by time instead of by channel."""
    w = waves(spark, sf_dir)
    back = F.reverse("e")
    both = F.when(F.col("vec_id") % 2 == 0, F.array("e", back)).otherwise(F.zip_with("e", back, lambda a, b: F.array(a, b)))
    return long_form(w.select("vec_id", signal.load_samples(both).alias("wave")), "wave")


@query("SELECT vec_id, i::INT AS i, round(c[i % len(c) + 1], 6) + 0.0 AS wave FROM (SELECT vec_id, c, unnest(range(20 * ((len(c) + 19) // 20))) AS i FROM (SELECT vec_id, (embedding::DOUBLE[])[1:48] AS c FROM embeddings))")
def capped_batch_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three seconds at most, in chunks of a second and a quarter, at 16 samples a second."""
    chunks = signal.batch_chunks(F.col("e"), 16, cap=3.0, chunk=1.25)
    return long_form(waves(spark, sf_dir).select("vec_id", F.flatten(chunks).alias("wave")), "wave")


def drawn_sql(seed: str) -> str:
    return f"('0x' || substr(md5('{seed}|' || vec_id), 1, 15))::BIGINT"


def speed_sql(tenths: int) -> str:
    """``resampled_sql``'s kernel for playing at so many tenths of the speed."""
    x, band = f"((i - 1) / {tenths}.0::DOUBLE - n / 10.0::DOUBLE) * {min(tenths, 10) * 0.99}::DOUBLE", min(tenths, 10) * 0.99
    kernel = f"CASE WHEN abs({x}) >= 6 THEN 0 WHEN abs({x}) < 1e-12 THEN 1 ELSE sin(pi() * {x}) / (pi() * {x}) * pow(cos(pi() * {x} / 12), 2) END * {band / tenths}::DOUBLE"
    return f"[list_sum([e[i] * {kernel} FOR i IN range(1, len(e) + 1)]) FOR n IN range((len(e) * 10 + {tenths - 1}) // {tenths})]"


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, {drawn_sql("speed")} % 3 AS k, {drawn_sql("crop")} AS c FROM embeddings),
  s AS (SELECT *, CASE k WHEN 0 THEN e WHEN 1 THEN {speed_sql(9)} ELSE {speed_sql(11)} END AS w FROM v), t AS (SELECT *, c % (len(w) - 23) AS start FROM s)
  SELECT vec_id, (vec_id % 10 + 10 * k)::INT AS label, i::INT AS i, round(w[start + i + 1], 6) + 0.0 AS wave FROM (SELECT *, unnest(range(24)) AS i FROM t)""")
def training_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a wave at one of three speeds, each speed a class of its own, cut to 24 samples."""
    w = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 10).cast("int").alias("label"), vectors.doubles("embedding").alias("wave"))
    stages = [chain.speed("speed", "vec_id"), chain.speed_class(10), chain.crop("crop", "vec_id", 24)]
    return long_form(chain.chained(w, stages, "vec_id", "label", "wave"), "wave")


ARCHIVED = "SELECT 'utt' || vec_id AS utt_id, (i - 1)::INT AS i, (embedding[i])::DOUBLE AS whole{more} FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"


def archived(spark: SparkSession, sf_dir: str) -> str:
    path = shared_path(spark, "archive")
    named = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("utt"), "vec_id").alias("utt_id"), "embedding")
    archives.write_vectors(named, path, "utt_id", "embedding")
    return path


@query(ARCHIVED.format(more=""))
def archive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors written as archives, then scanned."""
    return binary.ark_files(spark, archived(spark, sf_dir)).select("utt_id", F.posexplode("embedding").alias("i", "whole")).withColumn("whole", F.col("whole").cast("double"))


@query(ARCHIVED.format(more="") + " WHERE vec_id % 3 = 0")
def archive_by_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of them, read by the offsets in the indexes."""
    index = archives.index_lines(spark, archived(spark, sf_dir))
    some = archives.vectors_at(index.where(F.substring("utt_id", 4, 20).cast("long") % 3 == 0))
    return some.select("utt_id", F.posexplode("embedding").alias("i", "whole")).withColumn("whole", F.col("whole").cast("double"))


@query("""WITH p AS (SELECT p_partkey, string_split(lower(trim(regexp_replace(p_name, '[^A-Za-z ]', '', 'g'))), ' ') AS w FROM part), q AS (SELECT p_partkey, [x FOR x IN w IF x <> ''] AS w FROM p),
  r AS (SELECT p_partkey, w[1:1 + p_partkey % 2] AS source, CASE WHEN p_partkey % 3 = 0 THEN []::VARCHAR[] ELSE list_reverse(w) END AS parts, CASE WHEN p_partkey % 3 = 0 THEN [w, list_reverse(w)] ELSE [list_reverse(w)] END AS alternatives FROM q WHERE len(w) > 0)
  SELECT source, arg_max(parts, p_partkey) AS parts, arg_max(alternatives, p_partkey) AS alternatives FROM r GROUP BY source""")
def word_rules_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules made of part names: their first words => all of them from the end, or {in order / from the end}."""
    words = F.filter(F.split(F.lower(F.trim(F.regexp_replace("p_name", "[^A-Za-z ]", ""))), " "), lambda w: w != "")
    p = table(spark, sf_dir, "part").select("p_partkey", words.alias("w")).where(F.size("w") > 0)
    said = lambda w: F.array_join(w, " ")
    left = F.upper(said(F.slice("w", F.lit(1), (1 + F.col("p_partkey") % 2).cast("int"))))
    right = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("{ "), said("w"), F.lit(" / "), said(F.reverse("w")), F.lit(" }"))).otherwise(F.concat(said(F.reverse("w")), F.lit(" ; said so")))
    rules = p.select("p_partkey", F.concat(left, F.lit("  =>  "), right).alias("value"))
    comments = p.where("p_partkey = 1").selectExpr("0L AS p_partkey", "'; a comment => none' AS value").union(p.where("p_partkey = 1").selectExpr("0L", "'* rules'"))
    # one file, as rules have an order
    path = written_lines(rules.unionByName(comments).coalesce(1).sortWithinPartitions("p_partkey"), "rules")
    return text_tables.glm(spark, path)


#: Rules made of the words themselves: pairs of words become one, longer words two, some with an alternative.
RULES = WORDS + """, nx AS (SELECT rec, idx, word, st, ed, lead(word) OVER (PARTITION BY rec ORDER BY idx) AS next FROM rw),
  ru AS (SELECT DISTINCT [word, next] AS source, [word || '_' || next] AS parts, [[word || '_' || next]] AS alternatives FROM nx WHERE next IS NOT NULL AND (idx + length(word)) % 7 = 0
    UNION ALL SELECT DISTINCT [word], [substr(word, 1, 4), substr(word, 5)], [[substr(word, 1, 4), substr(word, 5)], [word]] FROM nx WHERE length(word) BETWEEN 7 AND 9)"""


@query(RULES + """, hit AS (SELECT a.rec, a.idx, r.source, r.parts, r.alternatives, len(r.source) AS n FROM nx a JOIN ru r ON r.source = CASE WHEN len(r.source) = 1 THEN [a.word] ELSE [a.word, a.next] END),
  lg AS (SELECT rec, idx, max(n) AS n, arg_max(parts, n) AS parts, arg_max(alternatives, n) AS alternatives FROM hit GROUP BY rec, idx), ct AS (SELECT rec, count(*) AS many FROM nx GROUP BY rec),
  go AS (SELECT rec, 0::BIGINT AS at, many FROM ct UNION ALL SELECT go.rec, go.at + coalesce(lg.n, 1), many FROM go LEFT JOIN lg ON go.rec = lg.rec AND go.at = lg.idx WHERE go.at < many),
  hd AS (SELECT go.rec, go.at AS idx, a.word, a.st, coalesce(b.ed, a.ed) AS ed, lg.parts, lg.alternatives FROM go JOIN nx a ON go.rec = a.rec AND go.at = a.idx LEFT JOIN lg ON go.rec = lg.rec AND go.at = lg.idx LEFT JOIN nx b ON go.rec = b.rec AND b.idx = go.at + lg.n - 1),
  sp AS (SELECT *, coalesce(parts, CASE WHEN word IN ('mm-hmm', 'uh-huh', 'um-hmm') THEN [word] ELSE string_split(regexp_replace(word, '^(.+)-(.+)$', '\\1' || chr(10) || '\\2'), chr(10)) END) AS ps FROM hd),
  ex AS (SELECT *, unnest(range(len(ps)))::INT AS part FROM sp)
  SELECT rec, idx, part, ps[part + 1] AS word, round(st + part * (ed - st) / len(ps), 6) AS st, round(st + (part + 1) * (ed - st) / len(ps), 6) AS ed, coalesce(CASE WHEN len(alternatives) > 1 THEN array_to_string([array_to_string(a, ' ') FOR a IN alternatives], ' / ') END, '') AS alternatives FROM ex""")
def words_standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = reference_words(spark, sf_dir).select("rec", "idx", "word", "st", "ed")
    follows = w.withColumn("next", F.lead("word").over(Window.partitionBy("rec").orderBy("idx")))
    # words are made distinct, not the longer rules made of them
    pairs = follows.where("next IS NOT NULL").where((F.col("idx") + F.length("word")) % 7 == 0).select("word", "next").distinct()
    one = F.array(F.concat_ws("_", "word", "next"))
    two = F.array(F.substring("word", 1, 4), F.substring("word", 5, 100))
    longer = w.where(F.length("word").between(7, 9)).select("word").distinct().select(F.array("word").alias("source"), two.alias("parts"), F.array(two, F.array("word")).alias("alternatives"))
    rules = pairs.select(F.array("word", "next").alias("source"), one.alias("parts"), F.array(one).alias("alternatives")).unionByName(longer)
    out = wordmap.standardised(w, rules, ["rec"])
    lattice = F.array_join(F.transform("alternatives", lambda a: F.array_join(a, " ")), " / ")
    return out.select("rec", "idx", "part", "word", F.round("st", 6).alias("st"), F.round("ed", 6).alias("ed"), F.coalesce(lattice, F.lit("")).alias("alternatives"))
