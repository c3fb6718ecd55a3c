"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, filter_audit, fim, htmltext, kneser_ney, line_dedup, minhash, mixing, secrets, simhash, vamana, warc, wordpiece
from .common import shared_path, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    rows = warc.read_warc(spark, path, payloads=False).where("last")
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("chunk_no").alias("n_chunks"), "digest_ok")


def op2_vamana(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vamana.nearest(table(spark, sf_dir, "embeddings"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.with_neighbours(table(spark, sf_dir, "documents")).drop("code")


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(table(spark, sf_dir, "pages"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_wordpiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), VOCABULARY)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), secrets.digest("base").alias("base_sha256"), secrets.spans_text("spans").alias("spans"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), VOCABULARY)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = fim.transform(table(spark, sf_dir, "documents")).withColumn("output_sha256", F.sha2("output", 256))
    return fim.restore(moved).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2("restored", 256).alias("restored_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_warc, op2_vamana, op3_simhash, op4_kneser_ney, op5_html_text, op6_minhash, op7_mixing, op8_wordpiece, op9_secrets, op10_bpe)
    own += (op11_fim, op12_filter_audit, op13_line_dedup, pipeline)
    return {f.__name__: f for f in own}


OP1 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS n, sha256(h) AS s FROM p),
  f AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS first FROM d), r AS (SELECT *, n >= 100 AND page_id <> first AS again FROM f)
  SELECT page_id, n AS payload_bytes, s AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to,
    CASE WHEN again THEN 1 ELSE greatest(1, (n + 1048575) // 1048576) END::INT AS n_chunks, true AS digest_ok FROM r"""

OP7 = r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS place FROM documents),
  s AS (SELECT source, sum(size)::BIGINT AS held, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
  k AS (SELECT *, row_number() OVER (ORDER BY 2 * held / w, source NULLS LAST) AS k FROM s),
  l AS (SELECT *, (1.5 * sum(held) OVER () - coalesce(sum(2 * held) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM k),
  t AS (SELECT source, held, CASE WHEN k < (SELECT min(k) FROM l WHERE level <= 2 * held / w) THEN 2.0::DOUBLE * held ELSE w * (SELECT arg_min(level, k) FROM l WHERE level <= 2 * held / w) END AS target FROM l),
  g AS (SELECT *, least(round(target)::BIGINT, 2 * held) AS given FROM t),
  q AS (SELECT *, CASE WHEN held = 0 THEN 0 ELSE given // held END AS passes, CASE WHEN held = 0 THEN 0 ELSE given % held END AS rest FROM g),
  c AS (SELECT d.*, q.* EXCLUDE (source), sum(size) OVER (PARTITION BY d.source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
  u AS (SELECT source, max(CASE WHEN through <= rest THEN place END) AS upto, max(rest) - coalesce(max(CASE WHEN through <= rest THEN through END), 0) AS missing FROM c GROUP BY source),
  x AS (SELECT c.source, arg_min(place, (abs(missing - size), place)) AS extra FROM c JOIN u ON c.source IS NOT DISTINCT FROM u.source WHERE place > coalesce(upto, '') AND size > 0 AND size < 2 * missing GROUP BY c.source)
  SELECT doc_id, size, held AS source_size, target, (size * (passes + coalesce(place <= upto, false)::INT + coalesce(place = extra, false)::INT))::BIGINT AS taken
  FROM c JOIN u ON c.source IS NOT DISTINCT FROM u.source LEFT JOIN x ON c.source IS NOT DISTINCT FROM x.source"""

OP11 = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
  u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS us, [('0x' || substr(s, 8 * i + 1, 8))::BIGINT FOR i IN [0, 1, 2, 3]] AS h FROM d),
  c AS (SELECT *, len(us) AS n, least(h[1] % (len(us) + 1), h[2] % (len(us) + 1)) AS a, greatest(h[1] % (len(us) + 1), h[2] % (len(us) + 1)) AS b FROM u),
  p AS (SELECT *, array_to_string(us[1:a], '') AS p, array_to_string(us[a + 1:b], '') AS m, array_to_string(us[b + 1:], '') AS s3,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c),
  o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s3 || '<M>' || m ELSE '<S>' || s3 || '<P>' || p || '<M>' || m END AS o FROM p),
  r AS (SELECT *, strpos(o, '<P>') AS ip, strpos(o, '<S>') AS i_s, strpos(o, '<M>') AS im FROM o)
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(o) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN o WHEN 'psm' THEN substr(o, 4, i_s - 4) || substr(o, im + 3) || substr(o, i_s + 3, im - i_s - 3)
      ELSE substr(o, ip + 3, im - ip - 3) || substr(o, im + 3) || substr(o, 4, ip - 4) END) AS restored_sha256 FROM r"""

OP12 = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
  f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t),
      'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)} AS x FROM d LEFT JOIN l USING (doc_id)),
  m AS (SELECT part, (CASE WHEN x.A THEN 'A' ELSE '' END) || (CASE WHEN x.B THEN 'B' ELSE '' END) || (CASE WHEN x.C THEN 'C' ELSE '' END) || (CASE WHEN x.D THEN 'D' ELSE '' END) || (CASE WHEN x.E THEN 'E' ELSE '' END) AS mask,
      count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
  k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
  o AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM k a, k b, k c, k d, k e WHERE length(list_aggregate(list_distinct([a.k, b.k, c.k, d.k, e.k]), 'string_agg', '')) = 5),
  s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5])::INT AS step FROM o), t AS (SELECT *, filter_order[step] AS letter, filter_order[1:step - 1] AS before FROM s),
  g AS (SELECT part, filter_order, step, letter, n, good, toxic, contains(mask, letter) AS fails, mask = letter AS only_this, before <> '' AND mask <> '' AND regexp_matches(mask, '[' || before || '_]') AS gone FROM t, m),
  r AS (SELECT part, filter_order, step, letter, sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END)::BIGINT AS removed,
      sum(CASE WHEN gone AND fails THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN only_this THEN n ELSE 0 END)::BIGINT AS unique_fails,
      sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM g GROUP BY ALL)
  SELECT * EXCLUDE (letter), (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r"""

OP13 = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
  l AS (SELECT r, doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM d),
  k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
  f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
  x AS (SELECT k.*, f.key IS NOT NULL AND f.last IS DISTINCT FROM k.doc_id AS gone FROM k LEFT JOIN f ON k.key = f.key)
  SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM x GROUP BY r"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1, "op7_mixing": OP7, "op11_fim": OP11, "op12_filter_audit": OP12, "op13_line_dedup": OP13}
