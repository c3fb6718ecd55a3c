"""Scans and sinks of line-based formats; every reader goes through Spark, so any store works."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import labels
from ..operators.manifests import assert_unique, assert_vocab, last_wins, suffixed

#: The types that an RTTM line may have.
RTTM_TYPES = ["SEGMENT", "NOSCORE", "NO_RT_METADATA", "LEXEME", "NON-LEX", "NON-SPEECH", "FILLER", "EDIT", "SU", "IP", "CB", "A/P", "SPEAKER", "SPKR-INFO"]


def lines(spark: SparkSession, path: str | list[str], *, joined: bool = False) -> DataFrame:
    """(file, pos, value): lines with their order in a file, or with ``joined`` in all files, one after another by name.

    Text files are read in splits. A split's first position is the number of lines in those before it, counted first; so
    no file passes a task whole.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"), "value")
    splits = rows.groupBy("file", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    before = (Window.orderBy("file", "_b") if joined else Window.partitionBy("file").orderBy("_b")).rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "_b", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start"))
    return rows.join(F.broadcast(starts), ["file", "_b"]).select("file", (F.col("_start") + F.col("_i")).cast("int").alias("pos"), "value")


def fields(value: str = "value") -> F.Column:
    return F.split(F.trim(F.regexp_replace(value, r"\s+", " ")), " ")


def wav_scp(spark: SparkSession, path: str) -> DataFrame:
    """(utt_id, path); of lines with one id the last counts."""
    rows = lines(spark, path).select("pos", fields().alias("f")).where(F.size("f") >= 2)
    return last_wins(rows.select(F.col("f")[0].alias("utt_id"), F.col("f")[1].alias("path"), "pos"), ["utt_id"], "pos").drop("pos")


def strict_pairs(spark: SparkSession, path: str, names: tuple[str, str], suffix: str = "", *, both: bool = False) -> DataFrame:
    """Two columns of a manifest whose first is unique; ``suffix`` goes on the first or on both."""
    rows = spark.read.text(path).select(fields().alias("f"))
    second = suffixed(F.col("f")[1], suffix) if both else F.col("f")[1]
    return assert_unique(rows.select(suffixed(F.col("f")[0], suffix).alias(names[0]), second.alias(names[1])), names[0])


def segment_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header and unique ID."""
    rows = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("escape", '"').csv(path)
    return assert_unique(rows, "ID")


def write_segment_csv(df: DataFrame, path: str) -> None:
    """A CSV with header; fields are quoted where they need it, quotes doubled, as ``segment_csv`` reads them."""
    df.write.option("header", True).option("escape", '"').csv(path)


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """``json_segments`` of files with one object to a line, which Spark can split."""
    kind = "map<string,struct<file:string,start:double,stop:double>>"
    return spark.read.text(path).select(F.explode(F.from_json("value", kind)).alias("segid", "s")).select("segid", "s.*")


def json_segments(spark: SparkSession, path: str) -> DataFrame:
    """(segid, file, start, stop) of an object of objects."""
    kind = "map<string,struct<file:string,start:double,stop:double>>"
    rows = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", kind)).alias("segid", "s"))
    return rows.select("segid", "s.*")


def trans7time(spark: SparkSession, path: str) -> DataFrame:
    """(pos, spk_id, st, ed, content); content is all further tokens without spaces; fewer than three tokens are an error."""
    rows = lines(spark, path).where(F.trim("value") != "").select("pos", "value", fields().alias("f"))
    ok = F.when(F.size("f") >= 3, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("too few fields: "), "value")))
    rows = rows.select("pos", ok.alias("f"))
    rest = F.when(F.size("f") > 3, F.array_join(F.slice("f", F.lit(4), F.size("f")), "")).otherwise("")
    return rows.select("pos", F.col("f")[0].alias("spk_id"), F.col("f")[1].cast("double").alias("st"), F.col("f")[2].cast("double").alias("ed"), rest.alias("content"))


def rttm(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """RTTM rows with tend and tmid. Comments and blank lines are skipped; stars are taken off; <na> durations are 0.

    Fewer than nine fields, an unknown type or a negative duration are errors.
    """
    rows = lines(spark, path).where(~F.col("value").rlike(r"^\s*([#;]|$)"))
    rows = rows.select("file", "pos", "value", fields(F.regexp_replace("value", r"\*", "")).alias("f"))
    f = F.when(F.size("f") >= 9, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("too few fields: "), "value")))
    rows = rows.select("file", "pos", f.alias("f"))
    num = lambda i: F.when(F.lower(F.col("f")[i]) == "<na>", 0.0).otherwise(F.col("f")[i].cast("double"))
    dur = F.when(num(4) < 0, F.raise_error(F.lit("negative duration")).cast("double")).otherwise(num(4))
    out = rows.select(F.upper(F.col("f")[0]).alias("type"), F.col("f")[1].alias("name"), F.col("f")[2].alias("chnl"), num(3).alias("tbeg"), dur.alias("tdur"), F.lower(F.col("f")[5]).alias("word"), F.lower(F.col("f")[6]).alias("subt"), F.col("f")[7].alias("spkr"), F.col("f")[8].alias("conf"), "pos")
    out = out.withColumns({"tend": F.col("tbeg") + F.col("tdur"), "tmid": F.col("tbeg") + F.col("tdur") / 2})
    return assert_vocab(out, "type", RTTM_TYPES)


def uem(spark: SparkSession, path: str) -> DataFrame:
    """(name, chnl, st, ed): evaluated parts, positive and without overlap; folders and extensions are taken off."""
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*([#;]|$)")).select(fields().alias("f"))
    name = F.regexp_replace(F.col("f")[0], r"^.*/|\.[^.]*$", "")
    rows = rows.select(name.alias("name"), F.col("f")[1].alias("chnl"), F.col("f")[2].cast("double").alias("st"), F.col("f")[3].cast("double").alias("ed"))
    last = F.lag("ed").over(Window.partitionBy("name", "chnl").orderBy("st"))
    bad = rows.withColumn("_p", last).where((F.col("ed") <= F.col("st")) | (F.col("_p") > F.col("st"))).limit(1).collect()
    if bad:
        raise ValueError(f"bad evaluated part: {bad[0]}")
    return rows


def textgrid(spark: SparkSession, path: str) -> DataFrame:
    """(file, tier, st, ed, mark) of intervals with a mark."""
    rows = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    tiers = rows.select("file", F.explode(F.slice(F.split("value", r"item \[\d+\]:"), F.lit(2), F.lit(1 << 20))).alias("t"))
    name = F.regexp_extract("t", r'name = "([^"]*)"', 1)
    parts = tiers.select("file", name.alias("tier"), F.explode(F.slice(F.split("t", r"intervals \[\d+\]:"), F.lit(2), F.lit(1 << 20))).alias("p"))
    num = lambda k: F.regexp_extract("p", rf"{k} = ([\d.eE+-]+)", 1).cast("double")
    return parts.select("file", "tier", num("xmin").alias("st"), num("xmax").alias("ed"), F.regexp_extract("p", r'text = "([^"]*)"', 1).alias("mark")).where("mark <> ''")


def glm(spark: SparkSession, path: str) -> DataFrame:
    """(source, parts, alternatives) of word rules 'a b => c d' or 'a => {b / c d}': arrays of words, and of such arrays.

    Rules are in lower case. Lines that are blank or begin with [ * % or ; are none. The right side ends at the first
    character that no word has, so parts are empty if it begins with a brace; alternatives are what stands in it. Rules
    that say neither are left out, of rules for the same words the last counts.
    """
    rows = lines(spark, path).where(~F.col("value").rlike(r"^\s*([\[*%;]|$)")).select("file", "pos", F.split(F.lower(F.trim("value")), r"\s+=>\s+").alias("f")).where(F.size("f") > 1)
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    plain = words(F.regexp_replace(F.col("f")[1], "[^a-z\\-'_ .].*", ""))
    braced = F.regexp_extract(F.col("f")[1], r"^\{([^}]*)\}", 1)
    several = F.filter(F.transform(F.split(braced, "/"), words), lambda a: F.size(a) > 0)
    rules = rows.select("file", "pos", words(F.col("f")[0]).alias("source"), plain.alias("parts"), F.when(F.size(plain) > 0, F.array(plain)).otherwise(several).alias("alternatives"))
    rules = rules.where((F.size("source") > 0) & (F.size("alternatives") > 0)).withColumn("_at", F.struct("file", "pos"))
    return last_wins(rules, ["source"], "_at").select("source", "parts", "alternatives")


def cmvn(spark: SparkSession, path: str) -> tuple[list[float], list[float]]:
    """(shift, scale): the number lists after <AddShift> and <Rescale> of a small statistics file."""
    text = "\n".join(r["value"] for r in lines(spark, path).orderBy("pos").select("value").collect())
    out = []
    for mark in ("<AddShift>", "<Rescale>"):
        body = text[text.index(mark) :]
        out.append([float(x) for x in body[body.index("[") + 1 : body.index("]")].split()])
    return out[0], out[1]


def files(spark: SparkSession, root: str, pattern: str = "*.wav") -> DataFrame:
    """(path) of files below a folder, without their contents."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root).select("path")


def scp_lines(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.concat_ws(" ", *columns).alias("value"))


def rttm_lines(df: DataFrame, rec: str, st: str, ed: str, speaker: str) -> DataFrame:
    """Diarization as RTTM lines: start and length with three decimals, the length taken before rounding."""
    fmt = "SPEAKER %s 0 %.3f %.3f <NA> <NA> %s <NA> <NA>"
    return df.select(F.format_string(fmt, F.col(rec).cast("string"), st, F.col(ed) - F.col(st), F.col(speaker).cast("string")).alias("value"))


def trans_lines(df: DataFrame, speaker: str, st: str, ed: str, text: str) -> DataFrame:
    clean = F.regexp_replace(text, r"[\r\n]", "")
    return df.select(F.format_string("%s %.3f %.3f %s", F.col(speaker).cast("string"), st, ed, clean).alias("value"))


def said_lines(df: DataFrame, speaker: str, st: str, ed: str, text: str) -> DataFrame:
    return df.select(F.format_string("%s: [%.3f %.3f] %s", F.col(speaker).cast("string"), st, ed, F.col(text)).alias("value"))


def score_lines(df: DataFrame) -> DataFrame:
    return df.select(F.format_string("%s %s %s %.5f", F.col("enrol").cast("string"), F.col("test").cast("string"), F.col("label").cast("string"), F.col("score")).alias("value"))


def vector_lines(df: DataFrame, key: str, emb: str) -> DataFrame:
    """(name, value): vectors as text; slashes in names become dashes."""
    text = F.array_join(F.transform(emb, lambda v: v.cast("string")), " ")
    return df.select(F.replace(F.col(key).cast("string"), F.lit("/"), F.lit("-")).alias("name"), text.alias("value"))


def diarization_json(df: DataFrame) -> DataFrame:
    """(rec, value): one JSON object for each recording: segid -> (start, stop, speaker), from rec, st, ed, speaker.

    Segment ids have times as Python rounds and writes them to three places.
    """
    segid = scalars.python_segment_id(F.col("rec"), F.col("st"), F.col("ed"), 3)
    entry = F.struct(segid.alias("segid"), F.struct(F.col("st").alias("start"), F.col("ed").alias("stop"), "speaker"))
    return df.groupBy("rec").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("value"))


def diarization_objects(spark: SparkSession, path: str) -> DataFrame:
    """(segid, start, stop, speaker) of files with one such object to a line."""
    kind = "map<string,struct<start:double,stop:double,speaker:string>>"
    return spark.read.text(path).select(F.explode(F.from_json("value", kind)).alias("segid", "s")).select("segid", "s.*")


def simple_rttm(spark: SparkSession, path: str, *, joined: bool = False) -> DataFrame:
    """(rec, pos, st, ed, speaker): recordings, times and speakers of RTTM lines, speakers numbered as first seen in their recording.

    With ``joined`` the files at ``path`` are parts of one.
    """
    rows = lines(spark, path, joined=joined).select("pos", fields().alias("f")).where(F.size("f") >= 8)
    st = F.col("f")[3].cast("double")
    got = rows.select(F.col("f")[1].alias("rec"), "pos", st.alias("st"), (st + F.col("f")[4].cast("double")).alias("ed"), F.col("f")[7].alias("speaker"))
    return labels.arrange_labels(got, ["rec"], "pos", "speaker")


def wav_or_list(spark: SparkSession, path: str) -> DataFrame:
    """(path): ``path`` itself if it names a WAV file, else the lines of the list that it is."""
    if path.endswith(".wav"):
        return spark.createDataFrame([(path,)], "path string")
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")


def table_of(spark: SparkSession, *paths: str) -> DataFrame:
    """CSV (with header) or JSON lines, which must all be of one kind."""
    kinds = {p.rstrip("/").rpartition(".")[2] for p in paths}
    if len(kinds) != 1 or not kinds <= {"csv", "json"}:
        raise ValueError(f"files of one kind, csv or json, are needed, not {sorted(kinds)}")
    return spark.read.option("header", True).csv(list(paths)) if kinds == {"csv"} else spark.read.json(list(paths))


def segments_json(df: DataFrame) -> DataFrame:
    """One JSON object for each recording: segid -> (file, start, stop), from rec, segid, file, start, stop."""
    entry = F.struct("segid", F.struct("file", "start", "stop"))
    return df.groupBy("rec").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("value"))


def write_once(df: DataFrame, path: str, options: dict[str, object]) -> bool:
    """Write ``df`` with the options that made it; False if that is done already, an error if it was with others."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_options.json")
    fs = mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    said = json.dumps(options, sort_keys=True)
    if fs.exists(mark):
        old = jvm.org.apache.commons.io.IOUtils.toString(fs.open(mark), "UTF-8")
        if old != said:
            raise ValueError(f"{path} was made with other options: {old}")
        return False
    df.write.mode("overwrite").parquet(path)
    out = fs.create(mark)
    out.write(bytearray(said.encode()))
    out.close()
    return True
