"""Scans of binary formats: WAV files and vector archives."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signal
from ..operators.manifests import last_wins


def wav_files(spark: SparkSession, path: str, **how: object) -> DataFrame:
    """(path, rate, samples) of WAV files."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(path)
    return rows.select("path", signal.decode_wav(F.col("content"), **how).alias("w")).select("path", "w.*")


def parse_ark(data: bytes) -> Iterator[tuple[str, np.ndarray]]:
    """(key, vector) of a binary float or double vector archive."""
    at = 0
    while at < len(data):
        end = data.index(b" ", at)
        key, at = data[at:end].decode(), end + 1
        if data[at : at + 2] != b"\0B":
            raise ValueError("only binary archives are supported")
        kind = data[at + 2 : at + 5]
        if kind not in (b"FV ", b"DV "):
            raise ValueError(f"only vectors are supported, not {kind!r}")
        n = struct.unpack("<i", data[at + 6 : at + 10])[0]
        size, dtype = (4, "<f4") if kind == b"FV " else (8, "<f8")
        at += 10
        yield key, np.frombuffer(data[at : at + n * size], dtype)
        at += n * size


def ark_bytes(rows: Iterator[tuple[str, np.ndarray]]) -> bytes:
    return b"".join(k.encode() + b" \0BFV \4" + struct.pack("<i", len(v)) + np.asarray(v, "<f4").tobytes() for k, v in rows)


def ark_files(spark: SparkSession, path: str) -> DataFrame:
    """(utt_id, embedding) of all archives in a folder; of vectors with one id that of the last file counts."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.ark").load(path).select("path", "content")
    if rows.select("path").isEmpty():
        raise FileNotFoundError(f"no archive in {path}")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in it:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                got = list(parse_ark(bytes(content)))
                yield pd.DataFrame({"path": name, "utt_id": [k for k, _ in got], "embedding": [v.astype(np.float32).tolist() for _, v in got]})

    return last_wins(rows.mapInPandas(run, "path string, utt_id string, embedding array<float>"), ["utt_id"], "path").drop("path")
