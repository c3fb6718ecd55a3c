"""Vector archives as a sink: tasks write binary archives and their indexes, the commit makes them visible."""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .binary import parse_ark

#: What stands before a vector of 32-bit floats in a binary archive.
HEAD = b"\0BFV \4"
STAGING = "_temporary"


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (file, hdfs, s3, gs) and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def vector_bytes(values: Iterable[float]) -> bytes:
    v = np.asarray(values, "<f4")
    return HEAD + struct.pack("<i", len(v)) + v.tobytes()


def file_name(key: str) -> str:
    """A key as a file's name: slashes become dashes."""
    return key.replace("/", "-")


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its staging folder and how many vectors; never the vectors' names."""

    folder: str
    rows: int


class ArchiveWriter(DataSourceWriter):
    """One archive and one index a task, or one file a vector, first in a folder of the attempt's own.

    The commit moves what successful attempts wrote into place; an aborted write leaves nothing. Index lines 'key
    path:offset' are written by the tasks, so names never go to the driver.
    """

    def __init__(self, path: str, form: str, overwrite: bool):
        self.path, self.form, self.overwrite = path.rstrip("/"), form, overwrite
        self.job = uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Written:
        store, root = place(self.path)
        task = TaskContext.get()
        number = task.partitionId() if task else 0
        folder = f"{root}/{STAGING}/{self.job}/{number}-{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        n = 0
        if self.form == "npy":
            for n, (key, vector) in enumerate(rows, 1):
                body = io.BytesIO()
                np.save(body, np.asarray(vector, np.float32))
                with store.open_output_stream(f"{folder}/{file_name(key)}.npy") as out:
                    out.write(body.getvalue())
            return Written(folder, n)
        name = f"vectors_{number:05d}-{self.job}"
        with store.open_output_stream(f"{folder}/{name}.ark") as ark, store.open_output_stream(f"{folder}/{name}.scp") as scp:
            at = 0
            for n, (key, vector) in enumerate(rows, 1):
                if not key or any(c.isspace() for c in key):
                    raise ValueError(f"no key of an archive: {key!r}")
                head, body = f"{key} ".encode(), vector_bytes(vector)
                ark.write(head + body)
                scp.write(f"{key} {self.path}/{name}.ark:{at + len(head)}\n".encode())
                at += len(head) + len(body)
        return Written(folder, n)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = place(self.path)
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if info.is_file and info.extension in ("ark", "scp", "npy"):
                    store.delete_file(info.path)
        for m in messages:
            if m and m.rows:
                for info in store.get_file_info(fs.FileSelector(m.folder)):
                    store.move(info.path, f"{root}/{info.base_name}")
        self.clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self.clear(*place(self.path))

    def clear(self, store: fs.FileSystem, root: str) -> None:
        own = f"{root}/{STAGING}"
        if store.get_file_info(f"{own}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{own}/{self.job}")
        if store.get_file_info(own).type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(own)):
            store.delete_dir(own)


class ArchiveSource(DataSource):
    """df.write.format("vector_archive").option("form", "ark" or "npy").mode("append" or "overwrite").save(path)."""

    @classmethod
    def name(cls) -> str:
        return "vector_archive"

    def schema(self) -> str:
        return "utt_id string, embedding array<float>"

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        form = self.options.get("form", "ark")
        if form not in ("ark", "npy"):
            raise ValueError(f"no such form: {form}")
        return ArchiveWriter(self.options["path"], form, overwrite)


def exists(path: str) -> bool:
    store, root = place(path)
    return any(i.extension in ("ark", "scp", "npy") for i in store.get_file_info(fs.FileSelector(root, allow_not_found=True)))


def write_vectors(vectors: DataFrame, path: str, key: str, vector: str, *, form: str = "ark", mode: str = "error") -> None:
    """Write ``vectors`` as binary archives with indexes (ark), or as a file for each (npy), to a folder that all tasks reach.

    ``mode``: error (if the folder has archives), append or overwrite. Rows whose vector is null are left out; a null or
    blank key of an archive is an error. Of rows that repeat a key an archive has each, single files the last written.
    """
    if mode not in ("error", "append", "overwrite"):
        raise ValueError(f"no such mode: {mode}")
    if mode == "error" and exists(path):
        raise FileExistsError(f"{path} has archives already")
    vectors.sparkSession.dataSource.register(ArchiveSource)
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("string").alias("utt_id"), F.col(vector).cast("array<float>").alias("embedding"))
    rows.write.format("vector_archive").option("form", form).mode("overwrite" if mode == "overwrite" else "append").save(path)


def index_lines(spark: SparkSession, path: str) -> DataFrame:
    """(utt_id, file, offset) of the indexes in a folder, or of one index."""
    rows = spark.read.option("pathGlobFilter", "*.scp").text(path)
    parts = F.regexp_extract("value", r"^(\S+) (.*):(\d+)$", 1), F.regexp_extract("value", r"^(\S+) (.*):(\d+)$", 2), F.regexp_extract("value", r"^(\S+) (.*):(\d+)$", 3)
    return rows.select(parts[0].alias("utt_id"), parts[1].alias("file"), parts[2].cast("long").alias("offset"))


def vectors_at(index: DataFrame) -> DataFrame:
    """(utt_id, embedding) of index rows (utt_id, file, offset): only the vectors asked for are read from archives.

    Rows are sorted by file and offset within partitions, so a task opens each of its files once and reads forwards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for b in batches:
            keys, out = [], []
            for key, path, offset in zip(*(b[c].to_pylist() for c in ("utt_id", "file", "offset")), strict=True):
                if path != name:
                    store, root = place(path)
                    name, file = path, store.open_input_file(root)
                file.seek(offset)
                head = file.read(10)
                width = 8 if head[2:4] == b"DV" else 4
                body = file.read(width * struct.unpack("<i", head[6:10])[0])
                keys.append(key)
                out.append(next(parse_ark(b"- " + head + body))[1].astype(np.float32))
            yield pa.RecordBatch.from_pydict({"utt_id": pa.array(keys, pa.string()), "embedding": pa.array(out, pa.list_(pa.float32()))})

    rows = index.select("utt_id", "file", "offset").repartition("file").sortWithinPartitions("file", "offset")
    return rows.mapInArrow(run, "utt_id string, embedding array<float>")
