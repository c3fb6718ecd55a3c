"""Lines that many documents share: a sharded minimal perfect hash over line digests, probed by blocks of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, pick, prepare, released, stored

#: Fixed value: what is stripped at both ends of a line (ASCII white space).
BLANKS = " \t\n\v\f\r"
#: Documents of a block and keys of a shard, about: what a task holds of the answers and of the index at once.
BLOCK_DOCS, SHARD_KEYS = 4096, 1 << 16
#: Bits of a level of the hash function, for each key that reaches it.
ROOM = 2
INDEX = "shard int, sizes array<int>, bits binary, prints binary, counts binary, lasts binary"
REQUEST = "block int, h1 long, h2 long, n long, last long"
NO_ID = np.iinfo(np.int64).min


def mixed(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    """A hash of each 128-bit digest for one level: Murmur's 64-bit finalizer."""
    x = h1.view(np.uint64) ^ (h2.view(np.uint64) * np.uint64(2 * level + 1))
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def fingerprint(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (mixed(h2, h1, 0) >> np.uint64(32)).astype(np.uint32)


class Shard:
    """A minimal perfect hash of distinct digests, and arrays of fingerprint, count and last doc_id by its value.

    Each level has ``ROOM`` bits for each key that reaches it. A key whose bit no other key of the level wants sets it
    and is done; the others go on to the next level. A key's value is the number of bits set before its own, over all
    levels: n keys have the values 0 to n - 1, in about four bits each.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, prints: np.ndarray, counts: np.ndarray, lasts: np.ndarray):
        self.sizes, self.bits, self.prints, self.counts, self.lasts = sizes, bits, prints, counts, lasts
        self.rank = np.cumsum(bits, dtype=np.int64) - 1

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, lasts: np.ndarray) -> Shard:
        sizes, levels, left = [], [], np.arange(len(h1))
        place = np.zeros(len(h1), np.int64)
        begin = 0
        while len(left):
            size = max(8, ROOM * len(left))
            at = (mixed(h1[left], h2[left], len(sizes) + 1) % np.uint64(size)).astype(np.int64)
            wanted = np.bincount(at, minlength=size)
            alone = wanted[at] == 1
            place[left[alone]] = begin + at[alone]
            levels.append(wanted == 1)
            sizes.append(size)
            begin += size
            left = left[~alone]
        bits = np.concatenate(levels) if levels else np.zeros(0, bool)
        order = np.argsort(place)
        return cls(np.array(sizes, np.int32), bits, fingerprint(h1, h2)[order], counts[order].astype(np.int64), lasts[order])

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The value of each digest, or -1 where no key has its fingerprint there."""
        out = np.full(len(h1), -1, np.int64)
        left, begin = np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = begin + (mixed(h1[left], h2[left], level + 1) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left, begin = left[~hit], begin + size
        known = out >= 0
        known[known] = self.prints[out[known]] == fingerprint(h1[known], h2[known])
        return np.where(known, out, -1)

    def row(self) -> list:
        return [self.sizes.tolist(), np.packbits(self.bits).tobytes(), self.prints.tobytes(), self.counts.tobytes(), self.lasts.tobytes()]

    @classmethod
    def read(cls, sizes: list[int], bits: bytes, prints: bytes, counts: bytes, lasts: bytes) -> Shard:
        total = int(sum(sizes))
        unpacked = np.unpackbits(np.frombuffer(bits, np.uint8), count=total).astype(bool)
        return cls(np.array(sizes, np.int32), unpacked, np.frombuffer(prints, np.uint32), np.frombuffer(counts, np.int64), np.frombuffer(lasts, np.int64))


def lines_of(text: pa.Array, least: int) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """All lines of a batch of texts as lists, each line's text number, and number, h1 and h2 of each line with a key."""
    lines = pc.split_pattern(pc.fill_null(text, "").cast(pa.large_string()), pattern="\n")
    flat, parent = pc.list_flatten(lines), pc.list_parent_indices(lines)
    key = pc.ascii_lower(pc.ascii_trim(flat, characters=BLANKS))
    long = np.flatnonzero(pc.greater_equal(pc.utf8_length(key), least).to_numpy(zero_copy_only=False))
    digests = b"".join(xxhash.xxh3_128_digest(k) for k in key.take(pa.array(long)).cast(pa.large_binary()).to_pylist())
    pairs = np.frombuffer(digests, np.int64).reshape(-1, 2)
    return lines, parent, long, pairs[:, 0].copy(), pairs[:, 1].copy()


def blocks_of(docs: DataFrame, n_blocks: int) -> DataFrame:
    """(block, doc_id, text): rows dealt by a hash of id and text, so that rows without an id spread as well."""
    flat = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return flat.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int").alias("block"), "doc_id", "text")


def requests(blocked: DataFrame, least: int) -> DataFrame:
    """(block, h1, h2, n, last): the digests of each block's keys, documents that hold them and the largest doc_id.

    A key that is everywhere comes once a block, however many documents of it hold it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, parent, long, h1, h2 = lines_of(b["text"], least)
            rows = pa.table({"row": parent.take(pa.array(long)), "h1": h1, "h2": h2}).group_by(["row", "h1", "h2"]).aggregate([])
            at = rows["row"].combine_chunks()
            out = pa.table({"block": b["block"].take(at), "h1": rows["h1"], "h2": rows["h2"], "n": np.ones(len(at), np.int64), "last": b["doc_id"].take(at)})
            yield from out.to_batches()

    found = blocked.mapInArrow(released(run), REQUEST)
    return found.groupBy("block", "h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def build_index(asked: DataFrame, n_shards: int) -> DataFrame:
    """The index (``INDEX``) of all distinct keys in ``asked``: a row a shard. A shard's keys and arrays are in memory at once."""
    keys = asked.select(F.pmod("h1", F.lit(n_shards)).cast("int").alias("shard"), "h1", "h2", "n", "last").repartition("shard")
    sums = keys.groupBy("shard", "h1", "h2").agg(F.sum("n").alias("n"), F.coalesce(F.max("last"), F.lit(int(NO_ID))).alias("last"))

    def build(t: pa.Table) -> pa.Table:
        h1, h2, n, last = (t[c].to_numpy() for c in ("h1", "h2", "n", "last"))
        row = [t["shard"][0].as_py(), *Shard.build(h1, h2, n, last).row()]
        kinds = (pa.int32(), pa.list_(pa.int32()), *[pa.binary()] * 4)
        return pa.table({f.split()[0]: pa.array([v], k) for f, v, k in zip(INDEX.split(", "), row, kinds, strict=True)})

    return sums.groupBy("shard").applyInArrow(build, INDEX)


def runs(of: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    if len(of):
        cuts = np.flatnonzero(np.diff(of)) + 1
        yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)], strict=True)


def frequent(asked: DataFrame, index: DataFrame, n_shards: int, documents: int) -> DataFrame:
    """(block, h1, h2, last) of the requested keys that at least ``documents`` documents hold.

    Each shard's index comes first in its sorted partition; then its requests are streamed past it.
    """
    none = [F.lit(None).cast(f.split(" ", 1)[1]).alias(f.split()[0]) for f in INDEX.split(", ")[1:]]
    questions = asked.select(F.pmod("h1", F.lit(n_shards)).cast("int").alias("shard"), *none, "block", "h1", "h2")
    rows = index.unionByName(questions, allowMissingColumns=True).withColumn("asks", F.col("sizes").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = -1, None
        for b in batches:
            shards, asks = b["shard"].to_numpy(), b["asks"].to_numpy(zero_copy_only=False)
            for begin, end in runs(shards * 2 + asks):
                if not asks[begin]:
                    number, shard = int(shards[begin]), Shard.read(*[b[f.split()[0]][begin].as_py() for f in INDEX.split(", ")[1:]])
                    continue
                if shards[begin] != number:
                    raise ValueError("requests before their shard of the index")
                part = b.slice(begin, end - begin)
                at = shard.find(part["h1"].to_numpy(), part["h2"].to_numpy())
                if (at < 0).any():
                    raise ValueError("a requested key that the index lacks")
                many = shard.counts[at] >= documents
                kept = part.select(["block", "h1", "h2"]).filter(pa.array(many))
                if kept.num_rows:
                    yield kept.append_column("last", pa.array(shard.lasts[at[many]]))

    return rows.repartition("shard").sortWithinPartitions("shard", "asks").mapInArrow(released(run), "block int, h1 long, h2 long, last long")


def without_lines(b: pa.RecordBatch, lasts: dict[tuple[int, int], int], least: int) -> pa.RecordBatch:
    """The documents of ``b`` without the lines whose key has another last holder than they are."""
    lines, parent, long, h1, h2 = lines_of(b["text"], least)
    ids = pc.fill_null(b["doc_id"], int(NO_ID)).to_numpy()[parent.to_numpy()[long]].tolist()
    drop = np.zeros(len(parent), bool)
    drop[long] = [lasts.get(k, i) != i for k, i in zip(zip(h1.tolist(), h2.tolist(), strict=True), ids, strict=True)]
    dropped = np.bincount(parent.to_numpy()[drop], minlength=len(lines))
    n = pc.list_value_length(lines).to_numpy()
    offsets = np.concatenate([[0], np.cumsum(n - dropped)])
    kept = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pc.list_flatten(lines).filter(pa.array(~drop)))
    text = pc.binary_join(kept, pa.scalar("\n", pa.large_string())).cast(pa.string())
    return pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "n_lines": pa.array(n, pa.int64()), "n_dropped": pa.array(dropped, pa.int64()), "text": text})


def deduplicated(docs: DataFrame, least: int = 40, documents: int = 5) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): texts without the lines that many documents share.

    A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys of at least ``least`` code
    points in at least ``documents`` rows lose all their lines but those in rows of the largest doc_id holding them.

    Every distinct key is in the index, which is dealt in shards of at most about 65,536 keys, so each probe finds its
    key; 32 bits of fingerprint catch an index that belongs to other documents. Keys are compared by 128-bit digests.
    Documents are dealt into blocks of about 4096; a block asks once for each of its keys, so a line that all documents
    hold costs a request a block. A task holds one shard, or the frequent keys of one block, and a batch of texts.

    Null texts count as empty (one empty line); rows that repeat a doc_id count each as a document and keep the lines of
    which they are the last holders; rows with a null doc_id hold a line last only where all its holders have none. A
    text all of whose lines go is empty. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    blocked = blocks_of(docs, max(1, docs.count() // BLOCK_DOCS))
    asked = stored(requests(blocked, least), "line-requests")
    n_shards = max(1, asked.count() // SHARD_KEYS)
    index = stored(build_index(asked, n_shards), "line-index")
    answers = stored(frequent(asked, index, n_shards, documents), "line-answers")
    forget(asked, index)
    rows = answers.withColumn("answers", F.lit(True)).unionByName(blocked.withColumn("answers", F.lit(False)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, lasts = None, {}
        for b in batches:
            blocks, answer = b["block"].to_numpy(), b["answers"].to_numpy(zero_copy_only=False)
            for begin, end in runs(blocks * 2 + ~answer):
                part = b.slice(begin, end - begin)
                if blocks[begin] != block:
                    block, lasts = blocks[begin], {}
                if answer[begin]:
                    h1, h2, last = (part[c].to_pylist() for c in ("h1", "h2", "last"))
                    lasts.update(zip(zip(h1, h2, strict=True), last, strict=True))
                else:
                    yield without_lines(part.select(["doc_id", "text"]), lasts, least)

    dealt = rows.repartition("block").sortWithinPartitions("block", F.desc("answers"))
    return dealt.mapInArrow(released(run), "doc_id long, n_lines long, n_dropped long, text string")
