"""Near duplicates: circulant MinHash signatures, banding, exact Jaccard verification, connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, numbered, pick, prepare, released, small, stored

#: Words of a shingle; links need 100 * intersection >= PERCENT * union.
WIDTH, PERCENT = 5, 75
#: A pair at the threshold shares one of 48 bands of 6 with probability 0.9999, a pair at 0.3 with 0.034.
BANDS, ROWS = 48, 6
#: Coordinates whose lowest bits make a sketch, and the most bits in which two sketches of a candidate pair differ: at
#: the threshold 32 do at the mean, and more than 60 once in ten million times.
SKETCH, APART = 256, 60
#: Members up to which an open group is compared by pair.
DIRECT = 64
#: Texts that hold more than this part of all rows are common; there are at most so many.
COMMON = 1024
CACHE_WORDS = 100_000
BLOCK = 256

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_P1, _P2 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Remembers the hashes of words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 48:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = h
        return h


def words_of(text: bytes) -> list[bytes]:
    """Runs without ASCII white space, A to Z in lower case; bytes' own methods know no other letters or spaces."""
    return text.lower().split()


def shingle_set(words: list[bytes], look: Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of five words each; of all words if there are fewer; of none if there are none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(look.__getitem__, words), np.uint64, n)
    width = min(n, WIDTH)
    total = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        total += h[k : n - width + 1 + k] * _FACTORS[k]
    return np.unique(mix(total))


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash: one permutation scatters the shingles, a second one, shifted by k, gives coordinate k.

    Positions are the numbers below 2^32. The first permutation has been applied with the shingle's hash, whose upper
    half is its position p; coordinate k is the least of pi(p - k) for one fixed permutation pi of those numbers. The
    multiplication within pi is distributed over the difference, so that each coordinate takes a few instructions.
    """
    p = (shingles >> np.uint64(32)).astype(np.uint32) * _P1
    shift = np.arange(size, dtype=np.uint32) * _P1
    least = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(p), BLOCK):
        x = p[at : at + BLOCK, None] - shift
        x ^= x >> np.uint32(15)
        x *= _P2
        np.minimum(least, x.min(axis=0), out=least)
    return least


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of the signature."""
    rows = sig.reshape(bands, -1).astype(np.uint64)
    key = mix(np.arange(1, bands + 1, dtype=np.uint64))
    for k in range(rows.shape[1]):
        key = mix(key * _M1 ^ rows[:, k])
    return key.view(np.int64)


def sketch(sig: np.ndarray) -> np.ndarray:
    """The lowest bits of the first coordinates in four longs."""
    return np.packbits((sig[:SKETCH] & np.uint32(1)).astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, *, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, same (digest of the words, equal for copies), keys (of the bands) and sketch for each row."""
    prepare(docs.sparkSession)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Words()
        for batch in batches:
            sizes, same, keys, bits = [], [], [], []
            for value in batch.column(1):
                words = words_of(value.as_buffer().to_pybytes()) if value.is_valid else []
                s = shingle_set(words, look)
                sizes.append(len(s))
                same.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                sig = signature(s, max(SKETCH, bands * rows)) if len(s) else None
                keys.append(None if sig is None else band_keys(sig[: bands * rows], bands))
                bits.append(None if sig is None else sketch(sig))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(same, pa.binary()), pa.array(keys, longs), pa.array(bits, longs)], names=["doc_id", "n_shingles", "same", "keys", "sketch"])

    flat = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return flat.mapInArrow(run, "doc_id long, n_shingles long, same binary, keys array<long>, sketch array<long>")


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and its full shingle set for the documents in ``ids`` (one column, id); stored, as both ends of pairs read it."""
    prepare(docs.sparkSession)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingle_set(words_of(v.as_buffer().to_pybytes()) if v.is_valid else [], look).view(np.int64) for v in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    flat = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("id"), "text")
    return stored(flat.join(small(ids, ids.count()), "id", "left_semi").mapInArrow(run, "id long, shingles array<long>"), "sets")


def parts_for(rows: int, each: int) -> int:
    """Tasks for a table of so many rows; small tables needn't be written in as many as there are shuffle partitions."""
    return max(12, -(-rows // each))


def sets_of_pairs(docs: DataFrame, pairs: DataFrame) -> tuple[DataFrame, int]:
    """(sets, number of pairs): the full shingle sets of all documents in ``pairs`` (a, b)."""
    count = pairs.count()
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().coalesce(parts_for(count, 500_000)), "ids")
    sets = shingle_sets(docs, ids)
    forget(ids)
    return sets, count


def with_sets(pairs: DataFrame, sets: DataFrame, once: bool = False) -> DataFrame:
    """``pairs`` with the sets sa and sb and the size of their intersection, common; once: one set for each a."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    if once:
        left = left.dropDuplicates(["a"])
    both = pairs.join(left, "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.withColumn("common", F.size(F.array_intersect("sa", "sb")))


def linked(common: Column | str, n: Column | str, m: Column | str) -> Column:
    return (100 + PERCENT) * F.col(common) >= PERCENT * (n + m)


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full shingle sets are similar enough."""
    sets, count = sets_of_pairs(docs, pairs)
    links = stored(with_sets(pairs, sets).where(linked("common", F.size("sa"), F.size("sb"))).select("a", "b").coalesce(parts_for(count, 5_000)), "links")
    forget(sets)
    return links


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node that it reaches over ``links`` (a, b), for every node that has a link.

    Each step takes the least root among neighbours and then the root's root; both are joins with map-side minima.
    """
    edges = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "edges")
    parts = parts_for(edges.count(), 500_000)
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")).coalesce(parts), "labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("n")).agg(F.min("root").alias("near"))
        step = labels.join(near, F.col("node") == F.col("n"), "left").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("k"), F.col("root").alias("far"))
        step = step.join(jump, F.col("root") == F.col("k"), "left").select("node", "old", F.least("root", "far").alias("root"))
        step = stored(step.coalesce(parts), "labels")
        forget(labels)
        labels = step
        if step.where("old <> root").isEmpty():
            forget(edges)
            return labels.select("node", "root")


def top(*more: str, among: Column | None = None) -> Column:
    """The member with the highest score, of several the one with the smallest id, and ``more`` of it."""
    one = F.struct(F.col("score"), (-F.col("id")).alias("minus"), *more)
    return F.max(one if among is None else F.when(among, one)).alias("top")


def faced(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a: pivot, b) compared on full sets: a, b, n, pn (sizes), linked, rest, probes and cap.

    rest: shingles of b outside the pivot, in order. Say b isn't linked to the pivot. Whatever x of at least m shingles
    is linked to b has PERCENT / (100 + PERCENT) * (n + m) in common with it; at most ``common`` of these lie within the
    pivot, so the others are in both rests, one of them among the first ``probes`` of b's. If the least such m (by b's
    own size and the smallest set beside it) asks for none, all of rest are probes, and x may also share none of them;
    then x has at most ``cap`` shingles, less than the pivot. So links that a pivot doesn't see are found by the shingles
    that it lacks, which in a group of near copies are few, and no pair is looked at that shares none.
    """
    sets, count = sets_of_pairs(docs, pairs)
    both = with_sets(pairs, sets, once=True)
    both = both.select("a", "b", F.size("sb").alias("n"), F.size("sa").alias("pn"), "common", F.sort_array(F.array_except("sb", "sa")).alias("rest"))
    both = stored(both.withColumn("linked", linked("common", F.col("n"), F.col("pn"))), "faced")
    forget(sets)
    whole = 100 + PERCENT
    least = both.groupBy("a").agg(F.min("n").alias("least"))
    both = both.join(least, "a")
    smallest = F.greatest(F.col("least"), F.ceil(PERCENT * F.col("n") / 100))
    asked = F.ceil(PERCENT * (F.col("n") + F.least("pn", smallest)) / whole) - F.col("common")
    probes = F.when(F.col("linked"), 0).when(asked >= 1, F.size("rest") - asked + 1).otherwise(F.size("rest"))
    cap = F.when(~F.col("linked") & (asked < 1), F.floor(whole * F.col("common") / PERCENT) - F.col("n"))
    return both.select("a", "b", "n", "pn", "linked", "rest", F.greatest(probes, F.lit(0)).cast("int").alias("probes"), cap.alias("cap"))


def joined(links: DataFrame, roots: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and components once more those of ``found`` (a, b) count that join two components."""
    of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    at = found.select("a", "b").distinct().join(of("a"), "a", "left").join(of("b"), "b", "left")
    new = stored(at.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b").coalesce(12), "links")
    if new.isEmpty():
        return links, roots
    links = links.select("a", "b").union(new)
    return links, components(links)


def settled(docs: DataFrame, groups: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
    """Components once all links within ``groups`` (g, id, n, score, sketch, asks) are found too.

    A link matters if one end asks. Groups without a member that asks or of one component are settled. Of the others,
    those up to a limit are compared by pair, of which only those with near enough sizes and sketches leave the join. In
    larger ones all members are compared with a pivot, the one that meets most others; groups with the same pivot become
    one. What that leaves open is dealt into smaller groups: one for each shingle outside the pivot, with members that
    may have a link there, and one for sets smaller than the pivot's. The limit is DIRECT and grows fourfold from round
    to round, so this ends; what is left then is texts of similarities about the threshold that have much in common.
    """
    limit = DIRECT
    while True:
        at = groups.join(roots, F.col("id") == F.col("node"), "left").select("g", "id", "n", "score", "sketch", "asks", F.coalesce("root", "id").alias("root"))
        state = at.groupBy("g").agg(F.count(F.lit(1)).alias("members"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.max("asks").alias("any"), top())
        live = stored(at.join(state.where("any and r0 < r1").select("g", "members", "top"), "g"), "live")
        few = live.where(F.col("members") <= limit)
        asks = few.where("asks").select("g", F.col("id").alias("pivot"), F.col("n").alias("pn"), F.col("root").alias("proot"), F.col("sketch").alias("psketch"))
        near = asks.join(few.select("g", "id", "n", "root", "sketch"), "g").where((F.col("root") != F.col("proot")) & alike())
        near = stored(near.select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b")).distinct(), "pairs")
        if not near.isEmpty():
            links, roots = joined(links, roots, verified(docs, near))
        rows = stored(by_pivot(live.where(F.col("members") > limit)), "groups")
        forget(near, live)
        if rows.isEmpty():
            return roots
        pairs = stored(rows.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
        met = stored(faced(docs, pairs), "met")
        links, roots = joined(links, roots, met.where("linked"))
        rows = rows.withColumnRenamed("n", "own").join(met, (F.col("pivot") == F.col("a")) & (F.col("id") == F.col("b")))
        kept = ["id", F.col("own").alias("n"), "score", "sketch"]
        by_shingle = rows.select("pivot", *kept, "probes", F.posexplode("rest").alias("at", "x"))
        by_shingle = by_shingle.select(F.xxhash64("pivot", "x").alias("g"), "id", "n", "score", "sketch", (F.col("at") < F.col("probes")).alias("asks"))
        low = rows.groupBy("pivot").agg(F.max("cap").alias("most"), F.min(F.when(F.col("n") < F.col("pn"), F.col("n"))).alias("least")).where("least <= most")
        low = rows.join(low, "pivot").where("cap >= least or (n < pn and n <= most)")
        low = low.select(F.xxhash64("pivot", F.lit("low")).alias("g"), *kept, F.coalesce(F.col("cap") >= F.col("least"), F.lit(False)).alias("asks"))
        rest = by_shingle.union(low).groupBy("g", "id").agg(*[F.first(x).alias(x) for x in ("n", "score", "sketch")], F.max("asks").alias("asks"))
        rest = stored(rest, "rest")
        crowds = rest.groupBy("g").agg(F.count(F.lit(1)).alias("members"), F.max("asks").alias("any")).where("members > 1 and any")
        groups = rest.join(crowds, "g", "left_semi")
        forget(pairs, met)
        limit *= 4


def by_pivot(large: DataFrame) -> DataFrame:
    """pivot, id, n, score and sketch of the members of ``large`` groups (with top, their best member).

    The pivot is the best member of the group or, if better, of another large group of one of its members; so groups of
    one family of texts mostly become one. A pivot need not lie in the group.
    """
    best = large.groupBy("id").agg(F.max("top").alias("best"))
    pivots = large.select("g", "id").join(best, "id").groupBy("g").agg((-F.max("best")["minus"]).alias("pivot"))
    return large.join(pivots, "g").select("pivot", "id", "n", "score", "sketch").distinct()


def alike() -> Column:
    """Sizes and sketches of a document (n, sketch) and a pivot (pn, psketch) allow for a link."""
    apart = sum((F.bit_count(F.get("sketch", F.lit(i)).bitwiseXOR(F.get("psketch", F.lit(i)))) for i in range(SKETCH // 64)), F.lit(0))
    return (100 * F.least("n", "pn") >= PERCENT * F.greatest("n", "pn")) & (apart <= APART)


def with_reps(rows: DataFrame, reps: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles and rep, the smallest doc_id of the text, of each of ``n`` rows (with same, the text's digest).

    Texts with more than one in ``COMMON`` of all rows are fewer than that, so their representatives are broadcast, and a
    text of very many copies isn't joined in one task; others are joined by digest. Rows without shingles have none.
    """
    common = F.broadcast(reps.where(F.col("copies") > n / COMMON).select("same", "rep"))
    kept = ["doc_id", "n_shingles", "rep"]
    some = rows.where("n_shingles > 0")
    rest = some.join(common.drop("rep"), "same", "left_anti").join(reps.where(F.col("copies") <= n / COMMON), "same", "left")
    none = rows.where("n_shingles = 0").withColumn("rep", F.lit(None).cast("long"))
    return some.join(common, "same").select(*kept).unionByName(rest.select(*kept)).unionByName(none.select(*kept))


def near_duplicates(docs: DataFrame, *, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The class of each document among near duplicates, one row for each row of ``docs``.

    Needs doc_id and text. Returns doc_id, n_shingles, component_id (the smallest doc_id reachable over links, itself
    included) and kept (doc_id = component_id). Texts are taken whole. A null or empty text, or one of white space
    only, has no shingles and is linked with nothing. Rows that share a doc_id are one node. A null doc_id takes no
    part: its component is null and it is kept. Other columns are ignored; an empty table gives no rows.

    Copies are first put down to the smallest doc_id of their text. In each band's bucket the hub, the member that
    meets most others over all its bands, is compared with all others (pairs whose sizes or sketches are too far apart
    leave within the join). ``settled`` finds the other links of buckets that then still join several components. So a
    group of n near copies costs about n comparisons a band and no link that banding proposes is lost, whatever a
    bucket's size.
    """
    base = stored(signatures(docs, bands=bands, rows=rows), "signatures")
    reps = base.where("n_shingles > 0 and doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = stored(reps, "texts")
    member = stored(with_reps(base.select("doc_id", "n_shingles", "same"), reps, base.count()), "members")
    chosen = base.join(reps.select("same", F.col("rep").alias("doc_id")), ["same", "doc_id"], "left_semi")
    rows_of = chosen.select(F.explode("keys").alias("bucket"), F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"))
    shared = rows_of.groupBy("bucket").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("members")).where("least < most")
    plain = stored(rows_of.join(shared.select("bucket", "members"), "bucket").distinct(), "shared")
    about = plain.groupBy("id").agg(F.sum("members").alias("score")).join(chosen.select(F.col("doc_id").alias("id"), "sketch").dropDuplicates(["id"]), "id")
    held = stored(plain.join(about, "id").select("bucket", "id", "n", "members", "score", "sketch"), "buckets")
    forget(plain, base, reps)
    pivots = held.groupBy("bucket").agg(top("n", "sketch")).select("bucket", (-F.col("top.minus")).alias("pivot"), F.col("top.n").alias("pn"), F.col("top.sketch").alias("psketch"))
    pairs = held.alias("h").join(pivots.alias("p"), (F.col("h.bucket") == F.col("p.bucket")) & (F.col("id") != F.col("pivot")) & alike())
    pairs = stored(pairs.select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b")).distinct(), "pairs")
    links = verified(docs, pairs)
    forget(pairs)
    roots = components(links)
    groups = held.where("members > 2").select(F.col("bucket").alias("g"), "id", "n", "score", "sketch", F.lit(True).alias("asks"))
    roots = settled(docs, groups, links, roots)
    forget(held)
    out = member.join(roots, F.col("rep") == F.col("node"), "left")
    root = F.coalesce("root", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), root).alias("component_id"), F.coalesce(F.col("doc_id") == root, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, **how: int) -> DataFrame:
    """``docs`` with one row for each class of near duplicates: the one with the smallest doc_id.

    Of rows that share a doc_id one stays, the first by its columns as JSON text. Rows with a null doc_id stay. All
    columns are kept, also those whose names repeat or differ in case only.
    """
    got = stored(near_duplicates(docs, **how).select("doc_id", "kept"), "classes")
    gone = stored(got.where("not kept").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    again = stored(got.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null").select(F.col("doc_id").alias("again")), "again")
    flat, names = numbered(docs)
    doc_id = F.col(f"c{names.index('doc_id')}").cast("long")
    kept = flat.join(small(gone, gone.count()), doc_id == F.col("gone"), "left_anti")
    times = again.count()
    if not times:
        return kept.toDF(*names)
    again = small(again, times)
    once = kept.join(again, doc_id == F.col("again"), "left_anti")
    row = F.struct(*kept.columns)
    first = kept.join(again, doc_id == F.col("again")).groupBy("again").agg(F.min_by(row, F.to_json(row)).alias("row"))
    return once.union(first.select("row.*")).toDF(*names)
