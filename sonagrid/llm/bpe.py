"""Byte-level BPE with a segment tree over adjacent pair ranks."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, prepare, released

#: The pre-tokenizer pattern of byte-level BPE files.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: No pair; larger than any rank and position.
NONE = 1 << 62
#: Chunks and pieces of at most so many characters are remembered, so many of each at once in a worker.
CACHE_CHARS, CACHE_PIECES = 48, 400_000
#: Texts and bytes of texts that are encoded together, and the most bytes of pieces that are merged together.
TEXTS, TEXT_BYTES, MANY = 512, 1 << 20, 64
#: What makes a text unusual: NUL, white space other than spaces and line ends, or two in a row.
ODD = r"[\x00\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|[ \n]\z"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def merge_pairs(ids: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """Apply BPE merges to ``ids``, leftmost lowest rank first.

    ``ranks`` has, for a pair (a << 16 | b), its rank << 32. Leaf n + i of a segment tree holds the rank of the pair
    that begins at symbol i, or NONE, and i, so that ties go left; an inner node holds the lesser of its children. The
    root is the next merge, which changes three leaves and their ancestors.
    """
    n = len(ids)
    if n < 2:
        return ids
    get = ranks.get
    tree = [NONE] * (2 * n)
    last = n - 1
    for i in range(last):
        tree[n + i] = get(ids[i] << 16 | ids[i + 1], NONE) | i
    for i in range(last, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, last))
    while (top := tree[1]) < NONE:
        i = top & 0xFFFFFFFF
        j = after[i]
        k = after[j]
        own = ids[i] = merged[top >> 32]
        ids[j] = -1
        after[i] = k
        value = NONE
        if k < n:
            before[k] = i
            value = get(own << 16 | ids[k], NONE) | i
        changed = [(n + j, NONE), (n + i, value)]
        h = before[i]
        if h >= 0:
            changed.append((n + h, get(ids[h] << 16 | own, NONE) | h))
        for at, value in changed:
            while tree[at] != value:
                tree[at] = value
                if at == 1:
                    break
                other = tree[at ^ 1]
                if other < value:
                    value = other
                at >>= 1
    return [x for x in ids if x >= 0]


class PairTable:
    """Ranks of pairs for whole arrays: open addressing in a flat table at most a quarter full."""

    def __init__(self, ranks: dict[int, int]):
        self.bits = max(4, (4 * len(ranks)).bit_length())
        keys = np.array(list(ranks), np.int64)
        values = np.array(list(ranks.values()), np.int64)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        self.probes = 0
        at = self.place(keys)
        while len(keys):
            self.probes += 1
            free = np.flatnonzero(self.keys[at] < 0)
            self.keys[at[free]] = keys[free]  # of several for one place, the last stays
            won = self.keys[at] == keys
            self.values[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + 1) & (len(self.keys) - 1)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank << 32 of each pair, or NONE."""
        keys = a.astype(np.int64) << 16 | b
        at = self.place(keys)
        out = np.where(self.keys[at] == keys, self.values[at], NONE)
        for _ in range(self.probes - 1):
            at = (at + 1) & (len(self.keys) - 1)
            hit = self.keys[at] == keys
            out = np.where(hit, self.values[at], out)
        return out


def merge_many(symbols: np.ndarray, lengths: np.ndarray, table: PairTable, merged: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``merge_pairs`` for many short rows at once, in (all symbols, length of each row) and out alike.

    There is a segment tree for each row, as in ``merge_pairs``; each step makes the next merge in every row.
    """
    w, size = len(lengths), 1 << max(1, int(lengths.max() - 1).bit_length())
    n = lengths.astype(np.int64)
    place = np.repeat(np.arange(w) * size - (np.cumsum(n) - n), n) + np.arange(len(symbols))
    ids = np.full(w * size, -1, np.int64)
    ids[place] = symbols
    grid = ids.reshape(w, size)
    tree = np.full((w, 2 * size), NONE, np.int64)
    value = table.get(np.maximum(grid[:, :-1], 0), np.maximum(grid[:, 1:], 0)) | np.arange(size - 1)
    tree[:, size : 2 * size - 1] = np.where(grid[:, 1:] >= 0, value, NONE)
    s = size
    while s > 1:
        np.minimum(tree[:, s : 2 * s : 2], tree[:, s + 1 : 2 * s : 2], out=tree[:, s // 2 : s])
        s //= 2
    tree = tree.ravel()
    after = np.tile(np.arange(1, size + 1), w)
    before = np.tile(np.arange(-1, size - 1), w)
    live = np.arange(w)
    while True:
        top = tree[live * (2 * size) + 1]
        some = top < NONE
        live, top = live[some], top[some]
        if not len(live):
            break
        base, root = live * size, live * (2 * size)
        i = top & 0xFFFFFFFF
        j = after[base + i]
        k = after[base + j]
        own = merged[top >> 32]
        ids[base + i], ids[base + j] = own, -1
        after[base + i] = k
        more = k < n[live]
        before[(base + k)[more]] = i[more]
        right = table.get(own, ids[base + np.where(more, k, 0)]) | i
        h = before[base + i]
        before_it = h >= 0
        h = np.maximum(h, 0)
        left = table.get(ids[base + h], own) | h
        tree[root + size + j] = NONE
        tree[root + size + i] = np.where(more, right, NONE)
        tree[(root + size + h)[before_it]] = left[before_it]
        for at in (size + j, size + i, size + h):
            for _ in range(size.bit_length() - 1):
                at = at >> 1
                tree[root + at] = np.minimum(tree[root + 2 * at], tree[root + 2 * at + 1])
    kept = ids >= 0
    return ids[kept], kept.reshape(w, size).sum(axis=1)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each row, one row after another."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


class Codec:
    """Encoder and decoder of one vocabulary file; it remembers the ids of chunks and pieces.

    A chunk begins at a line end or at a space before anything but white space. No piece of the pre-tokenizer reaches
    over such a place, so chunks are encoded one by one. Arrow cuts a batch of texts into chunks and finds the
    different ones; those not known yet are cut into pieces, whose merges are made together; ids are then gathered for
    all chunks of the batch. A chunk's key leaves out its first space; a text's first chunk begins with NUL instead.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"]:
            raise ValueError("only byte-level BPE without normalizer and prefix space is supported")
        vocab = model["vocab"]
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        self.ranks = {vocab[a] << 16 | vocab[b]: r << 32 for r, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        self.table, self.merged_array = PairTable(self.ranks), np.array(self.merged, np.int64)
        symbols = byte_symbols()
        self.first = np.array([vocab[s] for s in symbols], np.int64)
        back = {s: b for b, s in enumerate(symbols)}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes = {i: bytes(back[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.added.items()}
        every = range(max(self.bytes) + 1)
        self.token_bytes = pa.array([self.bytes.get(i, b"") for i in every], pa.large_binary())
        self.token_text = pa.array([b"%d," % i for i in every], pa.large_binary())
        self.pieces = regex.compile(PATTERN).findall
        longest = sorted(self.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest)) + ")").split if longest else None
        self.odd = "|".join([ODD, *map(re.escape, longest)])
        self.forget()

    def forget(self) -> None:
        self.chunks: dict[str, int] = {"\0": 0}
        self.known: dict[str, int] = {}
        self.start, self.length, self.ids = np.zeros(1, np.int64), np.zeros(1, np.int64), np.empty(0, np.int32)

    def store(self, ids: np.ndarray, length: np.ndarray) -> int:
        """Keep rows of ids; gives the number of the first."""
        n = len(self.start)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        return n

    def learn(self, pieces: list[str]) -> dict[str, int]:
        """Numbers of different pieces that are not known yet."""
        out: dict[str, int] = {}
        raw = [p.encode() for p in pieces]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        level = np.ceil(np.log2(np.maximum(size, 2))).astype(int)
        for k in np.unique(level):
            group = np.flatnonzero(level == k)
            for at in range(0, len(group), 16384):
                part = group[at : at + 16384]
                if 1 << k > MANY:
                    rows = [merge_pairs(self.first[np.frombuffer(raw[g], np.uint8)].tolist(), self.ranks, self.merged) for g in part]
                    ids, length = np.array([i for r in rows for i in r], np.int64), np.array(list(map(len, rows)), np.int64)
                else:
                    ids, length = merge_many(self.first[np.frombuffer(b"".join([raw[g] for g in part]), np.uint8)], size[part], self.table, self.merged_array)
                out.update(zip([pieces[g] for g in part], range(n := self.store(ids, length), n + len(part)), strict=True))
        self.known.update((p, n) for p, n in out.items() if len(p) <= CACHE_CHARS)
        return out

    def numbers(self, keys: list[str]) -> np.ndarray:
        """The rows of ids of different chunks."""
        if len(self.chunks) + len(self.known) > CACHE_PIECES:
            self.forget()
        chunks, known = self.chunks, self.known
        new = [c for c in keys if c not in chunks]
        cut: list[list[str]] = []
        for c in new:
            if c.isalpha():
                cut.append([" " + c])
            else:
                cut.append(self.pieces(c[1:] if c[:1] == "\0" else c if c[:1] == "\n" else " " + c))
        fresh = self.learn(list({p for ps in cut for p in ps if p not in known}))
        of = lambda p: n if (n := fresh.get(p)) is not None else known[p]
        extra: dict[str, int] = {}
        several = [i for i, ps in enumerate(cut) if len(ps) != 1]
        parts = np.fromiter((of(p) for i in several for p in cut[i]), np.int64)
        count = np.fromiter((len(cut[i]) for i in several), np.int64, len(several))
        sizes = self.length[parts]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(count)])]
        base = self.store(self.ids[ragged(self.start[parts], sizes)], np.diff(ends)) if several else 0
        at = dict(zip(several, range(base, base + len(several)), strict=True))
        for i, c in enumerate(new):
            n = at[i] if i in at else of(cut[i][0])
            if len(c) <= CACHE_CHARS:
                chunks[c] = n
            else:
                extra[c] = n
        if extra:
            return np.fromiter((n if (n := extra.get(c)) is not None else chunks[c] for c in keys), np.int64, len(keys))
        return np.fromiter(map(chunks.__getitem__, keys), np.int64, len(keys))

    def whole(self, text: str) -> list[int]:
        """Ids of a text with added tokens, whose strings stand for themselves, or with unusual white space."""
        out: list[int] = []
        for k, part in enumerate(self.special(text) if self.special else [text]):
            if k % 2:
                out.append(self.added[part])
                continue
            for p in self.pieces(part):
                n = self.known.get(p)
                n = self.learn([p])[p] if n is None else n
                out += self.ids[self.start[n] : self.start[n] + self.length[n]].tolist()
        return out

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of each text's); null texts have none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        rows = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(pa.scalar("\0", pa.large_string()), plain, pa.scalar("", pa.large_string())), "\n", " \n"), " ")
        words = rows.flatten().dictionary_encode()
        number = self.numbers(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy()]
        size = self.length[number]
        ids = self.ids[ragged(self.start[number], size)]
        edges = rows.offsets.to_numpy() - rows.offsets[0].as_py()
        through = np.concatenate([[0], np.cumsum(size)])[edges]
        count = np.diff(through)
        if not odd.any():
            return ids, count
        out = np.split(ids, through[1:-1])
        for i in np.flatnonzero(odd):
            out[i] = np.array(self.whole(texts[i].as_py()), np.int32)
        return np.concatenate(out), np.fromiter(map(len, out), np.int64, len(out))

    def encode(self, text: str) -> list[int]:
        return self.encode_batch(pa.array([text], pa.string()))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """Bytes that are no UTF-8 become U+FFFD."""
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Begin and length of runs of texts that are encoded together: of ``TEXTS`` at most, ``TEXT_BYTES`` or one text."""
    through = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
    begin = 0
    while begin < len(texts):
        used = through[begin - 1] if begin else 0
        end = min(max(int(np.searchsorted(through, used + TEXT_BYTES, "right")), begin + 1), begin + TEXTS, len(texts))
        yield begin, end - begin
        begin = end


def joined(table: pa.Array, ids: np.ndarray, count: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The entries of ``ids`` in one buffer, and where in it each text begins; the last place is the end."""
    got = table.take(pa.array(ids))
    offsets = np.frombuffer(got.buffers()[1], np.int64)[got.offset : got.offset + len(got) + 1] if len(got) else np.zeros(1, np.int64)
    data = memoryview(got.buffers()[2] or b"") if len(got) else memoryview(b"")
    return data, offsets[np.concatenate([[0], np.cumsum(count)])]


def encode_documents(docs: DataFrame, vocabulary: str, *, keep_ids: bool = False) -> DataFrame:
    """Encode each whole text and decode the ids again, one row for each row of ``docs``, without a shuffle.

    Needs doc_id and text. Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256
    and, with ``keep_ids``, ids and decoded. A null text counts as empty: no tokens and the digests of nothing. Null or
    repeated doc_ids and rows are kept as they come; other columns are ignored; an empty table gives none. Memory: one
    Arrow batch, one text's pieces and a bounded cache, which pieces beyond its length limit bypass.
    """
    prepare(docs.sparkSession)
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        kind += ", ids array<int>, decoded string"

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        sha = hashlib.sha256
        for whole in batches:
            for at, n in groups(whole.column(1)):
                batch = whole.slice(at, n)
                ids, count = c.encode_batch(batch.column(1))
                text, begin = joined(c.token_text, ids, count)
                ids_sha = [sha(text[a : max(a, b - 1)]).hexdigest() for a, b in zip(begin[:-1], begin[1:], strict=True)]
                data, begin = joined(c.token_bytes, ids, count)
                decoded = [bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(begin[:-1], begin[1:], strict=True)]
                dec_sha = [sha(t.encode()).hexdigest() for t in decoded]
                columns = [batch.column(0), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(dec_sha, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns += [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(ids, pa.int32())), pa.array(decoded, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kind)


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and the text of its ids; null ids give an empty text, an unknown id is an error."""
    prepare(encoded.sparkSession)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            texts = [c.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return pick(encoded, "doc_id", "ids").select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
