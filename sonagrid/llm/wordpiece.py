"""Greedy word-piece token counts by a linear longest-match automaton."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import pick, prepare, released

#: Words of at most so many bytes are remembered, so many of them at once in a worker.
CACHE_BYTES, CACHE_WORDS = 48, 400_000


class Automaton:
    """Trie over byte pieces with failure links and popped-token counts.

    ``pieces`` are byte strings; those in ``initial`` may begin a word, those in ``inner`` may follow. The trie has a
    root for each kind. At node v, reached by string s, ``fail[v]`` is the node for what is left of s once the greedy
    longest matches that are certain are taken off (-1: none), and ``pops[v]`` how many pieces those are. A word's
    count then needs one pass over its bytes, and no piece is ever built.
    """

    def __init__(self, initial: set[bytes], inner: set[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]
        final: list[bool] = [False, False]
        for root, pieces in ((0, initial), (1, inner)):
            for piece in pieces:
                v = root
                for b in piece:
                    w = self.next[v].get(b)
                    if w is None:
                        w = len(self.next)
                        self.next[v][b] = w
                        self.next.append({})
                        final.append(False)
                    v = w
                final[v] = v != root
        self.fail, self.pops = [-1] * len(self.next), [0] * len(self.next)
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for b, v in self.next[u].items():
                queue.append(v)
                if final[v]:
                    self.fail[v], self.pops[v] = 1, 1
                    continue
                z, popped = self.fail[u], self.pops[u]
                while z != -1 and b not in self.next[z]:
                    popped += self.pops[z]
                    z = self.fail[z]
                if z != -1:
                    self.fail[v], self.pops[v] = self.next[z][b], popped

    def count(self, word: bytes) -> int:
        """Pieces of ``word``; 1, the unknown token, if the longest-match rule gets stuck. Nothing has none."""
        if not word:
            return 0
        step, fail, pops = self.next, self.fail, self.pops
        v, n = 0, 0
        for b in word:
            while b not in step[v]:
                n += pops[v]
                v = fail[v]
                if v == -1:
                    return 1
            v = step[v][b]
        while v != 1:
            n += pops[v]
            v = fail[v]
            if v == -1:
                return 1
        return n


class Counter(dict):
    """Remembers the counts of words."""

    def __init__(self, automaton: Automaton, prefix: bytes):
        super().__init__()
        self.automaton, self.prefix = automaton, prefix

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(self.prefix + word)
        if len(word) <= CACHE_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """The word pieces of a byte-level vocabulary file: those with the space mark begin a word, the others go on."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    back = {s: b for b, s in enumerate(byte_symbols())}
    pieces = {bytes(back[c] for c in s) for s in vocab}
    inner = {p for p in pieces if not p.startswith(b" ")}
    return Counter(Automaton(pieces - inner, inner), b" ")


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Words and greedy word-piece tokens of each whole text, one row for each row of ``docs``, without a shuffle.

    Needs doc_id and text. Returns doc_id, n_words, n_tokens and max_word_tokens (0 without words). A word is a longest
    run without ASCII white space; it is cut, with a space before it, into the longest matching piece each time. A null
    text counts as empty. Null or repeated doc_ids and rows are kept as they come; other columns are ignored.
    """
    prepare(docs.sparkSession)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = counter(vocabulary).__getitem__
        for batch in batches:
            words, tokens, most = [], [], []
            for value in batch.column(1):
                n = list(map(look, (value.as_buffer().to_pybytes() if value.is_valid else b"").split()))
                words.append(len(n))
                tokens.append(sum(n))
                most.append(max(n, default=0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, most))],
                names=["doc_id", "n_words", "n_tokens", "max_word_tokens"],
            )

    kind = "doc_id long, n_words long, n_tokens long, max_word_tokens long"
    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kind)
