"""Secret scans: fixed patterns, and a randomness test battery with length-aware false-discovery control."""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, numbered, pick, prepare, released, stored

#: Kinds in their order, and the base patterns. A run of AKIA's or hex's class that is too short holds no
#: long enough match, so their least lengths stand in the pattern; that of assign must be tested on the match.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
#: Candidates of the battery: runs of characters that encodings use, of at least this length.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WORDLIKE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
ENCODINGS = (
    (re.compile(r"[0-9a-f]+|[0-9A-F]+"), {c: i % 16 for i, c in enumerate("0123456789abcdef")} | {c: 10 + i for i, c in enumerate("ABCDEF")}, 16),
    (re.compile(r"[A-Z2-7]+=*"), {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")}, 32),
    (re.compile(r"[A-Za-z0-9]+"), {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")}, 62),
    (re.compile(r""), {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")} | {"-": 62, "_": 63}, 64),
)
#: Cells of the statistic, its width, and the largest value that the battery still takes for random.
CELLS, WIDTH, LARGEST = 512, 0.5, 16.8  # the 99 % point of chi-squared with 6 degrees of freedom
NEAR = int(LARGEST / WIDTH) + 1  # cells of what may be random
#: Lengths from here on count as one. What words look like before any is seen: letters by their frequency in English,
#: as so many words; a word's statistic spreads at least this much (of its logarithm); lengths up to this ratio are pooled.
LONGEST, PRIOR, LEAST_SPREAD, ALIKE = 128, 400, 0.35, 1.2
LETTERS = dict(zip("etaoinshrdlcumwfgypbvkjxqz", (127, 91, 82, 75, 70, 67, 63, 61, 60, 43, 40, 28, 28, 24, 24, 22, 20, 20, 19, 15, 10, 8, 1.5, 1.5, 1, 0.7), strict=True))


def _upper(z: float) -> float:
    """P(normal > z), never 0."""
    return max(0.5 * math.erfc(z / math.sqrt(2)), 1e-30)


def battery(token: str) -> float:
    """How far ``token`` is from random in its inferred encoding: Fisher's sum over three tests, about chi-squared(6).

    The encoding is the narrowest of hex, base32, alphanumeric and base64 that has all characters (padding apart). The
    tests: chi-squared uniformity over its alphabet (Wilson-Hilferty), runs above and below the alphabet's middle, and
    lag-1 serial correlation. Infinite for tokens without 8 coding characters.
    """
    code, size = next((c, a) for p, c, a in ENCODINGS if p.fullmatch(token) or a == 64)
    x = [code[c] for c in token if c in code]
    n = len(x)
    if n < 8:
        return math.inf
    counts: dict[int, int] = {}
    for v in x:
        counts[v] = counts.get(v, 0) + 1
    df = size - 1
    chi = sum(c * c for c in counts.values()) * size / n - n
    k = 2 / (9 * df)
    p_uniform = _upper(((chi / df) ** (1 / 3) - 1 + k) / math.sqrt(k)) if chi > 0 else 1.0
    high = [v >= size / 2 for v in x]
    a = sum(high)
    b = n - a
    if a and b:
        runs = 1 + sum(s != t for s, t in zip(high, high[1:], strict=False))
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * _upper(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    m = sum(x) / n
    spread = sum((v - m) ** 2 for v in x)
    p_serial = 1e-30
    if spread:
        r = sum((s - m) * (t - m) for s, t in zip(x, x[1:], strict=False)) / spread
        p_serial = 2 * _upper(abs(r + 1 / n) * math.sqrt(n))
    return -2 * sum(math.log(min(1.0, max(p, 1e-30))) for p in (p_uniform, p_runs, p_serial))


def length_bin(n: int) -> int:
    return min(n, LONGEST)


@cache
def word_moments(length: int) -> tuple[float, float]:
    """Mean and mean square of the logarithm of the statistic of ``PRIOR`` words of so many letters, always the same."""
    draw = random.Random(length)
    x = [math.log(battery("".join(draw.choices(list(LETTERS), list(LETTERS.values()), k=length)))) for _ in range(PRIOR)]
    return sum(x) / PRIOR, sum(v * v for v in x) / PRIOR


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) in code points, by start, then kind."""
    low = text.lower()
    found = []
    if any(h in low for h in ASSIGN_HINTS):
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, bool]]:
    """(start, end, length bin, cell of the statistic, decoy) of runs that touch no base span.

    Decoys are runs that are plainly words; they are never reported and tell how often ordinary text looks random.
    Cells from NEAR on are too far from random to be reported.
    """
    out, k, reach = [], 0, -1
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while k < len(base) and base[k][0] < e:
            reach = max(reach, base[k][2])
            k += 1
        if reach > s:
            continue
        t = battery(m[0])
        cell = int(t / WIDTH) if t <= LARGEST else max(NEAR, int(min(t / WIDTH, CELLS - 1)))
        out.append((s, e, length_bin(e - s), cell, bool(WORDLIKE.fullmatch(m[0]))))
    return out


def p_values(length: int, decoys: dict[tuple[int, int], int]) -> list[float]:
    """For each cell below NEAR how often a word of this length is at most that far from random.

    The statistic's logarithm is taken as normal, with moments from ``PRIOR`` fixed words and the decoys (by length and
    cell) of like lengths; where more decoys are that near, their share counts. So no number of decoys is needed.
    """
    alike = [(c, n) for (b, c), n in decoys.items() if length / ALIKE <= b <= length * ALIKE]
    total = sum(n for _, n in alike)
    mean, square = (PRIOR * x for x in word_moments(length))
    for c, n in alike:
        x = math.log((c + 0.5) * WIDTH)
        mean, square = mean + n * x, square + n * x * x
    mean, square = mean / (PRIOR + total), square / (PRIOR + total)
    spread = max(LEAST_SPREAD, math.sqrt(max(0.0, square - mean * mean)))
    seen = [sum(n for c, n in alike if c <= cell) / max(1, total) for cell in range(NEAR)]
    return [max(0.5 * math.erfc((mean - math.log((cell + 1) * WIDTH)) / spread / math.sqrt(2)), seen[cell]) for cell in range(NEAR)]


def thresholds(found: DataFrame, rate: float) -> dict[int, int]:
    """For each length the largest cell that Benjamini and Hochberg's procedure reports at false-discovery rate ``rate``.

    Each run that is no decoy is a test; its p-value is that of its length and cell. All runs of the corpus are counted;
    what comes to the driver is one row for each length and cell (some 110 lengths by 512 cells at most).
    """
    cells = found.select(F.explode("candidates").alias("c")).groupBy("c.bin", "c.cell").agg(F.sum(F.col("c.decoy").cast("long")).alias("decoys"), F.count(F.lit(1)).alias("n"))
    rows = cells.collect()
    decoys = {(r["bin"], r["cell"]): r["decoys"] for r in rows if r["decoys"]}
    others = {(r["bin"], r["cell"]): r["n"] - r["decoys"] for r in rows if r["n"] > r["decoys"]}
    tests = sum(others.values())
    ps = {b: p_values(b, decoys) for b in {b for b, c in others if c < NEAR}}
    upto, before = -1.0, 0
    for p, n in sorted((ps[b][c], n) for (b, c), n in others.items() if c < NEAR):
        before += n
        if p <= rate * before / tests:
            upto = p
    limit = {b: sum(p <= upto for p in ps[b]) - 1 for b in ps}
    return {b: c for b, c in limit.items() if c >= 0}


SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
CAND = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("bin", pa.int32()), ("cell", pa.int32()), ("decoy", pa.bool_())])
SCAN = "doc_id long, base array<struct<start:long,kind:int,end:long>>, candidates array<struct<start:long,end:long,bin:int,cell:int,decoy:boolean>>"


def scan(docs: DataFrame) -> DataFrame:
    """Base spans and candidates of each whole text, one row for each row of ``docs``, without a shuffle."""
    prepare(docs.sparkSession)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, cands = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                b = base_spans(text)
                bases.append([dict(zip(("start", "kind", "end"), x, strict=True)) for x in b])
                cands.append([dict(zip(("start", "end", "bin", "cell", "decoy"), x, strict=True)) for x in candidates(text, b)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, pa.list_(SPAN)), pa.array(cands, pa.list_(CAND))], names=["doc_id", "base", "candidates"])

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCAN)


def find_secrets(docs: DataFrame, *, rate: float = 0.05) -> DataFrame:
    """Secrets of each whole text, one row for each row of ``docs``.

    Needs doc_id and text. Returns doc_id, base and spans: arrays of (start, kind's place in KINDS, end) in code points,
    end exclusive, by start, then kind; spans holds base and what the battery adds at false-discovery rate ``rate``
    (over all runs of the table, so a doubtful run's verdict can hang on other rows; one clear run is enough). A
    null text counts as empty and has none. Null or repeated doc_ids and rows are kept as they come; other columns are
    ignored. The scan's small rows are stored once, so that texts are read once.
    """
    found = stored(scan(docs), "secrets")
    limit = thresholds(found, rate)
    if not limit:
        return found.select("doc_id", "base", F.col("base").alias("spans"))
    upto = F.create_map(*[F.lit(x) for kv in limit.items() for x in kv])
    added = F.transform(
        F.filter("candidates", lambda c: ~c["decoy"] & (c["cell"] <= F.coalesce(F.try_element_at(upto, c["bin"]), F.lit(-1)))),
        lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")),
    )
    return found.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def spans_text(spans: str) -> F.Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, *, rate: float = 0.05, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in text replaced by ``mark`` and n_chars, if there is one, set to the new length.

    Spans that overlap become one mark. Texts without secrets, null ones too, stay as they are, as do rows and columns;
    names of other columns may repeat or differ in case only.
    The texts are scanned twice (for the false-discovery threshold, then to replace), so that they need no shuffle.
    """
    found = stored(scan(docs).select("candidates"), "secrets")
    limit = thresholds(found, rate)
    forget(found)
    flat, names = numbered(docs)
    at = names.index("text")
    count = names.index("n_chars") if "n_chars" in names else None

    def clean(text: str) -> str:
        base = base_spans(text)
        spans = [(s, e) for s, _, e in base] + [(s, e) for s, e, b, cell, decoy in candidates(text, base) if not decoy and cell <= limit.get(b, -1)]
        out, last = [], 0
        for s, e in sorted(spans):
            if s >= last:
                out += [text[last:s], mark]
            last = max(last, e)
        return "".join([*out, text[last:]])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            texts = [t if t is None else clean(t) for t in (v.as_py() for v in columns[at])]
            if count is not None:
                old = columns[count]
                lengths = [n.as_py() if t is None else len(t) for n, t in zip(old, texts, strict=True)]
                columns[count] = pa.array(lengths, old.type)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return flat.mapInArrow(run, flat.schema).toDF(*names)


def digest(spans: str) -> F.Column:
    return F.sha2(spans_text(spans).cast("binary"), 256)
