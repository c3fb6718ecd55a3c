"""Fill-in-middle, the filter audit and line dedup against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sonagrid.llm import filter_audit, fim, line_dedup

RNG = random.Random(11)
LONG = "  This line of license text is shared by very many of the documents \t"
TEXTS = [
    "a b  c\n", "", None, "   ", " x", "é ü  中 文 😀 x", "keep <P> plain", "tail \n", "one", "one", "x" * 300_000, "a b " * 100_000,
    *[" ".join(RNG.choice(["alpha", "Beta", "中文", "d\te", "\n\nf"]) for _ in range(RNG.randrange(1, 60))) for _ in range(60)],
]
WIDE = "doc_id long, text string, source string, TEXT string, form string, restored string, part string, mask int, n long, h1 long, block int, last long"


def wide(spark, rows):
    """Rows (doc_id, text, source) with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, s, "z", "f", "r", "p", 1, 2, 3, 4, 5) for i, t, s in rows], WIDE)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 7, t, ["a", "b", None, ""][i % 4]) for i, t in enumerate(TEXTS)]
    return wide(spark, [*rows, rows[3], rows[0], (None, "p q r s", "a"), (None, None, "a")])


def fim_row(i, text):
    text = text or ""
    h = [int(sha(f"42:{'' if i is None else i}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return (i, n, "plain", None, None, text)
    if h[3] % 100 < 80:
        return (i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fim_equals_brute_force(docs):
    got = sorted(map(tuple, fim.transform(docs).collect()), key=repr)
    want = sorted((fim_row(r["doc_id"], r[1]) for r in docs.collect()), key=repr)
    assert got == want
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    assert fim.transform(docs.where("false")).count() == 0


def test_fim_round_trip(docs):
    rows = fim.restore(fim.transform(docs, percent=100)).collect()
    assert sorted((r["doc_id"], r["restored"]) for r in rows if r["doc_id"] is not None) == sorted((r["doc_id"], r[1] or "") for r in docs.collect() if r["doc_id"] is not None)
    again = fim.restore(fim.transform(docs).withColumn("Restored", F.lit(1)))
    assert again.columns[-2:] == ["Restored", "restored"] and again.count() == docs.count()


def test_fim_units_join_to_the_text():
    for t in TEXTS:
        units = fim.units_of(pa.array([t or ""]).cast(pa.large_binary())).to_pylist()[0]
        assert b"".join(units).decode() == (t or "")
        assert [u.decode() for u in units if u] == re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t or "")


def test_fim_refuses_a_broken_output(spark):
    with pytest.raises(Exception, match="without three markers"):
        fim.restore(spark.createDataFrame([("psm", "<P>a<S>b")], "form string, output string")).collect()


def audit_brute(docs, labels):
    marks = defaultdict(lambda: [0, 0])
    for i, q, t in labels:
        if i is not None:
            marks[i] = [max(marks[i][0], int(q == 1)), max(marks[i][1], int(t == 1))]
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = []
    for i, t, part in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > least[t])
        fails.append((part or "", {k for k, b in zip("ABCDE", bad, strict=True) if b}, *marks[i]))
    out, shapley = [], Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {f[0] for f in fails}:
            for step, k in enumerate(order):
                c = Counter()
                for p, bad, good, toxic in fails:
                    if p != part:
                        continue
                    gone, now = bool(bad & set(order[:step])), k in bad
                    c["kept"] += not gone and not now
                    c["redundant"] += gone and now
                    c["unique"] += bad == {k}
                    if now and not gone:
                        c["removed"] += 1
                        c["good"] += good
                        c["toxic"] += toxic
                shapley[part, k] += c["removed"]
                out.append((part, order, step + 1, *(c[x] for x in ("kept", "removed", "redundant", "unique", "good", "toxic"))))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_equals_brute_force(spark):
    many = " ".join(f"w{i}" for i in range(250))
    kinds = [many, many + " #", "Xx " * 210, many.upper(), "A", "", None, many + "\x0b中", "short | text"]
    rows = [(i, RNG.choice(kinds), RNG.choice(["a", "b", None, ""])) for i in range(200)]
    rows += [rows[0], (*rows[0][:2], "c"), (None, many, "a"), (None, many, "b"), (None, None, None), (5000, many, "one copy only")]
    labels = [(i, RNG.choice([0, 1, None]), RNG.choice([0, 1])) for i in range(0, 200, 2)] + [(0, 1, 1), (None, 1, 1)]
    marks = spark.createDataFrame([(*x, 9, 9) for x in labels], "doc_id long, quality int, toxic int, good int, part int")
    got = filter_audit.audit(wide(spark, rows), marks)
    assert sorted(got.columns) == sorted(AUDIT)
    assert sorted(map(tuple, got.select(AUDIT).collect())) == audit_brute(rows, labels)
    assert filter_audit.audit(wide(spark, rows).where("false"), marks).count() == 0
    alone = filter_audit.audit(wide(spark, rows), marks.where("false"))
    assert alone.agg(F.sum("good_lost"), F.sum("toxic_lost")).collect()[0] == (0, 0)


def lines_brute(docs, least=40, documents=5):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))
    held = defaultdict(set)
    for number, (i, t, _) in enumerate(docs):
        for line in (t or "").split("\n"):
            held[key(line)].add((number, i))
    frequent = {k for k, v in held.items() if len(k) >= least and len(v) >= documents}
    last = {k: max((i for _, i in held[k] if i is not None), default=None) for k in frequent}
    out = []
    for i, t, _ in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in frequent or last[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_lines_equal_brute_force(spark, monkeypatch):
    shared = [LONG, LONG.upper(), "é" * 40, "é" * 39, "É" * 40, "中" * 45, *[f"line number {i} that a few documents of the table share" for i in range(12)]]
    make = lambda: "\n".join(RNG.choice([RNG.choice(shared), "", f"only {RNG.random()} here and nowhere else in the whole table"]) for _ in range(RNG.randrange(1, 9)))
    rows = [(i, make(), "a") for i in range(150)] + [(i, LONG, "a") for i in range(1000, 1060)]
    rows += [rows[7], (None, LONG + "\n" + make(), "a"), (None, None, "a"), (2000, "", "a"), (2001, f"{LONG}\n" * 20_000, "a")]
    rows += [(None, "a line that nobody but documents without an id holds", "a")] * 6
    monkeypatch.setattr(line_dedup, "BLOCK_DOCS", 20)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 30)
    docs = wide(spark, rows)
    got = sorted(map(tuple, line_dedup.deduplicated(docs).collect()), key=repr)
    want = lines_brute(rows)
    assert got == want and any(x[2] for x in want)
    assert sorted(map(tuple, line_dedup.deduplicated(docs, least=1, documents=2).collect()), key=repr) == lines_brute(rows, 1, 2)
    assert line_dedup.deduplicated(docs.where("false")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000, 50_000])
def test_shard_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    h1, h2 = (rng.integers(-(2**63), 2**63 - 1, n, dtype=np.int64) for _ in range(2))
    h1[: n // 2] = h1[0] if n else 0  # digests that agree in one half are still told apart
    counts, lasts = rng.integers(1, 100, n), rng.integers(0, 10**12, n)
    shard = line_dedup.Shard.read(*line_dedup.Shard.build(h1, h2, counts, lasts).row())
    at = shard.find(h1, h2)
    assert sorted(at.tolist()) == list(range(n))
    assert (shard.counts[at] == counts).all() and (shard.lasts[at] == lasts).all()
    assert len(shard.bits) <= 8 * n + 64
    strangers = shard.find(rng.integers(-(2**63), 2**63 - 1, 5000, dtype=np.int64), rng.integers(-(2**63), 2**63 - 1, 5000, dtype=np.int64))
    assert (strangers < 0).all()
