"""Alignments against plain dynamic programs over all pairs, and the reports against loops."""

import random

import pytest
import test_library as library
from pyspark.sql import functions as F

from sonagrid import alignment_queries
from sonagrid.operators import alignment, intervals, performance

WORD = "rec int, seq int, speaker string, word string, kind string, st double, ed double"


def plain(ref, sys, gain):
    """The most gain of any order-keeping pairing, by the full table."""
    best = [[0.0] * (len(sys) + 1) for _ in range(len(ref) + 1)]
    for i in range(1, len(ref) + 1):
        for j in range(1, len(sys) + 1):
            g = gain.get((i - 1, j - 1))
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + g if g is not None else 0)
    return best[-1][-1]


@pytest.mark.parametrize("seed", range(30))
def test_heaviest_chain_is_the_plain_optimum(seed):
    rng = random.Random(seed)
    n, m = rng.randrange(1, 12), rng.randrange(1, 12)
    gain = {(i, j): rng.choice([1.0, 2.0, 2.0, 5.5, 0.25]) for i in range(n) for j in range(m) if rng.random() < 0.4} or {(0, 0): 1.0}
    p = sorted(gain)
    chain = alignment.heaviest_chain([x for x, _ in p], [x for _, x in p], [gain[x] for x in p])
    pairs = [p[i] for i, _ in chain]
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:], strict=False))
    assert chain[-1][1] == sum(gain[x] for x in pairs) == plain(range(n), range(m), gain)


def test_pieces_give_what_the_whole_gives(spark):
    rng = random.Random(3)
    rows = []
    for rec in range(25):
        for r in range(40):
            rows += [(rec, r, r + d, float(rng.choice([-1, 0, 1, 2, 3]))) for d in (-2, -1, 0, 1) if r + d >= 0 and rng.random() < 0.35]
    got = alignment.best_pairs(spark.createDataFrame(rows, "rec int, r long, s long, gain double"), ["rec"]).collect()
    assert len({(x["rec"], x["piece"]) for x in got}) > 100
    for rec in range(25):
        own = sorted((x for x in got if x["rec"] == rec), key=lambda x: x["r"])
        assert all(a["r"] < b["r"] and a["s"] < b["s"] for a, b in zip(own, own[1:], strict=False))
        assert sum(x["gain"] for x in own) == own[-1]["total"] == plain(range(40), range(42), {(r, s): g for k, r, s, g in rows if k == rec})


def word_rows(rng, rec, n, speakers=("a",)):
    return [(rec, i, rng.choice(speakers), rng.choice(["so", "we", "can-do", "uh", "-go", "mm-hmm"]), rng.choice(["lex", "lex", "fp", "frag", "non-lex"]), i * 0.25 + rng.choice([0, 0.0625]), i * 0.25 + 0.3) for i in range(n)]


def weight(word, kind):
    bare = word.strip("-")
    return 0 if kind in ("non-lex", "misc") else 1 if "-" not in bare or bare in ("mm-hmm", "uh-huh", "um-hmm") else 2


def lone(w):
    return -1000 * weight(*w[3:5]) if w[4] == "lex" else -200 * max(1, weight(*w[3:5]))


def pair(a, b):
    if not min(a[6], b[6]) - max(a[5], b[5]) + 0.1 > 0:
        return None
    (wa, ka), (wb, kb) = a[3:5], b[3:5]
    if (wa, ka) == (wb, kb) or (ka == "lex" and kb == "frag" and wb.strip("-") in wa) or (ka == "frag" and kb == "lex" and wa.strip("-") in wb) or (ka == kb and ka in ("fp", "frag")):
        return 0
    return -100 * max(1, weight(wa, ka)) if ka == kb != "lex" else -1000 * max(1, weight(wa, ka), weight(wb, kb))


def test_words_align_as_the_plain_program(spark):
    rng = random.Random(8)
    ref, sys = [[w for rec in range(6) for w in word_rows(rng, rec, 30)] for _ in range(2)]
    got = alignment.align_words(spark.createDataFrame(ref, WORD), spark.createDataFrame(sys, WORD), ["rec"]).collect()
    assert len([x for x in got if x["ref"]]) == len(ref) and len([x for x in got if x["sys"]]) == len(sys)
    middle = lambda w: (w[5] + w[6], w[1])
    for rec in range(6):
        a, b = (sorted((w for w in side if w[0] == rec), key=middle) for side in (ref, sys))
        gains = {(i, j): g - lone(x) - lone(y) for i, x in enumerate(a) for j, y in enumerate(b) if (g := pair(x, y)) is not None}
        assert sum(x["gain"] or 0 for x in got if x["rec"] == rec) == plain(a, b, gains)
    path = alignment.word_path(alignment.align_words(spark.createDataFrame(ref, WORD), spark.createDataFrame(sys, WORD), ["rec"])).collect()
    for x in path:
        score = pair(tuple(x["ref"])[:7], tuple(x["sys"])[:7]) if x["ref"] and x["sys"] else lone(tuple(x["ref"] or x["sys"]))
        assert x["del"] + x["ins"] + x["sub"] == int(score <= -500) and x["n_ref"] == (weight(*x["ref"][3:5]) if x["ref"] else 0)


def test_attributes_give_a_bonus(spark):
    kind = "struct<word:string,kind:string,su:string,ip:string,weight:int,bare:string>"
    sides = [(("a", "lex", "x", None), ("a", "lex", "x", None)), (("a", "lex", "x", "p"), ("b", "lex", "y", "q")), (("a", "fp", None, "p"), ("b", "fp", "y", None))]
    both = spark.createDataFrame([((*a, 1, a[0]), (*b, 1, b[0])) for a, b in sides], f"a {kind}, b {kind}")
    assert [r[0] for r in both.select(alignment.word_pair_score("a", "b", ["su", "ip"])).collect()] == [20, 20 - 1000, 0]


def test_empty_sides(spark):
    some, none = spark.createDataFrame(word_rows(random.Random(1), 1, 4), WORD), spark.createDataFrame([], WORD)
    assert [x["sys"] for x in alignment.align_words(some, none, ["rec"]).collect()] == [None] * 4
    assert [x["ref"] for x in alignment.align_words(none, some, ["rec"]).collect()] == [None] * 4
    assert alignment.align_words(none, none, ["rec"]).count() == 0 and alignment.spoken_by(some, none, ["rec"]).count() == 0


def test_best_speaker_wins(spark):
    ref = [(1, 0, "x", "yes", "lex", 0.0, 0.5), (1, 1, "x", "no", "lex", 1.0, 1.5), (1, 2, "x", "end", "lex", 9.0, 9.5), (1, 3, "y", "yep", "lex", 0.0, 0.5), (1, 4, "y", "end", "lex", 9.0, 9.5)]
    sys = [(1, 0, "", "yes", "lex", 0.0, 0.5), (1, 1, "", "no", "lex", 1.0, 1.5), (1, 2, "", "end", "lex", 9.0, 9.5)]
    got = {x["s"]: (x["speaker"], x["r"], x["speakers"]) for x in alignment.spoken_by(spark.createDataFrame(ref, WORD), spark.createDataFrame(sys, WORD), ["rec"]).collect()}
    # y's "yep" costs a substitution; at "end" x has paid no insertion of "no"
    assert got == {0: ("x", 0, 2), 1: ("x", 1, 1), 2: ("x", 2, 2)}


def test_spans_hold_ends_and_may_be_empty(spark):
    words = spark.createDataFrame([(1, float(m)) for m in (1, 2, 3, 5)], "rec int, mid double")
    events = spark.createDataFrame([(1, 1, 2.0, 3.0), (1, 2, 3.5, 4.5), (1, 3, 0.0, 0.5), (1, 4, 0.0, 9.0), (1, 5, 5.0, 5.0), (2, 6, 0.0, 1.0)], "rec int, n int, st double, ed double")
    got = {x["n"]: (x["w0"], x["w1"]) for x in alignment.word_spans(events, words, ["rec"]).collect()}
    assert got == {1: (1, 2), 2: (3, 2), 3: (0, -1), 4: (0, 3), 5: (3, 3), 6: (0, -1)}


def test_no_task_holds_more_words_for_a_larger_table(spark, monkeypatch):
    """Words stand in as many partitions as their text asks for, however well they compress, and tags are as in one."""
    text = spark.read.parquet(f"{library.SF}/conversations.parquet").select("conv_id", F.length("text").alias("n"))
    total, longest = text.agg(F.sum("n")).first()[0], text.groupBy("conv_id").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
    want = sorted(map(repr, alignment_queries.words_tagged(spark, library.SF).collect()))
    monkeypatch.setattr(alignment_queries, "TEXT_A_TASK", 2000)
    words = alignment_queries.reference_words(spark, library.SF)
    held = [r["n"] for r in words.groupBy(F.spark_partition_id()).agg(F.sum(F.length("word") + 1).alias("n")).collect()]
    assert len(held) > total / 2000 / 2 and max(held) < 4 * 2000 + 2 * longest
    assert sorted(map(repr, alignment_queries.words_tagged(spark, library.SF).collect())) == want


def test_nested_and_crossing_tags(spark):
    words = spark.createDataFrame([(1, i, i + 0.5) for i in range(6)], "rec int, idx long, mid double")
    events = [(1, 0, "EDIT", "outer", 0.0, 6.0), (1, 1, "EDIT", "inner", 3.0, 5.0), (1, 2, "EDIT", "crossing", 4.0, 7.0), (1, 3, "FILLER", "f", 1.0, 2.0), (1, 4, "SU", "s", 0.0, 2.9), (1, 5, "IP", "early", 0.2, 0.2), (1, 6, "CB", "none", 0.0, 6.0)]
    got = alignment.tagged_words(words, spark.createDataFrame(events, "rec int, seq int, type string, subtype string, st double, ed double"), ["rec"])
    assert [tuple(x)[3:] for x in got.orderBy("idx").select("rec", "idx", "mid", "edit", "filler", "ip", "su").collect()] == [
        ("outer", None, None, None), ("outer", "f", None, None), ("outer", None, None, "s"), ("inner", None, None, None), ("crossing", None, None, None), ("crossing", None, None, None),
    ]


def test_times_keep_their_distance_beyond_anchors(spark):
    anchors = spark.createDataFrame([(1, 0, 1.0, 2.0, 11.0, 12.0), (1, 1, 4.0, 5.0, 15.0, 17.0)], "rec int, seq int, st double, ed double, rst double, red double")
    times = spark.createDataFrame([(1, t) for t in (0.0, 1.0, 1.5, 2.0, 3.0, 5.0, 6.0)] + [(2, 7.0)], "rec int, t double")
    got = {(x["rec"], x["t"]): x["rt"] for x in alignment.in_reference_time(times, anchors, ["rec"]).collect()}
    assert got == {(1, 0.0): 10.0, (1, 1.0): 11.0, (1, 1.5): 11.5, (1, 2.0): 12.0, (1, 3.0): 13.5, (1, 5.0): 17.0, (1, 6.0): 18.0, (2, 7.0): 7.0}


def test_reports_at_every_level(spark):
    rows = [("SU", "f1", "1", "q", "q"), ("SU", "f1", "1", "q", "s"), ("SU", "f2", "1", "s", None), ("SU", "f2", "2", None, "q"), ("SU", None, "2", None, "q")]
    errors = performance.event_errors(spark.createDataFrame(rows, "type string, file string, channel string, ref_subtype string, sys_subtype string"), ["type", "file", "channel"])
    got = {x["category"]: tuple(x)[2:6] for x in performance.performance(errors).collect()}
    assert got == {
        "ALL": (3, 1, 2, 1), "f=f1": (2, 0, 0, 1), "f=f2": (1, 1, 1, 0), "f=unknown": (0, 0, 1, 0), "c=1": (3, 1, 0, 1), "c=2": (0, 0, 2, 0),
        "c=1 f=f1": (2, 0, 0, 1), "c=1 f=f2": (1, 1, 0, 0), "c=2 f=f2": (0, 0, 1, 0), "c=2 f=unknown": (0, 0, 1, 0),
    }
    rates = {x["category"]: x for x in performance.performance(errors).collect()}
    assert rates["ALL"]["d_plus_i"] == pytest.approx(100) and rates["c=2"]["ins"] == 999.99
    assert {tuple(x)[1:] for x in performance.confusion(errors).collect()} == {("q", "q", 1), ("q", "s", 1), ("s", "{Miss}", 1), ("{FA}", "q", 2)}
    deltas = spark.createDataFrame([(-9,), (-4,), (-3,), (0,), (0,), (4,), (None,)], "delta int")
    assert {tuple(x) for x in performance.offsets(deltas, []).collect()} == {("<-3", 2), ("-3", 1), ("0", 2), (">3", 1)}


def test_word_errors(spark):
    event = "rec int, type string, subtype string, w0 long, w1 long, mapped boolean"
    ref = [(1, "EDIT", "a", 0, 2, True), (1, "SU", "q", 0, 4, True), (1, "SU", "s", 5, 9, False)]
    sys = [(1, "EDIT", "b", 1, 3, True), (1, "SU", "q", 0, 4, True), (1, "SU", "q", 1, 3, False)]
    words = spark.createDataFrame([(1, i, i != 3) for i in range(7)], "rec int, idx long, scored boolean")
    got = performance.word_errors(spark.createDataFrame(ref, event), spark.createDataFrame(sys, event), words, ["rec"])
    # EDIT: word 0 missing, 1 and 2 with the other subtype, 3 inserted but not scored; SU: 4 right, 3 inserted, 6 (nearest to 9) missing
    assert sorted(tuple(x)[1:] for x in got.collect()) == [
        ("EDIT", 0, 1, 1, 0, 0), ("EDIT", 1, 1, 0, 0, 1), ("EDIT", 2, 1, 0, 0, 1), ("SU", 3, 0, 0, 1, 0), ("SU", 4, 1, 0, 0, 0), ("SU", 6, 1, 1, 0, 0),
    ]


def test_metadata_score(spark):
    kind = "type string, subtype string, st double, ed double, w1 long"
    rows = [("SU", "s", 0.0, 10.0, 9), ("SU", "s", 6.0, 9.0, 9)], [("EDIT", "a", 0.0, 1.0, 3), ("EDIT", "b", 3.0, 4.0, 9)], [("IP", "i", 1.0, 1.0, 3), ("IP", "i", 1.25, 1.25, 4)]
    df = spark.createDataFrame(rows, f"a struct<{kind.replace(' string', ':string').replace(' double', ':double').replace(' long', ':long')}>, b struct<{kind.replace(' string', ':string').replace(' double', ':double').replace(' long', ':long')}>")
    got = [r[0] for r in df.select(alignment.metadata_pair_score("a", "b", gap=0.5, su_extent=2.0)).collect()]
    assert got[0] == pytest.approx(1.5 * 1.1 * 1.001 * 2 / 2.5) and got[1] is None and got[2] == pytest.approx((0.25 + 1e-8) * 1.1 * 1e-8 / (1e-8 + 0.5), rel=1e-6)
    assert df.select(F.count("a")).collect()[0][0] == 3


def test_metadata_meets_near_events_only(spark, monkeypatch):
    """The pairs compared are a few for each event, however long conversations are."""
    seen, join = [], intervals.overlap_join
    monkeypatch.setattr(intervals, "overlap_join", lambda a, b, key, width, **kw: seen.append((a, b, key, width)) or join(a, b, key, width, **kw))
    alignment_queries.metadata_alignment_rows(spark, library.SF)
    ((a, b, key, width),) = seen
    x, y = (intervals.cells(t, width).groupBy(*key, "cell").agg(F.count(F.lit(1)).alias(n)) for t, n in ((a, "m"), (b, "n")))
    events, met = a.count(), x.join(y, [*key, "cell"]).agg(F.sum(F.col("m") * F.col("n"))).first()[0]
    assert events > 100 and met < 10 * events
